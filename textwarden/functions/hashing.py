"""Digests: all native, except JSON canonicalisation of foreign records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HMAC_BLOCK = 64


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def hash_text(col: Column) -> Column:
    """NULL for a missing or empty text."""
    return F.when(F.length(col) > 0, sha256(col))


def actor_hash(actor: Column, tenant: Column, salt: str, api_key: Column | None = None) -> Column:
    """Risk identity: a key overrides the actor, nothing at all is UNKNOWN."""
    ident = F.when(F.coalesce(actor, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(actor)
    if api_key is not None:
        ident = F.when(F.coalesce(api_key, F.lit("")) == "", ident).otherwise(api_key)
    return sha256(F.concat_ws(":", F.lit(salt), F.coalesce(tenant, F.lit("default")), ident))


def ledger_actor_hash(tenant: Column, user: Column, role: Column) -> Column:
    return sha256(F.concat_ws(":", tenant, user, role))


def hmac_pads(secret: Column) -> Column:
    """Inner and outer key block of a secret; worth computing once per secret."""
    key = F.when(F.octet_length(secret) > HMAC_BLOCK, F.upper(sha256(secret))).otherwise(F.hex(secret.cast("binary")))
    padded = F.rpad(key, 2 * HMAC_BLOCK, "0")

    def pad(mask: int) -> Column:
        byte = lambda i: F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.unhex(
            F.array_join(
                F.transform(
                    F.sequence(F.lit(0), F.lit(HMAC_BLOCK - 1)),
                    lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(mask)).cast("bigint")), 2, "0"),
                ),
                "",
            )
        )

    return F.struct(pad(0x36).alias("inner"), pad(0x5C).alias("outer"))


def hmac_sha256(body: Column, pads: Column) -> Column:
    """Hex HMAC-SHA256 from two native digests."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], body.cast("binary")), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)


def sign_payload(body: Column, secret: Column, pads: Column | None = None) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(body, hmac_pads(secret) if pads is None else pads))


def verify_signature(body: Column, signature: Column, secret: Column) -> Column:
    return F.coalesce(sign_payload(body, secret) == signature, F.lit(False))


def canonical_json(drop: tuple[str, ...] = (), parse: tuple[str, ...] = ()):
    """UDF: JSON text to sorted, ASCII-escaped JSON with Python's separators.

    ``to_json`` writes other separators and no escapes, so the form in which
    records are sealed comes from here. ``drop`` leaves out top-level keys,
    ``parse`` names keys that hold JSON as text.
    """

    def canonical(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            obj = json.loads(text)
            if isinstance(obj, dict):
                obj = {k: v for k, v in obj.items() if k not in drop}
                for k in parse:
                    if isinstance(obj.get(k), str):
                        obj[k] = json.loads(obj[k])
            return json.dumps(obj, sort_keys=True, ensure_ascii=True)

        return texts.map(one)

    return F.pandas_udf(canonical, "string")
