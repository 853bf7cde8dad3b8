"""Sensitive business context by similarity to concept sentences."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SCORE_CAP, SEMANTIC_DLP
from ..functions.tokens import _WORD, concept_udf, embed_texts, hash_embed_udf, words
from ..schemas import FINDINGS

# The concepts of each label and the numbers of the score.
CONCEPTS = {
    "Trade Secret": (
        "proprietary chemical formula catalyst synthesis compound ratio",
        "confidential manufacturing process yield optimization recipe",
        "source code signing key private implementation exploit mitigation",
    ),
    "M&A / Insider Information": (
        "secret merger acquisition target due diligence valuation term sheet",
        "unannounced earnings guidance revenue forecast board confidential",
        "material non public information investor disclosure blackout",
    ),
    "Strategic Customer Data": (
        "confidential customer list renewal pricing discount contract negotiation",
        "enterprise account churn risk private pipeline competitor displacement",
    ),
    "Security Architecture": (
        "zero day vulnerability internal network diagram firewall bypass",
        "production credentials admin token incident response containment plan",
    ),
    "Regulated Health Context": (
        "patient diagnosis treatment plan clinical trial adverse event",
        "genetic marker fertility treatment embryo donor medical history",
    ),
}
THRESHOLD, HIGH_FROM = 0.34, 0.55
BOOST_FACTOR, BOOST_CAP = 0.45, 0.3
SENSITIVITY_FACTOR = 4.0


def _concept_tokens(concept: str) -> list[str]:
    ws = re.findall(_WORD, concept.lower())
    return sorted(set(ws) | {f"{a}_{b}" for a, b in zip(ws, ws[1:])})


def semantic_scan(
    df: DataFrame,
    text: str = "text",
    out: str = "semantic_findings",
    threshold: float = THRESHOLD,
    concepts: dict[str, tuple[str, ...]] = CONCEPTS,
) -> DataFrame:
    """Findings per label, best first. No shuffle: texts never leave their row.

    Words are cut natively; one Arrow call per batch gives the cosines with all
    concepts and the token shares; the choice of the concept is native.
    """
    flat = [(label, c) for label, cs in concepts.items() for c in cs]
    both = concept_udf(embed_texts([c for _, c in flat]), [_concept_tokens(c) for _, c in flat])
    k = len(flat)
    staged = df.withColumn("__cos", both(F.coalesce(words(F.col(text)), F.array().cast("array<string>"))))
    items, i = [], 0
    for rank, (label, cs) in enumerate(concepts.items()):
        best, concept, boost = F.lit(0.0), F.lit(""), F.lit(0.0)
        for c in cs:
            cos = F.get("__cos", F.lit(i))
            better = cos > best
            concept = F.when(better, c).otherwise(concept)
            boost = F.when(better, F.least(F.lit(BOOST_CAP), F.get("__cos", F.lit(k + i)) * BOOST_FACTOR)).otherwise(boost)
            best = F.when(better, cos).otherwise(best)
            i += 1
        score = F.least(F.lit(1.0), F.round(best + boost, 3))
        items.append(F.struct((-score).alias("k"), F.lit(rank).alias("rank"), F.lit(label).alias("label"), concept.alias("concept")))
    ranked = F.array_sort(F.filter(F.array(*items), lambda s: -s["k"] >= threshold))
    found = F.transform(
        ranked,
        lambda s, i: F.struct(
            i.alias("ord"),
            F.lit(SEMANTIC_DLP).alias("type"),
            s["label"].alias("label"),
            F.when(-s["k"] >= HIGH_FROM, "HIGH").otherwise("MEDIUM").alias("confidence"),
            s["concept"].alias("entity"),
            F.lit(0).alias("start"),
            F.lit(0).alias("end"),
            s["concept"].alias("snippet"),
            (-s["k"]).alias("score"),
            F.lit(None).cast("string").alias("redaction_tag"),
            F.lit(None).cast("string").alias("dpdp_category"),
        ),
    )
    return staged.withColumn(out, found.cast(FINDINGS)).drop("__cos")


def semantic_sensitivity(findings: Column | str = "semantic_findings") -> Column:
    total = F.aggregate(
        findings, F.lit(0.0), lambda acc, f: acc + F.coalesce(f["score"], F.lit(0.0)) * SENSITIVITY_FACTOR
    )
    return F.least(F.lit(SCORE_CAP), F.round(total, 2))


def hash_embed(df: DataFrame, text: str = "text", out: str = "embedding", dims: int = 384) -> DataFrame:
    """Signed-hash unit vector of each text."""
    ws = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    return df.withColumn(out, hash_embed_udf(dims)(ws))


def embed_chunks(df: DataFrame, text: str = "chunk", out: str = "embedding", model=None, dims: int = 384) -> DataFrame:
    """Vector per chunk: the hash embedding, or any text-to-vector UDF given."""
    return df.withColumn(out, model(F.col(text))) if model is not None else hash_embed(df, text, out, dims)
