"""Scores, redaction, pseudonyms and routes: everything row-local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut_text, scan_fold, text_blocks
from ..functions.hashing import sha256
from ..functions.patterns import (
    ALL_PATTERNS,
    CLASSIFICATION,
    INDIA_PATTERNS,
    INDIA_PII,
    PII,
    RISK_WEIGHTS,
    SCORE_CAP,
    SECRET,
    SENSITIVE_TERMS,
    SENSITIVITY_WEIGHTS,
    TOKEN_ALIASES,
    US_PATTERNS,
    Pattern,
    sensitivity_weight,
)
from .detect import dedupe_findings, either, order_findings, possible, quoted, scan, union_findings, with_probes

# The route threshold and the names that each surface uses.
AIRGAP_THRESHOLD = 7.0
ROUTES = {
    "gateway": ("airgap", "cloud_or_hybrid"),
    "proof": ("ollama/local-airgapped", "cloud_or_hybrid_allowed"),
    "simulate": ("local_airgap", "policy_default"),
}


def _sum(terms: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


# ---- scores ---------------------------------------------------------------


def weighted_counts(counts: Column, weights: Sequence[float]) -> Column:
    """Sum of count x weight, grouped by weight so that multiples stay exact."""
    by_weight: dict[float, list[int]] = {}
    for i, w in enumerate(weights):
        if w:
            by_weight.setdefault(w, []).append(i)
    terms = []
    for w, idx in by_weight.items():
        n = F.get(counts, F.lit(idx[0]))
        for i in idx[1:]:
            n = n + F.get(counts, F.lit(i))
        terms.append(n * F.lit(w))
    return _sum(terms)


def scanner_risk_counts(counts: Column | str, patterns: Sequence[Pattern] = ALL_PATTERNS) -> Column:
    counts = F.col(counts) if isinstance(counts, str) else counts
    return F.least(F.lit(SCORE_CAP), weighted_counts(counts, [RISK_WEIGHTS.get(p.type, 0.0) for p in patterns]))


def sensitivity_counts(counts: Column | str, patterns: Sequence[Pattern] = ALL_PATTERNS) -> Column:
    counts = F.col(counts) if isinstance(counts, str) else counts
    total = weighted_counts(counts, [sensitivity_weight(p.label, p.type) for p in patterns])
    return F.least(F.lit(SCORE_CAP), F.round(total, 2))


def scanner_risk(findings: Column | str) -> Column:
    """Risk of any findings column, those of a model included."""
    findings = F.col(findings) if isinstance(findings, str) else findings

    def n(type_: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["type"] == type_))

    return F.least(F.lit(SCORE_CAP), _sum([n(t) * F.lit(w) for t, w in RISK_WEIGHTS.items()]))


def sensitivity_score(findings: Column | str) -> Column:
    findings = F.col(findings) if isinstance(findings, str) else findings

    def weight(f: Column) -> Column:
        label, type_ = F.lower(F.coalesce(f["label"], F.lit(""))), F.upper(F.coalesce(f["type"], F.lit("")))
        term = F.lit(False)
        for t in SENSITIVE_TERMS:
            term = term | F.contains(label, F.lit(t))
        return (
            F.when(type_ == SECRET, SENSITIVITY_WEIGHTS[SECRET])
            .when(term, SENSITIVITY_WEIGHTS["term"])
            .when(type_.isin(INDIA_PII, PII), SENSITIVITY_WEIGHTS[PII])
            .when(type_ == CLASSIFICATION, SENSITIVITY_WEIGHTS[CLASSIFICATION])
            .otherwise(0.0)
        )

    total = F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + weight(f))
    return F.least(F.lit(SCORE_CAP), F.round(total, 2))


def request_risk(scanner: Column, semantic: Column, injection: Column, guardian: Column | None = None) -> Column:
    total = F.greatest(scanner, semantic) + injection
    return F.least(F.lit(SCORE_CAP), total if guardian is None else F.greatest(total, guardian))


def proof_score(*scores: Column) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


# ---- routes and names -----------------------------------------------------


def route(score: Column | str, mode: str = "gateway") -> Column:
    """The proof surface switches at the threshold itself, the others above it."""
    score = F.col(score) if isinstance(score, str) else score
    local, other = ROUTES[mode]
    cond = score >= AIRGAP_THRESHOLD if mode == "proof" else score > AIRGAP_THRESHOLD
    return F.when(cond, local).otherwise(other)


def govern_policy_name(n_findings: Column, score: Column, department: Column) -> Column:
    scope = F.when(F.coalesce(department, F.lit("")) == "", "GLOBAL").otherwise(department)
    name = F.when(score > AIRGAP_THRESHOLD, F.concat(scope, F.lit(":FORCE_AIRGAP_HIGH_SENSITIVITY"))).otherwise(
        F.concat(scope, F.lit(":PSEUDONYMIZE_BEFORE_LLM"))
    )
    return F.when(n_findings > 0, name)


def model_route(
    df: DataFrame,
    preferred: str = "preferred_model",
    score: str = "sensitivity_score",
    default_model: str = "llama3.1",
    local_model: str = "llama3.1",
    available: Sequence[str] | None = None,
    hybrid: bool = True,
) -> DataFrame:
    """Where a governed prompt would go. Calling a model is not part of this."""
    forced = F.coalesce(F.col(score) > AIRGAP_THRESHOLD, F.lit(False))
    wanted = F.when(F.coalesce(F.col(preferred), F.lit("")) == "", F.lit(default_model)).otherwise(F.col(preferred))
    target = F.when(forced, F.lit(local_model)).otherwise(wanted)
    provider = F.when(F.contains(target, F.lit("/")), F.lower(F.split_part(target, F.lit("/"), F.lit(1)))).otherwise("ollama")
    known = F.lit(True) if available is None else provider.isin(*available)
    fallback = ~known & F.lit(hybrid and (available is None or "ollama" in available))
    return df.withColumns(
        {
            "airgap_forced": forced,
            "target_model": target,
            "provider": provider,
            "fallback_used": fallback,
            "model_used": F.when(known, target).when(fallback, F.lit(local_model)).otherwise("none"),
        }
    )


def response_flags(inbound: Column, outbound: Column, n_pseudonyms: Column) -> list[Column]:
    return [
        F.when(inbound | outbound, "SENSITIVE_DATA_REDACTED").otherwise("CLEAN").alias("findings_alert"),
        (n_pseudonyms + F.when(outbound, 1).otherwise(0)).alias("redactions_applied"),
    ]


# ---- redaction ------------------------------------------------------------


def redaction_token(f: Column) -> Column:
    entity = F.trim(F.coalesce(f["entity"], F.lit("")))
    label = F.upper(F.coalesce(f["label"], F.lit("DATA")))
    last4 = F.regexp_extract(entity, r"(?U)(\d{3}-\d{2}-(\d{4}))", 2)
    ssn = F.contains(label, F.lit("SSN")) | (last4 != "")
    name = F.regexp_replace(F.regexp_replace(label, "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(
        ssn, F.concat(F.lit("[REDACTED_SSN_XXX-XX-"), F.when(last4 == "", "0000").otherwise(last4), F.lit("]"))
    ).otherwise(F.concat(F.lit("[REDACTED_"), F.when(name == "", "DATA").otherwise(name), F.lit("]")))


def _greedy(spans: Column, length: Column, item: str) -> Column:
    """Right-to-left choice of spans that do not overlap a span already taken.

    ``spans`` holds structs with start, end, ord and token; the result is in
    right-to-left order. ``length`` is that of the text, as a column of its own:
    it is compared with every span.
    """
    valid = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= length) & (s["start"] < s["end"]))
    right_first = F.array_sort(
        F.transform(valid, lambda s: F.struct((-s["start"]).alias("k"), s["ord"].alias("ord"), s.alias("s")))
    )
    return scan_fold(
        right_first,
        length,
        lambda edge, x: (
            F.when(x["s"]["end"] <= edge, x["s"]["start"]).otherwise(edge),
            x["s"]["end"] <= edge,
            x["s"],
        ),
        item,
    )


def _replace(text: Column, blocks: Column, chosen: Column) -> Column:
    """Rebuild the text from the gaps between chosen spans (left to right) and their tokens."""
    pieces = F.transform(
        chosen,
        lambda s, i: F.concat(
            cut_text(text, blocks, F.coalesce(F.get(chosen, i - 1)["end"], F.lit(0)), s["start"]), s["token"]
        ),
    )
    tail = cut_text(text, blocks, F.coalesce(F.get(chosen, F.size(chosen) - 1)["end"], F.lit(0)), F.length(text))
    return F.when(F.size(chosen) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))


_TAGS = tuple(p.redaction_tag for p in INDIA_PATTERNS)
_SPAN = "struct<start:int,end:int,ord:int,token:string>"


def redact_spans(df: DataFrame, text: str = "text", findings: str = "findings", out: str = "redacted") -> DataFrame:
    """Replace findings by ``[REDACTED_...]`` tokens."""
    t = F.col(text)
    spans = F.transform(
        findings,
        lambda f: F.struct(
            f["start"].alias("start"), f["end"].alias("end"), f["ord"].alias("ord"), redaction_token(f).alias("token")
        ),
    )
    staged = df.withColumn("__n", F.length(t))
    staged = staged.withColumns({"__c": F.reverse(_greedy(spans, F.col("__n"), _SPAN)), "__b": text_blocks(t)})
    return staged.withColumn(out, _replace(t, F.col("__b"), F.col("__c"))).drop("__c", "__b", "__n")


def redact_india(df: DataFrame, text: str = "text", out: str = "redacted", patterns: Sequence[Pattern] = INDIA_PATTERNS) -> DataFrame:
    """One substitution after the other, each on the text the previous one left.

    A probe that fails on the original text can only pass later because of a
    tag put in by an earlier step; tags hold no digit, ``@`` or keyword, so the
    probes of the original text decide, except for the capital letters of the
    few probes that tags could contain.
    """
    staged, col = with_probes(df, text), text
    kept = list(staged.columns)
    for i, p in enumerate(patterns):
        # Tags are plain letters: what is plain stays so.
        replaced = f"regexp_replace({col}, {either(p.java_plain, p.java)}, {quoted(p.redaction_tag)})"
        tag_could_pass = p.probes and not p.folded and any(x in tag for x in p.probes for tag in _TAGS)
        cond = None if tag_could_pass else possible(p, text)
        step = replaced if cond is None else f"CASE WHEN {cond} THEN {replaced} ELSE {col} END"
        staged, col = staged.selectExpr(*kept, f"{step} AS __t{i}"), f"__t{i}"
    return staged.selectExpr(*df.columns, f"{col} AS {out}")


def outbound_scan(df: DataFrame, text: str = "text", out: str = "safe_text") -> DataFrame:
    """Redact an answer with both tables and tell whether anything was found."""
    both = scan(df, text, ALL_PATTERNS, "__all")
    us = both.withColumn("__us", F.filter("__all", lambda f: f["type"].isin(SECRET, CLASSIFICATION)))
    masked = redact_india(redact_spans(us, text, "__us", "__safe"), "__safe", out)
    return masked.withColumn("response_redacted", F.size("__all") > 0).drop("__all", "__us", "__safe")


# ---- pseudonyms -----------------------------------------------------------


def token_label(label: Column) -> Column:
    """Short family name of a label as it appears in a pseudonym."""
    name = F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    name = F.when(name == "", "Data").otherwise(name)
    camel = F.array_join(
        F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), ""
    )
    for raw, alias in TOKEN_ALIASES.items():
        camel = F.when(label == raw, alias).otherwise(camel)
    stripped = F.substring(camel, F.lit(4), F.length(camel))
    return F.when(F.startswith(F.upper(camel), F.lit("PII")), F.when(stripped == "", "PII").otherwise(stripped)).otherwise(camel)


_PSEUDO = "struct<start:int,end:int,ord:int,token:string,label:string,type:string,entity:string>"


def _with_tokens(df: DataFrame, findings: str, patterns: Sequence[Pattern] | None) -> DataFrame:
    """Stage ``__p``: findings with their pseudonym token.

    Numbers count the findings of one family from left to right, those that a
    later overlap removes included.
    """
    ordered = F.array_sort(
        F.transform(findings, lambda f: F.struct(f["start"].alias("k"), f["ord"].alias("ord"), f.alias("f")))
    )
    if patterns is None:
        family = lambda label: token_label(label)
    else:
        # The families of known labels are constants; only unknown labels are worked out per row.
        spark_map = F.create_map(*[F.lit(x) for p in patterns for x in (p.label, _token_label_py(p.label))])
        family = lambda label: F.coalesce(F.element_at(spark_map, label), token_label(label))
    staged = df.withColumn(
        "__o", F.transform(ordered, lambda k: F.struct(family(k["f"]["label"]).alias("fam"), k["f"].alias("f")))
    )
    fams = F.array_distinct(F.transform("__o", lambda k: k["fam"]))
    tokens = F.flatten(
        F.transform(
            fams,
            lambda fam: F.transform(
                F.filter("__o", lambda k: k["fam"] == fam),
                lambda k, i: F.struct(
                    k["f"]["start"].alias("start"),
                    k["f"]["end"].alias("end"),
                    k["f"]["ord"].alias("ord"),
                    F.concat(F.lit("["), fam, F.lit("_"), (i + 1).cast("string"), F.lit("]")).alias("token"),
                    k["f"]["label"].alias("label"),
                    k["f"]["type"].alias("type"),
                    k["f"]["entity"].alias("entity"),
                ),
            ),
        )
    )
    return staged.withColumn("__p", tokens).drop("__o")


def _token_label_py(label: str) -> str:
    """The family of a known label, worked out once on the driver."""
    if label in TOKEN_ALIASES:
        name = TOKEN_ALIASES[label]
    else:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in label).split()
        name = "".join(w[:1].upper() + w[1:] for w in words) or "Data"
    if name.upper().startswith("PII"):
        name = name[3:] or "PII"
    return name


def pseudonymize(
    df: DataFrame,
    text: str = "text",
    findings: str = "findings",
    out: str = "protected_text",
    tokens: str = "pseudonyms",
    vault: str | None = "pseudonym_vault",
    patterns: Sequence[Pattern] | None = ALL_PATTERNS,
) -> DataFrame:
    """Replace findings by numbered tokens; the vault keeps hashes, never values."""
    t = F.col(text)
    staged = _with_tokens(df, findings, patterns)
    staged = staged.withColumn("__n", F.length(t))
    staged = staged.withColumns({"__c": F.reverse(_greedy(F.col("__p"), F.col("__n"), _PSEUDO)), "__b": text_blocks(t)}).drop("__p", "__n")
    cols = {
        out: _replace(t, F.col("__b"), F.col("__c")),
        tokens: F.transform("__c", lambda s: s["token"]),
    }
    if vault:
        cols[vault] = F.map_from_entries(
            F.transform(
                "__c",
                lambda s: F.struct(
                    s["token"],
                    F.struct(s["label"].alias("label"), s["type"].alias("type"), sha256(s["entity"]).alias("sha256")),
                ),
            )
        )
    return staged.withColumns(cols).drop("__c", "__b")


# ---- compositions ---------------------------------------------------------


def govern(
    df: DataFrame,
    text: str = "text",
    department: str = "department",
    entities: str | None = None,
    snippets: bool = False,
) -> DataFrame:
    """Findings, score, protected text, tokens, vault, route and policy name."""
    found = scan(df, text, ALL_PATTERNS, "__f", snippets)
    if entities:
        us = F.filter("__f", lambda f: f["type"] != INDIA_PII)
        india = F.filter("__f", lambda f: f["type"] == INDIA_PII)
        found = found.withColumn("findings", dedupe_findings(union_findings(us, entities, india)))
    else:
        found = found.withColumn("findings", order_findings("__f"))
    scored = found.drop("__f").withColumn("sensitivity_score", sensitivity_score("findings"))
    masked = pseudonymize(scored, text, "findings")
    score = F.col("sensitivity_score")
    return masked.withColumns(
        {
            "route": route(score),
            "policy_triggered": govern_policy_name(F.size("findings"), score, F.col(department)),
        }
    )


def finding_labels(findings: Column | str = "findings") -> Column:
    return F.array_sort(F.array_distinct(F.transform(findings, lambda f: F.coalesce(f["label"], F.lit("UNKNOWN")))))


def inspect_proxy(
    df: DataFrame, text: str = "text", department: str = "department", auto_redact: str | None = None
) -> DataFrame:
    """Envelope of the proxy surface: raw text next to protected text."""
    governed = govern(df, text, department)
    protected = F.col("protected_text")
    if auto_redact:
        protected = F.when(F.coalesce(F.col(auto_redact), F.lit(True)), protected).otherwise(F.col(text))
    return governed.withColumns(
        {"raw_text": F.col(text), "protected_text": protected, "finding_labels": finding_labels()}
    )


def audit_payload(df: DataFrame, actor: str = "actor", *keys: str) -> DataFrame:
    """The part of a governed row that may be logged."""
    return df.select(
        *keys,
        sha256(F.col(actor)).alias("actor_hash"),
        "policy_triggered",
        "sensitivity_score",
        "route",
        "pseudonyms",
        finding_labels().alias("finding_labels"),
    )


def dpdp_classify(counts: Column | str, patterns: Sequence[Pattern] = INDIA_PATTERNS, redacted: bool = False) -> Column:
    """Categories, sensitive labels (with repeats), count and consent flag, from counts."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    idx = [i for i, p in enumerate(patterns) if p.dpdp_category]
    cats = F.array_distinct(
        F.filter(
            F.array(*[F.when(F.get(counts, F.lit(i)) > 0, F.lit(patterns[i].dpdp_category)) for i in idx]),
            lambda c: c.isNotNull(),
        )
    )
    sensitive = F.flatten(
        F.array(
            *[
                F.array_repeat(F.lit(patterns[i].label), F.get(counts, F.lit(i)))
                for i in idx
                if patterns[i].dpdp_category == "SENSITIVE"
            ]
        )
    )
    n = F.lit(0)
    for i in idx:
        n = n + F.get(counts, F.lit(i))
    return F.struct(
        cats.alias("dpdp_categories"),
        sensitive.alias("sensitive_items_found"),
        n.alias("finding_count"),
        (F.size(sensitive) > 0).alias("requires_consent"),
        F.lit(redacted).alias("dpdp_compliant_redacted"),
    )


# The field lists of the two preset modes.
MASK_PRESETS = {
    "clinic": ("ssn", "dob", "patient_id", "medical_record_number", "phi", "claim_number"),
    "rcm": ("ssn", "dob", "patient_id", "medical_record_number", "phi", "claim_number", "billing_code", "insurance_id"),
}


def mask_columns(df: DataFrame, fields: Sequence[str], token: str = "[REDACTED]") -> DataFrame:
    """Replace the named columns, where present, by a constant."""
    wanted = {f.lower() for f in fields}
    return df.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.lit(token)) for c in df.columns if c.lower() in wanted}
    )
