"""Department rules: which apply, which match, and what follows.

A few hundred rules are configuration: they are compiled into one expression
per department, so that matching adds no join and no shuffle. ``match_table``
is the form for rule sets that outgrow an expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.patterns import JAVA_FLAGS, word_classes
from ..functions.presets import DEFAULT_ENFORCEMENT, DEFAULT_NAME, DEFAULT_THRESHOLD, ENFORCEMENTS, bundled_rules
from ..schemas import RULE
from .detect import folded, quoted
from .keywords import match_keywords

COMPILE_LIMIT = 500  # rules per expression
BROADCAST_RULES = 20_000  # rows up to which a rule table is broadcast
AUTOMATON_CHARS = 4 << 20  # characters of keywords up to which they form one automaton
SALT = 64
_EVERYWHERE = "*"  # key of the global rules
_META = "struct<rule_ord:int,name:string,description:string,enforcement:string,allowed_models:array<string>>"


def rules_frame(spark: SparkSession, rules: Sequence[dict] | None = None) -> DataFrame:
    rows = bundled_rules() if rules is None else rules
    return spark.createDataFrame([tuple(r.get(f.name) for f in RULE.fields) for r in rows], RULE)


def normalize_rules(raw: DataFrame) -> DataFrame:
    """Check every raw rule row; bad values get defaults and an error entry."""
    threshold = F.col("risk_threshold").try_cast("double")
    in_range = threshold.between(0.0, 10.0)
    no_name = F.coalesce(F.col("name"), F.lit("")) == ""
    enforcement = F.coalesce(F.col("enforcement"), F.lit(DEFAULT_ENFORCEMENT))
    bad_enforcement = ~enforcement.isin(*ENFORCEMENTS)
    bad_threshold = F.col("risk_threshold").isNotNull() & ~F.coalesce(in_range, F.lit(False))
    errors = F.array_compact(
        F.array(
            F.when(no_name, "Missing 'name'"),
            F.when(bad_enforcement, F.concat(F.lit("Invalid enforcement '"), enforcement, F.lit("'"))),
            F.when(
                bad_threshold,
                F.concat(F.lit("risk_threshold must be 0-10, got '"), F.col("risk_threshold").cast("string"), F.lit("'")),
            ),
        )
    )
    return raw.withColumns(
        {
            "errors": errors,
            "name": F.when(no_name, DEFAULT_NAME).otherwise(F.col("name")),
            "enforcement": F.when(bad_enforcement, DEFAULT_ENFORCEMENT).otherwise(enforcement),
            "risk_threshold": F.when(F.coalesce(in_range, F.lit(False)), threshold).otherwise(DEFAULT_THRESHOLD),
        }
    )


def applicable_rules(prompts: DataFrame, rules: DataFrame, department: str = "department") -> DataFrame:
    """Global rules and those of the prompt's department, one row per pair."""
    p = prompts.withColumn("__d", F.explode(_dept_keys(department)))
    r = rules.withColumn("__d", F.coalesce(F.upper("dept"), F.lit(_EVERYWHERE)))
    return p.join(_maybe_broadcast(r), "__d").drop("__d")


def _dept_keys(department: str) -> Column:
    """Join keys of a prompt: its department, and the one that global rules are filed under."""
    return F.array_distinct(F.array(F.upper(F.coalesce(F.col(department), F.lit(""))), F.lit(_EVERYWHERE)))


def _maybe_broadcast(rules: DataFrame) -> DataFrame:
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    return F.broadcast(rules) if small else rules


def _keyword_sql(keyword: str, text: str) -> str:
    if keyword.isascii() and not re.search(r"[.^$*+?{}\[\]\\|()]", keyword):
        return f"contains(__pfold, {quoted(keyword.lower())})"
    return f"{text} RLIKE {quoted(JAVA_FLAGS + '(?i)' + word_classes(keyword))}"


def _condition(rule: dict, text: str, labels: str, risk: str) -> str:
    conds = []
    if rule["entity_types"]:
        names = ", ".join(quoted(e) for e in rule["entity_types"])
        conds.append(f"coalesce(arrays_overlap({labels}, array({names})), false)")
    conds += [_keyword_sql(k, text) for k in rule["keywords"]]
    if rule["risk_threshold"]:
        conds.append(f"{risk} >= {float(rule['risk_threshold'])}D")
    return " OR ".join(conds) or "false"


def match_rules(
    df: DataFrame,
    rules: Sequence[dict] | None = None,
    text: str = "text",
    labels: str = "labels",
    risk: str = "risk_score",
    department: str = "department",
    out: str = "matched",
) -> DataFrame:
    """Add the matched rules, in rule order, as an array of structs."""
    rules = bundled_rules() if rules is None else list(rules)
    if len(rules) > COMPILE_LIMIT:
        raise ValueError("use match_table for a rule set of this size")

    def hits(group: Sequence[dict]) -> str:
        conds = ", ".join(f"CASE WHEN {_condition(r, text, labels, risk)} THEN {r['rule_ord']} END" for r in group)
        return f"array({conds})" if group else "CAST(array() AS array<int>)"

    by_dept: dict[str, list[dict]] = {}
    for r in rules:
        if r["dept"]:
            by_dept.setdefault(r["dept"].upper(), []).append(r)
    cases = " ".join(f"WHEN {quoted(d)} THEN {hits(g)}" for d, g in by_dept.items())
    local = f"CASE upper(coalesce({department}, '')) {cases} ELSE CAST(array() AS array<int>) END" if cases else hits([])
    everywhere = hits([r for r in rules if not r["dept"]])
    staged = df.selectExpr("*", f"{folded(text)} AS __pfold")
    staged = staged.selectExpr("*", f"array_compact(concat({everywhere}, {local})) AS __ords").drop("__pfold")
    meta = F.map_from_arrays(
        F.array(*[F.lit(r["rule_ord"]) for r in rules]),
        F.array(*[F.expr(_meta_sql(r)) for r in rules]),
    )
    return staged.withColumn(out, F.transform("__ords", lambda o: F.element_at(meta, o)).cast(f"array<{_META}>")).drop("__ords")


def _meta_sql(r: dict) -> str:
    models = ", ".join(quoted(m) for m in r["allowed_models"])
    return (
        f"named_struct('rule_ord', {r['rule_ord']}, 'name', {quoted(r['name'])}, "
        f"'description', {quoted(r['description'])}, 'enforcement', {quoted(r['enforcement'])}, "
        f"'allowed_models', CAST(array({models}) AS array<string>))"
    )


def match_table(
    df: DataFrame,
    rules: DataFrame,
    key: str,
    text: str = "text",
    labels: str = "labels",
    risk: str = "risk_score",
    department: str = "department",
    out: str = "matched",
) -> DataFrame:
    """The same matches from a rule table.

    A table of a checked size goes to every task as one automaton, which finds
    all its keywords in one pass over a text. A larger one is joined on the
    department, repeated per salt, so that a department with most of the
    prompts is spread over many tasks.
    """
    some = rules.select("dept", "entity_types", "keywords", "risk_threshold", "rule_ord", "name", "description", "enforcement", "allowed_models")
    held = some.limit(BROADCAST_RULES + 1).collect()
    if len(held) <= BROADCAST_RULES and sum(len(k or "") for r in held for k in r["keywords"] or ()) <= AUTOMATON_CHARS:
        return match_keywords(df, [r.asDict() for r in held], text, labels, risk, _dept_keys(department), out)
    salts = SALT
    p = df.select(
        key,
        F.col(text).alias("__t"),
        F.col(labels).alias("__l"),
        F.col(risk).alias("__r"),
        F.explode(_dept_keys(department)).alias("__d"),
        F.pmod(F.xxhash64(key), F.lit(salts)).alias("__s"),
    )
    r = rules.select(
        F.coalesce(F.upper("dept"), F.lit(_EVERYWHERE)).alias("__d"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("__s"),
        "entity_types",
        "keywords",
        "risk_threshold",
        F.struct("rule_ord", "name", "description", "enforcement", "allowed_models").cast(_META).alias("__rule"),
    )
    hit = (
        F.coalesce(F.arrays_overlap("__l", "entity_types"), F.lit(False))
        | F.exists("keywords", lambda k: F.rlike(F.col("__t"), F.concat(F.lit(JAVA_FLAGS + "(?i)"), F.replace(k, F.lit(r"\b"), F.lit(word_classes(r"\b"))))))
        | ((F.col("risk_threshold") != 0) & (F.col("__r") >= F.col("risk_threshold")))
    )
    pairs = p.join(r, ["__d", "__s"]).where(hit).groupBy(key).agg(F.array_sort(F.collect_list("__rule")).alias(out))
    return df.join(pairs, key, "left").withColumn(out, F.coalesce(out, F.array().cast(f"array<{_META}>")))


def decide(df: DataFrame, matched: str = "matched", model: str | None = "preferred_model", department: str = "department", out: str = "decision") -> DataFrame:
    """The decision that follows from the matched rules of a row."""
    m = F.col(matched)
    asked = F.lit(None).cast("string") if model is None else F.nullif(F.col(model), F.lit(""))
    blocks = F.filter(m, lambda r: r["enforcement"] == "block")
    first_block = F.get(blocks, 0)["rule_ord"]
    last_block = F.get(blocks, F.size(blocks) - 1)
    refused = lambda r: (F.size(r["allowed_models"]) > 0) & asked.isNotNull() & ~F.array_contains(r["allowed_models"], asked)
    # A rule that blocks, or redacts before any block, raises the action; every other one warns.
    raises = lambda r: (r["enforcement"] == "block") | (
        (r["enforcement"] == "redact") & (first_block.isNull() | (r["rule_ord"] < first_block))
    )
    warnings = F.flatten(
        F.transform(
            m,
            lambda r: F.array_compact(
                F.array(
                    F.when(
                        ~raises(r),
                        F.concat(F.lit("Policy '"), r["name"], F.lit("' warned: "), r["description"]),
                    ),
                    F.when(
                        refused(r),
                        F.concat(F.lit("Model '"), asked, F.lit("' not in allowlist for policy '"), r["name"], F.lit("'")),
                    ),
                )
            ),
        )
    )
    description = F.when(last_block["description"] == "", "High risk content").otherwise(last_block["description"])
    dept = F.col(department)
    return df.withColumn(
        out,
        F.struct(
            F.when(F.size(blocks) > 0, "block")
            .when(F.exists(m, lambda r: r["enforcement"] == "redact"), "redact")
            .otherwise("warn")
            .alias("action"),
            F.transform(m, lambda r: r["name"]).alias("triggered_rules"),
            F.concat(F.lit("Policy '"), last_block["name"], F.lit("' blocked: "), description).alias("block_reason"),
            warnings.alias("warnings"),
            (~F.exists(m, refused)).alias("model_allowed"),
            F.concat(F.when(F.coalesce(dept, F.lit("")) == "", "GLOBAL").otherwise(dept), F.lit("_policy")).alias(
                "policy_name"
            ),
        ),
    )


def policy_summary(rules: DataFrame) -> DataFrame:
    """Rules per department (NULL: global) and in total."""
    return rules.groupBy("dept").agg(F.count("*").alias("n_rules"))


def rule_hits(df: DataFrame, matched: str = "matched", *by: str) -> DataFrame:
    """How often each rule fires over a corpus."""
    return (
        explode_rows(df, by, matched, "r")
        .groupBy(*by, "r.rule_ord", "r.name", "r.enforcement")
        .agg(F.count("*").alias("n_hits"))
    )


def verify_manifests(df: DataFrame, manifest: str = "manifest", signature: str = "signature", canonical: Column | None = None) -> DataFrame:
    """Compare a stored signature with the digest of the canonical manifest."""
    expected = F.sha2(F.col(manifest) if canonical is None else canonical, 256)
    return df.withColumns({"expected_signature": expected, "valid": expected == F.col(signature)})


def policy_versions(df: DataFrame, name: str = "name", limit: int = 100) -> DataFrame:
    return df.orderBy(F.col(name).desc()).limit(limit)
