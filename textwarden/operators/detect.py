"""Pattern scanners: text in, span findings or label counts out.

Offsets are code points. They are derived from the lengths of the matches and
of the gaps between them, so one pattern costs one regex pass over a text
without hits and two over a text with hits, all inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut_text, explode_rows, prefix_sums, scan_fold, text_blocks
from ..functions.patterns import (
    ALL_PATTERNS,
    ASCII_RUN,
    CLASSIFICATION_PATTERNS,
    INDIA_PATTERNS,
    NOT_PLAIN,
    PII,
    REQUIRED_LABELS,
    RUN,
    SECRET_PATTERNS,
    US_PATTERNS,
    Pattern,
)
from ..schemas import FINDING, FINDINGS

# The four letters outside ASCII that case-insensitive matching equates with ASCII ones.
_FOLD_FROM, _FOLD_TO = "İıKſ", "iiks"
US_SNIPPET, INDIA_SNIPPET = 30, 20


def quoted(value: str) -> str:
    """A SQL string literal. Long expressions are built as SQL text, in one parse."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_literal(text: str, literals: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(x)})" for x in literals) + ")"


def any_word(fold: str, words: Sequence[str]) -> str:
    """SQL: one of the words may stand alone in a folded text; short ones are looked at with their neighbours."""
    short = [w for w in words if len(w) <= 3 and w.isalpha()]
    conds = [f"contains({fold}, {quoted(w)})" for w in words if w not in short]
    conds += [f"(contains({fold}, '{w}') AND {fold} RLIKE '{w}(?<![a-z0-9_]{w})(?![a-z0-9_])')" for w in short]
    return "(" + " OR ".join(conds) + ")"


def folded(text: str) -> str:
    """Lower-cased text in which case-insensitive literals can be looked up."""
    odd = any_literal(text, _FOLD_FROM)
    return f"CASE WHEN {odd} THEN lower(translate({text}, '{_FOLD_FROM}', '{_FOLD_TO}')) ELSE lower({text}) END"


def with_probes(df: DataFrame, text: str) -> DataFrame:
    """Stage the shared probe columns, so that they are computed once per row."""
    if "__fold" in df.columns:
        return df
    staged = df.selectExpr(
        "*",
        f"{folded(text)} AS __fold",
        f"{text} RLIKE {quoted('(?U)' + chr(92) + 'd')} AS __any",
        f"{text} RLIKE {quoted('(?U)' + chr(92) + 'd{4}')} AS __four",
        f"{plain_text(text)} AS __plain",
    )
    # The few places that patterns of digits can match; of a text that is not plain, the text itself.
    runs = f"CASE WHEN NOT __any THEN '' WHEN __plain THEN array_join(regexp_extract_all({text}, {quoted(RUN)}, 0), '|') ELSE {text} END"
    return staged.selectExpr("*", f"{runs} AS __runs")


def without_probes(df: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """Drop the probe columns, unless they were there before, ``but`` being the columns of then."""
    return df if "__fold" in but else df.drop("__fold", "__any", "__four", "__plain", "__runs")


def plain_text(text: str) -> str:
    """SQL: a text of plain letters, for which the cheaper form of a pattern will do.

    ASCII is always plain and its runs are taken out in one cheap pass, so that the costly class meets the few other characters.
    """
    return f"NOT regexp_replace({text}, {quoted(ASCII_RUN)}, '') RLIKE {quoted(NOT_PLAIN)}"


def either(plain: str, spelt: str, flag: str = "__plain") -> str:
    """SQL: the form of a pattern that suits the row."""
    return quoted(spelt) if plain == spelt else f"IF({flag}, {quoted(plain)}, {quoted(spelt)})"


def possible(p: Pattern, text: str) -> str | None:
    """SQL condition without which the pattern cannot match, if there is a cheap one."""
    conds = []
    if p.digits:
        conds.append("__any" if p.digits == "any" else "__four")
    if p.probes and p.folded and p.whole_words:
        conds.append(any_word("__fold", p.probes))
    elif p.probes:
        conds.append(any_literal("__fold" if p.folded else text, p.probes))
    if p.core:
        conds.append(f"__runs RLIKE {quoted(p.core)}")
    return " AND ".join(conds) or None


def _matches(p: Pattern, text: str) -> str:
    found = f"regexp_extract_all({text}, {either(p.java_plain, p.java)}, 0)"
    cond = possible(p, text)
    return found if cond is None else f"CASE WHEN {cond} THEN {found} ELSE array() END"


def count_matches(
    df: DataFrame, text: str = "text", patterns: Sequence[Pattern] = ALL_PATTERNS, out: str = "counts"
) -> DataFrame:
    """Number of hits per pattern (``array<int>`` in pattern order), no spans.

    Enough for every score and label statistic, and much narrower than findings.
    """
    sizes = ", ".join(f"coalesce(size({_matches(p, text)}), 0)" for p in patterns)
    return without_probes(with_probes(df, text).selectExpr("*", f"array({sizes}) AS {out}"), df.columns)


def scan(
    df: DataFrame,
    text: str = "text",
    patterns: Sequence[Pattern] = ALL_PATTERNS,
    out: str = "findings",
    snippets: bool = False,
) -> DataFrame:
    """All matches of all patterns, in pattern order and then by position."""
    t = F.col(text)
    found_sql = ", ".join(_matches(p, text) for p in patterns)
    staged = with_probes(df, text).selectExpr("*", f"array({found_sql}) AS __m")
    # Lengths of the gaps before each match; only worked out where there is a match.
    gaps_sql = ", ".join(
        f"CASE WHEN size(__m[{i}]) > 0 THEN transform(split({text}, {either(p.java_plain, p.java)}, -1), g -> length(g)) END"
        for i, p in enumerate(patterns)
    )
    meta_sql = ", ".join(
        "named_struct('type', {}, 'label', {}, 'confidence', {}, 'redaction_tag', {}, 'dpdp_category', {}, 'width', {})".format(
            *(
                "CAST(NULL AS STRING)" if v is None else quoted(v)
                for v in (p.type, p.label, p.confidence, p.redaction_tag, p.dpdp_category)
            ),
            US_SNIPPET if p.dpdp_category is None else INDIA_SNIPPET,
        )
        for p in patterns
    )
    # The arrays meet in zip_with, not by index: Catalyst would move an indexed
    # column's expression into the lambda and work it out again per element.
    hits = F.filter(
        F.zip_with(
            F.zip_with(F.expr(f"array({meta_sql})"), "__m", lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
            F.expr(f"array({gaps_sql})"),
            lambda h, g: F.struct(h["p"].alias("p"), h["m"].alias("m"), g.alias("g")),
        ),
        lambda h: F.size(h["m"]) > 0,
    )

    def spans(h: Column) -> Column:
        ends = prefix_sums(F.zip_with(F.slice(h["g"], 1, F.size(h["m"])), h["m"], lambda g, m: g + F.length(m)))
        return F.zip_with(
            h["m"],
            ends,
            lambda m, e: F.struct(
                h["p"].alias("p"), m.alias("entity"), (e - F.length(m)).alias("start"), e.alias("end")
            ),
        )

    staged = without_probes(staged.withColumn("__s", F.flatten(F.transform(hits, spans))).drop("__m"), df.columns)
    if snippets:
        staged = staged.withColumn("__b", text_blocks(t))

    def finding(f: Column, i: Column) -> Column:
        snippet = F.lit(None).cast("string")
        if snippets:
            width = f["p"]["width"]
            snippet = snippet_of(t, F.col("__b"), f["start"], f["end"], width)
        return F.struct(
            i.alias("ord"),
            f["p"]["type"].alias("type"),
            f["p"]["label"].alias("label"),
            f["p"]["confidence"].alias("confidence"),
            f["entity"].alias("entity"),
            f["start"].alias("start"),
            f["end"].alias("end"),
            snippet.alias("snippet"),
            F.lit(None).cast("double").alias("score"),
            f["p"]["redaction_tag"].alias("redaction_tag"),
            f["p"]["dpdp_category"].alias("dpdp_category"),
        )

    found = F.coalesce(F.transform("__s", finding), F.array().cast(FINDINGS))
    return staged.withColumn(out, found).drop("__s", "__b")


def snippet_of(text: Column, blocks: Column, start: Column, end: Column, width: Column | int) -> Column:
    """The text around a span, clipped at both ends of the text."""
    return cut_text(text, blocks, F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text)))


def snippet(df: DataFrame, width: int, text: str = "text", findings: str = "findings") -> DataFrame:
    """Fill in the ``snippet`` field of existing findings."""
    staged = df.withColumn("__b", text_blocks(F.col(text)))
    fill = F.transform(
        findings,
        lambda f: f.withField("snippet", snippet_of(F.col(text), F.col("__b"), f["start"], f["end"], width)),
    )
    return staged.withColumn(findings, fill).drop("__b")


def scan_secrets(df: DataFrame, text: str = "text", out: str = "findings", **kw) -> DataFrame:
    return scan(df, text, SECRET_PATTERNS, out, **kw)


def scan_classification(df: DataFrame, text: str = "text", out: str = "findings", **kw) -> DataFrame:
    return scan(df, text, CLASSIFICATION_PATTERNS, out, **kw)


def scan_us(df: DataFrame, text: str = "text", out: str = "findings", **kw) -> DataFrame:
    return scan(df, text, US_PATTERNS, out, **kw)


def scan_india_pii(df: DataFrame, text: str = "text", out: str = "findings", **kw) -> DataFrame:
    return scan(df, text, INDIA_PATTERNS, out, **kw)


def scan_entities(
    df: DataFrame,
    text: str = "text",
    model: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[tuple]]]] | None = None,
    out: str = "entities",
    min_score: float = 0.4,
) -> DataFrame:
    """Optional named-entity hook.

    ``model`` is a factory that each Python worker calls once; the result maps
    a batch of texts to lists of ``(entity_type, start, end, score)``. Without
    a model the column is an empty array, as in the default setting.
    """
    if model is None:
        return df.withColumn(out, F.array().cast(FINDINGS))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            rows = run([t or "" for t in texts])
            yield pd.Series(
                [[{"label": a, "start": int(b), "end": int(c), "score": float(s)} for a, b, c, s in r] for r in rows]
            )

    udf = F.pandas_udf(predict, "array<struct<label:string,start:int,end:int,score:double>>")
    t = F.col(text)
    staged = df.withColumn("__e", F.filter(udf(t), lambda s: s["score"] > min_score)).withColumn("__b", text_blocks(t))
    found = F.transform(
        "__e",
        lambda s, i: F.struct(
            i.alias("ord"),
            F.lit(PII).alias("type"),
            s["label"].alias("label"),
            F.format_string("%.1f%%", s["score"] * 100).alias("confidence"),
            cut_text(t, F.col("__b"), s["start"], s["end"]).alias("entity"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            snippet_of(t, F.col("__b"), s["start"], s["end"], US_SNIPPET).alias("snippet"),
            s["score"].alias("score"),
            F.lit(None).cast("string").alias("redaction_tag"),
            F.lit(None).cast("string").alias("dpdp_category"),
        ),
    )
    return staged.withColumn(out, found).drop("__e", "__b")


def renumber(findings: Column) -> Column:
    return F.transform(findings, lambda f, i: f.withField("ord", i))


def union_findings(*columns: str | Column) -> Column:
    """Concatenate findings columns, keeping their order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return renumber(F.concat(*[F.coalesce(c, F.array().cast(FINDINGS)) for c in cols]))


def dedupe_findings(findings: Column | str) -> Column:
    """Sort by (start, -end, ord) and keep the first of each (start, end, label)."""
    findings = F.col(findings) if isinstance(findings, str) else findings
    # Sorted by (start, -end, label, ord), repeats are neighbours.
    keyed = F.array_sort(
        F.transform(
            findings,
            lambda f: F.struct(
                f["start"].alias("a"), (-f["end"]).alias("b"), f["label"].alias("c"), f["ord"].alias("d"), f.alias("f")
            ),
        )
    )
    first = scan_fold(
        keyed,
        F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("string").alias("c")),
        lambda last, k: (
            F.struct(k["a"].alias("a"), k["b"].alias("b"), k["c"].alias("c")),
            ~(last["a"].eqNullSafe(k["a"]) & last["b"].eqNullSafe(k["b"]) & last["c"].eqNullSafe(k["c"])),
            k["f"],
        ),
        FINDING.simpleString(),
    )
    return order_findings(first)


def order_findings(findings: Column | str) -> Column:
    """Sort by (start, -end, ord): what deduplication comes to for pattern findings.

    One pattern never reports a span twice and labels are unique per pattern,
    so only findings of a model can repeat.
    """
    findings = F.col(findings) if isinstance(findings, str) else findings
    keyed = F.transform(
        findings,
        lambda f: F.struct(f["start"].alias("a"), (-f["end"]).alias("b"), f["ord"].alias("c"), f.alias("f")),
    )
    return renumber(F.transform(F.array_sort(keyed), lambda k: k["f"]))


def findings_long(df: DataFrame, *keys: str, findings: str = "findings", outer: bool = False) -> DataFrame:
    """One row per finding; only the keys travel along, not the text."""
    if outer:
        return df.select(*keys, F.explode_outer(findings).alias("f")).select(*keys, "f.*")
    return explode_rows(df, keys, findings, "f").select(*keys, "f.*")


def label_counts(counts: Column | str, patterns: Sequence[Pattern] = ALL_PATTERNS) -> Column:
    """``array<struct<type,label,n>>`` of the labels that occur."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    meta = F.array(*[F.struct(F.lit(p.type).alias("type"), F.lit(p.label).alias("label")) for p in patterns])
    return F.filter(
        F.zip_with(
            counts,
            meta,
            lambda n, p: F.struct(p["type"].alias("type"), p["label"].alias("label"), n.alias("n")),
        ),
        lambda x: x["n"] > 0,
    )


def redaction_label_stats(df: DataFrame, counts: str = "counts", patterns: Sequence[Pattern] = ALL_PATTERNS, *by: str) -> DataFrame:
    """Findings per label over a corpus: summed before the shuffle."""
    return (
        explode_rows(df, by, label_counts(counts, patterns), "x")
        .groupBy(*by, "x.type", "x.label")
        .agg(F.sum("x.n").alias("n_findings"))
    )


def pattern_coverage(df: DataFrame, counts: str = "counts", patterns: Sequence[Pattern] = ALL_PATTERNS, required: Sequence[str] = REQUIRED_LABELS) -> DataFrame:
    """Required labels that a corpus never triggers."""
    spark = df.sparkSession
    detected = explode_rows(df, (), label_counts(counts, patterns), "x").select("x.label").distinct()
    needed = spark.createDataFrame([(r,) for r in required], "label string")
    return needed.join(detected, "label", "left_anti")
