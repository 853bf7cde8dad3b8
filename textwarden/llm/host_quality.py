"""Quality rules per document, with verdicts learned per host. DataFrame functions only.

Each document is measured natively inside its row. Failures of the rules are
then aggregated by host (the ``source`` column), failure rates are shrunk with
a beta prior fitted to all hosts, and a host that mostly fails a rule is
marked for it. A document is dropped if it fails the base rule, or fails a
rule for which its host is marked; so a clean document of a bad host stays.

Defined results: text null or "" has no words and fails the base rule; source
null or "" is one host; repeated rows count as often as they come; an empty
table gives no rows; other columns are ignored by ``judge``, kept by
``keep_good``, where a row without doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Blanks, tabs and line ends; symbols that prose seldom has.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A host is marked for a rule if its shrunk failure rate is above this.
HOST_LIMIT = 0.5
RULES = ("symbols", "lines", "repeats", "length")


def covered_by_repeats(trigrams: Column) -> Column:
    """Words inside windows of three whose hash occurs at least twice; ``trigrams`` are the hashes in order."""
    ordered = F.array_sort(F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda e, j: (e["h"] == F.get(s, j)["h"])
        twice = F.filter(s, lambda e, j: F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def steps(p: Column) -> Column:
        gaps = F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    # One-element transforms bind an array so that it is computed once.
    found = F.get(F.transform(F.array(ordered), lambda s: F.get(F.transform(F.array(places(s)), steps), 0)), 0)
    return F.when(F.size(F.array_distinct(trigrams)) == F.size(trigrams), F.lit(0)).otherwise(found)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, host and the counts of every row, and the columns to keep."""
    slim = docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    trimmed = F.btrim("text", F.lit(BLANKS))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    split = slim.select(
        *keep,
        "doc_id",
        "host",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("words"),
    )
    w = F.col("words")
    hashed = split.select(
        *keep,
        "doc_id",
        "host",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        .alias("trigrams"),
    )
    return hashed.select(
        *keep, "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        covered_by_repeats(F.col("trigrams")).cast("long").alias("n_repeat_words"),
    )


def with_failures(rows: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and a flag per rule."""
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "f_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
            "f_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
            "f_repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
            "f_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
        }
    )


def marked_hosts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host and a flag b_<rule> per rule, for hosts marked for at least one rule.

    The prior of a rule has the mean of all documents and the spread of the
    hosts' rates (method of moments); its strength is kept between 1 and 1e6.
    """
    hosts = stored(
        rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"f_{r}").cast("long")).alias(f"k_{r}") for r in RULES])
    )
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for r in RULES:
        rate = F.col(f"k_{r}") / F.col("n")
        aggs += [F.sum(f"k_{r}").alias(f"k_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    prior = hosts.agg(*aggs).first()
    flags = []
    for r in RULES:
        mean = (prior[f"k_{r}"] or 0) / max(prior["n"], 1)
        spread = prior[f"v_{r}"] or 0.0
        strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
        flags.append(((F.col(f"k_{r}") + mean * strength) / (F.col("n") + strength) > limit).alias(f"b_{r}"))
    return hosts.select(F.col("host").alias("marked"), *flags).where(" OR ".join(f"b_{r}" for r in RULES))


def _judged(docs: DataFrame, *keep: str) -> DataFrame:
    rows = stored(with_failures(measured(docs, *keep)))
    hosts = marked_hosts(rows)
    hit = F.lit(False)
    for r in RULES:
        hit = hit | (F.col(f"f_{r}") & F.coalesce(f"b_{r}", F.lit(False)))
    return rows.join(hosts, F.col("host") == F.col("marked"), "left").withColumn("kept", ~F.col("base_failed") & ~hit)


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every row, whether it fails the base rule, and whether it is kept."""
    return _judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; each has its flags beside it and meets the few marked hosts, so no text is shuffled."""
    whole = docs.withColumn("__doc", F.struct(*docs.columns))
    return _judged(whole, "__doc").where("kept").select("__doc.*")


_FLAGS = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
u AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM t),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM u WHERE k > 1) GROUP BY 1),
m AS (SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"({c}) AS f_{r}" for r, c in _FLAGS.items())} FROM m),
h AS (SELECT host, count(*) AS n, {", ".join(f"sum(f_{r}::INT) AS k_{r}" for r in _FLAGS)} FROM f GROUP BY 1),
p AS (SELECT {", ".join(f"sum(k_{r}) / sum(n) AS m_{r}, var_pop(k_{r} / n) AS v_{r}" for r in _FLAGS)} FROM h),
s AS (SELECT *, {", ".join(f"CASE WHEN v_{r} > 0 THEN least(1e6, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1e6 END AS s_{r}" for r in _FLAGS)} FROM p),
b AS (SELECT host AS marked, {", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) > {HOST_LIMIT} AS b_{r}" for r in _FLAGS)} FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"(f_{r} AND b_{r})" for r in _FLAGS)}) AS kept
FROM f JOIN b ON host = marked
"""
