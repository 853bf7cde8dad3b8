"""Use of AI tools seen in DNS or proxy logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Watched domains with tool, vendor and risk.
AI_DOMAINS = (
    ("chat.openai.com", "ChatGPT", "OpenAI", "HIGH"),
    ("api.openai.com", "OpenAI API", "OpenAI", "HIGH"),
    ("chatgpt.com", "ChatGPT", "OpenAI", "HIGH"),
    ("gemini.google.com", "Gemini", "Google", "HIGH"),
    ("bard.google.com", "Bard", "Google", "HIGH"),
    ("generativelanguage.googleapis.com", "Gemini API", "Google", "HIGH"),
    ("claude.ai", "Claude", "Anthropic", "HIGH"),
    ("api.anthropic.com", "Claude API", "Anthropic", "HIGH"),
    ("copilot.microsoft.com", "Copilot", "Microsoft", "MEDIUM"),
    ("bing.com", "Bing Chat", "Microsoft", "MEDIUM"),
    ("copilot.github.com", "GitHub Copilot", "Microsoft", "MEDIUM"),
    ("poe.com", "Poe AI", "Quora", "MEDIUM"),
    ("character.ai", "Character.AI", "C.AI", "MEDIUM"),
    ("perplexity.ai", "Perplexity", "Perplexity", "MEDIUM"),
    ("you.com", "You.com AI", "You", "LOW"),
    ("pi.ai", "Pi", "Inflection", "LOW"),
    ("huggingface.co", "HuggingFace", "HF", "LOW"),
    ("replicate.com", "Replicate", "Replicate", "MEDIUM"),
    ("mistral.ai", "Mistral", "Mistral", "MEDIUM"),
    ("cohere.com", "Cohere", "Cohere", "MEDIUM"),
    ("writesonic.com", "Writesonic", "Writesonic", "LOW"),
    ("jasper.ai", "Jasper AI", "Jasper", "LOW"),
    ("grok.x.ai", "Grok", "xAI", "HIGH"),
)
WATCHLIST = "domain string, name string, vendor string, risk string"
BROADCAST_DOMAINS = 100_000
SALT = 32  # shares of a host when a large list is joined back


def watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AI_DOMAINS), WATCHLIST)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def parent_domains(host: Column) -> Column:
    """The host and its parents, longest first: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def detect_shadow_ai(log: DataFrame, watch: DataFrame, *keep: str, host: str = "host", suffix: bool = True, detected_by: str = "SYSTEM") -> DataFrame:
    """Log rows whose host, or a parent of it, is watched; the longest match counts.

    While the list is small it is broadcast, and joined on the exploded
    parents. Choosing the longest match needs no shuffle: a row's matches are
    picked by a join per parent only where the list itself nests. A large list
    is looked up in the order of reversed names (``longest_match``).
    """
    small = watch.limit(BROADCAST_DOMAINS + 1).count() <= BROADCAST_DOMAINS
    if suffix and not small:
        return detect_in_large_list(log, watch, *keep, host=host, detected_by=detected_by)
    w = watch.select(F.lower("domain").alias("domain"), "name", "vendor", "risk")
    if suffix:
        # A watched domain below another watched one: rows of the parent that the child also matches are dropped.
        nested = w.withColumn("__parents", parent_domains(F.col("domain"))).select(F.col("domain").alias("__child"), F.explode(F.expr("slice(__parents, 2, size(__parents))")).alias("domain"))
        children = nested.groupBy("domain").agg(F.collect_set("__child").alias("__children"))
        w = w.join(children, "domain", "left")
        rows = log.select(*keep, F.col(host).alias("__host"), F.explode(parent_domains(F.col(host))).alias("domain"))
    else:
        w = w.withColumn("__children", F.lit(None).cast("array<string>"))
        rows = log.select(*keep, F.col(host).alias("__host"), F.col(host).alias("domain"))
    hits = rows.join(F.broadcast(w) if small else w, "domain")
    closer = F.exists(
        F.coalesce("__children", F.array().cast("array<string>")),
        lambda c: (F.col("__host") == c) | F.endswith(F.col("__host"), F.concat(F.lit("."), c)),
    )
    return _detected(hits.where(~closer), keep, detected_by)


def _detected(hits: DataFrame, keep: Sequence[str], detected_by: str) -> DataFrame:
    return hits.select(
        *keep,
        "domain",
        F.col("name").alias("tool_name"),
        "vendor",
        F.coalesce("risk", F.lit("MEDIUM")).alias("risk"),
        F.lit(detected_by).alias("detected_by"),
        F.lit("ALERT").alias("action"),
    )


def reversed_name(host: Column) -> Column:
    """Labels from the top down, each with a dot behind: a parent's name begins those of all below it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def longest_match(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """host, domain: the longest of the domains that is the host or a parent of it; both distinct and in lower case.

    Hosts and domains are sorted together by reversed name, in range
    partitions. Going through one, the domains that begin the present name form
    a stack, the path of a trie. What lies open at the start of a partition are
    parents of its first name: a few rows per partition, looked up beforehand.
    """
    both = hosts.select(reversed_name("host").alias("name"), F.lit(False).alias("watched")).unionByName(
        domains.select(reversed_name("domain").alias("name"), F.lit(True).alias("watched"))
    )
    dealt = cut(both.repartitionByRange("name").sortWithinPartitions("name", F.desc("watched")).withColumn("part", F.spark_partition_id()))
    first = dealt.groupBy("part").agg(F.min("name").alias("name"))
    above = F.expr("transform(sequence(1, size(split(name, '[.]')) - 1), i -> concat(array_join(slice(split(name, '[.]'), 1, i), '.'), '.'))")
    parents = first.select("part", F.explode(above).alias("name"))
    opened = parents.join(domains.select(reversed_name("domain").alias("name")), "name").groupBy("part").agg(F.array_sort(F.collect_list("name")).alias("n")).collect()
    seeds = dealt.sparkSession.sparkContext.broadcast({r["part"]: r["n"] for r in opened})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, begun = [], False
        for pdf in batches:
            names, found = [], []
            for name, watched, part in zip(pdf["name"], pdf["watched"], pdf["part"]):
                if not begun:
                    stack, begun = list(seeds.value.get(part, ())), True
                while stack and not name.startswith(stack[-1]):
                    stack.pop()
                if watched:
                    if not stack or stack[-1] != name:
                        stack.append(name)
                elif stack:
                    names.append(name)
                    found.append(stack[-1])
            yield pd.DataFrame({"host": names, "domain": found}, dtype=object)

    back = lambda c: F.array_join(F.reverse(F.split(F.expr(f"substring({c}, 1, length({c}) - 1)"), r"\.")), ".")
    return dealt.mapInPandas(walk, "host string, domain string").select(back("host").alias("host"), back("domain").alias("domain"))


def detect_in_large_list(log: DataFrame, watch: DataFrame, *keep: str, host: str = "host", detected_by: str = "SYSTEM") -> DataFrame:
    """``detect_shadow_ai`` for a list of any size: distinct hosts are matched, and joined back by salted keys."""
    w = watch.select(F.lower("domain").alias("domain"), "name", "vendor", "risk")
    rows = log.select(*keep, F.col(host).alias("__host")).where("__host IS NOT NULL")
    pairs = longest_match(rows.select(F.col("__host").alias("host")).distinct(), w.select("domain").where("domain IS NOT NULL").distinct())
    known = pairs.join(w, "domain").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("__s", F.pmod(F.xxhash64("__host", *keep), F.lit(SALT)).cast("int"))
    return _detected(salted.join(known.withColumnRenamed("host", "__host"), ["__host", "__s"]), keep, detected_by)


def shadow_detections(df: DataFrame, risk: str | None = None, limit: int = 100, order: str = "seq") -> DataFrame:
    rows = df if risk is None else df.where(F.col("risk") == risk.upper())
    return rows.orderBy(F.col(order).desc()).limit(limit)


def shadow_summary(df: DataFrame) -> DataFrame:
    """Counts per vendor; totals are sums over them."""
    risk = F.coalesce("risk", F.lit("MEDIUM"))
    return df.groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("vendor")).agg(
        F.count("*").alias("total_detections"),
        F.count_if(risk == "HIGH").alias("high_risk"),
        F.count_if(risk == "MEDIUM").alias("medium_risk"),
    )
