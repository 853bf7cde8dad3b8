"""Document ingest, chunking, retrieval and document reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut_text, explode_rows, text_blocks
from ..functions.patterns import US_PATTERNS
from .detect import scan
from .mask import redact_india, redact_spans, scanner_risk
from .nearest import nearest
from .semantic import embed_chunks
from .splitter import split_text

# Fixed values.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 150
HIGH_RISK = 7.0
BASE_HOURS, WORDS_PER_HOUR, RATE, LEAK_BONUS = 0.1, 2000.0, 250.0, 1500.0
FALLBACK_ANSWER = "No direct answer found in indexed context."

MAX_VECTORS = 20_000  # vectors of the side that is sent to every task


def chunk(df: DataFrame, *keep: str, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed-stride chunks: ``size`` characters, each starting ``size - overlap`` after the last."""
    # An empty text has no chunk. It is left out here and not by a filter, which
    # the optimizer would push below the work that made the text.
    staged = df.select(*keep, F.col(text).alias("__t"), text_blocks(F.col(text)).alias("__b"))
    n = F.length("__t")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    pieces = F.when(n > 0, F.transform(starts, lambda s: cut_text(F.col("__t"), F.col("__b"), s, F.least(s + size, n))))
    return explode_rows(staged, keep, pieces, "chunk", "chunk_no")


def chunk_separators(df: DataFrame, *keep: str, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that end at paragraphs, lines or words (see ``splitter``)."""
    return split_text(df, *keep, text=text, size=size, overlap=overlap)


def ingest_documents(docs: DataFrame, *keep: str, text: str = "text", embed: bool = True, model=None) -> DataFrame:
    """Scan, score, redact, and only then chunk and embed: raw text is never indexed."""
    scanned = scan(docs, text, US_PATTERNS, "findings")
    scored = scanned.withColumns({"risk": scanner_risk("findings"), "alert": scanner_risk("findings") > HIGH_RISK})
    clean = redact_spans(scored, text, "findings", "clean_text")
    pieces = chunk_separators(clean, *keep, "risk", "alert", text="clean_text")
    return embed_chunks(pieces, "chunk", "embedding", model) if embed else pieces


# ---- retrieval ------------------------------------------------------------


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ids and scores of the k best, ties to the smaller id. ``ids`` ascend."""
    k = min(k, scores.shape[1])
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return ids[order], np.take_along_axis(scores, order, axis=1)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 1))


def _pairs(qids, ids, scores) -> pd.DataFrame:
    n, k = ids.shape
    ranks = np.tile(np.arange(1, k + 1, dtype=np.int32), n)
    return pd.DataFrame({"query_id": np.repeat(qids, k), "rank": ranks, "item_id": ids.ravel(), "score": scores.ravel()})


_PAIR = "query_id bigint, rank int, item_id bigint, score double"


def _local(df: DataFrame, key: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded set of vectors, ordered by id."""
    pdf = df.select(key, vec).toPandas().sort_values(key)
    return pdf[key].to_numpy(), _matrix(pdf[vec])


def _against_index(queries: DataFrame, index: DataFrame, qid: str, iid: str, qvec: str, ivec: str, k: int) -> DataFrame:
    """Queries stream past a bounded index: the best k per query are final in the map task."""
    ids, vectors = _local(index, iid, ivec)
    shared = queries.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(vectors.T)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, table = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                got, score = _top(_matrix(part[qvec]) @ table, item_ids, k)
                yield _pairs(part[qid].to_numpy(), got, score)

    return queries.select(qid, qvec).mapInPandas(search, _PAIR)


def _against_queries(queries: DataFrame, index: DataFrame, qid: str, iid: str, qvec: str, ivec: str, k: int) -> DataFrame:
    """The index streams past bounded queries: each task keeps k per query."""
    qids, vectors = _local(queries, qid, qvec)
    shared = index.sparkSession.sparkContext.broadcast((qids, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q = shared.value
        if not len(query_ids):
            return
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[iid].to_numpy()
            scores = q @ _matrix(pdf[ivec]).T
            ids = np.broadcast_to(ids, scores.shape)
            if best is not None:
                ids, scores = np.hstack([best[0], ids]), np.hstack([best[1], scores])
            order = np.lexsort((ids, -scores), axis=1)[:, :k]
            best = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        if best is not None:
            yield _pairs(query_ids, *best)

    return index.select(iid, ivec).mapInPandas(search, _PAIR)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Merge candidates in two steps, so that no group holds those of all tasks at once."""
    cand = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))
    part = pairs.groupBy("query_id", F.pmod(F.spark_partition_id(), F.lit(512)).alias("p")).agg(
        F.slice(F.array_sort(F.collect_list(cand)), 1, k).alias("c")
    )
    merged = part.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k).alias("c"))
    return merged.select("query_id", F.posexplode("c").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("item_id"), (-F.col("x.s")).alias("score")
    )


def similarity_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int = 4,
    query_id: str = "query_id",
    index_id: str = "item_id",
    query_vec: str = "embedding",
    index_vec: str = "embedding",
    max_vectors: int = MAX_VECTORS,
) -> DataFrame:
    """Exact nearest neighbours by dot product, ties to the smaller id.

    A side of a checked size goes to every task and the other one streams past
    it as matrix products. Where both are large, the index is placed in cells,
    and a query visits only those that can hold one of its best (``nearest``).
    Pairs are never materialised, only the best k per query and block.
    """
    names = (query_id, index_id, query_vec, index_vec)
    n_index = index.select(index_id).limit(max_vectors + 1).count()
    if n_index <= max_vectors:
        return _against_index(queries, index, *names, k)
    if queries.select(query_id).limit(max_vectors + 1).count() <= max_vectors:
        return _best(_against_queries(queries, index, *names, k), k)
    return nearest(queries, index, k, *names)


def topk_in_blocks(
    queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str, query_vec: str, index_vec: str, query_blocks: int, index_blocks: int
) -> DataFrame:
    """Exact nearest neighbours when both sides are large, in one job.

    Both sides are dealt into blocks by the hash of their ids. A task holds one
    block of each, multiplies them, and keeps the best k per query; the best of
    all index blocks are merged afterwards. Nothing passes through the driver.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(query_id, query_vec, block(query_id, query_blocks).alias("__q"), every(index_blocks).alias("__i"))
    x = index.select(index_id, index_vec, block(index_id, index_blocks).alias("__i"), every(query_blocks).alias("__q"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _pairs(np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0)))
        right = right.sort_values(index_id)
        table, ids, found = np.ascontiguousarray(_matrix(right[index_vec]).T), right[index_id].to_numpy(), []
        for lo in range(0, len(left), 1024):
            part = left.iloc[lo : lo + 1024]
            found.append(_pairs(part[query_id].to_numpy(), *_top(_matrix(part[query_vec]) @ table, ids, k)))
        return pd.concat(found, ignore_index=True)

    return _best(q.groupBy("__q", "__i").cogroup(x.groupBy("__q", "__i")).applyInPandas(search, _PAIR), k)


def rag_context(prompts: DataFrame, index: DataFrame, k: int = 4, key: str = "prompt_id", item: str = "item_id", chunk_text: str = "chunk", out: str = "context") -> DataFrame:
    """The k nearest chunks of each prompt, joined by blank lines and redacted."""
    top = similarity_topk(prompts, index, k, key, item)
    texts = index.select(F.col(item).alias("item_id"), F.col(chunk_text).alias("__chunk"))
    joined = (
        top.join(texts, "item_id")
        .groupBy(F.col("query_id").alias(key))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "__chunk"))).alias("__c"))
        .select(key, F.array_join(F.transform("__c", lambda c: c["__chunk"]), "\n\n").alias("__raw"))
    )
    us = redact_spans(scan(joined, "__raw", US_PATTERNS, "__f"), "__raw", "__f", "__safe")
    return redact_india(us, "__safe", out).select(key, out)


def answer_extract(
    context: Column, query: Column, topic: str = "murder", any_of: Sequence[str] = ("death", "imprisonment"), fallback: str = FALLBACK_ANSWER
) -> Column:
    """First sentence about the topic that names one of the outcomes, if the query asks for it."""
    asks = F.contains(F.lower(query), F.lit(topic))

    def fits(s: Column) -> Column:
        low = F.lower(s)
        named = F.lit(False)
        for word in any_of:
            named = named | F.contains(low, F.lit(word))
        return (s != "") & F.contains(low, F.lit(topic)) & named

    sentences = F.transform(F.split(context, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.coalesce(F.when(asks, F.get(F.filter(sentences, fits), 0)), F.lit(fallback))


# ---- reports --------------------------------------------------------------


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def roi_stats(df: DataFrame, text: str = "text", risk: str = "risk") -> DataFrame:
    """Words, hours and money saved per document; totals are sums of these."""
    words = word_count(F.col(text))
    hours = F.lit(BASE_HOURS) + words / F.lit(WORDS_PER_HOUR)
    bonus = F.when(F.col(risk) > HIGH_RISK, LEAK_BONUS).otherwise(0.0)
    return df.withColumns({"words": words, "hours_saved": hours, "money_saved": F.round(hours * RATE, 2) + bonus})


def roi_totals(stats: DataFrame, *by: str, risk: str = "risk") -> DataFrame:
    return stats.groupBy(*by).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col(risk) > HIGH_RISK).alias("leaks_blocked"),
        F.sum("words").alias("words"),
        F.round(F.sum(F.col("hours_saved").cast("decimal(28,8)")), 2).cast("double").alias("hours_saved"),
        F.round(F.sum(F.col("money_saved").cast("decimal(28,8)")), 2).cast("double").alias("money_saved"),
    )


def monthly_report(processed: DataFrame, risk: str = "risk", name: str = "file", top: int = 10) -> DataFrame:
    """Totals and the first ``top`` risky files by name."""
    totals = roi_totals(processed, risk=risk).withColumn("part", F.lit("totals"))
    risky = processed.where(F.col(risk) > HIGH_RISK).orderBy(name).limit(top)
    listed = risky.select(F.lit("risky").alias("part"), F.col(name).alias("file"), F.col(risk).alias("score"))
    return totals.unionByName(listed, allowMissingColumns=True)


def report_due(last_report: Column, as_of: str, cycle_days: int = 30) -> Column:
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last_report.cast("timestamp"))) / F.lit(86_400_000_000))
    return last_report.isNull() | (days >= cycle_days)


def file_audit_report(processed: DataFrame, name: str = "file", risk: str = "risk", at: str = "processed_at") -> DataFrame:
    return processed.select(
        F.col(at).alias("Timestamp"),
        F.col(name).alias("File"),
        F.col(risk).alias("Risk Score"),
        F.col("words").alias("Words Processed"),
        F.col("status").alias("Redaction Profile"),
    )
