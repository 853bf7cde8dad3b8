"""Token ids of a corpus in a binary, entropy-coded file format.

``write_token_files`` encodes every text, counts all ids, and writes blocks
coded by one shared frequency table (``rans.py``) in ascending doc_id order;
``read_token_files`` decodes blocks independently of one another.

Files are Parquet used as a container, so that Spark's committer makes them
whole whatever executors are lost: ``blocks`` has a row per block (file,
block, ids, payload), ``model`` the frequency table. A block holds whole
documents, about ``BLOCK`` ids or one longer document.

Defined results: text null or "" is the end id alone; repeated rows are
encoded as often as they come; equal doc_ids follow one another, ordered by
the checksum of their ids; a null doc_id comes first; an empty table gives no
blocks; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import BATCH, shared_path, stored
from .tokens import default_vocabulary, encode_arrays

#: Ids of a block, and ids of a file.
BLOCK = 1 << 18
FILE_IDS = 1 << 24


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n, crc, ids (16 bits each if all fit, else 32) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                wide = [w.astype("<u4", copy=False) for w in encode_arrays(part.column(1), vocabulary)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(w) for w in wide], pa.int64()),
                        pa.array([zlib.crc32(w) for w in wide], pa.int64()),
                        pa.array([w.astype("<u2").tobytes() if w.max() < 65536 else w.tobytes() for w in wide], pa.binary()),
                    ],
                    ["doc_id", "n", "crc", "ids"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, crc long, ids binary")


def _unpack(n: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def count_ids(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows; as long as the vocabulary, which bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            ids = [_unpack(n, b) for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            c = np.bincount(np.concatenate(ids)) if ids else total[:0]
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "c"])

    got = rows.select("n", "ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(max([0, *(r["id"] for r in got)]) + 1, np.int64)
    for r in got:
        counts[r["id"]] = r["c"]
    return counts


@functools.lru_cache(maxsize=1)
def _model(freq: bytes) -> rans.Model:
    """The tables of one model per worker, beside the memory of pieces and not in its place."""
    return rans.Model(np.frombuffer(freq, "<i8"))


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Writes ``blocks`` and ``model`` below ``path``."""
    spark = docs.sparkSession
    rows = stored(tokenised(docs, vocabulary or default_vocabulary()))
    counts = count_ids(rows)
    freq = rans.quantise(counts).astype("<i8").tobytes()
    spark.range(1).select(F.lit(bytearray(freq)).alias("frequencies"), F.lit(rans.SCALE).alias("scale")).write.parquet(f"{path}/model")
    files = max(spark.sparkContext.defaultParallelism, int(counts.sum()) // FILE_IDS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block, parts, docs_in, size = _model(freq), 0, [], [], 0
        file = TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            payload = rans.encode(np.concatenate(parts), model, docs_in)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                ["file", "block", "ids", "payload"],
            )

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size and size + n > BLOCK:
                    yield row()
                    block, parts, docs_in, size = block + 1, [], [], 0
                parts.append(_unpack(n, ids))
                docs_in.append((doc, n))
                size += n
        if size:
            yield row()

    (
        rows.repartitionByRange(files, "doc_id", "crc", "n")
        .sortWithinPartitions("doc_id", "crc", "n")
        .select("doc_id", "n", "ids")
        .mapInArrow(run, "file int, block int, ids long, payload binary")
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as array) of every document in the files."""
    freq = bytes(spark.read.parquet(f"{path}/model").first()["frequencies"])
    blocks = spark.read.schema("file int, block int, ids long, payload binary").parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(freq)
        for batch in batches:
            for file, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = rans.decode(payload, model)
                docs = rans.documents(payload)
                ends = np.cumsum([k for _, k in docs])
                cut = [ids[e - k : e].astype("<u4") for e, (_, k) in zip(ends, docs, strict=True)]
                cols = [
                    pa.array([d for d, _ in docs], pa.int64()),
                    pa.array([file] * len(docs), pa.int32()),
                    pa.array([block] * len(docs), pa.int32()),
                    pa.array(ends - [k for _, k in docs], pa.int64()),
                    pa.array([k for _, k in docs], pa.int64()),
                    pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                ]
                names = ["doc_id", "file", "block", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([c.tolist() for c in cut], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, file int, block int, inside long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    rows = blocks.select("file", "block", "payload").mapInArrow(run, schema)
    sizes = blocks.groupBy("file", "block").agg(F.sum("ids").alias("ids"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("ids").alias("all"))
    files = files.select("file", F.coalesce(F.sum("all").over(upto.orderBy("file")), F.lit(0)).alias("before_file"))
    before = sizes.select("file", "block", F.coalesce(F.sum("ids").over(upto.partitionBy("file").orderBy("block")), F.lit(0)).alias("before"))
    starts = before.join(files, "file").select("file", "block", (F.col("before") + F.col("before_file")).alias("first"))
    out = rows.join(starts, ["file", "block"])
    return out.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` into the shared folder and returns what they hold per document."""
    path = shared_path(docs.sparkSession)
    write_token_files(docs, path, vocabulary)
    return read_token_files(docs.sparkSession, path)
