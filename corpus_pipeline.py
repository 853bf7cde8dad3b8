"""From raw documents to packed training sequences, in five stages of the corpus operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textwarden.llm import decontaminate, host_quality, ngram_join, packing, toxicity
from textwarden.llm.common import prepare, read, stored

#: Pieces that a worker remembers while it packs: fewer than on its own, as its executor holds what earlier stages left.
REMEMBERED = 200_000


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    return toxicity.keep_clean(docs, read(prepare(spark), sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and the verdict of their host."""
    return host_quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (five words, 0.8)."""
    prepare(spark)
    return ngram_join.one_per_component(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, read(prepare(spark), sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and their place in it."""
    prepare(spark)
    return packing.pack(docs, remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("quality rules", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: Learned scores and token ids cannot be stated in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
