"""Exact nearest neighbours by dot product, through cells around centres.

The vectors of an index are placed in the cell of their nearest centre. With
``r`` the largest distance of a cell's vectors from its centre ``c``, no dot
product of a query ``q`` with one of them exceeds ``q.c + |q| r``. Each query
first visits the cell that promises most; its k-th score there rules out every
cell whose bound is lower. Only the other cells are visited, so a query is
copied once per cell it must see, not once per block of the index.

Centres come from a bounded sample and steer cost alone: the bounds hold for
whatever centres there are, so results are exact. Cells above ``block``
vectors are searched in blocks, and the queries of a cell in portions, so a
task holds one block and one portion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Vectors sampled for the centres (the driver holds them), most centres, and rounds that improve them.
SAMPLE, MAX_CELLS, ROUNDS = 20_000, 1024, 6
#: Vectors of a block, and queries of a portion.
BLOCK = 20_000
#: Bounds and selections allow for this relative error of a dot product in doubles.
SLACK = 1e-9

_PAIR = "query_id bigint, rank int, item_id bigint, score double"


@dataclass(frozen=True)
class Cells:
    """An index in cells; centres, radii and counts are bounded by ``MAX_CELLS``."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    members: DataFrame

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no dot product with a vector of the cell exceeds; minus infinity for empty cells."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        reach = queries @ self.centres.T + length * self.radius
        reach += SLACK * (1 + length * (np.linalg.norm(self.centres, axis=1) + self.radius))
        return np.where(self.count > 0, reach, -np.inf)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64) if len(vectors) else np.zeros((0, 0))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def centres_of(index: DataFrame, vec: str, n: int) -> np.ndarray:
    """``n`` centres at most, by Lloyd's rounds over ``SAMPLE`` vectors chosen by hash."""
    x = _matrix(index.select(vec).orderBy(F.xxhash64(vec)).limit(SAMPLE).toPandas()[vec])
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(n, len(centres))).astype(int)]
    for _ in range(ROUNDS):
        at = _nearest_centre(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        held = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(held > 0, total / np.maximum(held, 1), centres)
    return centres


def place(index: DataFrame, iid: str, ivec: str, cells: int | None = None) -> Cells:
    """The index in cells, cut off from its lineage: item_id, vec, cell."""
    index = index.where(F.col(ivec).isNotNull()).select(F.col(iid).cast("bigint").alias("item_id"), F.col(ivec).alias("vec"))
    if cells is None:
        cells = min(MAX_CELLS, max(1, int(index.count() ** 0.5)))
    centres = centres_of(index, "vec", cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vec"])
                at = _nearest_centre(x, centres)
                yield pdf.assign(cell=at.astype(np.int32), far=np.linalg.norm(x - centres[at], axis=1))

    members = cut(index.mapInPandas(assign, f"item_id bigint, vec {index.schema['vec'].dataType.simpleString()}, cell int, far double"))
    stats = members.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).toPandas()
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    radius[stats["cell"]], count[stats["cell"]] = stats["r"], stats["n"]
    return Cells(centres, radius, count, members.drop("far"))


def _exact(q: np.ndarray, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k``: selected by the matrix product, scored one pair like the other, ties to smaller ids."""
    k = min(k, len(ids))
    least = np.partition(rough, -k)[-k]
    near = np.flatnonzero(rough >= least - SLACK * (1 + abs(least)))
    score = (x[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def _search(visits: DataFrame, cells: Cells, k: int, block: int) -> DataFrame:
    """The best ``k`` per query and block of the cells that ``visits`` (query_id, vec, cell) names."""
    asked = np.zeros(len(cells.count), np.int64)
    for r in visits.groupBy("cell").count().collect():
        asked[r["cell"]] = r["count"]
    blocks = F.array(*[F.lit(int(n)) for n in cells.count // block + 1])
    portions = F.array(*[F.lit(int(n)) for n in asked // block + 1])
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.get(n, "cell")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.get(n, "cell") - 1))
    left = visits.select("query_id", "vec", "cell", dealt("query_id", portions).alias("portion"), every(blocks).alias("block"))
    right = cells.members.select("item_id", "vec", "cell", dealt("item_id", blocks).alias("block"), every(portions).alias("portion"))
    right = right.where(F.get(F.array(*[F.lit(bool(n)) for n in asked]), "cell"))

    def search(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(items):
            ids, x = items["item_id"].to_numpy(), _matrix(items["vec"])
            table = np.ascontiguousarray(x.T)
            for lo in range(0, len(queries), 256):
                part = queries.iloc[lo : lo + 256]
                q = _matrix(part["vec"])
                for i, (query, rough) in enumerate(zip(part["query_id"], q @ table)):
                    best, score = _exact(q[i], x, ids, rough, k)
                    found.append(pd.DataFrame({"query_id": query, "rank": np.arange(1, len(best) + 1), "item_id": best, "score": score}))
        if not found:
            return pd.DataFrame({"query_id": [], "rank": [], "item_id": [], "score": []})
        return pd.concat(found, ignore_index=True)

    keys = ("cell", "block", "portion")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _PAIR)


def home_visits(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """query_id, vec and the cell with the highest bound; more cells while these hold fewer than ``k`` vectors."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                order = np.argsort(-cells_only.bounds(_matrix(pdf["vec"])), axis=1, kind="stable")
                held = np.cumsum(cells_only.count[order], axis=1)
                need = (np.hstack([np.zeros((len(order), 1), np.int64), held[:, :-1]]) < k) & (cells_only.count[order] > 0)
                row, column = np.nonzero(need)
                yield pdf.iloc[row].assign(cell=order[row, column].astype(np.int32))

    cells_only = Cells(cells.centres, cells.radius, cells.count, None)
    return queries.mapInPandas(choose, f"query_id bigint, vec {queries.schema['vec'].dataType.simpleString()}, cell int")


def other_visits(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """query_id, vec, cell for the cells that may hold one of the best; ``queries`` has ``least``, their k-th score so far."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                bound = cells_only.bounds(_matrix(pdf["vec"]))
                least = pdf["least"].to_numpy(np.float64)
                open_ = (bound >= least[:, None]) & (bound > -np.inf)
                seen = pdf["home"].tolist()
                open_[np.repeat(np.arange(len(seen)), list(map(len, seen))), np.concatenate(seen).astype(int)] = False
                row, column = np.nonzero(open_)
                yield pdf.iloc[row][["query_id", "vec"]].assign(cell=column.astype(np.int32))

    cells_only = Cells(cells.centres, cells.radius, cells.count, None)
    return queries.mapInPandas(choose, f"query_id bigint, vec {queries.schema['vec'].dataType.simpleString()}, cell int")


def visits(queries: DataFrame, cells: Cells, k: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What the first cells gave (pairs), and the visits still to make (query_id, vec, cell)."""
    home = cut(home_visits(queries, cells, k))
    pairs = cut(_search(home, cells, k, block))
    best = merge(pairs, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    seen = home.groupBy("query_id").agg(F.collect_set("cell").alias("home"))
    known = queries.join(best, "query_id", "left").join(seen, "query_id")
    known = known.withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return pairs, cut(other_visits(known, cells, k))


def merge(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query of candidates, in two steps: no group holds those of all tasks at once."""
    cand = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))
    part = pairs.groupBy("query_id", F.pmod(F.xxhash64("item_id"), F.lit(64)).alias("p")).agg(F.slice(F.array_sort(F.collect_list(cand)), 1, k).alias("c"))
    merged = part.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k).alias("c"))
    return merged.select("query_id", F.posexplode("c").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("item_id"), (-F.col("x.s")).alias("score")
    )


def nearest(
    queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str, query_vec: str, index_vec: str, cells: int | None = None, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, item_id, score of the exact best ``k``; rows without a vector are left out, ids of queries are unique."""
    if index.where(F.col(index_vec).isNotNull()).isEmpty():
        return index.sparkSession.createDataFrame([], _PAIR)
    placed = place(index, index_id, index_vec, cells)
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vec).alias("vec"))
    pairs, rest = visits(asked, placed, k, block)
    return merge(pairs.unionByName(_search(rest, placed, k, block)), k)
