"""Sharding by balanced label propagation. DataFrame functions only.

Linked documents (one group: equal texts) should share a shard while shards
keep equal numbers of documents. Copies of one text are alike, so the state is
not a row per document but the count of each group in each shard; a group that
holds a third of all rows is at most ``shards`` rows.

Each round joins the counts of a group over all shards: documents want to
move to the shard where most of their group is (a group larger than a shard
fills several in that order). Wishes are summed into a matrix of shard pairs,
and quotas accept what is matched by wishes the other way plus what the target
has room for. After the rounds, single documents fill what is left, so that
counts differ by at most one; if groups overfill a shard, its last units are
split (a group that is whole is never moved to make room for another). Finally
documents are numbered inside group and shard without gathering
either in one task.

Defined results: null texts are one group and have no bytes; repeated rows are
placed as often as they come; a null doc_id is an id like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import bucket_of, ranked, stored

SHARDS = 24
ROUNDS = 6
#: Buckets in which quotas are spent, so that no shard pair is ordered by one task.
QUOTA_BUCKETS = 8


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small local table; its size is bounded by the square of the number of shards."""
    rows = rows or [tuple(-1 for _ in columns.split(","))]
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(f'{v}L' for v in r) + ')' for r in rows)} AS t({columns})")


def targets(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _per_shard(values: list[int]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard").cast("int") + 1)


def _wishes(units: DataFrame, sizes: list[int], load: list[int]) -> DataFrame:
    """grp, shard, n, to, m: how many rows of a unit want to leave, and where to.

    A shard with room for the whole group comes before one without, then that
    which holds most of the group, then the emptier one.
    """
    room = _per_shard(sizes)
    whole = Window.partitionBy("grp")
    units = units.withColumn("free", _per_shard([s - n for s, n in zip(sizes, load, strict=True)]))
    units = units.withColumn("fits", F.sum("n").over(whole) - F.col("n") <= F.col("free"))
    best_first = Window.partitionBy("grp").orderBy(F.desc("fits"), F.desc("n"), F.desc("free"), "shard")
    before = best_first.rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        units.withColumn("size", room)
        .withColumn("all", F.sum("n").over(whole))
        .withColumn("taken", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("want", F.greatest(F.lit(0), F.least(F.col("size"), F.col("all") - F.col("taken"))))
        .withColumn("k", F.row_number().over(best_first))
        .withColumn("takers", F.array_sort(F.collect_list(F.when(F.col("want") > F.col("n"), F.struct("k", "shard", (F.col("want") - F.col("n")).alias("gap")))).over(whole)))
    )
    taker = F.get("takers", F.pmod(F.col("k"), F.greatest(F.size("takers"), F.lit(1))).cast("int"))
    return (
        plan.where((F.col("n") > F.col("want")) & (F.size("takers") > 0))
        .withColumn("taker", taker)
        .select("grp", "shard", F.col("taker.shard").alias("to"), F.least(F.col("n") - F.col("want"), F.col("taker.gap")).alias("m"))
        .withColumn("b", bucket_of(QUOTA_BUCKETS, "grp"))
    )


def _shares(total: int, claims: list[int]) -> list[int]:
    """``total`` dealt out in proportion to the claims, none more than it claims; what rounding leaves goes to the first."""
    every = sum(claims)
    total = min(total, every)
    out = [c * total // every if every else 0 for c in claims]
    rest = total - sum(out)
    for k, c in enumerate(claims):
        more = min(rest, c - out[k])
        out[k] += more
        rest -= more
    return out


def _quotas(wishes: list[tuple[int, int, int, int]], load: list[int], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """What each (from, to, bucket) may move: matched by the other direction, or into free room."""
    flow: dict[tuple[int, int], int] = {}
    for i, j, _, m in wishes:
        flow[i, j] = flow.get((i, j), 0) + m
    granted = {}
    for j in range(len(sizes)):
        into = sorted((i, m) for (i, t), m in flow.items() if t == j)
        matched = [min(m, flow.get((j, i), 0)) for i, m in into]
        extra = _shares(max(0, sizes[j] - load[j]), [m - k for (_, m), k in zip(into, matched, strict=True)])
        for (i, _), k, x in zip(into, matched, extra, strict=True):
            granted[i, j] = k + x
    out = []
    for pair, total in granted.items():
        own = sorted(w for w in wishes if w[:2] == pair)
        out += [(*w[:3], q) for w, q in zip(own, _shares(total, [w[3] for w in own]), strict=True) if q]
    return out


def _loads(units: DataFrame, shards: int) -> list[int]:
    load = [0] * shards
    for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    return load


def propagate(units: DataFrame, sizes: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Moves rows of ``units`` (grp, shard, n) between shards until none wants or may move."""
    spark = units.sparkSession
    for _ in range(rounds):
        load = _loads(units, len(sizes))
        wishes = cut(_wishes(units, sizes, load))
        flow = [tuple(r) for r in wishes.groupBy("shard", "to", "b").agg(F.sum("m")).collect()]
        quotas = _quotas(flow, load, sizes)
        if not quotas:
            break
        allowed = F.broadcast(_values(spark, quotas, "shard, to, b, q"))
        spent = Window.partitionBy("shard", "to", "b").orderBy(F.desc("m"), "grp")
        moves = (
            wishes.join(allowed, ["shard", "to", "b"])
            .withColumn("before", F.sum("m").over(spent) - F.col("m"))
            .withColumn("m", F.greatest(F.lit(0), F.least("m", F.col("q") - F.col("before"))))
            .where("m > 0")
        )
        deltas = units.unionByName(moves.select("grp", "shard", (-F.col("m")).alias("n"))).unionByName(
            moves.select("grp", F.col("to").alias("shard"), F.col("m").alias("n"))
        )
        units = cut(deltas.groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return units


def _split_over(units: DataFrame, sizes: list[int]) -> DataFrame:
    """Units cut so that no shard holds more than its size; what is too much goes where room is."""
    load = _loads(units, len(sizes))
    if all(n <= s for n, s in zip(load, sizes, strict=True)):
        return units
    holes, at = [], 0
    for s, (n, size) in enumerate(zip(load, sizes, strict=True)):
        if n < size:
            holes.append((at, at + size - n, s))
            at += size - n
    over, at = [], 0
    for n, size in zip(load, sizes, strict=True):
        over.append(at)
        at += max(0, n - size)

    bucketed = units.withColumn("b", bucket_of(64, "grp"))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("shard", "b").agg(F.sum("n").alias("t")).select(
        "shard", "b", F.coalesce(F.sum("t").over(upto.partitionBy("shard").orderBy("b")), F.lit(0)).alias("off")
    )
    placed = (
        bucketed.withColumn("inside", F.coalesce(F.sum("n").over(upto.partitionBy("shard", "b").orderBy("grp")), F.lit(0)))
        .join(offsets, ["shard", "b"])
        .withColumn("lo", F.col("off") + F.col("inside"))
        .withColumn("stay", F.greatest(F.lit(0), F.least("n", _per_shard(sizes) - F.col("lo"))))
        .withColumn("x", _per_shard(over) + F.greatest(F.lit(0), F.col("lo") - _per_shard(sizes)))
        .withColumn("y", F.col("x") + F.col("n") - F.col("stay"))
    )
    hole = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(s).cast("long").alias("s")) for a, b, s in holes])
    moved = (
        placed.where("stay < n")
        .select("grp", "x", "y", F.explode(F.filter(hole, lambda h: (h["a"] < F.col("y")) & (h["b"] > F.col("x")))).alias("h"))
        .select("grp", F.col("h.s").alias("shard"), (F.least("y", "h.b") - F.greatest("x", "h.a")).alias("n"))
    )
    return placed.select("grp", "shard", F.col("stay").alias("n")).unionByName(moved).where("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law: row counts differ by at most one."""
    text = F.col("text").cast("string")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("")).alias("grp"),
        )
    )
    spark = docs.sparkSession
    start = rows.groupBy("grp", bucket_of(shards, "doc_id").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    groups = cut(
        start.groupBy("grp").agg(F.sum("n").alias("all"), F.collect_list(F.struct("shard", "n")).alias("at")).where("all > 1")
    )
    total = rows.count()
    sizes = targets(total, shards)
    units = cut(groups.select("grp", F.explode("at").alias("u")).select("grp", "u.shard", "u.n"))
    units = cut(_split_over(propagate(units, sizes), sizes))
    # Where the k-th copy of a group belongs: ends of its shares, one per shard at most.
    ends = units.select(
        "grp", "shard", F.sum("n").over(Window.partitionBy("grp").orderBy("shard")).alias("end")
    ).groupBy(F.col("grp").alias("g")).agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    ends = cut(ends)  # read from files, so that a join can split a hot group
    known = rows.join(ends, F.col("grp") == F.col("g"), "left").drop("g")
    linked = ranked(known.where("ends IS NOT NULL"), ["grp"], ["doc_id", "size"], "k", 16).select(
        "doc_id", "size", "text_crc32", F.get(F.filter("ends", lambda e: e["end"] > F.col("k")), 0)["shard"].alias("shard")
    )
    load, bounds = _loads(units, shards), []
    for s, n in zip(sizes, load, strict=True):
        bounds.append((bounds[-1] if bounds else 0) + s - n)
    free = F.array(*[F.lit(b).cast("long") for b in bounds])
    single = ranked(known.where("ends IS NULL"), [], ["doc_id", "size"], "k", 64).select(
        "doc_id", "size", "text_crc32", F.size(F.filter(free, lambda b: b <= F.col("k"))).cast("long").alias("shard")
    )
    placed = stored(linked.unionByName(single))
    return ranked(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot", 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
