"""Request and cost budgets per actor, in windows anchored at a first request.

A window starts at the first request after the last one ran out, so window
starts depend on one another. They are found in three steps, none of which
holds a whole actor: each block of time works out where it would leave off for
any point of entry (from its distinct times alone); one small row per block
carries the entry along; with its entry known, every block marks its windows.
Decisions are then made per window, batch by batch and run by run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default budget.
MAX_REQUESTS, WINDOW_US, MAX_COST, COST_PER_1K = 120, 60_000_000, 5.0, 0.01
BLOCK_US = 3_600_000_000
OK, RATE, COST = "OK", "RATE_LIMIT_EXCEEDED", "COST_BUDGET_EXCEEDED"
_NEVER = -(2**62)


def request_cost(tokens: Column, per_1k: float = COST_PER_1K) -> Column:
    return F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)) / F.lit(1000.0) * F.lit(per_1k)


def _whole_groups(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches cut so that no group of equal keys is split, with the group borders.

    The last group of a batch waits for the next batch, so at most one batch
    and one group are held.
    """
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        codes = [pdf[k].to_numpy() for k in keys]
        change = np.zeros(len(pdf), dtype=bool)
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in codes) != last
        starts = np.flatnonzero(change)
        last = tuple(c[-1] for c in codes)
        if not len(starts):
            held.append(pdf)
            continue
        cut = starts[-1]
        done = [*held, pdf.iloc[:cut]] if cut else held
        held = [pdf.iloc[cut:]]
        if done:
            yield _bordered(pd.concat(done, ignore_index=True), keys)
    if held:
        yield _bordered(pd.concat(held, ignore_index=True), keys)


def _bordered(pdf: pd.DataFrame, keys: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray]:
    change = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        c = pdf[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return pdf, np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])


def _next(us: np.ndarray, window: int) -> np.ndarray:
    """Index of the first request after the window that starts at each request."""
    return np.searchsorted(us, us + window, side="right")


def _exits(us: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible first window starts of a block, and the last start each leads to.

    Of neighbours that lead to the same end only the last is kept: looking up
    the first kept one at or after a time gives the same end.
    """
    n = len(us)
    nxt = _next(us, window)
    first = np.arange(min(np.searchsorted(us, us[0] + window, side="right") + 1, n))
    at = first.copy()
    while True:
        forward = nxt[at]
        going = forward < n
        if not going.any():
            break
        at = np.where(going, forward, at)
    ends = us[at]
    keep = np.append(ends[1:] != ends[:-1], True)
    return us[first][keep], ends[keep]


def window_starts(
    requests: DataFrame, actor: str = "actor", us: str = "us", window: int = WINDOW_US, block: int = BLOCK_US
) -> DataFrame:
    """Add ``window_start`` to every request. ``us`` is a BIGINT of microseconds."""
    rows = requests.withColumn("__blk", F.expr(f"`{us}` div {int(block)}L"))

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(batches, [actor, "__blk"]):
            t = pdf[us].to_numpy()
            found = [_exits(t[lo:hi], window) for lo, hi in zip(cuts, cuts[1:])]
            yield pd.DataFrame(
                {
                    actor: pdf[actor].iloc[cuts[:-1]].to_numpy(),
                    "__blk": pdf["__blk"].iloc[cuts[:-1]].to_numpy(),
                    "cand": [f[0] for f in found],
                    "ends": [f[1] for f in found],
                }
            )

    actor_type = requests.schema[actor].dataType.simpleString()
    slim = rows.select(actor, "__blk", us).distinct().repartition(actor, "__blk").sortWithinPartitions(actor, "__blk", us)
    per_block = slim.mapInPandas(exits, f"{actor} {actor_type}, __blk bigint, cand array<bigint>, ends array<bigint>")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start = None, _NEVER
        for pdf in batches:
            entry = []
            for a, cand, ends in zip(pdf[actor], pdf["cand"], pdf["ends"]):
                if a != who:
                    who, start = a, _NEVER
                entry.append(start)
                i = np.searchsorted(cand, start + window, side="right")
                if i < len(cand):
                    start = int(ends[i])
            yield pd.DataFrame({actor: pdf[actor], "__blk": pdf["__blk"], "__entry": entry})

    entries = (
        per_block.repartition(actor)
        .sortWithinPartitions(actor, "__blk")
        .mapInPandas(carry, f"{actor} {actor_type}, __blk bigint, __entry bigint")
    )

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start = None, _NEVER
        for pdf in batches:
            t, entry = pdf[us].to_numpy(), pdf["__entry"].to_numpy()
            starts, cuts = np.empty(len(t), np.int64), _bordered(pdf, [actor, "__blk"])[1]
            for lo, hi in zip(cuts[: len(pdf)], cuts[1:]):
                here = (pdf[actor].iat[lo], pdf["__blk"].iat[lo])
                if here != last:
                    last, start = here, int(entry[lo])
                i = lo
                while i < hi:
                    if t[i] > start + window:
                        start = int(t[i])
                    j = i + int(np.searchsorted(t[i:hi], start + window, side="right"))
                    starts[i:j] = start
                    i = j
            yield pdf.drop(columns=["__blk", "__entry"]).assign(window_start=starts)

    schema = requests.select("*", F.lit(0).cast("bigint").alias("window_start")).schema
    # By a digest of the keys: a repartition by the join's own keys is dropped from the plan, and the join then may
    # read its shuffle in other pieces, which parts the rows of a block.
    dealt = rows.join(entries, [actor, "__blk"]).repartition(F.xxhash64(actor, "__blk"))
    joined = dealt.sortWithinPartitions(actor, "__blk", us)
    return joined.select(*requests.columns, "__blk", "__entry").mapInPandas(mark, schema)


def decide_part(costs: np.ndarray, used: int, spent: float, max_requests: int, max_cost: float) -> tuple[np.ndarray, int, float]:
    """The next requests of a window: 0 accepted, 1 over the rate, 2 over the cost; and what is used and spent after them.

    A denied request consumes nothing. Decisions come in runs: how far a run of
    accepted requests reaches is read from running sums over stretches of
    doubling length, and the end of a run of dear ones from what is left. The
    sums are those of a request after the other, so they round alike.
    """
    out, i, step = np.ones(len(costs), np.int64), 0, 16
    while i < len(costs) and used < max_requests:
        part = costs[i : i + min(step, max_requests - used)]
        sums = np.cumsum(np.concatenate([[spent], part]))[1:]
        over = np.flatnonzero(sums > max_cost)
        good = int(over[0]) if len(over) else len(part)
        if good:
            out[i : i + good], used, spent, i = 0, used + good, float(sums[good - 1]), i + good
        step *= 2
        if good < len(part):
            step = 16
            while i < len(costs):
                part = costs[i : i + step]
                fits = np.flatnonzero(spent + part <= max_cost)
                end = i + (int(fits[0]) if len(fits) else len(part))
                out[i:end], i, step = 2, end, step * 2
                if len(fits):
                    break
            step = 16
    return out, used, spent


def rate_cost_decisions(
    requests: DataFrame,
    actor: str = "actor",
    ts: str = "ts",
    tokens: str = "tokens",
    tie: str = "request_id",
    max_requests: int = MAX_REQUESTS,
    window_us: int = WINDOW_US,
    max_cost: float = MAX_COST,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Allow or deny every request; the rows of one actor and window stay in one task, which carries three numbers through them."""
    rows = requests.withColumns({"us": F.unix_micros(ts), "cost": request_cost(F.col(tokens))})
    marked = window_starts(rows, actor, "us", window_us, block_us)
    schema = marked.select("*", F.lit("").alias("decision")).schema

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, last, used, spent = np.array([OK, RATE, COST], object), None, 0, 0.0
        for pdf in batches:
            costs, out = pdf["cost"].to_numpy(), np.zeros(len(pdf), np.int64)
            cuts = _bordered(pdf, [actor, "window_start"])[1]
            for lo, hi in zip(cuts[: len(pdf)], cuts[1:]):
                here = (pdf[actor].iat[lo], pdf["window_start"].iat[lo])
                if here != last:
                    last, used, spent = here, 0, 0.0
                out[lo:hi], used, spent = decide_part(costs[lo:hi], used, spent, max_requests, max_cost)
            yield pdf.assign(decision=names[out])

    ordered = marked.repartition(actor, "window_start").sortWithinPartitions(actor, "window_start", "us", tie)
    return ordered.mapInPandas(decide, schema).withColumn("allowed", F.col("decision") == OK)
