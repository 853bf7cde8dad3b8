"""Toxicity by a support vector machine on a gapped subsequence string kernel.

The kernel of two words counts common subsequences of ``LENGTH`` characters
inside a span of at most ``SPAN``, each weighted by ``DECAY`` per character
left out, and is normalised to 1 for equal words; so an insult with inserted
or changed characters stays close to the insult. Landmark words are chosen
from labelled documents, the Nyström map makes the kernel linear, and a linear
machine with squared hinge loss separates words of toxic documents from words
of clean ones; clean words on the wrong side are learned again. A document is as toxic as its worst word; a logistic curve,
fitted to the labelled documents, turns that into a score from 0 to 1.

The machine is fitted on at most ``SAMPLE`` labelled documents of each class
(those with the smallest hash of doc_id); every row is then scored, whole.
Since the map is linear, a fitted machine is one weight per subsequence.

Defined results: text null or "" has no words and the lowest score; repeated
rows score alike; conflicting labels of one document count as toxic; null
labels or ids teach nothing; a null doc_id is held out; without toxic and
clean labels every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_memory

LENGTH = 4
SPAN = 6
DECAY = 0.6
#: Labelled documents of each class, words of each class, and landmarks of each class to learn from.
SAMPLE = 3000
WORDS = 12_000
LANDMARKS = 64
#: Weight of a clean word that was once taken for toxic.
HARD = 5.0
#: Share of words that may be taken for telling by chance, of those that are rarer than a fixed share of the toxic documents.
FALSE = 0.01
#: Tokens remembered per Python worker; beyond that only those of the present texts are kept. It changes no result.
REMEMBERED = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")
#: Four or more single characters with a blank or a mark between them, an insult spelt out.
_SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]+){3,}[^\W\d_](?!\S)")


def letters(token: str) -> str:
    """The letters of a token in lower case; marks inside it are left out."""
    return "".join(_LETTERS.findall(token.lower()))


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens between blanks, and spelt-out words as one token each."""
    if not text:
        return set()
    out = set(text.split())
    out.update(_SPELT.findall(text))
    return out


def _choices(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences in a word of ``n`` characters and their weights."""
    if n < LENGTH:  # a short word is one subsequence
        return np.arange(n)[None, : n or None][: min(n, 1)], np.ones(min(n, 1))
    rest = [(i, j, k) for i in range(1, SPAN) for j in range(i + 1, SPAN) for k in range(j + 1, SPAN)]
    steps = np.array([(0, *r) for r in rest], np.int64)
    places = (np.arange(n)[:, None, None] + steps[None]).reshape(-1, LENGTH)
    places = places[places[:, -1] < n]
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0 - LENGTH)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one length at a time: their numbers, codes of all places (a row per word) and weights of the places."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        places, weights = _choices(int(n))
        if not len(places):
            continue
        rows = np.flatnonzero(lengths == n)
        chars = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), "<u4").reshape(len(rows), n).astype(np.uint64)
        chars &= np.uint64(0xFFFF)
        codes = chars[:, places[:, 0]]
        for k in range(1, places.shape[1]):
            codes <<= np.uint64(16)
            codes |= chars[:, places[:, k]]
        yield rows, codes, weights


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, code and weight of every distinct subsequence of every word (weights of equal ones added up)."""
    owner, code, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for rows, codes, weights in _by_length(words):
        owner.append(np.repeat(rows, codes.shape[1]))
        code.append(codes.ravel())
        weight.append(np.tile(weights, len(rows)))
    owner, code, weight = np.concatenate(owner), np.concatenate(code), np.concatenate(weight)
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    first = np.flatnonzero(np.r_[len(owner) > 0, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]) if len(owner) else np.zeros(0, np.int64)
    return owner[first], code[first], np.add.reduceat(weight, first) if len(first) else weight


def self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel of each word (row) with itself; equal subsequences of a word are added up first."""
    out = np.full(len(codes), float(weights @ weights))
    order = np.argsort(codes, axis=1)
    ordered = np.take_along_axis(codes, order, axis=1)
    twice = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
    if len(twice):
        ordered = ordered[twice]
        first = np.ones(ordered.shape, bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        at = np.flatnonzero(first.ravel())
        total = np.add.reduceat(weights[order[twice]].ravel(), at)
        out[twice] = np.bincount(at // codes.shape[1], total**2, len(twice))
    return out


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each other word."""
    wo, wc, ww = subsequences(words)
    oo, oc, ow = subsequences(others)
    out = np.zeros((len(words), len(others)))
    codes = np.unique(oc)
    table = np.zeros((len(codes), len(others)))
    if len(codes):
        table[np.searchsorted(codes, oc), oo] = ow
        at = np.minimum(np.searchsorted(codes, wc), len(codes) - 1)
        hit = codes[at] == wc
        for lo in range(0, int(hit.sum()), 20_000):
            pick = np.flatnonzero(hit)[lo : lo + 20_000]
            np.add.at(out, wo[pick], table[at[pick]] * ww[pick, None])
    norm = np.sqrt(np.bincount(wo, ww**2, len(words)))[:, None] * np.sqrt(np.bincount(oo, ow**2, len(others)))[None]
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


@dataclass
class Machine:
    """Weight of each subsequence code, bias, and the logistic curve over a document's worst word."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def values(self, words: list[str], step: int = 20_000) -> np.ndarray:
        """Distance of each word from the machine's boundary."""
        parts = [self._values(words[at : at + step]) for at in range(0, len(words), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _values(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        if not len(self.codes):
            return out
        # Slots by the highest bits of a product; codes that share a slot get tables of their own.
        bits, tables, left = np.uint64(64 - 18), [], np.arange(len(self.codes))
        while len(left):
            factor = np.uint64((2 * len(tables) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            slots = (self.codes[left] * factor) >> bits
            _, first = np.unique(slots, return_index=True)
            table, at = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18)
            table[slots[first]], at[slots[first]] = self.codes[left[first]], self.weights[left[first]]
            tables.append((factor, table, at))
            left = np.delete(left, first)
        for rows, codes, weights in _by_length(words):
            total = np.zeros(len(rows))
            for factor, table, at in tables:
                slots = (codes * factor) >> bits
                total += np.where(table[slots] == codes, at[slots], 0.0) @ weights
            hit = np.flatnonzero(total)
            out[rows[hit]] += total[hit] / np.sqrt(self_kernel(codes[hit], weights))
        return out

    def worst(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """Highest value of a word of each text; ``known`` remembers tokens."""
        out = np.full(len(texts), self.bias)
        for lo in range(0, len(texts), 200):
            part = [tokens_of(t) for t in texts[lo : lo + 200]]
            words = set().union(*part)
            if len(known) > REMEMBERED:
                kept = {w: known[w] for w in words & known.keys()}  # mostly those that come again everywhere
                known.clear()
                known.update(kept)
            new = list(words - known.keys())
            known.update(zip(new, self.values([letters(t) for t in new]).tolist(), strict=True))
            for i, bag in enumerate(part, lo):
                if bag:
                    out[i] = max(self.bias, max(map(known.__getitem__, bag)))
        return out

    def scores(self, worst: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(worst))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


def nothing_learned() -> Machine:
    return Machine(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0, 0.0)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of ``z`` is 1."""
    w = np.zeros(z.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(40):
        inside = y * (z @ w) < 1
        zi, yi, ci = z[inside], y[inside], weight[inside]
        new = np.linalg.solve((zi * ci[:, None]).T @ zi + np.diag(reg), (zi * ci[:, None]).T @ yi)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, y), with Platt's smoothed targets; toxic rows weigh a fifth."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.2 / n1, 0.8 / n0) * len(y)
    f = np.c_[x, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -50, 50)))
        grad = f.T @ (weight * (p - target)) + 1e-3 * w
        step = np.linalg.solve((f * (weight * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), grad)
        w = w - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def without_copies(bags: list[tuple[int, np.ndarray]], hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Leaves out bags of words that share three smallest hashes (in one of 4 draws) with an earlier one.

    Copies of one document would otherwise make its chance words look telling.
    """
    seen, out = [set() for _ in range(4)], []
    for y, bag in bags:
        h = hashes[bag]
        keys = [tuple(int((h * np.uint64(2 * (3 * d + k) + 3) ^ (h >> np.uint64(7 + d))).min(initial=2**64 - 1)) for k in range(3)) for d in range(4)]
        if not any(k in s for k, s in zip(keys, seen, strict=True)):
            out.append((y, bag))
        for k, s in zip(keys, seen, strict=True):
            s.add(k)
    return out


def significant(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Words that stand in toxic documents more often than chance puts them; at most ``FALSE`` of these by chance (Benjamini-Hochberg)."""
    p, share = np.ones(len(toxic)), n1 / (n1 + n0)
    tested = np.flatnonzero(9 * clean <= toxic)
    pairs, back = np.unique(np.c_[toxic[tested], clean[tested]], axis=0, return_inverse=True)
    tails = [sum(math.exp(math.lgamma(a + b + 1) - math.lgamma(j + 1) - math.lgamma(a + b - j + 1) + j * math.log(1 - share) + (a + b - j) * math.log(share)) for j in range(b + 1)) for a, b in pairs.tolist()]
    p[tested] = np.array(tails)[back.ravel()] if tails else p[tested]
    ordered = np.sort(p)
    passed = np.flatnonzero(ordered <= FALSE * np.arange(1, len(p) + 1) / max(1, len(p)))
    return p <= ordered[passed[-1]] if len(passed) else np.zeros(len(p), bool)


def fit(rows: Iterable[tuple[int, Iterable[str]]]) -> Machine:
    """A machine from (label, words) of documents."""
    ids: dict[str, int] = {}
    bags = [(y, np.array(sorted({ids.setdefault(w, len(ids)) for w in words}), np.int32)) for y, words in rows]
    words = list(ids)
    del ids
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    bags = without_copies(bags, hashes)
    n = Counter(y for y, _ in bags)
    if not n[0] or not n[1]:
        return nothing_learned()
    count = [np.bincount(np.concatenate([bag for y, bag in bags if y == c]).astype(np.int64), minlength=len(words)) for c in (0, 1)]
    usable = np.fromiter(map(len, words), np.int64, len(words)) > 0
    # A word is telling if it stands almost only in toxic documents, and in more than chance would put it.
    least = min(n[1], max(4, round(0.015 * n[1])))
    enough = (count[1] >= least) | significant(count[1], count[0], n[1], n[0])
    telling = np.flatnonzero(usable & enough & (9 * count[0] <= count[1]) & (count[1] * n[0] > 4 * n[1] * count[0]))
    telling = sorted(telling, key=lambda i: (-count[1][i], words[i]))[:WORDS]
    every_clean = np.flatnonzero(usable & (count[0] > 0) & (2 * count[1] * n[0] <= 3 * n[1] * count[0]))
    clean = every_clean[np.argsort(hashes[every_clean], kind="stable")][:WORDS]
    bad, good = [words[i] for i in telling], [words[i] for i in clean]
    if not bad or not good:
        return nothing_learned()
    # Landmarks: telling words that are not too close to one another, and clean words.
    pool = bad[: 4 * LANDMARKS]
    near = kernel(pool, pool)
    at: list[int] = []
    for i in range(len(pool)):
        if len(at) < LANDMARKS and (not at or near[i, at].max() < 0.8):
            at.append(i)
    chosen = [pool[i] for i in at] + good[:LANDMARKS]
    values, vectors = np.linalg.eigh(kernel(chosen, chosen) + 1e-3 * np.eye(len(chosen)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    # Insults with a character written twice or left over, so that gapped forms count as toxic too.
    gapped = [w[: len(w) // 2] + c + w[len(w) // 2 :] for w in bad if len(w) >= LENGTH for c in (w[len(w) // 2], "x")]
    plain = np.sqrt(count[1][telling])
    weight = np.r_[plain, np.repeat(plain[[len(w) >= LENGTH for w in bad]] / 4, 2)]
    owner, code, own = subsequences(chosen)
    norm = np.sqrt(np.bincount(owner, own**2, len(chosen)))
    codes, back = np.unique(code, return_inverse=True)
    positive = kernel(bad + gapped, chosen) @ root
    near: list[int] = []
    for turn in range(3):
        # After the first turn the clean words that the machine takes for toxic are learned too.
        some = good + [words[i] for i in near]
        z = np.r_[positive, kernel(some, chosen) @ root]
        y = np.r_[np.ones(len(positive)), -np.ones(len(some))]
        ballast = np.r_[np.ones(len(good)), np.full(len(near), HARD)]
        w = _svm(np.c_[z, np.ones(len(y))], y, np.r_[weight / weight.sum() * ballast.sum(), ballast])
        alpha = root @ w[:-1]
        made = Machine(codes, np.bincount(back, own * alpha[owner] / norm[owner], len(codes)), float(w[-1]), 1.0, 0.0)
        if turn < 2:
            value = made.values([words[i] for i in every_clean])
            top = np.argsort(-value, kind="stable")[: WORDS // 4]
            near = sorted({*near, *every_clean[top[value[top] > -0.5]].tolist()})
    value = made.values(words)
    worst = np.array([value[bag].max(initial=made.bias) for _, bag in bags])
    made.slope, made.shift = _logistic(worst, np.array([y for y, _ in bags], float))
    return made


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: one in five by the checksum of the id, and those without id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from the labelled documents that are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = marks.join(texts.select("doc_id").distinct(), "doc_id")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])  # at most 2 * sample rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted({letters(t) for t in tokens_of(text)} - {""})) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["doc_id", "toxic", "words"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(bags, "doc_id long, toxic int, words string").collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit((r["toxic"], r["words"].split()) for r in got)


def score(text: Column, machine: Machine) -> Column:
    """Score of every text under a fitted machine."""
    name = f"toxicity {xxhash.xxh3_64_hexdigest(machine.codes.tobytes() + machine.weights.tobytes())}"

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        known = worker_memory(name)
        return pd.Series(machine.scores(machine.worst([t if isinstance(t, str) else None for t in texts], known)))

    return run(text.cast("string"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    machine = train(docs, labels, sample)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score(F.col("text"), machine).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    machine = train(docs, labels, sample)
    return docs.withColumn("__score", score(F.col("text"), machine)).where(F.col("__score") < 0.5).drop("__score")
