"""Interleaved range coder (static asymmetric numeral system) for one block of token ids, in numpy.

A block is coded by ``lanes`` independent states in lockstep: step t takes ids
t * lanes .. (t + 1) * lanes - 1. States are 64 bits wide and give off 32-bit
words; probabilities are multiples of 2 ** -SCALE. Every ``every`` steps the
states and the place in the words are written down, so a block can be decoded
from any such checkpoint, by several readers at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 1024
EVERY = 128
MAGIC = b"RAN1"
_HEAD = "<4sIIIIIII"  # magic, ids, lanes, every, checkpoints, words, documents, crc32 of the ids
HEAD_SIZE = 32
_U = np.uint64


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE, at least 1 for every id that occurs.

    Rounded down first; what is missing goes to, and what is too much comes
    from, the most frequent ids.
    """
    total = int(counts.sum())
    freq = np.zeros(len(counts), np.int64)
    if total == 0:
        return freq
    used = counts > 0
    freq[used] = np.maximum(1, (counts[used].astype(object) * (1 << SCALE) // total).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    rest = (1 << SCALE) - int(freq.sum())
    while rest:
        for s in order:
            if rest > 0:
                freq[s] += rest
                rest = 0
            elif rest < 0 and freq[s] > 1:
                take = min(freq[s] - 1, -rest)
                freq[s] -= take
                rest += take
            if not rest:
                break
    return freq


class Model:
    """Frequency table with what coding and decoding look up."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq).astype(_U)
        ends = np.cumsum(self.freq)
        self.start = ends - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode(ids: np.ndarray, model: Model, docs: list[tuple[int | None, int]]) -> bytes:
    """One block; ``docs`` are (doc_id or None, number of ids) in order."""
    n = len(ids)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, _U)
    words, marks, count = [], {}, 0
    freq, start = model.freq[ids], model.start[ids]
    shift, low32, scale = _U(63 - SCALE), _U(32), _U(SCALE)
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], start[t * lanes : (t + 1) * lanes]
        s = x[: len(f)]
        full = s >= (f << shift)
        if full.any():
            out = s[full]
            words.append(out.astype(np.uint32))
            s[full] = out >> low32
            count += len(out)
        q = s // f
        x[: len(f)] = (q << scale) + (s - q * f) + c
        if t % EVERY == 0:
            marks[t] = (count, x.copy())
    words.reverse()
    points = [(count - at, state) for _, (at, state) in sorted(marks.items())]
    body = b"".join(struct.pack("<I", at) + state.astype("<u8").tobytes() for at, state in points)
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    index = b"".join(struct.pack("<?qI", d is not None, d or 0, k) for d, k in docs)
    head = struct.pack(_HEAD, MAGIC, n, lanes, EVERY, len(points), count, len(docs), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + index + body + stream


def documents(block: bytes) -> list[tuple[int | None, int]]:
    head = struct.unpack_from(_HEAD, block)
    rows = struct.iter_unpack("<?qI", block[HEAD_SIZE : HEAD_SIZE + 13 * head[6]])
    return [(d if there else None, k) for there, d, k in rows]


def checkpoints(block: bytes) -> int:
    return struct.unpack_from(_HEAD, block)[4]


def decode(block: bytes, model: Model, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from checkpoint ``first`` up to checkpoint ``last`` (end of the block if None)."""
    magic, n, lanes, every, points, count, docs, crc = struct.unpack_from(_HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = HEAD_SIZE + 13 * docs
    size = 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", count, at + points * size)
    whole = first == 0 and last is None
    last = points if last is None else last
    if n == 0 or first >= last:
        return np.zeros(0, np.uint32)
    (pos,) = struct.unpack_from("<I", block, at + first * size)
    x = np.frombuffer(block, "<u8", lanes, at + first * size + 4).astype(_U)
    end = min(n, last * every * lanes)
    out = np.empty(end - first * every * lanes, np.uint32)
    mask, scale, low32 = _U((1 << SCALE) - 1), _U(SCALE), _U(32)
    for i in range(0, len(out), lanes):
        k = min(lanes, len(out) - i)
        s = x[:k]
        slot = s & mask
        sym = model.symbol[slot]
        out[i : i + k] = sym
        s = model.freq[sym] * (s >> scale) + slot - model.start[sym]
        need = s < LOW
        m = int(np.count_nonzero(need))
        if m:
            s[need] = (s[need] << low32) | words[pos : pos + m]
            pos += m
        x[:k] = s
    if whole and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not match")
    return out
