"""Tokens and signed-hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 384
# Words that a Python worker takes at once; a batch of long texts holds many millions, each of which costs some hundred bytes.
SLICE_WORDS = 1_000_000
_WORD = "[a-z0-9][a-z0-9_-]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def bigrams(word_list: Column) -> Column:
    n = F.size(word_list)
    return F.zip_with(
        F.slice(word_list, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(word_list, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )


def tokenize(text: Column) -> Column:
    """Words, then adjacent pairs joined by an underscore."""
    w = words(text)
    return F.when(F.size(w) > 1, F.concat(w, bigrams(w))).otherwise(w)


def _digests(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hash and sign per distinct token."""
    blake2b = hashlib.blake2b
    made = b"".join([blake2b(t, digest_size=8).digest() for t in tokens.cast(pa.large_binary()).to_pylist()])
    octets = np.frombuffer(made, np.uint8).reshape(-1, 8)
    heads = np.ascontiguousarray(octets[:, :4]).view(">u4").ravel().astype(np.int64)
    return heads, 1.0 - 2.0 * (octets[:, 4] % 2)


def encode_tokens(word_lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and dictionary code of every word and adjacent pair, and the dictionary."""
    if isinstance(word_lists, pa.ChunkedArray):
        word_lists = word_lists.combine_chunks()
    rows = pc.list_parent_indices(word_lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(word_lists).cast(pa.large_string())
    if len(flat) == 0:
        return rows, rows, flat
    pairs = pc.binary_join_element_wise(flat[:-1], flat[1:], pa.scalar("_", pa.large_string()))
    same = rows[:-1] == rows[1:]
    coded = pa.concat_arrays([flat, pairs.filter(pa.array(same))]).dictionary_encode()
    return np.concatenate([rows, rows[:-1][same]]), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _matrix(n: int, rows: np.ndarray, codes: np.ndarray, dictionary: pa.Array, dims: int) -> np.ndarray:
    if not len(codes):
        return np.zeros((n, dims))
    heads, signs = _digests(dictionary)
    matrix = np.bincount(rows * dims + (heads % dims)[codes], weights=signs[codes], minlength=n * dims).reshape(n, dims)
    norms = np.sqrt((matrix**2).sum(axis=1))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def embed_batch(word_lists: pa.Array, dims: int = DIMS) -> np.ndarray:
    """L2-normalised matrix of one Arrow batch of word lists.

    Pairs are built by Arrow kernels; the digest runs once per distinct token
    of the batch and the sums are one ``bincount``.
    """
    return _matrix(len(word_lists), *encode_tokens(word_lists), dims)


def _slices(word_lists: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """A batch of word lists in parts of about ``most`` words, one list at least."""
    if isinstance(word_lists, pa.ChunkedArray):
        word_lists = word_lists.combine_chunks()
    counts = pc.fill_null(pc.list_value_length(word_lists), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(counts, dtype=np.int64) - counts) // (most or SLICE_WORDS)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(counts)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield word_lists.slice(lo, hi - lo)


def _vectors(parts: Iterator[np.ndarray], dims: int) -> pa.Array:
    """Rows of matrices as one array of lists."""
    flat = pa.concat_arrays([pa.array([], pa.float64()), *(pa.array(m.ravel()) for m in parts)])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), flat)


def hash_embed_udf(dims: int = DIMS):
    """UDF: word list to a dense unit vector."""

    @F.arrow_udf("array<double>")
    def hash_embed(word_lists: pa.Array) -> pa.Array:
        return _vectors((embed_batch(part, dims) for part in _slices(word_lists)), dims)

    return hash_embed


def concept_udf(vectors: np.ndarray, token_sets: list[list[str]]):
    """UDF: word list to its cosines with a few fixed unit vectors, followed by
    the share of each one's tokens that the list contains."""
    table = np.ascontiguousarray(vectors.T)
    k = table.shape[1]
    names = sorted({t for ts in token_sets for t in ts})
    wanted = pa.array(names, pa.large_string())
    member = np.array([[float(t in ts) for ts in token_sets] for t in names])
    sizes = np.array([len(ts) for ts in token_sets], dtype=float)

    def scores_of(word_lists: pa.Array) -> np.ndarray:
        n = len(word_lists)
        rows, codes, dictionary = encode_tokens(word_lists)
        scores = np.zeros((n, 2 * k))
        if len(codes):
            scores[:, :k] = _matrix(n, rows, codes, dictionary, table.shape[0]) @ table
            # Presence of the few tokens that some vector has, then shares by a small product.
            slot = pc.index_in(dictionary, wanted).to_numpy(zero_copy_only=False)[codes]
            hit = ~np.isnan(slot)
            present = np.zeros((n, len(wanted)))
            present[rows[hit], slot[hit].astype(np.int64)] = 1.0
            scores[:, k:] = present @ member / sizes
        return scores

    @F.arrow_udf("array<double>")
    def concepts(word_lists: pa.Array) -> pa.Array:
        return _vectors((scores_of(part) for part in _slices(word_lists)), 2 * k)

    return concepts


def embed_texts(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Vectors of a handful of constants, worked out on the driver."""
    import re

    lists = [re.findall(_WORD, t.lower()) for t in texts]
    return embed_batch(pa.array(lists, pa.list_(pa.string())), dims)
