"""Whole-batch text helpers over Arrow and numpy, shared by the operators.

Words are maximal runs of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bounds what a Python worker holds for one slice: its words and their codes take many times the text.
SLICE_BYTES = 3 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text each; a longer row stands alone."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    # idle workers share the executor's memory with the next stage
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each text where its words begin (one more entry at the end)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words, the texts' offsets into them, and the distinct words that the codes mean."""
    flat, offsets = split_words(texts, lower)
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), offsets, coded.dictionary.to_pylist()


def hash_words(words: list[str], seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass"), seed) for w in words), dtype=np.uint64, count=len(words))


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    z = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values (their own hashes given); shorter input gives none."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    size = len(codes) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix(out ^ codes[k : k + size], k)
    return out


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each segment; empty segments give zero."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
