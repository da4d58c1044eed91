"""Groups of documents whose sets of 5-word shingles are at least 0.8 alike (Jaccard), verified on the sets.

A pair that is 0.8 alike differs in some ten of a fingerprint's 64 bits.  No split of 64 bits lets a tree over the
Hamming distance prune at that radius, so the SimHash links (three bits, over the same shingles) are joined by the
links of equal min-hash bands: BANDS bands of BAND_ROWS functions find a pair of similarity s with probability
1 - (1 - s ** BAND_ROWS) ** BANDS, 0.9996 at 0.8.  Documents with the same set of shingles are one from the start.

The candidate links only say what may belong together.  Their connected components are walked breadth first on the
exact sets, and a link is kept if it is at least ``similarity``.  A component beyond ``CELL_WORDS`` words is dealt out
as a grid of blocks, so every pair of it meets in one task of bounded size.

Nulls and edge cases: words as in the SimHash operator; a text of fewer words than a shingle is one shingle; null and
blank texts are copies of one another; a very long text is one set, in a slice of its own; a row with a null doc_id
is left out; rows with equal doc_id are documents of their own, told apart by their texts; of a group the row with
the smallest doc_id, then the smallest hash of its text, is the first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.components import connected_components
from tidelog.llm.scratch import Scratch
from tidelog.llm.textops import coded_words, hash_words, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 5
#: Words of a block; a task holds two blocks of a component.
CELL_WORDS = 1 << 19


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    codes, offsets, words = coded_words(texts, lower=True)
    hashes = hash_words(words)
    words_of = np.diff(offsets)
    counts = np.where(words_of > 0, np.maximum(1, words_of - shingle + 1), 0)
    doc = np.repeat(np.arange(len(texts)), counts)
    start = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(doc))
    own = hashes[codes] if len(codes) else np.empty(0, np.uint64)
    rolled = np.zeros(len(doc), np.uint64)
    for k in range(shingle):
        # a text shorter than a shingle ends early
        there = start + k < offsets[doc + 1]
        rolled[there] = mix(rolled[there] ^ own[start[there] + k], k)
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the hashes of its text and of its set, its words, its fingerprint and its band hashes (none for a blank text) for each row with an id."""
    rng = np.random.default_rng(5)
    flips = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, offsets = shingle_sets(part.column("text"), shingle)
                full = np.flatnonzero(np.diff(offsets))
                bands = np.zeros((len(full), BANDS), np.uint64)
                for k in range(BANDS * BAND_ROWS if len(full) else 0):
                    least = np.minimum.reduceat((sets ^ flips[k]) * factors[k], offsets[full])
                    bands[:, k // BAND_ROWS] = mix(bands[:, k // BAND_ROWS] ^ least, k)
                key = [xxhash.xxh64_intdigest(sets[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                held = np.zeros(part.num_rows + 1, np.int32)
                held[full + 1] = BANDS
                prints = [simhash.fingerprint(t, shingle) for t in part.column("text").to_pylist()]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("hash"), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.diff(offsets)), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum(held, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))],
                    names=["doc_id", "hash", "key", "words", "fp", "bands"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("hash"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return chosen.mapInArrow(run, "doc_id long, hash long, key long, words long, fp long, bands array<long>")


def text_hash(text_col: str) -> Column:
    """Tells rows of the same doc_id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def verified(sets: np.ndarray, offsets: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest (pairs of rows) of the links of at least ``similarity`` between all sets."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    codes = np.unique(sets, return_inverse=True)[1]
    doc = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    holders = doc[order]
    begins = np.searchsorted(codes[order], np.arange(codes.max(initial=-1) + 2))
    waiting = np.ones(n, bool)
    left, right = [], []
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            own = codes[offsets[at] : offsets[at + 1]]
            counts = begins[own + 1] - begins[own]
            rows = np.repeat(begins[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            common = np.bincount(holders[rows], minlength=n)
            # common / union, in whole numbers but for the threshold
            close = np.flatnonzero(waiting & (common >= similarity * (sizes + sizes[at] - common) - 1e-9) & (common > 0))
            waiting[close] = False
            left += [at] * len(close)
            right += close.tolist()
            queue += close.tolist()
    return left, right


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", cell_words: int = CELL_WORDS) -> DataFrame:
    """doc_id, hash (of the text), component (the group's smallest doc_id), first (whether this is the group's first row) of each row with an id."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    prints = scratch.keep(sketches(docs, shingle, id_col, text_col), "sketches")
    # the nodes are the sets; one row stands for each
    distinct = scratch.keep(prints.groupBy("key").agg(F.min(F.struct("doc_id", "hash", "words", "fp", "bands")).alias("least")).select("key", "least.*"), "distinct")
    buckets = distinct.select(F.col("key").alias("a"), F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    alike = buckets.join(shared, ["band", "hash"]).where("a != b").select("a", "b")
    by_print = scratch.keep(distinct.groupBy("fp").agg(F.min("key").alias("node")), "prints")
    same_print = distinct.join(by_print, "fp").where("key != node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    near_print = simhash.links(by_print.select("node", "fp"), scratch)
    coarse = connected_components(scratch.keep(alike.union(same_print).union(near_print).distinct(), "candidates"), scratch)
    # one row of each set, with its component's size
    members = scratch.keep(distinct.select("key", "doc_id", "hash", "words").join(coarse.withColumnRenamed("node", "key"), "key"), "members")
    sizes = members.groupBy("component").agg(F.sum("words").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", F.ceil(F.greatest(F.lit(1), F.col("all")) / cell_words).alias("across"))
    members = members.join(sizes, "component").select("key", "doc_id", "hash", "component", "across", F.pmod(F.xxhash64("key"), F.col("across")).alias("own"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda x: F.least(x, F.col("own")) * F.col("across") + F.greatest(x, F.col("own")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("hash"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    # the members grow with the corpus: the same join at every size
    placed = texts.join(members.hint("merge"), ["doc_id", "hash"]).select("key", "text", "component", F.explode(cells).alias("cell"))

    def compare(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        sets, offsets = shingle_sets(table.column("text").combine_chunks(), shingle)
        left, right = verified(sets, offsets, similarity)
        return pa.table({"a": pa.array(key[left], pa.int64()), "b": pa.array(key[right], pa.int64())})

    links = placed.groupBy("component", "cell").applyInArrow(compare, "a long, b long")
    groups = connected_components(scratch.keep(links, "links"), scratch)
    roots = distinct.select("key", "doc_id", "hash").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("component", "key")).drop("component")
    least = roots.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("least"))
    roots = scratch.keep(roots.select("key", "root").join(least, "root").select("key", "least"), "roots")
    out = prints.select("doc_id", "hash", "key").join(roots, "key")
    return scratch.finish(out.select("doc_id", "hash", F.col("least.doc_id").alias("component"), (F.struct("doc_id", "hash") == F.col("least")).alias("first")))
