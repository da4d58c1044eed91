"""Passages that repeat across documents, word for word or nearly, found with compact windows.

A text's tokens are its shingles of ``shingle`` lower-cased words.  Under one min-hash function, the Cartesian
tree over the tokens' hashes has for each token the widest interval in which it is the smallest: all
subsequences inside that interval and around the token share it as their signature.  Only nodes wide enough
for a passage of ``min_words`` words matter, and those are the minima of the sliding windows of that width: a
compact window is a run of windows that keep their minimum.  So the tree needn't be built.

1. Functions come in bands of two.  Where the compact windows of a band's functions overlap by a passage, both
   signatures make a key.  Passages whose token sets are s alike share a
   band's key with a probability near s * s, and one of BANDS keys at least with 1 - (1 - s * s) ** BANDS, for each
   ``min_words`` words that they have; equal passages share all.  Keys are counted over all documents.
2. Keys met at least twice make a Bloom filter of bounded size, which goes to all tasks.  A second pass over the
   texts keeps the compact windows that hit it, and the words' hashes of the places where some did, in tiles of
   ``TILE`` words.  A filter that is too full lets more windows pass and loses none: then the second pass writes all
   windows, some two or three times the text, and the work stays in proportion to the corpus.
3. Windows are grouped by key.  Each one is paired with its group's first (smallest doc_id), not with all others.
   Pairs are gathered by tiles, which is the interval join: what the functions agree on says which tiles to compare, and
   along which diagonals.
4. Both tiles' words are compared along these diagonals, and along those near them where words were lost or added.  A span counts if at least ``similarity`` of its words agree,
   in runs of three or more (maximal scoring segments over the agreeing and the other words).  Spans that meet
   at the edges of tiles are joined, and those of ``min_words`` words or more are passages.

A passage that a document shares with several earlier ones has a row for each of them that is first in some group;
passages of one earlier document that follow each other are one span, in whatever order that document holds them.
A passage that many documents share costs one row for each holder and key.  Near-duplicate pairs are missed if they share
no key, or if in each group that they share the first document holds neither of their passages.

Nulls and edge cases: a null, empty or short text has no passages; a very long text is one row, in a slice of its own;
a null doc_id cannot be reported and its row is left out of the passages (``remove_repeats`` keeps it unchanged); rows
with the same doc_id count as one document, whose rows are told apart by their texts' hash; equal rows count once; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch, unused
from tidelog.llm.textops import coded_words, hash_words, mix, ngram_hashes, slices

MIN_WORDS = 50
SHINGLE = 5
BANDS = 4
SIMILARITY = 0.8
#: Fewest words of a run that agrees, and words by which spans of one pair of documents may lie apart.
RUN = 3
GAP = 2
#: Words of a tile, and words that it holds of its neighbours.
TILE = 512
MARGIN = 64
#: Diagonals on either side that are tried where words are lost or added, and the share that agrees from which none is.
NEAR = 16
ENOUGH = 0.98
#: Bits of the filter: for each key, and at most.
KEY_BITS = 16
MAX_BITS = 1 << 27


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` values."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


class Words:
    """Hashed words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        codes, self.offsets, distinct = coded_words(texts, lower=True)
        self.hashes = hash_words(distinct, 7)[codes] if len(distinct) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))

    def compact_windows(self, band: int, min_words: int, shingle: int) -> tuple[np.ndarray, ...]:
        """For each pair of compact windows of the band's functions that share a passage: key, first and last start of these passages, place of the first token."""
        n = len(self.hashes)
        width = min_words - shingle + 1
        empty = np.empty(0, np.int64)
        if n < min_words:
            return np.empty(0, np.uint64), empty, empty, empty
        # a value's low bits tell its place, so that the least value names its token
        low = np.uint64((1 << (width - 1).bit_length()) - 1)
        if not hasattr(self, "tokens"):
            self.tokens = ngram_hashes(self.hashes, shingle)
            self.inside = self.doc[: n - min_words + 1] == self.doc[min_words - 1 :]
        place = np.arange(len(self.tokens), dtype=np.uint64) & low
        one, two = (sliding_min((mix(self.tokens, 100 + 2 * band + k) & ~low) | place, width) for k in (0, 1))
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | ~self.inside[:-1]
        # the windows that lie in one text
        first = np.flatnonzero(new & self.inside)
        stops = np.append(np.flatnonzero(new | ~self.inside), len(one))
        last = stops[np.searchsorted(stops, first, side="right")] - 1
        at = [first + ((v[first] - first.astype(np.uint64)) & low).astype(np.int64) for v in (one, two)]
        key = mix(mix(one[first] & ~low, 11 + band) ^ mix(two[first] & ~low, 12), 13)
        return key, first, last, at[0]


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(keys >> np.uint64(shift)) & np.uint64(bits - 1) for shift in (3, 33)]


def repeated_keys(docs: DataFrame, min_words: int, shingle: int, bands: int) -> DataFrame:
    """The keys (long) that at least two texts have, or one text in a slice of its own twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                for band in range(bands):
                    key, first, *_ = words.compact_windows(band, min_words, shingle)
                    if len(key):
                        # a text counts a key once
                        own = np.unique(mix(key ^ mix(words.doc[first].astype(np.uint64), 1)), return_index=True)[1]
                        yield pa.record_batch([pa.array(key[own].view(np.int64))], names=["key"])

    counted = docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select("key")


def key_filter(keys: DataFrame, scratch: Scratch) -> np.ndarray:
    """A Bloom filter of the keys; its size is bounded whatever their number."""
    keys = scratch.keep(keys, "keys")
    bits = 1 << 12
    total = keys.count()
    while bits < min(MAX_BITS, KEY_BITS * total):
        bits *= 2
    place = F.explode(F.array(*[F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(bits - 1)) for shift in (3, 33)]))
    masks = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("mask"))
    # MAX_BITS / 64 rows at most
    table = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    if table.num_rows:
        out[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return out


def hits(docs: DataFrame, shared, min_words: int, shingle: int, bands: int) -> DataFrame:
    """Rows of two kinds: compact windows that hit the filter (key and position), and tiles around them (start and words)."""
    schema = "doc_id long, hash long, tile int, key long, position int, start int, words binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = len(table) * 64
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                found = []
                for band in range(bands):
                    own = words.compact_windows(band, min_words, shingle)
                    hit = np.ones(len(own[0]), bool)
                    for at in _places(own[0], bits):
                        hit &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    found.append([v[hit] for v in own])
                key, first, last, place = (np.concatenate(v) for v in zip(*found, strict=True))
                if not len(key):
                    continue
                doc = words.doc[place]
                base, end = words.offsets[doc], words.offsets[doc + 1]
                tile = (place - base) // TILE
                ids, hashes = part.column("doc_id"), part.column("hash")
                n = len(key)
                yield pa.record_batch(
                    [ids.take(pa.array(doc)), hashes.take(pa.array(doc)), pa.array(tile.astype(np.int32)), pa.array(key.view(np.int64)), pa.array((place - base).astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=names,
                )
                number = doc * ((int(tile.max()) + 1) or 1) + tile
                order = np.argsort(number, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
                one = order[head]
                begin = np.minimum.reduceat(first[order], head) - MARGIN
                stop = np.maximum.reduceat(last[order], head) + min_words + MARGIN
                begin = np.maximum(begin, np.maximum(base[one], base[one] + tile[one] * TILE - MARGIN))
                stop = np.minimum(stop, np.minimum(end[one], base[one] + (tile[one] + 1) * TILE + MARGIN))
                short = (words.hashes >> np.uint64(32)).astype("<u4")
                n = len(one)
                yield pa.record_batch(
                    [ids.take(pa.array(doc[one])), hashes.take(pa.array(doc[one])), pa.array(tile[one].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array((begin - base[one]).astype(np.int32)), pa.array([short[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())],
                    names=names,
                )

    return docs.where("doc_id is not null").select("doc_id", "hash", "text").mapInArrow(run, schema)


def agreeing(own: np.ndarray, own_start: int, other: np.ndarray, other_start: int, diagonals: list[int]) -> np.ndarray:
    """Which of the own words agree with the other's, in runs of RUN or more, along or near one of the diagonals (own place less other place)."""
    out = np.zeros(len(own), bool)
    reached = np.zeros(len(own), bool)

    def mark(d: int) -> None:
        low = max(own_start, other_start + d)
        high = min(own_start + len(own), other_start + len(other) + d)
        if high - low < RUN:
            return
        reached[low - own_start : high - own_start] = True
        same = own[low - own_start : high - own_start] == other[low - d - other_start : high - d - other_start]
        core = same[: len(same) - RUN + 1].copy()
        for k in range(1, RUN):
            core &= same[k : len(same) - RUN + 1 + k]
        for k in range(RUN):
            out[low - own_start + k : low - own_start + k + len(core)] |= core

    for d in diagonals:
        mark(d)
    if out.sum() < ENOUGH * reached.sum():
        for d in {d + k for d in diagonals for k in range(-NEAR, NEAR + 1)} - set(diagonals):
            mark(d)
    return out


def spans(match: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Maximal segments that score above zero with 1 - similarity for a word that agrees and -similarity for another."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], match.astype(np.int8), [0]])))
    # segments so far: begin, end, the score before them and with them, none contained in a better one
    held: list[list] = []
    total = 0.0
    before = 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        low = total - (a - before) * similarity
        total, before = low + (b - a) * (1 - similarity), b
        segment = [a, b, low, total]
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= segment[2]:
                k -= 1
            if k < 0 or held[k][3] >= segment[3]:
                held.append(segment)
                break
            segment = [held[k][0], segment[1], held[k][2], segment[3]]
            del held[k:]
    return [(s[0], s[1]) for s in held]


def _joined(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group and begin: where each joined interval's rows begin, and the intervals' ends."""
    lift = group * (int(end.max()) + GAP + 2)
    reach = np.maximum.accumulate(end + lift)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] + lift[1:] > reach[:-1] + GAP]))
    return first, np.concatenate([reach[first[1:] - 1], reach[-1:]]) - lift[first]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut only between documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = np.asarray(batch.column("doc_id"))
        change = np.flatnonzero(doc[1:] != doc[:-1])
        if held and doc[0] != held[-1].column("doc_id")[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE, bands: int = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), first_doc_id, hash (of the text): the spans of each document that an earlier one (by id) holds too."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "compact-windows")
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    shared = spark.sparkContext.broadcast(key_filter(repeated_keys(docs, min_words, shingle, bands), scratch))
    found = scratch.keep(hits(docs, shared, min_words, shingle, bands), "hits")
    windows = found.where("key is not null").select("key", "doc_id", "hash", "position")
    first = F.min(F.struct("doc_id", "hash", "position"))
    # the first of each key that two documents have; written, so that the join with it can split a hot key's rows
    holders = scratch.keep(windows.groupBy("key").agg(first.alias("first"), F.max("doc_id").alias("last")).where("last > first.doc_id").drop("last"), "holders")
    tile = lambda c: F.shiftright(c, TILE.bit_length() - 1)
    pairs = windows.join(holders, "key").where("doc_id > first.doc_id")
    pairs = pairs.groupBy("doc_id", "hash", tile("position").alias("tile"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.hash").alias("first_hash"), tile("first.position").alias("first_tile"))
    pairs = pairs.agg(F.collect_set(F.col("position") - F.col("first.position")).alias("diagonals"))
    # equal rows have equal tiles
    tiles = found.where("words is not null").groupBy("doc_id", "hash", "tile").agg(F.any_value("start").alias("start"), F.any_value("words").alias("words"))
    first_tiles = tiles.toDF("first_doc_id", "first_hash", "first_tile", "first_start", "first_words")
    both = pairs.join(tiles, ["doc_id", "hash", "tile"]).join(first_tiles, ["first_doc_id", "first_hash", "first_tile"])
    both = both.select("doc_id", "hash", "first_doc_id", "start", "words", "first_start", "first_words", "diagonals")
    schema = "doc_id long, hash long, first_doc_id long, start_word int, end_word int"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, ends = [], [], []
            starts, first_starts = np.asarray(batch.column("start")), np.asarray(batch.column("first_start"))
            for k, (own, other, diagonals) in enumerate(zip(batch.column("words"), batch.column("first_words"), batch.column("diagonals"), strict=True)):
                start = int(starts[k])
                match = agreeing(np.frombuffer(own.as_buffer(), "<u4"), start, np.frombuffer(other.as_buffer(), "<u4"), int(first_starts[k]), diagonals.as_py())
                for a, b in spans(match, similarity):
                    rows.append(k), begins.append(a + start), ends.append(b + start)
            at = pa.array(rows, pa.int32())
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("doc_id", "hash", "first_doc_id")), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "hash", "first_doc_id", "start_word", "end_word"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_document(batches):
            doc, hashed, first_doc, begin, end = (table.column(c).to_numpy() for c in ("doc_id", "hash", "first_doc_id", "start_word", "end_word"))
            change = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1]) | (first_doc[1:] != first_doc[:-1])
            head, stop = _joined(np.concatenate([[0], np.cumsum(change)]), begin.astype(np.int64), end.astype(np.int64))
            head, stop = head[stop - begin[head] >= min_words], stop[stop - begin[head] >= min_words]
            yield pa.record_batch([pa.array(doc[head]), pa.array(begin[head]), pa.array(stop.astype(np.int32)), pa.array(first_doc[head]), pa.array(hashed[head])], names=["doc_id", "start_word", "end_word", "first_doc_id", "hash"])

    compared = both.mapInArrow(compare, schema).repartition("doc_id").sortWithinPartitions("doc_id", "hash", "first_doc_id", "start_word", "end_word")
    return scratch.finish(compared.mapInArrow(merge, "doc_id long, start_word int, end_word int, first_doc_id long, hash long"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without the passages that an earlier document holds; a text that is all repeats goes with its row.

    The white space between the words that stay is kept as it was, except that a passage goes with the white
    space after it.  Other columns stay as they are.
    """
    spans_, id_, hash_ = unused(docs.columns, "spans", "span_id", "span_hash")
    found = repeated_passages(docs, id_col, text_col, **options).select("doc_id", "hash", "start_word", "end_word").distinct()
    # a span for each passage of a document and each earlier holder that is first in a group
    lists = found.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(spans_)).toDF(id_, hash_, spans_)
    marked = docs.withColumn(hash_, F.xxhash64(F.col(f"`{text_col}`").cast("string"))).withColumn(id_, F.col(f"`{id_col}`").cast("long"))
    # the lists grow with the corpus: the same join at every size
    marked = marked.join(lists.hint("merge"), [id_, hash_], "left").select(*[f"`{n}`" for n in docs.columns], spans_)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        words = re.compile(rb"[^\x20\x09-\x0d]+")
        for batch in batches:
            for part in slices(batch, text_col):
                column = part.column(spans_)
                texts, keep = part.column(text_col).to_pylist(), np.ones(part.num_rows, bool)
                for k in np.flatnonzero(np.asarray(column.is_valid())):
                    raw = (texts[k] or "").encode("utf-8", "surrogatepass")
                    at = [m.start() for m in words.finditer(raw)] + [len(raw)]
                    rest, done = [], 0
                    for span in column[int(k)].as_py():
                        # spans of different holders may overlap
                        if span["start_word"] > done or not done:
                            rest.append(raw[at[done] if done else 0 : at[span["start_word"]]])
                        done = max(done, span["end_word"])
                    rest.append(raw[at[done] :])
                    texts[k] = b"".join(rest).decode("utf-8", "surrogatepass")
                    keep[k] = bool(texts[k].strip(" \t\n\v\f\r"))
                arrays = [pa.array(texts, pa.string()) if n == text_col else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    return marked.mapInArrow(run, docs.schema)
