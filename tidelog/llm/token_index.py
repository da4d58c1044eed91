"""Raw token-id shards with a minimal perfect hash index over document keys.

Layout of a store (a folder that the cluster shares):

* ``shard-*.ids``: the ids of the shard's documents, one after another, as little-endian unsigned
  16-bit integers where the vocabulary allows it, else 32-bit;
* ``shard-*.idx``: eight bytes with the length of a JSON text, that text (the arrays' names, types and
  lengths), then the arrays: ``keys`` and ``valid`` of all rows, ``offsets`` (in ids), and the index, which
  are the hash's ``bits``, ``ranks`` and ``levels``, and for each slot a 32-bit ``prints`` fingerprint,
  ``first`` row and ``run`` length;
* ``manifest``: a Parquet table with a row for each shard: file name, rows, tokens, least and greatest key,
  ids before the shard.

Documents lie in ascending key order over all shards, so the manifest's key bounds name a key's shard.  The
hash of the key gives its slot in constant expected time, the slot's stored fingerprint tells strangers
apart, and the slot's row gives the byte range of the ids: ``Store.get`` reads some hundred bytes of the index
and the ids themselves, whatever the store's size.  A task writes under a name of its own, and only names in
the manifest count, so a task that runs twice does no harm.

Nulls and edge cases: a null or empty text holds the end id alone; rows with a null key are stored
first and are reached by position only; rows that share a key are stored side by side (in several shards
if they are many) and the key finds all of them; a key that isn't there finds nothing; a long text is one row
of a shard; an empty table makes a store without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch
from tidelog.llm.textops import mix, slices
from tidelog.llm.tokens import Encoder

#: Text bytes planned for a shard.
SHARD_BYTES = 32 << 20
#: Bits for each key of a level of the hash, and levels before the few keys left are kept as a list.
GAMMA = 2.0
LEVELS = 24


class MinimalPerfectHash:
    """Distinct 64-bit keys to 0..n-1: keys alone in a slot of a level stay, the others try the next level."""

    def __init__(self, bits: np.ndarray, ranks: np.ndarray, levels: np.ndarray, rest: np.ndarray):
        self.bits, self.ranks, self.levels, self.rest = bits, ranks, levels, rest

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, parts, levels = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            words = max(1, math.ceil(GAMMA * len(left) / 64))
            slot = (mix(left, level) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(slot, minlength=words * 64) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            levels.append(words)
            left = left[~alone[slot]]
        bits = np.concatenate(parts) if parts else np.empty(0, "<u8")
        counts = np.bitwise_count(bits).astype(np.int64)
        return cls(bits, (np.cumsum(counts) - counts).astype("<u4"), np.array(levels, "<i8"), np.sort(left).astype("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a stranger gets some slot or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_rows, base = np.arange(len(keys)), 0
        for level, words in enumerate(self.levels.tolist()):
            slot = (mix(keys[open_rows], level) % np.uint64(words * 64)).astype(np.int64)
            word = base + (slot >> 6)
            shift = (slot & 63).astype(np.uint64)
            hit = (self.bits[word] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word[hit]] & ((np.uint64(1) << shift[hit]) - np.uint64(1)))
            out[open_rows[hit]] = self.ranks[word[hit]].astype(np.int64) + below
            open_rows = open_rows[~hit]
            base += words
        if len(open_rows) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_rows]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_rows]
            placed = int(np.bitwise_count(self.bits).sum())
            out[open_rows[same]] = placed + at[same]
        return out


def _open(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "file://" + "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64), 977) >> np.uint64(32)).astype("<u4")


class Shard:
    """One shard of a store, read by position or by key.  Arrays are read when they are asked for, whole or in part."""

    def __init__(self, folder: str, name: str):
        files, base = _open(folder)
        self.index = files.open_input_file(f"{base}/{name}.idx")
        length = int.from_bytes(self.index.read_at(8, 0), "little")
        at, self.places = 8 + length, {}
        for key, kind, count in json.loads(self.index.read_at(length, 8)):
            self.places[key] = (np.dtype(kind), count, at)
            at += np.dtype(kind).itemsize * count
        self.kind = np.dtype("<u2" if self.part("width")[0] == 2 else "<u4")
        self.ids_file = files.open_input_file(f"{base}/{name}.ids")

    def part(self, key: str, first: int = 0, count: int | None = None) -> np.ndarray:
        """Some values of an array, read from their place in the file."""
        kind, length, at = self.places[key]
        count = length - first if count is None else count
        return np.frombuffer(self.index.read_at(count * kind.itemsize, at + first * kind.itemsize), kind)

    def load(self) -> Shard:
        """Reads the whole index, for many keys at once."""
        self.keys, self.valid, self.offsets = self.part("keys"), self.part("valid").astype(bool), self.part("offsets")
        self.prints, self.first, self.run = self.part("prints"), self.part("first"), self.part("run")
        self.hash = MinimalPerfectHash(self.part("bits"), self.part("ranks"), self.part("levels"), self.part("rest"))
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key (after ``load``); zero rows where the stored fingerprint differs."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys.view(np.uint64))
        known = slot >= 0
        known[known] = self.prints[slot[known]] == _prints(keys[known])
        first, run = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], run[known] = self.first[slot[known]], self.run[slot[known]]
        return first, run

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from one offset to another."""
        return np.frombuffer(self.ids_file.read_at((stop - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)

    def slot(self, key: int) -> int:
        """A key's slot, from one word of each level that it is tried in; -1 if it has none."""
        value, base = np.array([key], np.int64).view(np.uint64), 0
        for level, words in enumerate(self.part("levels").tolist()):
            at = int((mix(value, level) % np.uint64(words * 64))[0])
            word = int(self.part("bits", base + (at >> 6), 1)[0])
            if word >> (at & 63) & 1:
                return int(self.part("ranks", base + (at >> 6), 1)[0]) + (word & ((1 << (at & 63)) - 1)).bit_count()
            base += words
        # the few keys that no level could place come last
        rest = self.part("rest")
        at = int(np.searchsorted(rest, value[0]))
        return self.places["prints"][1] - len(rest) + at if at < len(rest) and rest[at] == value[0] else -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document of a key in this shard."""
        slot = self.slot(key)
        if slot < 0 or self.part("prints", slot, 1)[0] != _prints(np.array([key], np.int64))[0]:
            return []
        first, run = int(self.part("first", slot, 1)[0]), int(self.part("run", slot, 1)[0])
        # 32 bits may agree by chance
        if int(self.part("keys", first, 1)[0]) != key:
            return []
        offsets = self.part("offsets", first, run + 1).tolist()
        return [self.ids(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class Store:
    """A whole store, read by key."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        self.folder = folder
        files, base = _open(folder)
        held = pq.read_table(f"{base}/manifest", filesystem=files, columns=["name", "first_key", "last_key"]).drop_null().sort_by("first_key")
        self.names = held.column("name").to_pylist()
        self.first_keys, self.last_keys = held.column("first_key").to_numpy(), held.column("last_key").to_numpy()
        self.shards: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document of a key."""
        out = []
        # shards follow each other by key: those of one key are neighbours
        for k in range(int(np.searchsorted(self.last_keys, key)), int(np.searchsorted(self.first_keys, key, side="right"))):
            name = self.names[k]
            if name not in self.shards:
                self.shards[name] = Shard(self.folder, name)
            out += self.shards[name].get(key)
        return out


def _write_index(target, keys: np.ndarray, valid: np.ndarray, offsets: np.ndarray, width: int) -> None:
    rows = np.flatnonzero(valid)
    distinct, at, run = np.unique(keys[rows], return_index=True, return_counts=True)
    found = MinimalPerfectHash.build(distinct.view(np.uint64))
    slot = found.slots(distinct.view(np.uint64))
    first, runs, prints = np.empty(len(slot), "<u4"), np.empty(len(slot), "<u4"), np.empty(len(slot), "<u4")
    first[slot], runs[slot], prints[slot] = rows[at], run, _prints(distinct)
    arrays = {
        "keys": keys.astype("<i8"), "valid": valid.astype("u1"), "offsets": offsets.astype("<i8"), "width": np.array([width], "<i8"), "bits": found.bits,
        "ranks": found.ranks, "levels": found.levels, "rest": found.rest, "prints": prints, "first": first, "run": runs,
    }
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
    target.write(len(head).to_bytes(8, "little") + head)
    for values in arrays.values():
        target.write(values.tobytes())


def write_store(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all documents into a store at ``folder``; returns its manifest."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        encoder = Encoder.of(tokenizer)
        kind = np.dtype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        name, target = f"shard-{uuid.uuid4().hex}", None
        keys, valid, sizes = [], [], []
        for batch in batches:
            for part in slices(batch):
                target = target or files.open_output_stream(f"{base}/{name}.ids")
                ids, offsets = encoder.encode(part.column("text").to_pylist())
                target.write(ids.astype(kind).tobytes())
                column = part.column("doc_id")
                keys.append(np.asarray(column.fill_null(0), np.int64)), valid.append(np.asarray(column.is_valid())), sizes.append(np.diff(offsets))
        if target is None:
            return
        target.close()
        keys, sizes, valid = np.concatenate(keys), np.concatenate(sizes), np.concatenate(valid)
        with files.open_output_stream(f"{base}/{name}.idx") as index:
            _write_index(index, keys, valid, np.concatenate([[0], np.cumsum(sizes)]), kind.itemsize)
        from pyspark import TaskContext

        bounds = [int(f(keys[valid])) if valid.any() else None for f in (np.min, np.max)]
        row = [TaskContext.get().partitionId(), name, len(keys), int(sizes.sum()), *bounds]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["shard", "name", "rows", "tokens", "first_key", "last_key"])

    scratch = Scratch(spark, "token-index")
    _make(spark, folder)
    # equal keys spread by their text, so that one key cannot fill a shard unless its rows are equal
    ordered = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = scratch.keep(ordered.mapInArrow(run, "shard long, name string, rows long, tokens long, first_key long, last_key long"), "written")
    # a narrow row for each shard, that is for each SHARD_BYTES of text: their running sum is one task's
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    written.withColumn("start", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(f"{folder}/manifest")
    scratch.drop()
    return spark.read.parquet(f"{folder}/manifest")


def _make(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of each stored document, found by its key and read from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"]).load()
                first, count = shard.find(shard.keys[shard.valid])
                lookup = np.flatnonzero(~shard.valid)
                if len(first):
                    new = np.concatenate([[True], first[1:] != first[:-1]])
                    found = np.repeat(first[new], count[new]) + np.arange(int(count[new].sum())) - np.repeat(np.cumsum(count[new]) - count[new], count[new])
                    lookup = np.concatenate([lookup, found])
                at = 0
                while at < len(lookup):
                    low = int(shard.offsets[lookup[at]])
                    stop = max(at + 1, int(np.searchsorted(shard.offsets[lookup + 1], low + (1 << 21), side="right")))
                    rows = lookup[at:stop]
                    ids = shard.ids(low, int(shard.offsets[rows[-1] + 1])).astype("<u4")
                    begins, ends = shard.offsets[rows], shard.offsets[rows + 1]
                    crcs = [zlib.crc32(ids[a - low : b - low]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array(shard.keys[rows], mask=~shard.valid[rows]), pa.array(begins + row["start"]), pa.array(ends - begins), pa.array(crcs, pa.int64()), pa.array(np.full(len(rows), row["shard"]))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )
                    at = stop

    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(run, schema)


def token_store(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes a store (in the session's shared folder unless told otherwise) and reads it back."""
    spark = docs.sparkSession
    target = folder or Scratch(spark, "token-store").path("store")
    write_store(docs, target, tokenizer)
    return read_store(spark, target)
