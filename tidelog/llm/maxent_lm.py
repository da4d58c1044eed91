"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax over the whole vocabulary.

Tokens are lower-cased words and an end mark for each text.

* Blocks: documents are dealt by a hash of their id and text, sorted by it, and cut into blocks of a few megabytes, each
  with its own word list.  So the blocks, and with them all scores, are the same however the input is partitioned.
* Counts: blocks send their words, in buckets of the words' hashes, to be summed over all training documents;
  the totals go back to the blocks in the same buckets.  A word crosses the cluster once for each block.
* Outcomes: every word that training documents hold, and one more that stands for all others.  The root's
  classes are HEAD classes of WIDTH frequent words each, BANDS bands of the other words by their count, and the unknown word.
  A band's words are told apart by ten bits of their hash, in two steps of WIDTH cells; in a cell a word has its add-one
  share.  P(word | history) is the product along this path.  Each step is a softmax over WIDTH outcomes with hashed
  features of the history: the previous word, the previous two, and the second-last alone (a skip); the last step
  has the previous word only.  Without features the model is the add-one unigram itself, so probabilities
  sum to one over the vocabulary and the unknown word.
* Training: ``epochs`` passes over all blocks, each in ``rounds`` parts.  In a round every block of the part starts from the
  shared weights and makes Adagrad minibatch updates.  A row of weights moves by the mean of the blocks' changes, weighted by
  what each block learned about it, and the squared gradients are added up and kept for the next rounds.
* Scoring: numpy batches gather the sparse features' rows.

The feature tables' sizes are parameters; they and the head's words are what is broadcast.  The counts grow with the input.

Nulls and edge cases: a null or empty text is its end mark alone; a very long text is a block of its own; a null id is held
out; without training documents every word has probability one, as the base formula says; equal rows get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch
from tidelog.llm.textops import coded_words, hash_words, mix, segment_sums

BLOCK_BYTES = 8 << 20
#: Text that one task cuts into blocks, and words of all blocks that one task sums.
DEALT_BYTES = 32 << 20
BUCKET_WORDS = 1_000_000
WIDTH, HEAD, BANDS = 32, 16, 15
UNKNOWN = HEAD + BANDS
#: The root is node 0; then the classes, the bands, and a node for each first cell of a band.
NODES = 1 + HEAD + BANDS + BANDS * WIDTH
ROOT_FEATURES, NODE_FEATURES = 1 << 13, 1 << 14
EPOCHS, ROUNDS, BATCH, RATE = 1, 4, 8192, 0.3
PART_ROWS, SPREAD = 1 << 12, 64
#: No word holds a line feed.
END = "\n"
_ONES = np.ones(WIDTH, np.float32)


@contextmanager
def _rows_per_batch(spark: SparkSession, rows: int):
    """Blocks are large rows: a job that reads them gets few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tokens(part: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Codes, sizes, words (in the order of their hashes) and these hashes of a block's texts."""
    codes, offsets, words = coded_words(part.column("text").combine_chunks(), lower=True)
    words.append(END)
    hashes = hash_words(words, 3)
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    sizes = np.diff(offsets) + 1
    out = np.empty(int(sizes.sum()), np.int32)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(sizes) - 1] = True
    out[ends], out[~ends] = place[-1], place[codes]
    return out, sizes, pa.array(words, pa.string()).take(pa.array(order)), hashes[order]


def _packed(values: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def _unpacked(data: bytes, kind: str, count: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, count * np.dtype(kind).itemsize, asbytes=True), kind)


def blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """Tokenised documents: ids, whether held out, sizes and codes; the block's words by hash, their hashes and training counts."""
    schema = "block long, ids array<long>, held array<boolean>, sizes array<int>, codes binary, words array<string>, hashes binary, counts array<int>"
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32())]
    names = [f.split()[0] for f in schema.split(", ")]

    def made(shard: int, number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(parts)
        codes, sizes, words, hashes = _tokens(part)
        held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [
            pa.array([(shard << 24) + number]), one(part.column("id").combine_chunks()), one(pa.array(held)), one(pa.array(sizes.astype(np.int32))),
            pa.array([_packed(codes.astype("<i4"))], pa.binary()), one(words),
            pa.array([hashes.astype("<u8").tobytes()], pa.binary()), one(pa.array(counts.astype(np.int32))),
        ]
        return pa.record_batch([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, held, size = None, 0, [], 0
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            bytes_ = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
            begin = 0
            for k in range(batch.num_rows):
                if shard[k] != current or size + bytes_[k] > BLOCK_BYTES and size:
                    held += [batch.slice(begin, k - begin)] if k > begin else []
                    if held:
                        yield made(int(current), number, held)
                    number = number + 1 if shard[k] == current else 0
                    current, held, size, begin = shard[k], [], 0, k
                size += bytes_[k]
            held.append(batch.slice(begin))
        if held:
            yield made(int(current), number, held)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(True)).alias("held"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / DEALT_BYTES))
    rows = rows.withColumn("hash", F.xxhash64("id", "text")).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("long"))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "hash").drop("hash").mapInArrow(run, schema)


def _scattered(made: DataFrame, buckets: int) -> DataFrame:
    """A block's words and counts by bucket; a bucket is a range of hashes, so a block's buckets follow in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = batch.column("words")[k].values, batch.column("counts")[k].values
                bucket = (np.frombuffer(batch.column("hashes")[k].as_buffer(), "<u8") >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                found, first = np.unique(bucket, return_index=True)
                offsets = pa.array(np.concatenate([first, [len(words)]]).astype(np.int32))
                yield pa.record_batch(
                    [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), batch.column("block")[k].as_py())), pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, counts)],
                    names=["bucket", "block", "words", "counts"],
                )

    return made.select("block", "words", "hashes", "counts").mapInArrow(run, "bucket int, block long, words array<string>, counts array<int>")


def bands(totals: np.ndarray) -> np.ndarray:
    """The band of a word that training documents hold so often: powers of four."""
    return np.minimum(BANDS - 1, np.log2(np.maximum(1, totals)) // 2).astype(np.int64)


def cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both steps' cells of a word, from bits that its bucket doesn't depend on."""
    low = hashes.astype(np.uint64)
    return (low & np.uint64(WIDTH - 1)).astype(np.int64), (low >> np.uint64(5) & np.uint64(WIDTH - 1)).astype(np.int64)


def totals(made: DataFrame, top: int) -> DataFrame:
    """For each bucket: a row for each block with its words' totals, and one (block null) with the bucket's most frequent words, its add-one masses by band and cells, tokens and distinct words."""
    size = made.agg(F.sum(F.size("words"))).first()[0] or 0
    schema = "block long, bucket int, words array<string>, counts array<long>, masses array<long>, tokens long, distinct long"

    def add(table: pa.Table) -> pa.Table:
        words = table.column("words").combine_chunks()
        coded = words.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        counts = table.column("counts").combine_chunks().flatten().to_numpy()
        total = np.bincount(codes, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        names = np.array(coded.dictionary.to_pylist(), dtype=object)
        known = total > 0
        # the most frequent ones: those below the last place's count needn't be sorted
        least = np.partition(total, len(total) - top)[len(total) - top] if len(total) > top else 0
        best = np.flatnonzero(known & (total >= least))
        best = best[np.lexsort((names[best], -total[best]))][:top]
        one, two = cells(hash_words(names[known].tolist(), 3))
        masses = np.bincount((bands(total[known]) * WIDTH + one) * WIDTH + two, weights=total[known] + 1, minlength=BANDS * WIDTH * WIDTH).astype(np.int64)
        n = table.num_rows
        bucket = table.column("bucket")[0].as_py()
        lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1] + len(best)).astype(np.int32)), pa.array(np.concatenate([total[codes], total[best]])))
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "words": pa.array([None] * n + [names[best].tolist()], pa.list_(pa.string())), "counts": lists, "masses": pa.array([None] * n + [masses.tolist()], pa.list_(pa.int64())),
            "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()), "distinct": pa.array([None] * n + [int(known.sum())], pa.int64()),
        })

    return _scattered(made, max(1, math.ceil(size / BUCKET_WORDS))).groupBy("bucket").applyInArrow(add, schema)


class Model:
    """Weights and biases, and the frequent words' hashes and places."""

    def __init__(self, words: list[str], counts: list[int], masses: np.ndarray, tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        hashes, counts = hash_words(words, 3), np.array(counts, np.int64)
        order = np.argsort(hashes)
        self.head_hashes, self.head_places = hashes[order], order
        masses = masses.reshape(BANDS, WIDTH, WIDTH).astype(np.float64)
        if len(words):
            np.subtract.at(masses, (bands(counts), *cells(hashes)), counts + 1)
        self.masses = masses
        head = np.zeros(HEAD * WIDTH)
        head[: len(counts)] = counts + 1
        head = head.reshape(HEAD, WIDTH)
        levels = np.zeros((NODES, WIDTH))
        levels[0] = [*head.sum(axis=1), *masses.sum(axis=(1, 2)), 1.0]
        levels[1 : 1 + HEAD] = head
        levels[1 + HEAD : 1 + HEAD + BANDS] = masses.sum(axis=2)
        levels[1 + HEAD + BANDS :] = masses.reshape(-1, WIDTH)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.maximum(np.log(levels / np.maximum(1e-300, levels.sum(axis=1, keepdims=True))), -1e4).astype(np.float32)
        self.root, self.node = np.zeros((ROOT_FEATURES, WIDTH), np.float32), np.zeros((NODE_FEATURES, WIDTH), np.float32)
        self.root_seen, self.node_seen = np.ones(ROOT_FEATURES, np.float32), np.ones(NODE_FEATURES, np.float32)

    def outcomes(self, hashes: np.ndarray, totals_of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each word: child of the root, node and child of the second and the third step (-1: none), and the log of its share in its cell."""
        at = np.minimum(np.searchsorted(self.head_hashes, hashes), max(0, len(self.head_hashes) - 1))
        frequent = self.head_hashes[at] == hashes if len(self.head_hashes) else np.zeros(len(hashes), bool)
        place = self.head_places[at] if len(self.head_hashes) else np.zeros(len(hashes), np.int64)
        band, (one, two) = bands(totals_of), cells(hashes)
        known = totals_of > 0
        root = np.where(frequent, place // WIDTH, np.where(known, HEAD + band, UNKNOWN))
        node, child = np.where(frequent, 1 + place // WIDTH, np.where(known, 1 + HEAD + band, -1)), np.where(frequent, place % WIDTH, one)
        rare = known & ~frequent
        last, cell = np.where(rare, 1 + HEAD + BANDS + band * WIDTH + one, -1), two
        share = np.zeros(len(hashes))
        share[rare] = np.log((totals_of[rare] + 1) / self.masses[band[rare], one[rare], two[rare]])
        return root, node, child, last, cell, share

    def steps(self, row: dict) -> tuple[np.ndarray, list]:
        """Of a block's tokens: codes, and for each step the tokens that take it, their nodes, children and features."""
        n = len(row["totals"])
        hashes = np.frombuffer(row["hashes"], "<u8")
        sizes = np.asarray(row["sizes"], np.int64)
        codes = _unpacked(row["codes"], "<i4", int(sizes.sum())).astype(np.int64)
        root, node, child, last, cell, share = self.outcomes(hashes, np.asarray(row["totals"], np.int64))
        own = mix(hashes, 1)[codes]
        first = np.cumsum(sizes) - sizes
        end = mix(hash_words([END], 3), 1)[0]
        back1 = np.concatenate([[end], own[:-1]]) if len(own) else own
        back1[first] = end
        back2 = np.concatenate([[end], back1[:-1]]) if len(own) else own
        back2[first] = end
        history = np.stack([mix(back1, 2), mix(back1 ^ mix(back2, 3), 4), mix(back2, 5)], axis=1)
        assert n == len(hashes)
        return codes, [(root, None, 3, history), (child, node, 3, history), (cell, last, 1, history), share]

    def features(self, history: np.ndarray, nodes: np.ndarray | None, count: int) -> np.ndarray:
        """Rows of the tables; small numbers, which sort fast."""
        if nodes is None:
            return (history & np.uint64(ROOT_FEATURES - 1)).astype(np.uint16)
        return (mix(history[:, :count] ^ (nodes.astype(np.uint64)[:, None] << np.uint64(20)), 6) & np.uint64(NODE_FEATURES - 1)).astype(np.uint16)

    def chances(self, at: np.ndarray, nodes: np.ndarray | None, chosen: np.ndarray | None = None) -> np.ndarray:
        """Softmax over a step's outcomes, or the chance of the chosen ones."""
        table = self.root if nodes is None else self.node
        out = table.take(at[:, 0], axis=0)
        for k in range(1, at.shape[1]):
            out += table.take(at[:, k], axis=0)
        out += self.bias[0] if nodes is None else self.bias.take(nodes, axis=0)
        np.exp(np.minimum(out, 60, out=out), out=out)
        whole = out @ _ONES
        if chosen is not None:
            return out[np.arange(len(out)), chosen] / whole
        out *= (1 / whole)[:, None]
        return out

    def update(self, at: np.ndarray, nodes: np.ndarray | None, gradient: np.ndarray) -> None:
        """Adagrad on the rows that a minibatch touches, one step size for a row."""
        table, seen = (self.root, self.root_seen) if nodes is None else (self.node, self.node_seen)
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        summed = _row_sums(gradient, order // at.shape[1], first)
        touched = ranked[first]
        seen[touched] += np.einsum("ij,ij->i", summed, summed) / WIDTH
        table[touched] -= summed * (RATE / np.sqrt(seen[touched]))[:, None]


def _row_sums(rows: np.ndarray, source: np.ndarray, first: np.ndarray, short: int = 16) -> np.ndarray:
    """Sums of ``rows[source]`` over the runs that begin at ``first``; most runs are short."""
    size = np.diff(np.append(first, len(source)))
    out = rows.take(source[first], axis=0)
    for k in range(1, short):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            return out
        out[longer] += rows.take(source[first[longer] + k], axis=0)
    for k in np.flatnonzero(size > short).tolist():
        own = source[first[k] + short : first[k] + size[k]]
        out[k] += np.ones(len(own), np.float32) @ rows.take(own, axis=0)
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Blocks with their lists as arrays."""
    for k in range(batch.num_rows):
        row = {n: batch.column(n)[k] for n in batch.schema.names}
        out = {"block": row["block"].as_py(), "codes": row["codes"].as_py(), "hashes": row["hashes"].as_py()}
        for n in ("sizes", "totals", "held"):
            out[n] = row[n].values.to_numpy(zero_copy_only=False)
        yield out | ({"ids": row["ids"].values} if "ids" in row else {})


def train_block(model: Model, row: dict) -> int:
    """Updates the model in place over the block's training documents; returns their tokens."""
    codes, (*levels, _) = model.steps(row)
    train = np.flatnonzero(np.repeat(~np.asarray(row["held"], bool), row["sizes"]))
    for begin in range(0, len(train), BATCH):
        batch = train[begin : begin + BATCH]
        for children, nodes, count, history in levels:
            own, of = batch, None
            if nodes is not None:
                of = nodes[codes[batch]]
                own, of = batch[of >= 0], of[of >= 0]
                if not len(own):
                    continue
            at = model.features(history[own], of, count)
            gradient = model.chances(at, of)
            gradient[np.arange(len(own)), children[codes[own]]] -= 1
            model.update(at, of, gradient)
    return len(train)


def train(made: DataFrame, model: Model, epochs: int = EPOCHS, rounds: int = ROUNDS) -> None:
    """``epochs`` passes over all blocks, each in ``rounds`` distributed updates of the shared weights."""
    spark = made.sparkSession
    tables = ("root", "node")
    sizes = {"root": ROOT_FEATURES, "node": NODE_FEATURES}
    parts = [(name, begin) for name in tables for begin in range(0, sizes[name], PART_ROWS)]
    schema = "part int, spread long, order long, weight binary, change binary"

    def add(table: pa.Table) -> pa.Table:
        """Sums by a fixed order, so that they do not depend on the tasks."""
        table = table.sort_by("order")
        weight = change = 0
        for w, c in zip(table.column("weight").to_pylist(), table.column("change").to_pylist(), strict=True):
            weight, change = weight + np.frombuffer(w, "<f4"), change + np.frombuffer(c, "<f4").reshape(-1, WIDTH)
        first = table.slice(0, 1)
        return pa.table({"part": first.column("part"), "spread": pa.array([0], pa.int64()), "order": first.column("spread"), "weight": pa.array([weight.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    def halved(table: pa.Table) -> pa.Table:
        """A block's change travels in half precision."""
        table = table.sort_by("order")
        weight = change = 0
        for w, c in zip(table.column("weight").to_pylist(), table.column("change").to_pylist(), strict=True):
            w = np.frombuffer(w, "<f4")
            weight, change = weight + w, change + np.frombuffer(c, "<f2").reshape(-1, WIDTH).astype(np.float32) * w[:, None]
        first = table.slice(0, 1)
        return pa.table({"part": first.column("part"), "spread": pa.array([0], pa.int64()), "order": first.column("spread"), "weight": pa.array([weight.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    for turn in range(epochs * rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import copy

            for batch in batches:
                for row in _rows(batch):
                    own = copy.copy(shared.value)
                    own.root, own.node, own.root_seen, own.node_seen = (x.copy() for x in (own.root, own.node, own.root_seen, own.node_seen))
                    if not train_block(own, row):
                        continue
                    for part, (name, begin) in enumerate(parts):
                        rows = slice(begin, begin + PART_ROWS)
                        weight = (getattr(own, f"{name}_seen") - getattr(shared.value, f"{name}_seen"))[rows]
                        change = (getattr(own, name) - getattr(shared.value, name))[rows]
                        yield pa.record_batch(
                            [pa.array([part], pa.int32()), pa.array([row["block"] // SPREAD], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([weight.astype("<f4").tobytes()], pa.binary()), pa.array([change.astype("<f2").tobytes()], pa.binary())],
                            names=["part", "spread", "order", "weight", "change"],
                        )

        with _rows_per_batch(spark, 2):
            own = made.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn % rounds).select("block", "held", "sizes", "codes", "hashes", "totals")
            summed = own.mapInArrow(run, schema).groupBy("part", "spread").applyInArrow(halved, schema)
            # the model's own size: a few megabytes
            found = summed.groupBy("part").applyInArrow(add, schema).select("part", "weight", "change").collect()
        for row in found:
            name, begin = parts[row["part"]]
            rows = slice(begin, begin + PART_ROWS)
            weight = np.frombuffer(row["weight"], "<f4")
            getattr(model, name)[rows] += np.frombuffer(row["change"], "<f4").reshape(-1, WIDTH) / np.maximum(weight, 1e-30)[:, None]
            getattr(model, f"{name}_seen")[rows] += weight
        shared.destroy()


def score_block(model: Model, row: dict) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base and model log10 scores of a block's documents."""
    codes, (*levels, share) = model.steps(row)
    counts = np.asarray(row["totals"], np.int64)
    offsets = np.concatenate([[0], np.cumsum(row["sizes"])])
    base = np.log((counts + 1) / (model.tokens + model.distinct + 1))[codes]
    logs = share[codes]
    for begin in range(0, len(codes), BATCH):
        batch = np.arange(begin, min(begin + BATCH, len(codes)))
        for children, nodes, count, history in levels:
            own, of = batch, None
            if nodes is not None:
                of = nodes[codes[batch]]
                own, of = batch[of >= 0], of[of >= 0]
                if not len(own):
                    continue
            chance = model.chances(model.features(history[own], of, count), of, children[codes[own]])
            logs[own] += np.log(np.maximum(chance, 1e-30))
    return np.diff(offsets), segment_sums((counts > 0)[codes].astype(np.int64), offsets), segment_sums(base, offsets) / math.log(10), segment_sums(logs, offsets) / math.log(10)


def counted(docs: DataFrame, held_out: Column, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, Model]:
    """The blocks with their words' hashes and totals, and the model before training."""
    spark = docs.sparkSession
    made = scratch.keep(blocks(docs, held_out, id_col, text_col), "blocks")
    with _rows_per_batch(spark, 8):
        found = scratch.keep(totals(made, HEAD * WIDTH), "totals")
    sums = found.where("block is null")
    whole = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    best = sums.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n")).orderBy(F.desc("n"), "word").limit(HEAD * WIDTH).collect()
    masses = np.zeros(BANDS * WIDTH * WIDTH, np.int64)
    # one row for each cell: BANDS * WIDTH * WIDTH at most
    for r in sums.select(F.posexplode("masses").alias("at", "mass")).where("mass > 0").groupBy("at").agg(F.sum("mass").alias("mass")).collect():
        masses[r["at"]] = r["mass"]
    model = Model([r["word"] for r in best], [r["n"] for r in best], masses, whole.n, whole.v)
    lists = found.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("b"))
    lists = lists.select("block", F.flatten(F.transform("b", lambda x: x["counts"])).alias("totals"))

    out = scratch.keep(made.select("block", "ids", "held", "sizes", "codes", "hashes").join(lists, "block"), "counted")
    scratch.drop(scratch.paths[-1])
    return out, model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows where ``held_out`` is false."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    made, model = counted(docs, held_out, id_col, text_col, scratch)
    train(made, model, epochs, rounds)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                tokens, known, base, own = score_block(shared.value, row)
                n = len(tokens)
                yield pa.record_batch(
                    [row["ids"], pa.array(row["held"], pa.bool_()), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(n, shared.value.tokens, np.int64)), pa.array(base), pa.array(own)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    with _rows_per_batch(spark, 2):
        return scratch.finish(made.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
