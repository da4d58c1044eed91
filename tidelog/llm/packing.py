"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are cut into whole sequences and one rest each.  The rests' lengths, in units of ``UNIT``
tokens, make a histogram of bounded size.  A linear program over cutting patterns covers it: a revised
simplex holds the patterns, and a knapsack dynamic program over the dual prices finds the next one until
none pays.  The rounded-down pattern counts, and first-fit-decreasing patterns for the few rests left,
are then dealt to the documents: a document's rank within its length class says which copy of which
pattern takes it.  Only the histogram comes to the driver.

Where an order of the documents is given, each pattern's copies are spread evenly over rounds, documents of a class
are dealt in their order, and sequences are numbered in the order of what they hold.

Nulls and edge cases: a null or empty text is the end id alone, one piece of one token; a null doc_id
and equal rows are packed like any other row; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch
from tidelog.llm.textops import slices
from tidelog.llm.tokens import Encoder

LENGTH = 2048
UNIT = 8
#: Where an order is followed: rows numbered by one task at most, about, and rounds in which every pattern gets its share.
ORDERED_ROWS = 16384
ROUNDS = 256
EPSILON = 1e-7
#: Column generation ends once no plan can use fewer sequences by more than this share.
GAP = 1e-3


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Value and item counts of the best unbounded knapsack."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], fits = best[room - 1], int(np.searchsorted(sizes, room, side="right"))
        if fits:
            values = prices[:fits] + best[room - sizes[:fits]]
            top = int(np.argmax(values))
            if values[top] > best[room] + 1e-12:
                best[room], chosen[room] = values[top], top
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often to use each, fractionally, to cover the demand with fewest bins."""
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    use = inverse @ demand
    for _ in range(10 * m + 100):
        prices = inverse.sum(axis=0)  # each pattern costs one
        value, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + GAP:  # use.sum() / value is a lower bound
            break
        direction = inverse @ pattern
        ratios = np.full(m, np.inf)
        positive = direction > 1e-9
        ratios[positive] = use[positive] / direction[positive]
        out = int(np.argmin(ratios))
        columns[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        use = np.maximum(inverse @ demand, 0)
    return columns.astype(np.int64), use


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size to count) with whole multiplicities that hold every item of the histogram."""
    sizes = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(k)] for k in sizes], float)
    columns, use = column_generation(sizes, demand, capacity)
    out, left = [], demand.astype(np.int64)
    for k in np.argsort(-use, kind="stable"):
        copies = int(use[k] + EPSILON)
        # no more copies than the items left fill completely
        taken = columns[:, k] > 0
        copies = min([copies, *(left[taken] // columns[taken, k]).tolist()])
        if copies > 0:
            left -= copies * columns[:, k]
            out.append(({int(s): int(c) for s, c in zip(sizes, columns[:, k], strict=True) if c}, copies))
    while left.any():
        room, pattern = capacity, {}
        for k in range(len(sizes) - 1, -1, -1):
            if count := int(min(left[k], room // sizes[k])):
                pattern[int(sizes[k])] = count
                room -= count * int(sizes[k])
        held = np.array([pattern.get(int(s), 0) for s in sizes])
        copies = int((left[held > 0] // held[held > 0]).min())
        left -= copies * held
        out.append((pattern, copies))
    return out


def in_rounds(patterns: list[tuple[dict[int, int], int]], rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """The same patterns, each dealt out evenly over rounds, so that a sequence's items have like ranks in their classes."""
    # patterns of few copies start anywhere, not all in the last round
    phase = [(k + 1) * 0.6180339887498949 % 1 for k in range(len(patterns))]
    out = []
    for n in range(rounds):
        for (pattern, copies), at in zip(patterns, phase, strict=True):
            if share := int(copies * (n + 1) / rounds + at) - int(copies * n / rounds + at):
                out.append((pattern, share))
    return out


class Dealer:
    """Sequence and slot of an item, from its size and its rank among items of that size."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        self.of: dict[int, list[np.ndarray]] = {}
        first, table = 0, {}
        for pattern, copies in patterns:
            for size, count in pattern.items():
                table.setdefault(size, []).append((first, count, copies))
            first += copies
        self.sequences = first
        for size, rows in table.items():
            firsts, counts, copies = np.array(rows, np.int64).T
            self.of[size] = [np.cumsum(counts * copies), counts * copies, counts, firsts]

    def place(self, size: int, rank: np.ndarray) -> np.ndarray:
        ends, held, counts, firsts = self.of[size]
        at = np.searchsorted(ends, rank, side="right")
        return firsts[at] + (rank - (ends[at] - held[at])) // counts[at]


def cut(docs: DataFrame, tokenizer: str, length: int, unit: int, id_col: str, text_col: str, order_col: str | None = None) -> DataFrame:
    """Pieces of all documents, with their size class and their place among the task's pieces of that class (or the document's order)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, part int, local long"
    ordered = [F.col(order_col).cast("long").alias("ordinal")] if order_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part_id = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(length // unit + 2, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder.encode(part.column("text").to_pylist())
                ids = ids.astype("<u4")
                tokens = np.diff(offsets)
                pieces = -(-tokens // length)
                row = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, tokens[row] - start)
                begins = offsets[row] + start
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), (begins + size).tolist(), strict=True)]
                # class 0 is a whole sequence
                kind = np.where(size == length, 0, -(-size // unit))
                order = np.argsort(kind, kind="stable")
                kinds, first, counts = np.unique(kind[order], return_index=True, return_counts=True)
                local = np.empty(len(row), np.int64)
                local[order] = np.arange(len(row)) - np.repeat(first, counts) + np.repeat(seen[kinds], counts)
                seen[kinds] += counts
                ordinal = [part.column("ordinal").take(pa.array(row))] if order_col else []
                yield pa.record_batch(
                    [part.column("doc_id").take(pa.array(row)), *(pa.array(v.astype(np.int64)) for v in (start, size)), pa.array(crcs, pa.int64()), pa.array(tokens[row].astype(np.int64)),
                     pa.array(kind.astype(np.int32)), pa.array(np.full(len(row), part_id, np.int32)), pa.array(local), *ordinal],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "local", *(["ordinal"] if order_col else [])],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *ordered).mapInArrow(run, schema + (", ordinal long" if order_col else ""))


def numbered(rows: DataFrame, ordinal: str, group: list[str], order: list[str], span: float, name: str) -> DataFrame:
    """``rows`` with their number from 0 within a group, ascending by ``ordinal``: ranks in ranges of it, not in one task for a group."""
    ranged = rows.withColumn("_range", F.floor(F.col(ordinal) / span))
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(ordinal, *order))
    return ranged.join(before, [*group, "_range"]).withColumn(name, F.col("_before") + inside - 1).drop("_range", "_before")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``order_col`` (a whole number, ascending, no nulls): documents of a length class are dealt in this order, and
    sequences are numbered by the mean of their tokens' documents in it.
    """
    if length % unit:
        raise ValueError("the sequence length must be a multiple of the unit")
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(cut(docs, tokenizer, length, unit, id_col, text_col, order_col), "pieces")
    counts = scratch.keep(pieces.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    # one row for each length class: length / unit + 1 at most
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(0, 0)
    patterns = plan(histogram, length // unit)
    dealer = Dealer(in_rounds(patterns) if order_col else patterns)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    carried = ["ordinal"] if order_col else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column("size")), np.asarray(batch.column("rank"))
            sequence = rank.copy()
            for kind in np.unique(size[size > 0]).tolist():
                own = size == kind
                sequence[own] = whole + dealer.place(kind, rank[own])
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), batch.column("rank"), batch.column("size"), *(batch.column(c) for c in carried)], names=[*columns, "sequence_id", "rank", "size", *carried])

    if order_col:
        ranked = numbered(pieces, "ordinal", ["size"], ["start"], ORDERED_ROWS, "rank")
    else:
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = pieces.join(before.drop("n"), ["size", "part"]).withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0)))
    ranked = ranked.select(*columns, "size", "rank", *carried)
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, rank long, size int" + (", ordinal long" if order_col else ""))
    if order_col:
        placed = scratch.keep(placed, "placed")
        means = placed.groupBy("sequence_id").agg((F.sum(F.col("ordinal") * F.col("length").cast("double")) / F.sum("length")).alias("mean"))
        new = numbered(scratch.keep(means, "means"), "mean", [], ["sequence_id"], ORDERED_ROWS, "number")
        placed = placed.join(new.select("sequence_id", "number"), "sequence_id").drop("sequence_id").withColumnRenamed("number", "sequence_id")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return scratch.finish(out.select(*columns, "sequence_id", "offset"))
