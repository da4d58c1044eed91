"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are ranked and cut into blocks.  A source of weight w (of all weights) gives its j-th block the
release time floor(j / w) and the deadline ceil((j + 1) / w), in slots of one block; among released blocks the
earliest deadline goes first (of equal ones the first source).  On one processor with weights that sum to one no
deadline is missed, so after every slot each source has had its share to within less than one block.  All times are
whole-number arithmetic on the weights themselves: there is no period to which they are rounded.  When a source has
had its last block, its weight goes to the others in proportion and a new phase begins there, so every row gets
exactly one place; within a phase the bound holds against that phase's weights.

The schedule isn't run from its beginning.  What it has done up to a slot follows from the weights: every block
whose deadline has come, and of the released others as many as slots are left, earliest deadline first, as long
as the releases leave room for them (``counts_at``).  A task starts there and runs the slots that its own blocks can
lie in.  Only counts by source come to the driver; ranks come from counts by source and hash block, so a source with
most of the rows is ranked in many tasks, and a row with all its columns moves once.

Nulls and edge cases: null is a source like any other; a source without a target weight gets its share of rows
as weight, a weight of zero or less is an error; equal rows get neighbouring ranks; a long text is one row like any
other; an empty table gives an empty result; other columns are kept, but one named like a result column is replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch, unused

#: Rows of a block, and rows of all sources that go to one rank of hash blocks.
BLOCK_ROWS = 8
RANKED_ROWS = 2048
#: Weights whose common whole parts sum to EXACT at most are taken as they are, others as whole parts of PARTS: after t
#: slots that rounding is t / 2**49 of a block at most.
EXACT, PARTS = 1 << 24, 1 << 48
#: Slots whose room is looked at together, and slots that are run together.
SCAN = 1 << 16


def parts_of(weights: list[float]) -> list[int]:
    """The weights as whole numbers: exact ones, or parts of PARTS by largest remainder, one at least."""
    exact = [Fraction(w).limit_denominator(1000) if abs(Fraction(w).limit_denominator(1000) - Fraction(w)) < 1e-15 * w else Fraction(w) for w in weights]
    shared = math.lcm(*(w.denominator for w in exact))
    plain = [int(w * shared) for w in exact]
    plain = [w // math.gcd(*plain) for w in plain]
    if sum(plain) <= EXACT:
        return plain
    whole = sum(exact)
    exact = [w * PARTS / whole for w in exact]
    out = [max(1, math.floor(x)) for x in exact]
    for k in sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k))[: max(0, PARTS - sum(out))]:
        out[k] += 1
    # weights below one part have been raised: the largest gives
    out[max(range(len(out)), key=out.__getitem__)] -= sum(out) - PARTS
    return out


def counts_at(parts: list[int], slot: int) -> list[int]:
    """Blocks of each source that the schedule has run before the slot."""
    total = sum(parts)
    done = [slot * a // total for a in parts]
    over = [slot * a % total for a in parts]
    need = slot - sum(done)
    if not need:
        return done
    # released blocks whose deadline is still to come: one at most of each source
    options = sorted((-(-(done[k] + 1) * total // a), k, done[k] * total // a) for k, a in enumerate(parts) if over[k])
    edges = np.array(sorted({r for _, _, r in options}), np.int64)
    # for each range of times up to a release: the least room that the blocks due leave from then on to the slot
    room = np.full(len(edges), need, np.int64)
    for n in range(1, len(edges)):
        for begin in range(int(edges[n - 1]) + 1, int(edges[n]) + 1, SCAN):
            back = slot - np.arange(begin, min(begin + SCAN, int(edges[n]) + 1))
            free = back.copy()
            for a, r in zip(parts, over, strict=True):
                # blocks due that are released in the time; in two steps where a * back may take 96 bits
                if total == PARTS:
                    due = (back * (a >> 24) + ((back * (a & 0xFFFFFF) - r) >> 24)) >> 24
                else:
                    due = (back * a - r) // total
                free -= np.maximum(0, due)
            room[n] = min(room[n], int(free.min()))
    for _, k, release in options:
        n = int(np.searchsorted(edges, release)) + 1
        if room[:n].min() > 0:
            room[:n] -= 1
            done[k] += 1
            need -= 1
            if not need:
                break
    return done


def line(parts: list[int], start: int, done: list[int]) -> Iterator[int]:
    """The source of each slot from ``start`` on, where ``done`` blocks have been run."""
    done, total = list(done), sum(parts)
    waiting = [(done[k] * total // a, k) for k, a in enumerate(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    slot = start
    while True:
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * total // parts[k]), k))
        k = heapq.heappop(ready)[1]
        done[k] += 1
        heapq.heappush(waiting, (done[k] * total // parts[k], k))
        yield k
        slot += 1


@dataclass
class Phase:
    """Slots from ``first`` on: the sources that are left, their parts, and the blocks that each had before."""

    first: int
    sources: list[int]
    parts: list[int]
    before: list[int]


def phases(held: list[int], weights: list[float]) -> list[Phase]:
    out: list[Phase] = []
    left, done, slot = list(held), [0] * len(held), 0
    while active := [k for k in range(len(held)) if left[k]]:
        parts = parts_of([weights[k] for k in active])
        out.append(Phase(slot, active, parts, [done[k] for k in active]))
        if len(active) == 1:
            break
        # the phase ends once a source has had its last block; none has before the first release of a last one
        at = min((left[k] - 1) * sum(parts) // a for k, a in zip(active, parts, strict=True))
        used = counts_at(parts, at)
        for n in line(parts, at, used):
            used[n] += 1
            at += 1
            if used[n] == left[active[n]]:
                break
        for k, n in zip(active, used, strict=True):
            done[k] += n
            left[k] -= n
        slot += at
    return out


def slots(plan: list[Phase], source: int, blocks: np.ndarray) -> np.ndarray:
    """The slot of each of a source's blocks (ascending numbers)."""
    out = np.empty(len(blocks), np.int64)
    own = [(p, p.sources.index(source)) for p in plan if source in p.sources]
    ends = [*(p.before[n] for p, n in own[1:]), None]
    for (phase, n), end in zip(own, ends, strict=True):
        low = np.searchsorted(blocks, phase.before[n])
        high = len(blocks) if end is None else np.searchsorted(blocks, end)
        if low == high:
            continue
        wanted = blocks[low:high] - phase.before[n]
        if len(phase.sources) == 1:
            out[low:high] = phase.first + wanted
            continue
        # runs of blocks near each other: between them the schedule is skipped
        cuts = np.flatnonzero(np.diff(wanted) > 64) + 1
        found = []
        for run in np.split(wanted, cuts):
            at = int(run[0]) * sum(phase.parts) // phase.parts[n]
            used = counts_at(phase.parts, at)
            number, goals = used[n], iter(run.tolist())
            goal = next(goals)
            for slot, k in enumerate(line(phase.parts, at, used), at):
                if k == n:
                    if number == goal:
                        found.append(phase.first + slot)
                        goal = next(goals, None)
                        if goal is None:
                            break
                    number += 1
        out[low:high] = found
    return out


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", block_rows: int = BLOCK_ROWS, power: float = 1.0, ordered: bool = False, slot_col: str = "slot", position_col: str = "position") -> DataFrame:
    """``docs`` with slot and position (ascending in the mixture; a gap where a source's last block is short).

    ``weights``: target weights by source; sources without one weigh (rows ** power).  ``ordered``: the rows are
    written in the order of their position.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("target weights must be positive")
    scratch = Scratch(docs.sparkSession, "pfair")
    source = F.col(f"`{source_col}`").cast("string")
    fields = [f for f in docs.schema if f.name not in (slot_col, position_col)]
    names = [f.name for f in fields]
    key, order, part, before, rank = unused([*docs.columns], "key", "order", "part", "before", "rank")
    spread = max(1, math.ceil(docs.count() / RANKED_ROWS))
    hashed = [f"`{f.name}`" for f in fields if not f.dataType.simpleString().startswith("map")]
    # blocks by the whole row's hash: only equal rows stay together; a key that is never null joins and groups alike
    marked = docs.withColumns({key: F.coalesce(F.concat(F.lit("="), source), F.lit("")), order: F.xxhash64(*hashed)})
    marked = marked.withColumn(part, F.pmod(order, F.lit(spread)).cast("int"))
    counts = scratch.keep(marked.groupBy(key, part).agg(F.count(F.lit(1)).alias("n")), "counts")
    # one row for each source
    held = {r[key]: r["n"] for r in counts.groupBy(key).agg(F.sum("n").alias("n")).collect()}
    keys = sorted(held)
    weights = {"" if k is None else f"={k}": w for k, w in (weights or {}).items()}
    goal = [float(weights[k]) if k in weights else float(held[k] ** power) for k in keys]
    plan = phases([math.ceil(held[k] / block_rows) for k in keys], goal)
    shared = docs.sparkSession.sparkContext.broadcast(({k: n for n, k in enumerate(keys)}, plan))
    begins = counts.withColumn(before, F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = marked.join(begins, [key, part])
    ranked = ranked.withColumn(rank, F.col(before) + F.row_number().over(Window.partitionBy(key, part).orderBy(order)) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, plan = shared.value
        for batch in batches:
            coded = batch.column(key).dictionary_encode()
            code, ranks = np.asarray(coded.indices, np.int64), np.asarray(batch.column(rank), np.int64)
            slot = np.empty(batch.num_rows, np.int64)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                own = code == k
                blocks, inverse = np.unique(ranks[own] // block_rows, return_inverse=True)
                slot[own] = slots(plan, numbers[name], blocks)[inverse]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(slot), pa.array(slot * block_rows + ranks % block_rows)], names=[*names, slot_col, position_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{slot_col}` long", f"`{position_col}` long"])
    out = ranked.select(*[f"`{n}`" for n in names], key, rank).mapInArrow(place, schema)
    if ordered:
        out = scratch.keep(out, "mixed")
        out = out.repartitionByRange(spread, position_col).sortWithinPartitions(position_col)
    return out
