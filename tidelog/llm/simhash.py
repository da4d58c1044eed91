"""SimHash near-duplicate groups found with vantage-point trees.

A fingerprint has 64 bits over the XXH64 hashes of lower-cased shingles of three words (``shingle``).  Two fingerprints
link if they differ in at most three bits.  Such a pair differs in at most one bit in the upper or in
the lower half, so two vantage-point trees, each over the Hamming distance of one half, find every
pair with a query ball of radius one: the triangle inequality prunes all branches except those whose
shell the ball crosses.  The top of each tree is built on the driver from a bounded sample of
fingerprints and cuts the fingerprints into shards; a fingerprint lives in one shard of a tree and
visits those that its ball overlaps.  Pairs are verified on all 64 bits.  A shard reports a spanning
forest of its links instead of all pairs, and shards beyond a size are dealt out as a grid of blocks.
Groups are connected components, by alternating large-star and small-star rounds.

Nulls and edge cases: a null or blank text has fingerprint zero and links like any other; a very long text is
one fingerprint of all its shingles; a row with a null doc_id keeps its row and links like any other, has no
say in a group's smallest id, and gets that group's id (null if the group has no id at all); equal rows stay
separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.scratch import Scratch
from tidelog.llm.textops import slices

BITS = 3
SEED = 42
SHINGLE = 3
#: Fingerprints of a shard that one task compares; larger shards are dealt out in blocks of this size.
BLOCK = 4096
#: Shards are planned at this many fingerprints on average.
SHARD = 2048
#: Greatest depth of the tree built on the driver, and sampled fingerprints for each of its leaves.  Beyond 134 million
#: fingerprints shards grow; they are still compared in full, in blocks, but at a cost that grows with their size.
MAX_DEPTH = 16
SAMPLE_PER_LEAF = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) > shingle else [len(joined)]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = [_signed(fingerprint(t, shingle)) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    return (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class VantageTree:
    """The complete top of a vantage-point tree: node i has children 2i+1 (near) and 2i+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.points = np.zeros((1 << depth) - 1, np.uint32)
        self.radii = np.zeros((1 << depth) - 1, np.int16)
        members = {0: sample}
        for node in range(len(self.points)):
            own = members.pop(node)
            if len(own):
                # of a few candidates, the point whose distances spread most separates best
                tried = own[:: max(1, len(own) // 8)][:8]
                apart = np.bitwise_count(tried[:, None] ^ own[None, :])
                best = int(np.argmax(apart.std(axis=1)))
                distance = apart[best].astype(np.int16)
                # a median would put ties on one side; the radius nearest to an even cut is taken
                options = np.arange(distance.min(), max(distance.max(), distance.min() + 1))
                cut = np.abs((distance[None, :] <= options[:, None]).sum(axis=1) - len(own) / 2)
                self.points[node], self.radii[node] = tried[best], options[int(np.argmin(cut))]
                near = distance <= self.radii[node]
                members[2 * node + 1], members[2 * node + 2] = own[near], own[~near]
            else:
                members[2 * node + 1] = members[2 * node + 2] = own

    def route(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, visits) triples: one home leaf for each value, and the leaves that it visits.

        A ball that crosses a shell at a node of its home path only looks inwards: of two values on
        either side of the shell, the outer one visits the inner's leaves.  Below, it takes every
        branch that the triangle inequality leaves open.
        """
        row = np.arange(len(values))
        node = np.zeros(len(values), np.int64)
        visits = np.zeros(len(values), bool)
        for _ in range(self.depth):
            distance = np.bitwise_count(values[row] ^ self.points[node]).astype(np.int16)
            radii = self.radii[node]
            near_home = distance <= radii
            near = np.where(visits, distance - radius <= radii, near_home | (distance - radius <= radii))
            far = np.where(visits, distance + radius > radii, ~near_home)
            node, row, visits = (
                np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]),
                np.concatenate([row[near], row[far]]),
                np.concatenate([visits[near] | ~near_home[near], visits[far]]),
            )
        return row, node - ((1 << self.depth) - 1), visits


def forest(fps: np.ndarray, ids: np.ndarray, home: np.ndarray, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links between home rows, and from home rows to the others."""
    order = np.argsort(~home, kind="stable")
    fps, ids, n_home = fps[order].view(np.uint64), ids[order], int(home.sum())
    root = np.arange(len(fps))
    left: list[int] = []
    right: list[int] = []
    step = max(1, (1 << 21) // max(1, len(fps)))
    for at in range(0, n_home, step):
        close = np.bitwise_count(fps[at : min(n_home, at + step), None] ^ fps[None, at:]) <= bits
        close[np.arange(len(close)), np.arange(len(close))] = False
        for k in np.flatnonzero(close.any(axis=1)):
            others = np.flatnonzero(close[k]) + at
            roots, first = np.unique(root[others], return_index=True)
            new = roots != root[at + k]
            if new.any():
                left += [int(ids[at + k])] * int(new.sum())
                right += ids[others[first[new]]].tolist()
                root[np.isin(root, roots[new])] = root[at + k]
    return left, right


def links(nodes: DataFrame, scratch: Scratch, bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the rows (node long, fp long, distinct) at up to ``bits`` bits exactly as all pairs would."""
    total = nodes.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / shard))))
    wanted = SAMPLE_PER_LEAF << depth
    share = max(1, total // wanted)
    # 2 * SAMPLE_PER_LEAF << MAX_DEPTH fingerprints at most (16 MB), whatever the table's size
    sample = np.array([r.fp for r in nodes.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").limit(2 * wanted).collect()], np.int64)
    trees = [VantageTree(half, depth) for half in halves(sample)] if depth else [VantageTree(half[:0], 0) for half in halves(sample)]
    radius = bits // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = np.asarray(part.column("fp"))
                for tree, half in enumerate(halves(fps)):
                    row, leaf, visits = trees[tree].route(half, radius)
                    yield pa.record_batch(
                        [pa.array(leaf * 2 + tree, pa.int32()), pa.array(~visits), part.column("node").take(pa.array(row)), part.column("fp").take(pa.array(row))],
                        names=["leaf", "home", "node", "fp"],
                    )

    dealt = scratch.keep(nodes.select("node", "fp").mapInArrow(deal, "leaf int, home boolean, node long, fp long"), "dealt")
    # one row for each leaf of the two trees: 2 << MAX_DEPTH at most
    sizes = {r.leaf: (r.homes, r.visitors) for r in dealt.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")).collect()}
    grids = {leaf: (math.ceil(h / block), max(1, math.ceil(v / block))) for leaf, (h, v) in sizes.items() if h > block or v > 4 * block}

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, home = np.asarray(batch.column("leaf")), batch.column("home").to_numpy(zero_copy_only=False)
            spread = np.asarray(batch.column("fp")).view(np.uint64)
            spread = (spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            rows, cells, homes = [], [], []
            large = np.isin(leaf, np.fromiter(grids, np.int64, len(grids)))
            plain = np.flatnonzero(~large)
            rows.append(plain), cells.append(np.zeros(len(plain), np.int64)), homes.append(home[plain])
            for i in np.flatnonzero(large):
                across, down = grids[int(leaf[i])]
                if home[i]:
                    own = int(spread[i] % np.uint64(across))
                    # cells of home against home: (own, x) for x >= own, and (x, own) as the second side
                    first = [own * across + x for x in range(own, across)]
                    second = [x * across + own for x in range(own)]
                    visited = [across * across + own * down + y for y in range(down)]
                    cell, is_home = first + second + visited, [True] * len(first) + [False] * len(second) + [True] * len(visited)
                else:
                    own = int(spread[i] % np.uint64(down))
                    cell = [across * across + x * down + own for x in range(across)]
                    is_home = [False] * across
                rows.append(np.full(len(cell), i)), cells.append(np.array(cell, np.int64)), homes.append(np.array(is_home, bool))
            row = np.concatenate(rows)
            yield pa.record_batch(
                [pa.array(leaf[row], pa.int32()), pa.array(np.concatenate(cells), pa.int64()), pa.array(np.concatenate(homes)), batch.column("node").take(pa.array(row)), batch.column("fp").take(pa.array(row))],
                names=["leaf", "cell", "home", "node", "fp"],
            )

    def compare(table: pa.Table) -> pa.Table:
        fps, ids, home = (table.column(c).to_numpy() for c in ("fp", "node", "home"))
        left, right = forest(fps, ids, home.astype(bool), bits)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    placed = dealt.mapInArrow(block_of, "leaf int, cell long, home boolean, node long, fp long")
    return scratch.keep(placed.groupBy("leaf", "cell").applyInArrow(compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    if bits != BITS:
        raise ValueError("the two half trees with radius one are exact for three bits")
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # fingerprints are the nodes, so rows without an id link like any other
    component = connected_components(links(groups.select(F.col("fp").alias("node"), "fp"), scratch, bits), scratch)
    groups = groups.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = scratch.keep(groups.join(smallest, "root").select("fp", "component_id"), "groups")
    out = prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return scratch.finish(out)
