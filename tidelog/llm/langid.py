"""Language identification by cross-parsing.

Each language has a reference: a bounded sample of labelled text, indexed by a suffix automaton.  A text is
parsed against it from left to right into the longest phrases that occur in the reference; the fewer phrases a
text of given length needs, the lower its cross entropy.  The phrase count, times the bits that name a place
in the reference, over the text's bytes, is compared between languages and the least wins.

The automaton's transitions become one table in which a missing step closes the phrase and opens the next, so
whole batches are parsed side by side, one byte a step.  A text longer than a lane is parsed in several lanes at
once, each as if a phrase began there; then each lane is parsed again from the state that the one before it ended in,
until both parses are in the same state, and the phrases between are corrected.  So the count is that of one parse
over the whole text.

Learning takes a bounded sample: REFERENCE_DOCS documents of each language, chosen by a hash of their id, and of a
text beyond ``piece`` characters a run of that length from a place that the hash chooses.

Nulls and edge cases: a very long text is parsed whole; a text that is null or has no letter is ``und`` with score zero, as is every text if
nothing was learned; a null id is never learned from; ties go to the first language by name; with one language
only the score is one; equal texts get equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.textops import slices

#: Reference bytes of a language (fewer if there are many languages), and labelled documents drawn for it on average.
REFERENCE_BYTES = 32 << 10
ALL_REFERENCE_BYTES = 512 << 10
REFERENCE_DOCS = 64
PIECE = 8192
LANE = 512
#: Lanes that are stepped together.
ABREAST = 1 << 14
_letter = re.compile(r"[^\W\d_]")


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        current = len(steps)
        steps.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = current
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    return steps


class Parser:
    """The parse table of one reference: next state times four, plus the phrases that the step closes."""

    def __init__(self, reference: bytes):
        steps = suffix_automaton(reference)
        known = sorted(set(reference))
        self.codes = np.zeros(256, np.uint8)
        self.codes[known] = np.arange(1, len(known) + 1)
        width = len(known) + 1
        table = np.empty((len(steps), width), np.int32)
        root = np.zeros(width, np.int32)
        for c, to in steps[0].items():
            root[self.codes[c]] = to
        # without a step: the phrase ends, and a byte that no phrase begins with is one by itself
        table[:] = np.where(root > 0, root * width * 4 + 1, 2)
        for state, own in enumerate(steps):
            for c, to in own.items():
                table[state, self.codes[c]] = to * width * 4
        table[0] = np.where(root > 0, root * width * 4, 1)
        self.table = table.ravel()
        self.bits = float(np.log2(max(2, len(reference))))

    def anew(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lanes of the data, parsed as if a phrase began there: phrases closed, and the last state (zero: no phrase is open)."""
        order = np.argsort(-length, kind="stable")
        count, last = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int32)
        for at in range(0, len(order), ABREAST):
            own = order[at : at + ABREAST]
            state, closed, first, size = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64), begin[own], length[own]
            for k in range(int(size[0])):
                n = int(np.searchsorted(-size, -k))
                step = self.table[state[:n] + data[first[:n] + k]]
                closed[:n] += step & 3
                state[:n] = step >> 2
            count[own], last[own] = closed, state
        return count, last

    def carried(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that parses begun in these states close more than ``anew`` does, and their last state (-1: the same)."""
        more, last = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int32)
        own, k = np.flatnonzero(state), 0
        fresh, held = np.zeros(len(own), np.int32), state[own]
        while len(own):
            code = data[begin[own] + k]
            x, y = self.table[fresh + code], self.table[held + code]
            more[own] += (y & 3) - (x & 3)
            fresh, held, k = x >> 2, y >> 2, k + 1
            apart, ended = fresh != held, length[own] == k
            last[own[apart & ended]] = held[apart & ended]
            going = apart & ~ended
            own, fresh, held = own[going], fresh[going], held[going]
        return more, last

    def phrases(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each text, whose bytes follow each other."""
        data = self.codes[raw]
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(size) - size)[text] + LANE * number
        length = np.minimum(LANE, np.cumsum(size)[text] - begin)
        count, last = self.anew(data, begin, length)
        more, true_last = np.zeros(len(text), np.int64), last.copy()
        # what a lane was begun with the last time, and lanes to be parsed from another state
        used = np.zeros(len(text), np.int32)
        later = np.flatnonzero(number)
        while len(todo := later[true_last[later - 1] != used[later]]):
            used[todo] = true_last[todo - 1]
            more[todo], ends = self.carried(data, begin[todo], length[todo], used[todo])
            true_last[todo] = np.where(ends >= 0, ends, last[todo])
        final = np.cumsum(lanes) - 1
        return np.bincount(text, weights=count + more, minlength=len(size)).astype(np.int64) + (true_last[final] > 0)


class Identifier:
    """All languages' parsers; built once in a worker from the broadcast references."""

    _known: dict[int, Identifier] = {}

    def __init__(self, references: dict[str, bytes]):
        self.languages = sorted(references)
        self.parsers = [Parser(references[k]) for k in self.languages]

    @classmethod
    def of(cls, references: dict[str, bytes]) -> Identifier:
        key = hash(tuple(sorted(references.items())))
        if key not in cls._known:
            cls._known.clear()
            cls._known[key] = cls(references)
        return cls._known[key]

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        named = np.array([bool(t) and _letter.search(t) is not None for t in texts], bool)
        score, names = np.zeros(len(texts)), ["und"] * len(texts)
        rows = np.flatnonzero(named)
        if not len(rows) or not self.languages:
            return names, score
        raw = [texts[k].lower().encode("utf-8", "surrogatepass") for k in rows]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = np.frombuffer(b"".join(raw), np.uint8)
        costs = np.stack([parser.phrases(joined, size) * parser.bits for parser in self.parsers])
        costs /= size
        best = np.argmin(costs, axis=0)
        least = costs[best, np.arange(len(raw))]
        if len(self.languages) > 1:
            second = np.partition(costs, 1, axis=0)[1]
            score[rows] = np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)
        else:
            score[rows] = 1.0
        for k, b in zip(rows.tolist(), best.tolist(), strict=True):
            names[k] = self.languages[b]
        return names, score


def references(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", piece: int = PIECE) -> dict[str, bytes]:
    """A bounded reference text for each language of the rows that may be learned from."""
    text = F.col(text_col).cast("string")
    rows = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.octet_length(text) > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    whole = 1 << 40
    docs_of = max(4, min(REFERENCE_DOCS, ALL_REFERENCE_BYTES // 1024 // len(counts)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, F.lit(9)).alias("h"), text.alias("text"))
    # about docs_of documents of each language, by their hash, however many there are
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(whole, -(-docs_of * whole // n))))])
    rows = rows.where(F.pmod("h", F.lit(whole)) < share[F.col("lang")])
    place = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.char_length("text") - piece + 1)) + 1
    drawn = rows.select("lang", "h", F.when(F.char_length("text") > piece, F.substr("text", place.cast("int"), F.lit(piece))).otherwise(F.col("text")).alias("text")).collect()
    limit = max(2048, min(REFERENCE_BYTES, ALL_REFERENCE_BYTES // len(counts)))
    out: dict[str, bytes] = {}
    for row in sorted(drawn, key=lambda r: (r["lang"], r["h"], r["text"])):
        held = out.get(row["lang"], b"")
        if len(held) < limit:
            out[row["lang"]] = (held + row["text"].lower().encode("utf-8", "surrogatepass") + b"\n")[:limit]
    return out


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows where ``held_out`` is false."""
    held = F.coalesce(held_out, F.lit(True))
    learned = docs.sparkSession.sparkContext.broadcast(references(docs, ~held, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            identifier = Identifier.of(learned.value)
            for part in slices(batch):
                names, score = identifier.identify(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
