"""Quality rules: plain counts of a text, and a calibrated logistic regression over hashed n-grams.

The model sees mean weights of hashed words and word pairs and of hashed runs of three and four characters.  It
is trained by minibatch Adagrad on a bounded sample of rows with a quality label, Platt-scaled on a part of the
sample that was not trained on, and scores texts in Arrow batches against a fixed threshold.

Nulls and edge cases: a null or blank text has zero of everything and fails the base rules; without labels of
both kinds the verdict is the base rules' alone; a very long text is one row, scored whole; equal rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.labelled import labelled_texts
from tidelog.llm.textops import coded_words, hash_words, mix, ngram_hashes, segment_sums, slices

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32768
#: Hashed features of each of the four kinds.
FEATURES = 1 << 14
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.5, 1e-6
_SHIFT = np.uint64(64 - 14)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Features:
    """Hashed features of a batch: for each kind, a feature for each position, and the texts' offsets into them."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        self.codes, self.offsets, self.words = coded_words(texts)
        hashes = mix(hash_words([w.lower() for w in self.words], 5))[self.codes] if self.words else np.empty(0, np.uint64)
        # no pair reaches over a text's end: the sums below take one position less
        pairs = ngram_hashes(hashes, 2)
        plain = texts.to_pylist()
        text_offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
        raw = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kinds = [((hashes >> _SHIFT).astype(np.int32), self.offsets, 1), ((pairs >> _SHIFT).astype(np.int32), self.offsets, 2)]
        for n in (3, 4):
            size = max(0, len(raw) - n + 1)
            key = np.zeros(size, np.uint64)
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + raw[k : k + size]
            key ^= key >> np.uint64(32)
            self.kinds.append((((key * np.uint64(0xBF58476D1CE4E5B9)) >> _SHIFT).astype(np.int32), text_offsets, n))

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Sum over the kinds of the mean weight of a text's features."""
        out = np.zeros(len(self.offsets) - 1)
        for k, (at, offsets, n) in enumerate(self.kinds):
            begin = offsets[:-1]
            stop = np.maximum(begin, offsets[1:] - n + 1)
            total = np.concatenate([[0.0], np.cumsum(weights[k][at], dtype=np.float64)])
            begin, stop = np.minimum(begin, len(at)), np.minimum(stop, len(at))
            out += (total[stop] - total[begin]) / np.maximum(1, stop - begin)
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and mean value of each feature that a text has, by row."""
        row, feature, value = [], [], []
        for k, (at, offsets, n) in enumerate(self.kinds):
            size = np.maximum(0, np.diff(offsets) - n + 1)
            doc = np.repeat(np.arange(len(size)), size)
            position = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + offsets[:-1][doc]
            pair, count = np.unique(doc * FEATURES + at[position], return_counts=True)
            row.append(pair // FEATURES), feature.append(pair % FEATURES + k * FEATURES), value.append(count / size[pair // FEATURES])
        row = np.concatenate(row)
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate(feature)[order].astype(np.int32), np.concatenate(value)[order].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # a row of FEATURES for each kind
    bias: float
    slope: float
    shift: float
    fitted: bool

    def probabilities(self, found: Features) -> np.ndarray:
        return _sigmoid(self.slope * (found.means(self.weights) + self.bias) + self.shift)


def fit(sample: pa.Table) -> Model:
    quality = np.asarray(sample.column("quality"), np.float64) > 0
    model = Model(np.zeros((4, FEATURES), np.float32), 0.0, 1.0, 0.0, False)
    if not 0 < quality.sum() < len(quality):
        return model
    starts, features, values, count = [], [], [], 0
    for batch in sample.to_batches(max_chunksize=500):
        row, feature, value = Features(batch.column("text")).rows()
        starts.append(count + np.searchsorted(row, np.arange(batch.num_rows)))
        count += len(row)
        features.append(feature), values.append(value)
    starts, feature, value = np.concatenate([*starts, [count]]), np.concatenate(features), np.concatenate(values)
    rng = np.random.default_rng(0)
    order = rng.permutation(len(quality))
    test, train = order[: len(order) // 5], order[len(order) // 5 :]
    weights, seen = np.zeros(4 * FEATURES), np.full(4 * FEATURES, 1e-8)
    bias = float(np.log((quality.sum() + 1) / ((~quality).sum() + 1)))

    def gather(rows):
        size = starts[rows + 1] - starts[rows]
        at = np.arange(int(size.sum())) + np.repeat(starts[rows] - (np.cumsum(size) - size), size)
        return np.repeat(np.arange(len(rows)), size), feature[at], value[at]

    def logits(rows):
        own, f, v = gather(rows)
        return own, f, v, np.bincount(own, weights=v * weights[f], minlength=len(rows)) + bias

    for _ in range(EPOCHS):
        train = rng.permutation(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            own, f, v, z = logits(rows)
            error = _sigmoid(z) - quality[rows]
            gradient = np.bincount(f, weights=v * error[own], minlength=len(weights)) / len(rows) + DECAY * weights
            seen += gradient**2
            weights -= RATE * gradient / np.sqrt(seen)
            bias -= RATE * 0.1 * float(error.mean())
    z = np.concatenate([logits(test[at : at + BATCH])[3] for at in range(0, len(test), BATCH)]) if len(test) else np.zeros(0)
    slope, shift = 1.0, 0.0
    if 0 < quality[test].sum() < len(test):
        goal = np.where(quality[test], (quality[test].sum() + 1) / (quality[test].sum() + 2), 1 / ((~quality[test]).sum() + 2))
        x, beta = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
        for _ in range(25):
            p = _sigmoid(x @ beta)
            beta -= np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (beta - [1.0, 0.0]))
        slope, shift = float(max(beta[0], 1e-3)), float(beta[1])
    return Model(weights.reshape(4, FEATURES).astype(np.float32), bias, slope, shift, True)


def repeat_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that the text holds twice or more."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = ngram_hashes(codes.astype(np.uint64), 3)
    inside = np.flatnonzero(doc[: len(keys)] == doc[2:]) if len(keys) else np.empty(0, np.int64)
    keys = mix(keys[inside] ^ mix(doc[inside].astype(np.uint64), 9))
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    starts = inside[order[same[:-1] | same[1:]]]
    marked = np.zeros(len(codes), np.int64)
    for k in range(3):
        marked[starts + k] = 1
    return segment_sums(marked, offsets)


def base_counts(texts: pa.Array, found: Features) -> dict[str, np.ndarray]:
    words = pa.array(found.words, pa.string())
    dup_lines = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
            dup_lines[k] = len(lines) - len(set(lines))
    at = lambda values: segment_sums(np.asarray(values, np.int64)[found.codes], found.offsets)
    return {
        "n_words": np.diff(found.offsets), "word_chars": at(pc.utf8_length(words)), "n_symbols": at(pc.count_substring_regex(words, r"[#*$%&|<>]")),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words(found.codes, found.offsets),
    }


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_texts(docs, labels, rows, max_bytes, id_col, text_col)))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                found = Features(texts)
                base = base_counts(texts, found)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                probability = model.value.probabilities(found)
                kept = ~failed & ((probability >= threshold) | (not model.value.fitted))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in base.values()), pa.array(failed), pa.array(probability), pa.array(kept)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
