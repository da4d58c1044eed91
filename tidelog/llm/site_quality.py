"""Document quality by hierarchical empirical Bayes.

Evidence of a document's own text comes from two small models fitted on labelled rows: a ridge logistic
regression on the shapes of its words (letters, capitals, digits and marks, runs collapsed) for quality, and
log-odds of hashed words that toxic documents hold significantly more often for toxicity.  A document is good
if it is of quality and not toxic.  Toxic words are counted over all labelled documents, as sums made by Spark, and
chosen by a likelihood ratio, which holds for rare words too: a word that none but a few toxic documents hold counts.

Sites form a hierarchy: all documents, a host, a path of the host.  Grouped aggregation over all documents sums
their evidence (a labelled document counts with its label) by path and by host.  Each level is a beta-binomial
whose prior is its parent's posterior mean; the prior's strength comes from the between-group variance by the
method of moments, so sparse sites shrink to their parent and large ones speak for themselves.  A document's
posterior odds are its own odds times its path's odds over the global odds; ``threshold`` decides.  A document whose
own text is as likely toxic as ``toxic_limit`` isn't kept, however good its site.

Nulls and edge cases: a null or blank text has no words and gets the labelled rows' average evidence; null hosts
or paths form one site of their own; without labels of both kinds the evidence is the average and everything
that the threshold admits stays; a very long text is scored whole, in a slice of its own; equal rows get equal
results; an empty table gives an empty result; other columns, whatever their names, are kept or ignored as the
function says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.labelled import labelled_texts
from tidelog.llm.scratch import Scratch, unused
from tidelog.llm.textops import hash_words, segment_sums, slices, split_words

SAMPLE_ROWS = 6000
SAMPLE_BYTES = 32768
THRESHOLD = 0.4
SHAPES = 1024
WORDS = 1 << 18
RIDGE = 1e-3
#: A word speaks for toxicity from this signed root of the likelihood ratio, log-odds and toxic documents on.
MIN_ROOT, MIN_ODDS, MIN_HELD = 3.9, 1.5, 3
TOXIC_LIMIT = 0.8


def _logit(p):
    return np.log(p) - np.log1p(-p)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_shapes(words: pa.Array) -> pa.Array:
    """Lower-case runs become a, upper-case A, digits 0; a mark repeated is one mark."""
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{L}*\p{Ll}\p{L}*|\p{Lo}+", "a"), (r"\p{N}+", "0"), (r"!+", "!"), (r"\*+", "*"), (r"#+", "#"), (r"\$+", "$"), (r"%+", "%"), (r"&+", "&"), (r"\.+", ".")):
        words = pc.replace_substring_regex(words, pattern, to)
    return words


@dataclass
class Evidence:
    """Both models; ``shapes`` and ``toxic`` are weights by hashed feature."""

    shapes: np.ndarray
    bias: float
    toxic: np.ndarray
    toxic_bias: float
    blank: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities that each text is good, and that it is toxic."""
        flat, offsets = split_words(texts)
        coded = flat.dictionary_encode()
        codes, words = np.asarray(coded.indices, np.int64), coded.dictionary
        counts = np.diff(offsets)
        shape, speaks = features(words)
        quality = self.bias + segment_sums(self.shapes[shape][codes], offsets) / np.maximum(1, counts)
        # each toxic word of a text counts once
        rows = np.flatnonzero(self.toxic[speaks][codes])
        doc = np.searchsorted(offsets, rows, side="right") - 1
        pairs = np.unique(doc * WORDS + speaks[codes[rows]])
        toxic = self.toxic_bias + np.bincount(pairs // WORDS, weights=self.toxic[pairs % WORDS], minlength=len(texts))[: len(texts)]
        good = _sigmoid(quality) * (1 - _sigmoid(toxic))
        return np.where(counts > 0, np.clip(good, 1e-6, 1 - 1e-6), self.blank), np.where(counts > 0, _sigmoid(toxic), 0.0)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shape and hashed lower-cased letters of each distinct word."""
    shapes = word_shapes(words).dictionary_encode()
    shape = (hash_words(shapes.dictionary.to_pylist(), 1) % np.uint64(SHAPES)).astype(np.int64)[np.asarray(shapes.indices, np.int64)]
    return shape, hashed(words)


def likelihood_root(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Signed root of the likelihood ratio of words held by a of the toxic and b of the clean documents."""
    total, held = toxic + clean, a + b
    out = np.zeros(len(a))
    for seen, wanted in ((a, held * toxic), (b, held * clean), (toxic - a, (total - held) * toxic), (clean - b, (total - held) * clean)):
        out += seen * np.log(np.maximum(seen, 1e-300) * total / np.maximum(wanted, 1e-300))
    return np.sign(a * total - held * toxic) * np.sqrt(np.maximum(0, 2 * out))


def word_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """How many labelled documents that are not toxic (0), and toxic ones (1), there are, and how many of them hold each hashed word."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic"))
    kind = np.min_scalar_type(WORDS - 1).newbyteorder("<")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, offsets = split_words(part.column("text"))
                coded = flat.dictionary_encode()
                word = hashed(coded.dictionary)[np.asarray(coded.indices, np.int64)]
                pairs = np.unique(np.repeat(np.arange(part.num_rows), np.diff(offsets)) * WORDS + word)
                ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * WORDS) * kind.itemsize
                buffers = [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer((pairs % WORDS).astype(kind).tobytes())]
                yield pa.record_batch([part.column("_id"), pa.Array.from_buffers(pa.binary(), part.num_rows, buffers)], names=["_id", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, held = np.zeros(2, np.int64), np.zeros((2, WORDS), np.int64)
        for batch in batches:
            for part in slices(batch, "words"):
                own = part.column("words").to_pylist()
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                documents += np.bincount(toxic, minlength=2)
                size = np.fromiter(map(len, own), np.int64, len(own)) // kind.itemsize
                np.add.at(held, (np.repeat(toxic, size), np.frombuffer(b"".join(own), kind)), 1)
        # word -1 stands for the documents themselves
        used = np.flatnonzero(held.any(axis=0))
        yield pa.record_batch([pa.array(np.concatenate([[-1], used])), *(pa.array(np.concatenate([[documents[k]], held[k][used]])) for k in (0, 1))], names=["word", "clean", "toxic"])

    # the hashed words of a text move to its label, not the text; labels grow with the corpus: the same join at every size
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).where("_id is not null")
    labelled = texts.mapInArrow(distinct_words, "_id long, words binary").join(known.hint("merge"), "_id").select("words", (F.col("toxic") > 0).alias("toxic"))
    # one row for each hashed word: WORDS + 1 at most
    found = labelled.mapInArrow(count, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    words, out = np.asarray(found.column("word"), np.int64), np.zeros((2, WORDS + 1), np.int64)
    for k, name in enumerate(("clean", "toxic")):
        out[k][words] = np.asarray(found.column(name), np.int64)
    return out[:, -1], out[:, :-1]


def hashed(words: pa.Array) -> np.ndarray:
    """Hashed lower-cased letters of each distinct word."""
    bare = pc.utf8_lower(pc.utf8_trim(words, ".,;:!?\"'()[]*#$%&|"))
    return (hash_words(bare.to_pylist(), 2) % np.uint64(WORDS)).astype(np.int64)


def fit_evidence(sample: pa.Table, documents: np.ndarray, held: np.ndarray) -> Evidence:
    """``sample``: labelled texts; the other two: see ``word_counts``."""
    texts = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    quality = np.asarray(sample.column("quality"), np.float64)
    toxic = np.asarray(sample.column("toxic"), np.float64) > 0
    good = (quality > 0) & ~toxic
    rate = (good.sum() + 1) / (len(good) + 2)
    empty = Evidence(np.zeros(SHAPES), float(_logit(rate)), np.zeros(WORDS), -40.0, float(rate))
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    flat, offsets = split_words(texts)
    counts = np.diff(offsets)
    if not len(flat):
        return empty
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    shape, word = features(coded.dictionary)
    doc = np.repeat(np.arange(len(texts)), counts)
    if 0 < quality.sum() < len(quality):
        x = np.bincount(doc * SHAPES + shape[codes], minlength=len(texts) * SHAPES).reshape(-1, SHAPES) / np.maximum(1, counts)[:, None]
        used = np.flatnonzero(x.any(axis=0))
        x = np.column_stack([x[:, used], np.ones(len(x))])
        beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE * len(x))
        penalty[-1] = 1e-9
        for _ in range(12):
            p = _sigmoid(x @ beta)
            w = np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty), x.T @ (quality - p) - penalty * beta)
            beta += step
            if np.abs(step).max() < 1e-4:
                break
        empty.shapes[used], empty.bias = beta[:-1], float(beta[-1])
    else:
        empty.bias = float(_logit((quality.sum() + 1) / (len(quality) + 2)))
    if documents.all():
        with_word, clean_with = held[1], held[0]
        n_toxic, n_clean = int(documents[1]), int(documents[0])
        a, b, c, d = with_word + 0.5, clean_with + 0.5, n_toxic - with_word + 0.5, n_clean - clean_with + 0.5
        chosen = (with_word >= MIN_HELD) & (np.log(a * d / (b * c)) >= MIN_ODDS) & (likelihood_root(with_word, clean_with, n_toxic, n_clean) >= MIN_ROOT)
        empty.toxic = np.where(chosen, np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1)), 0.0)
        # the rest of toxic documents hold none of these words; absence shifts the odds by what the sample says
        spoken = np.isin(np.arange(len(texts)), doc[chosen[word[codes]]])
        silent = ((toxic & ~spoken).sum() + 0.5) / ((~spoken).sum() + 1.0)
        empty.toxic_bias = float(_logit(np.clip(min(silent, n_toxic / (n_toxic + n_clean)), 1e-4, 0.5)))
    return empty


def site_posteriors(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """host, path, host_score, path_score, odds (of path over all) from rows of host, path, good."""
    paths = scratch.keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = float(np.clip((whole.s or 0.0) / whole.n, 1e-4, 1 - 1e-4)) if whole.n else 0.5

    def strength(groups: DataFrame, n: str, s: str, parent: Column) -> float:
        """The method of moments over all groups, as sums made by Spark."""
        rate = F.col(s) / F.col(n)
        within = parent * (1 - parent)
        row = groups.where(F.col(n) > 1).agg(F.sum(F.col(n) * ((rate - parent) ** 2 - within / F.col(n))).alias("b"), F.sum(n).alias("n"), F.avg(within).alias("w"), F.count(F.lit(1)).alias("k")).first()
        return 100.0 if (row.k or 0) < 2 else float(np.clip(row.w / max(row.b / row.n, 1e-6) - 1, 1.0, 1e4))

    k = strength(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_score", (F.col("hs") + k * mean) / (F.col("hn") + k))
    joined = scratch.keep(paths.join(hosts, "host"), "sites")
    k = strength(joined, "n", "s", F.col("host_score"))
    score = (F.col("s") + k * F.col("host_score")) / (F.col("n") + k)
    joined = joined.withColumn("path_score", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), score)))
    return scratch.keep(joined.select("host", "path", "host_score", "path_score", (F.log(F.col("path_score") / (1 - F.col("path_score"))) - float(_logit(mean))).alias("odds")), "posteriors")


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, toxic_limit: float = TOXIC_LIMIT, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, keep_columns: bool = False) -> DataFrame:
    """doc_id, host, path, doc_score, toxic_score, host_score, path_score, posterior, kept of each row.

    With ``keep_columns``: the rows of ``docs`` that are kept, as they were.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "site-quality")
    model = spark.sparkContext.broadcast(fit_evidence(labelled_texts(docs, labels, rows, max_bytes, id_col, text_col), *word_counts(docs, labels, id_col, text_col)))
    names = docs.columns if keep_columns else []
    id_, host_, path_, text_, good_, toxic_ = unused(docs.columns, "id", "host", "path", "text", "good", "toxic")
    added = [id_, host_, path_]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"{id_} long", f"{host_} string", f"{path_} string", f"{good_} double", f"{toxic_} double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_):
                good, toxic = model.value.scores(part.column(text_))
                yield pa.record_batch([*(part.column(n) for n in [*names, *added]), pa.array(good), pa.array(toxic)], names=[*names, *added, good_, toxic_])

    site = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((host, host_), (path, path_))]
    # each text is scored once; what is kept beside the scores is what the result needs
    plain = docs.select(*[f"`{n}`" for n in names], F.col(f"`{id_col}`").cast("long").alias(id_), *site, F.col(f"`{text_col}`").cast("string").alias(text_))
    scored = scratch.keep(plain.mapInArrow(score, schema), "evidence")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias(id_)).agg(F.min(F.when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)).alias("label"))
    sites = site_posteriors(scored.select(id_, host_, path_, good_).join(known, id_, "left").select(F.col(host_).alias("host"), F.col(path_).alias("path"), F.coalesce("label", good_).alias("good")), scratch)
    # the table of sites is broadcast only if Spark finds it below its threshold; a hot site is split otherwise
    hs, ps, odds = unused([*scored.columns], "host_score", "path_score", "odds")
    placed = scored.join(sites.toDF(host_, path_, hs, ps, odds), [host_, path_])
    posterior = 1 / (1 + F.exp(-(F.log(F.col(good_) / (1 - F.col(good_))) + F.col(odds))))
    kept = (posterior >= threshold) & (F.col(toxic_) < toxic_limit)
    if keep_columns:
        return placed.where(kept).select(*[f"`{n}`" for n in names])
    return placed.select(F.col(id_).alias("doc_id"), F.col(host_).alias("host"), F.col(path_).alias("path"), F.col(good_).alias("doc_score"), F.col(toxic_).alias("toxic_score"), F.col(hs).alias("host_score"), F.col(ps).alias("path_score"), posterior.alias("posterior"), kept.alias("kept"))
