"""Operators against brute force on a table with nulls, empty and long texts, ties, repeats and an extra column."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import audio, compact_windows, langid, maxent_lm, packing, pfair, quality_rules, simhash, site_quality, token_index

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, tokens string"
EN = "The cat sat on the mat and looked at the small brown dog which ran over the hill to find another bone number"
DE = "Der Hund lief über den grünen Hügel und suchte nach einem anderen Knochen während die Katze schlief am Haus"


def rows():
    out = []
    for k in range(60):
        base, lang = ((EN, "en"), (DE, "de"))[k % 2]
        text = " ".join(f"{w}{(k * 7 + n) % 11 if n % 3 == 0 else ''}" for n, w in enumerate(base.split() * 4))
        out.append((k, text, lang, "abc"[k % 3], len(text), "x", "y"))
    out += [(60, None, None, None, None, None, None), (61, "", "en", "a", 0, None, None), (62, " \t\n", "en", "a", 3, None, None)]
    out += [(63, out[0][1], "en", "a", 1, None, None), (64, out[0][1].upper(), "en", "a", 1, None, None), (65, "word " * 60000, "en", "b", 1, None, None), (66, "a b", "de", None, 3, None, None)]
    out += [(67, "hello <|startoftext|> world<|endoftext|>", "en", "a", 1, None, None), (68, "x <|ENDOFTEXT|>y\tz <|endoftext|", "en", "a", 1, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(40)] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return WORDS.findall(text or "")


def test_token_store(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = by_id(token_index.token_store(docs, public_tokenizers.path("word_bpe_49k.json"))), 0
    for r in rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_quality_rules(docs, labels):
    got = by_id(quality_rules.judge(docs, labels))
    for r in rows():
        text, w = r[1] or "", words(r[1])
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(windows)
        marked = {k + d for k, g in enumerate(windows) if often[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))
        assert g.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (g.base_failed and g.kept)


def test_maxent(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = by_id(maxent_lm.score(docs, held))
    tokens = {r[0]: [w.translate(LOWER) for w in words(r[1])] + [None] for r in rows()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = Counter(t for k, x in tokens.items() if not out[k] for t in x)
    n = sum(counts.values())
    for k, x in tokens.items():
        base = sum(math.log10((counts[t] + 1) / (n + len(counts) + 1)) for t in x)
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (out[k], len(x), sum(counts[t] > 0 for t in x), n)
        assert got[k].base_score == pytest.approx(base) and got[k].score < 0


def test_simhash(docs):
    prints = {}
    for r in rows():
        w = [x.translate(LOWER) for x in words(r[1])]
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[r[0]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    part = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    got = by_id(simhash.near_duplicates(docs))
    assert {k: g.fingerprint for k, g in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: g.component_id for k, g in got.items()} == part


def test_packing(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    for r in rows():
        ids, at = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], 0
        for p in sorted((p for p in pieces if p.doc_id == r[0]), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p.offset, p.length) for p in pieces if p.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_media(docs):
    got = by_id(audio.audio_features(docs))
    for r in rows():
        data = (r[1] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        g = got[r[0]]
        import hashlib

        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[0].feature == got[63].feature and got[0].media_sha256 == got[63].media_sha256


    for r in rows():
        table = audio.read_windows(got[r[0]].windows)
        kind = table.schema.field("log_mel").type
        assert kind.shape == [audio.WINDOW, audio.MELS] and table.num_rows == int(got[r[0]].feature.split(":")[2])
        start, end = table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist()
        # the spans cover the payload without gaps
        assert start[0] == 0 and start[1:] == pytest.approx(end[:-1]) and end[-1] == pytest.approx(got[r[0]].payload_bytes / 16)
        assert all(0 <= s.start_ms < s.end_ms for s in got[r[0]].spans)
    assert audio.read_windows(got[65].windows).num_rows > 20


@pytest.mark.parametrize("up, down", [(3, 4), (1, 2), (2, 1), (5, 3)])
def test_resampler(up, down):
    samples = np.random.default_rng(up).integers(0, 256, 301, np.uint8)
    phases = audio.polyphase_filter(up, down)
    size = phases.shape[1]
    # zeros between the samples, the whole filter at the high rate, then every ``down``th value
    whole = np.zeros(up * size)
    for p in range(up):
        whole[p::up] = phases[p][::-1]
    high = np.zeros((len(samples) + size) * up)
    high[: len(samples) * up : up] = (samples.astype(float) - 128) / 128
    smooth = np.convolve(high, whole)
    want = [smooth[k * down + (size - size // 2 - 1) * up] for k in range(-(-len(samples) * up // down))]
    got = audio.resample(samples, up, down)
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert audio.resample(samples, up, down, 7, 50) == pytest.approx(got[7:50], abs=1e-6)


def test_tones():
    """A tone's log-mel frames peak in the band that holds it; frames do not depend on the pieces."""
    rate = audio.RATE * audio.UP / audio.DOWN
    bank = audio.mel_bank(rate)
    for hertz in (400, 1000, 2500, 4500):
        tone = np.round(128 + 90 * np.sin(2 * np.pi * hertz * np.arange(40000) / audio.RATE)).astype(np.uint8)
        mel, energy = audio.log_mel(tone, rate)
        assert len(mel) == audio.frame_count(30000)
        assert abs(int(np.median(mel[2:-2].argmax(axis=1))) - int(bank[round(hertz * audio.FRAME / rate)].argmax())) <= 1
        assert np.ptp(energy[2:-2]) < 1


def test_pieces(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 70000, np.uint8)
    whole = audio.log_mel(samples, 12000)
    monkeypatch.setattr(audio, "PIECE", 64)
    for a, b in zip(whole, audio.log_mel(samples, 12000), strict=True):
        assert a == pytest.approx(b, abs=1e-3)


def test_stored_windows():
    mel = np.random.default_rng(3).normal(0, 2, (150, audio.MELS)).astype(np.float32)
    table = audio.read_windows(audio.store_windows(mel, 10.0, 1501.0))
    assert table.column("start_ms").to_pylist() == [0, 640, 1280] and table.column("end_ms").to_pylist() == [640, 1280, 1501]
    held = table.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert held[:150].astype(np.float32) == pytest.approx(mel, rel=1e-3, abs=1e-3) and (held[150:] == -6).all()


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(50):
        energy = np.round(rng.normal(0, 1, int(rng.integers(1, 60))), 2)
        level, want, opened = np.round(energy - np.median(energy), 3), [], None
        for k, x in enumerate([*level, -99]):
            if opened is None and x >= audio.OPEN_DB:
                opened = k
            elif opened is not None and x < audio.CLOSE_DB:
                want += [(opened, k)] if k - opened >= audio.MIN_FRAMES else []
                opened = None
        assert audio.segments(energy) == want


def test_languages(docs):
    got = by_id(langid.identify(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    assert [got[k].lang_pred for k in (60, 61, 62)] == ["und"] * 3
    assert all(got[k].lang_pred == ("en", "de")[k % 2] and 0 <= got[k].score <= 1 for k in range(60))


def test_passages(spark):
    unique = lambda k, n: " ".join(f"u{k}x{j}" for j in range(n))
    passage = unique("shared", 70)
    data = [(1, f"{unique(1, 40)} {passage} {unique(2, 40)}"), (2, f"{unique(3, 30)} {passage} {unique(4, 10)}"), (3, unique(5, 120)), (4, None), (5, ""), (None, f"{unique(6, 9)} {passage}"), (2, f"{unique(7, 9)} other row"), (6, passage.upper())]
    df = spark.createDataFrame([(*r, "x", [1]) for r in data], "doc_id long, text string, _spans string, _span_id array<int>")
    spans = compact_windows.repeated_passages(df).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in spans) == [(2, 30, 100, 1), (6, 0, 70, 1)]
    cleaned = compact_windows.remove_repeats(df)
    assert cleaned.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in cleaned.collect())
    # a document that is all a repeat goes with its row; the others stay as they were
    assert kept == Counter([*(r for k, r in enumerate(data) if k not in (1, 7)), (2, f"{unique(3, 30)} {unique(4, 10)}")])


def test_passage_of_two_documents(spark):
    unique = lambda k, n: " ".join(f"u{k}x{j}" for j in range(n))
    data = [(1, unique(1, 200)), (2, unique(2, 200)), (3, f"{unique(3, 20)} {' '.join(unique(1, 200).split()[50:110])} {' '.join(unique(2, 200).split()[90:150])} {unique(4, 20)}")]
    got = compact_windows.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in got) == [(3, 20, 80, 1), (3, 80, 140, 2)]


def test_near_passages(spark):
    import random

    pick = random.Random(7)
    fresh = lambda n: [f"w{pick.randrange(3000)}" for _ in range(n)]
    data, planted = [], {}
    for k in range(160):
        # a passage of 60 to 200 words, every 10th to 25th word changed, some lost, some added
        passage, every = fresh(pick.randrange(60, 200) if k % 4 else 200), pick.randrange(10, 26)
        copy = []
        for n, w in enumerate(passage):
            if n % every != every // 2:
                copy.append(w)
            elif k % 5 == 0:
                copy += [w, "added"]
            elif k % 5 > 1:
                copy.append("changed")
        front = fresh(pick.randrange(0, 900))
        data += [(2 * k, " ".join(fresh(30) + passage + fresh(30))), (2 * k + 1, " ".join(front + copy + fresh(40)))]
        planted[2 * k + 1] = (len(front), len(front) + len(copy), len(passage))
    got = compact_windows.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    caught = {r.doc_id for r in got if r.doc_id in planted and r.first_doc_id == r.doc_id - 1 and min(r.end_word, planted[r.doc_id][1]) - max(r.start_word, planted[r.doc_id][0]) >= 0.7 * (planted[r.doc_id][1] - planted[r.doc_id][0])}
    long = {k for k, p in planted.items() if p[2] >= 150}
    # nothing else is named
    assert all(r.doc_id in planted and r.first_doc_id == r.doc_id - 1 and r.start_word >= planted[r.doc_id][0] - 12 and r.end_word <= planted[r.doc_id][1] + 12 for r in got)
    assert len(caught & long) >= 0.95 * len(long) and len(caught) >= 0.9 * len(planted), (len(caught), len(planted), len(caught & long), len(long))


def common_words(a, b):
    """Words of a in runs of three that b holds."""
    held, out = set(zip(b, b[1:], b[2:], strict=False)), set()
    for n, run in enumerate(zip(a, a[1:], a[2:], strict=False)):
        if run in held:
            out |= {n, n + 1, n + 2}
    return len(out)


def test_passages_against_brute_force(spark, monkeypatch):
    import random

    pick = random.Random(11)
    monkeypatch.setattr(compact_windows, "TILE", 64)
    size = 14
    stock = [[f"p{n}x{j}" for j in range(pick.randrange(14, 60))] for n in range(12)]
    data = []
    for k in range(150):
        text = []
        for _ in range(pick.randrange(0, 5)):
            part = pick.choice(stock)
            a = pick.randrange(0, len(part) - 13)
            text += part[a : a + pick.randrange(5, 60)] + [f"f{pick.randrange(4000)}" for _ in range(pick.randrange(0, 40))]
        data.append((k, " ".join(text)))
    got = compact_windows.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(4), min_words=size, shingle=3).collect()
    texts = {k: t.split() for k, t in data}
    covered = {k: set() for k in texts}
    for r in got:
        assert r.first_doc_id < r.doc_id and r.end_word - r.start_word >= size
        own = texts[r.doc_id][r.start_word : r.end_word]
        assert common_words(own, texts[r.first_doc_id]) >= 0.8 * len(own)
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    missed = total = 0
    held: dict[tuple, int] = {}
    for k, words_ in texts.items():
        runs = [tuple(words_[n : n + size]) for n in range(len(words_) - size + 1)]
        for n, run in enumerate(runs):
            if held.get(run, k) < k:
                total += 1
                missed += not set(range(n, n + size)) <= covered[k]
        for run in runs:
            held.setdefault(run, k)
    assert total > 500 and missed <= 0.005 * total, (missed, total)


def test_mix_and_sites(docs, labels):
    mixed = pfair.mix(docs.select("doc_id", "source", "lang", "n_chars"), power=0.5).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r[0] for r in rows())
    judged = site_quality.judge(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len({r.doc_id for r in judged}) == len(judged) > 0


@pytest.mark.parametrize("name", ["rules", "lm", "simhash", "packing", "tokens", "media", "language", "passages", "mix", "sites"])
def test_empty_table(spark, docs, labels, name):
    none = docs.limit(0)
    held = F.lit(False)
    made = {
        "rules": lambda: quality_rules.judge(none, labels), "lm": lambda: maxent_lm.score(none, held), "simhash": lambda: simhash.near_duplicates(none),
        "packing": lambda: packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")), "tokens": lambda: token_index.token_store(none, public_tokenizers.path("word_bpe_49k.json")),
        "media": lambda: audio.audio_features(none), "language": lambda: langid.identify(none, held), "passages": lambda: compact_windows.repeated_passages(none),
        "mix": lambda: pfair.mix(none.select("doc_id", "source", "lang", "n_chars"), power=0.5), "sites": lambda: site_quality.judge(none, labels, F.col("source"), F.col("lang")),
    }
    assert made[name]().count() == 0


def test_near_copies(spark):
    import random

    import corpus_pipeline
    from tidelog.llm import near_copies

    pick = random.Random(3)
    data = []
    for k in range(120):
        text = [f"w{pick.randrange(5000)}" for _ in range(pick.randrange(60, 400))]
        data.append((len(data), " ".join(text)))
        for _ in range(k % 3):
            copy = [f"c{pick.randrange(5000)}" if pick.random() < 0.004 * (k % 12) else w for w in text]
            data.append((len(data), " ".join(copy).title() if k % 2 else " ".join(copy)))
    data += [(len(data), "one two"), (len(data) + 1, "One  two"), (len(data) + 2, None), (len(data) + 3, " "), (None, data[0][1])]
    grams = {k: {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for k, t in data if k is not None for w in [words((t or "").lower())]}
    part, low = {k: k for k in grams}, 0
    for a in grams:
        for b in range(a):
            same = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            low += 0.8 <= same < 0.9
            if same >= 0.8 and part[a] != part[b]:
                gone, to = max(part[a], part[b]), min(part[a], part[b])
                part = {k: to if v == gone else v for k, v in part.items()}
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert low > 5
    found = near_copies.near_copies(df, cell_words=1000).collect()
    assert {r.doc_id: r.component for r in found} == part and {r.doc_id for r in found if r.first} == set(part.values())
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(part.values())) and kept.count(None) == 1


def test_near_dedup_of_repeated_rows(spark):
    import corpus_pipeline

    words_of = lambda k: " ".join(f"t{k}w{n}" for n in range(80))
    # an id with two texts, rows that are there twice (with another value, and wholly), a copy under another id, ids and texts that are null
    data = [(1, words_of(1), "b"), (1, words_of(2), "a"), (2, words_of(3), "x"), (2, words_of(3), "y"), (3, words_of(4), "z"), (3, words_of(4), "z"), (4, words_of(1).upper(), "c"), (None, words_of(1), "n"), (None, words_of(1), "n"), (5, None, None), (6, "  ", "q")]
    df = spark.createDataFrame(data, "doc_id long, text string, _go string").repartition(3)
    for source in (df, df.repartition(7)):
        got = corpus_pipeline.near_dedup(spark, source, "")
        rows = Counter((r.doc_id, r.text) for r in got.collect())
        assert got.columns == df.columns and rows == Counter({(1, words_of(1)): 1, (1, words_of(2)): 1, (2, words_of(3)): 1, (3, words_of(4)): 1, (None, words_of(1)): 2, (5, None): 1})
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_mixture_reaches_packing(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(pfair, "RANKED_ROWS", 200)
    monkeypatch.setattr(packing, "ORDERED_ROWS", 300)
    # source a has long documents, b short ones, c few
    data = [(k, " ".join(f"w{(k + n) % 97}" for n in range((900, 120, 300)["abc"[k % 3] == "b" and 1 or (k % 3)] + k % 50)), "abc"[k % 3] if k % 9 != 2 else "a") for k in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    mixed = corpus_pipeline.mixing(spark, df, "")
    # rows come in any order and from many files
    pieces = corpus_pipeline.pack(spark, mixed.repartition(7, "doc_id"), "").collect()
    place = {r.doc_id: r["_position"] for r in mixed.collect()}
    source = {k: s for k, _, s in data}
    total = sum(p.length for p in pieces)
    assert {p.doc_id for p in pieces} == set(source) and {p.sequence_id for p in pieces} == set(range(max(p.sequence_id for p in pieces) + 1))

    def shares(ordered, part):
        held, seen = Counter(), 0
        for p in ordered:
            if seen < part * total:
                held[source[p.doc_id]] += p.length
                seen += p.length
        return {s: held[s] / seen for s in "abc"}

    for part in (0.1, 0.25, 0.5, 0.75):
        goal = shares(sorted(pieces, key=lambda p: place[p.doc_id]), part)
        got = shares(sorted(pieces, key=lambda p: p.sequence_id), part)
        assert all(abs(goal[s] - got[s]) < 0.06 for s in "abc"), (part, goal, got)


def test_rare_toxic_words(spark):
    # eleven toxic documents of 76 hold two words; two without a label hold them too, on a site that is good
    rude = dict.fromkeys(range(11), "scum moron") | {100: "scum moron", 101: "Moron! Scum"}
    data = [(k, f"{' '.join(f'w{(k * 13 + n * 7) % 31}' for n in range(60))} {rude.get(k, 'friend')}", "big", "en") for k in range(110)]
    labels = spark.createDataFrame([(k, 1, int(k in rude)) for k in range(76)], "doc_id long, quality int, toxic int")
    got = by_id(site_quality.judge(spark.createDataFrame(data, "doc_id long, text string, source string, lang string"), labels, F.col("source"), F.col("lang")))
    assert {k for k, r in got.items() if r.toxic_score >= 0.8} == set(rude)
    assert {k for k, r in got.items() if not r.kept} == set(rude)


def test_store_by_key(spark, tmp_path, monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_index, "SHARD_BYTES", 4000)
    texts = {k: f"text number {k} of the store <|endoftext|> {'long ' * (k % 50)}" for k in range(-150, 450, 3)}
    data = [*texts.items(), *((9, f"again {n}") for n in range(300)), (None, "no key"), (600, None)]
    folder = str(tmp_path / "store")
    manifest = token_index.write_store(spark.createDataFrame(data, "doc_id long, text string"), folder, public_tokenizers.path("word_bpe_49k.json"))
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 3 and shards[0].start == 0 and all(b.start == a.start + a.tokens for a, b in zip(shards, shards[1:], strict=False))
    encoded = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    wanted = {}
    for k, t in data:
        wanted.setdefault(k, []).append(encoded(t))
    store = token_index.Store(folder)
    for k in range(-160, 610):
        assert sorted(x.tolist() for x in store.get(k)) == sorted(wanted.get(k, [])), k


def test_perfect_hash():
    import numpy as np

    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert sorted(token_index.MinimalPerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def earliest_deadlines(weights, slots):
    """The schedule from its beginning, with fractions."""
    from fractions import Fraction

    whole = sum(Fraction(w) for w in weights)
    share = [Fraction(w) / whole for w in weights]
    done, out = [0] * len(weights), []
    for t in range(slots):
        ready = [k for k in range(len(weights)) if math.floor(done[k] / share[k]) <= t]
        k = min(ready, key=lambda k: (math.ceil((done[k] + 1) / share[k]), k))
        done[k] += 1
        out.append(k)
    return out


def test_pfair_schedule():
    import random
    from itertools import islice

    pick = random.Random(4)
    for trial in range(60):
        weights = [float(pick.randrange(1, 9)) if trial % 3 == 0 else pick.random() ** pick.choice([1, 4]) + 1e-3 for _ in range(pick.randrange(1, 7))]
        parts = pfair.parts_of(weights)
        assert all(abs(a / sum(parts) - w / sum(weights)) < 1e-14 for a, w in zip(parts, weights, strict=True))
        wanted = earliest_deadlines(weights if trial % 3 == 0 else parts, 150)
        assert list(islice(pfair.line(parts, 0, [0] * len(weights)), 150)) == wanted
        for t in range(0, 150, 11):
            assert pfair.counts_at(parts, t) == [wanted[:t].count(k) for k in range(len(weights))]


def test_pfair_deviation():
    from itertools import islice

    import numpy as np

    for weights in ([math.sqrt(n) for n in (400_000, 300_000, 120_000, 50_000, 7_000, 333)], [0.9, 0.07, 0.03], [math.pi, math.e, 0.001]):
        slots = 1_000_000
        found = np.fromiter(islice(pfair.line(pfair.parts_of(weights), 0, [0] * len(weights)), slots), np.int64, slots)
        for k, w in enumerate(weights):
            assert np.abs(np.cumsum(found == k) - np.arange(1, slots + 1) * (w / sum(weights))).max() < 1


def test_pfair_table(spark, monkeypatch):
    import numpy as np

    # a hot source, small ones, null, and columns named like the operator's own
    data = [(k, "hot" if k % 3 else None if k % 21 == 0 else f"s{k % 5}", f"text {k}", -1, -1, "x", "y") for k in range(6000)] + [(1, "hot", "text 1", -1, -1, "x", "y")] * 3
    df = spark.createDataFrame(data, "doc_id long, source string, text string, slot long, position long, _order string, _key string").repartition(5)
    weights = {s: w for s, w in (("hot", math.sqrt(2)), (None, 0.1))}
    got = pfair.mix(df, weights, power=0.5).orderBy("position").collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter((k, s, t) for k, s, t, *_ in data)
    assert len({r.position for r in got}) == len(data) and all(r["_order"] == "x" and r["_key"] == "y" for r in got)
    # one source in each slot, eight rows at most, and every slot of the plan used
    held = Counter(r.source for r in got)
    of = {}
    for r in got:
        assert of.setdefault(r.slot, r.source) == r.source
    assert sorted(of) == list(range(sum(-(-n // 8) for n in held.values())))
    assert max(Counter(r.slot for r in got).values()) <= 8
    # until the first source has had its last block, each has its share to within a block
    goal = {s: weights.get(s) or held[s] ** 0.5 for s in held}
    line = [of[t] for t in range(len(of))]
    first_end = min(max(t for t in range(len(line)) if line[t] == s) for s in held)
    for s in held:
        own = np.cumsum([x == s for x in line[: first_end + 1]])
        assert np.abs(own - np.arange(1, first_end + 2) * goal[s] / sum(goal.values())).max() < 1
    # the partitions of the input change nothing
    again = pfair.mix(df.repartition(2), weights, power=0.5).collect()
    assert sorted((r.position, r.doc_id) for r in again) == [(r.position, r.doc_id) for r in got]
    # the number of rows that a task ranks changes no count
    monkeypatch.setattr(pfair, "RANKED_ROWS", 100_000)
    whole = pfair.mix(df, weights, power=0.5).collect()
    assert Counter((r.slot, r.source) for r in whole) == Counter((r.slot, r.source) for r in got)


def longest_matches(text, reference):
    """Phrases of a greedy parse into the longest substrings of the reference."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in reference:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_cross_parsing(monkeypatch):
    import random

    import numpy as np

    pick = random.Random(5)
    for trial in range(12):
        letters = b"ab" if trial % 3 == 0 else b"abcdefgh "
        reference = bytes(pick.choice(letters) for _ in range(pick.choice([1, 30, 400])))
        texts = [bytes(pick.choice(letters + b"z") for _ in range(pick.choice([1, 7, 63, 64, 65, 500, 3000]))) for _ in range(12)]
        # a text that the reference holds never closes a phrase within a lane
        texts += [reference * 3, reference]
        monkeypatch.setattr(langid, "LANE", pick.choice([1, 16, 64]))
        size = np.array([len(t) for t in texts])
        got = langid.Parser(reference).phrases(np.frombuffer(b"".join(texts), np.uint8), size)
        assert got.tolist() == [longest_matches(t, reference) for t in texts]


def test_long_texts_are_learned_from(spark):
    from tidelog.llm.labelled import labelled_texts

    long = " ".join(f"wort{k % 700}" for k in range(9000))
    df = spark.createDataFrame([(1, long, "de"), (2, "the cat sat on the mat " * 9, "en"), (3, "wort5 wort6 wort7 " * 5, None), (None, "x y", "xx")], "doc_id long, text string, lang string")
    got = by_id(langid.identify(df, F.lit(False)))
    assert got[3].lang_pred == got[1].lang_pred == "de" and got[2].lang_pred == "en"
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_texts(df, labels, 10, 4000).to_pylist()
    assert [(r["quality"], r["toxic"]) for r in rows] == [(1, 0), (0, 1)] and len(rows[0]["text"]) == 1000 and rows[0]["text"] in long


def test_simhash_without_ids(spark):
    # a row without an id joins two that have one
    base = " ".join(f"w{k}" for k in range(400)).split()
    def changed(*at):
        return " ".join("zz" if k in at else w for k, w in enumerate(base))
    texts = [(k, changed(*range(0, 4 * k, 4))) for k in range(0, 60)]
    prints = {k: simhash.fingerprint(t) for k, t in texts}
    part = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    part[a] = part[b] = min(part[a], part[b])
    gone = {k for k in prints if k % 2}
    named = {}
    for k in prints:
        if k not in gone:
            named.setdefault(part[k], k)
    df = spark.createDataFrame([(None if k in gone else k, t, k) for k, t in texts], "doc_id long, text string, component_id long")
    got = simhash.near_duplicates(df).collect()
    wanted = Counter((None if k in gone else k, f"{prints[k]:016x}", named.get(part[k])) for k in prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == wanted


def test_site_quality(spark):
    # clashing names, a long text, nulls and a site of its own
    good, bad = "The quiet river runs under an old stone bridge , and people walk there .", "BUY NOW !!! $$$ click 4 free ### win 999 %% CASH *** now !!!"
    data = [(k, (good if k % 2 else bad) + f" w{k}", "a" if k < 80 else "b" if k < 118 else None, "p", 0.5, "h", "t") for k in range(120)] + [(None, good, "a", "p", 0.5, "h", "t"), (500, good * 4000, "a", "p", 0.5, "h", "t"), (501, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, kept string, odds double, _host string, _text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(site_quality.judge(df, labels, F.col("source"), F.col("source")))
    assert len(got) == 122 + 1 and all(got[k].kept == bool(k % 2) for k in range(120)) and got[500].kept
    kept = site_quality.judge(df, labels, F.col("source"), F.col("source"), keep_columns=True)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, r in got.items() if r.kept)


def test_site_posteriors(spark):
    # the hierarchy against the same sums in Python
    import random

    from tidelog.llm.scratch import Scratch

    pick = random.Random(2)
    data = [(h, f"{h}/{p}", 1.0 if pick.random() < 0.2 + 0.1 * (ord(h) - 97) + 0.05 * p else 0.0) for h in "abcdef" for p in range(4) for _ in range(pick.choice([1, 3, 40]))]
    got = {(r.host, r.path): r for r in site_quality.site_posteriors(spark.createDataFrame(data, "host string, path string, good double"), Scratch(spark, "test")).collect()}
    mean = sum(g for *_, g in data) / len(data)

    def shrunk(groups, parent):
        # (n, s) by group, parent mean by group: method of moments, then the beta-binomial's posterior mean
        many = [k for k, (n, _) in groups.items() if n > 1]
        between = sum(n * ((s / n - parent[k]) ** 2 - parent[k] * (1 - parent[k]) / n) for k in many for n, s in [groups[k]]) / sum(groups[k][0] for k in many)
        within = sum(parent[k] * (1 - parent[k]) for k in many) / len(many)
        strength = min(1e4, max(1.0, within / max(between, 1e-6) - 1))
        return {k: (s + strength * parent[k]) / (n + strength) for k, (n, s) in groups.items()}

    hosts, paths = {}, {}
    for h, p, g in data:
        for table, key in ((hosts, h), (paths, (h, p))):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + g)
    host = shrunk(hosts, dict.fromkeys(hosts, mean))
    path = shrunk(paths, {k: host[k[0]] for k in paths})
    for k, r in got.items():
        assert r.host_score == pytest.approx(host[k[0]]) and r.path_score == pytest.approx(path[k])
        assert r.odds == pytest.approx(math.log(path[k] / (1 - path[k])) - math.log(mean / (1 - mean)))


def test_maxent_probabilities(spark):
    import random

    import numpy as np

    from tidelog.llm.scratch import Scratch

    pick = random.Random(9)
    words_ = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    data = []
    for k in range(400):
        text = pick.choices(words_, weights, k=pick.randrange(0, 300))
        # after w1 comes a word that is rare elsewhere
        data.append((k, " ".join(x + " z7" if x == "w1" else x for x in text)))
    data += [(k, "w5 " * 20000) for k in (1000, 1001)] + [(None, "w1 w2"), (2000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    # partitions change nothing
    one, many = (maxent_lm.score(df.repartition(n), held).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True) for n in (1, 9))
    assert one.equals(many)
    gain = (one.score - one.base_score)[one.held_out & one.doc_id.notna()].sum() / one.n_tokens[one.held_out & one.doc_id.notna()].sum()
    assert gain > 0.02
    made, model = maxent_lm.counted(df, held, "doc_id", "text", Scratch(spark, "test"))
    maxent_lm.train(made, model, 1, 2)
    known = {}
    for row in made.collect():
        known |= zip(np.frombuffer(row["hashes"], "<u8").tolist(), row["totals"], strict=True)
    counts = Counter(t for k, text in data if k is not None and k % 7 != 2 for t in [w.translate(LOWER) for w in words(text)] + ["\n"])
    assert sum(v > 0 for v in known.values()) == len(counts)
    # after any history, all known words and the unknown one add up to one
    vocabulary = [h for h, c in known.items() if c] + [12345]
    totals = [known.get(h, 0) for h in vocabulary]
    for history in (["w1"], ["w0", "w3"], ["nobody"]):
        hashes = np.array([*token_index_hash(history), *vocabulary], np.uint64)
        texts = [[k for k in range(len(history))] + [len(history) + n] for n in range(len(vocabulary))]
        row = {"hashes": hashes.astype("<u8").tobytes(), "totals": [0] * len(history) + totals, "sizes": [len(t) for t in texts], "codes": maxent_lm._packed(np.array([c for t in texts for c in t], "<i4")), "held": [False] * len(texts)}
        context = {"hashes": row["hashes"], "totals": row["totals"], "sizes": [len(history)], "codes": maxent_lm._packed(np.arange(len(history)).astype("<i4")), "held": [False]}
        logs = maxent_lm.score_block(model, row)[3] - maxent_lm.score_block(model, context)[3]
        assert (10**logs).sum() == pytest.approx(1, abs=1e-3)
        if history == ["w1"]:
            at = vocabulary.index(token_index_hash(["z7"])[0])
            assert 10 ** logs[at] > 3 * (counts["z7"] + 1) / (sum(counts.values()) + len(counts) + 1)


def token_index_hash(words_):
    from tidelog.llm.textops import hash_words

    return hash_words(words_, 3).tolist()
