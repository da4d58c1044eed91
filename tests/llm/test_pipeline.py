"""All five stages on a table with planted cases, against what has to come out."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    pick = random.Random(11)
    said = lambda n, kind="w": " ".join(f"{kind}{pick.randrange(4000)}" for _ in range(n))
    texts, labels, kind = {}, [], {}

    def add(k, text, name):
        texts[k], kind[k] = text, name

    for k in range(240):
        add(k, said(pick.randrange(80, 400)), "clean")
        labels.append((k, 1, 0))
    for k in range(240, 300):
        add(k, " ".join(pick.choice(["buy", "now", "click", "here", "cheap", f"z{pick.randrange(30)}"]) for _ in range(150)) + f" {said(30, 'q')}", "junk")
        labels.append((k, 0, 0))
    for k in range(300, 350):
        text = said(120).split()
        for _ in range(15):
            text.insert(pick.randrange(len(text)), pick.choice(["vilea", "vileb", "vilec"]))
        add(k, " ".join(text), "toxic")
        # the last ones have no label
        labels += [(k, 1, 1)] if k < 340 else []
    for k in range(350, 370):
        add(k, texts[k - 350], "copy")
    for k in range(370, 390):
        text = texts[k - 340].split()
        text[len(text) // 2] = "changed"
        add(k, " ".join(text), "near copy" if len(text) > 120 else "maybe")
    passage = said(80, "p")
    for k in range(390, 396):
        add(k, f"{said(90)} {passage} {said(60)}", "passage")
    add(396, None, "empty"), add(397, "", "empty")
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(k, t, "en", "a" if k % 3 else "b", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, kind, passage


def test_pipeline(spark, planted):
    folder, texts, kind, passage = planted
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    of = lambda name: {k for k, v in kind.items() if v == name}
    assert of("clean") <= set(pieces) and of("passage") <= set(pieces)
    assert not set(pieces) & (of("copy") | of("near copy"))
    assert len(set(pieces) & of("toxic")) <= 2 and len(set(pieces) & of("junk")) <= 3
    for k, rows in pieces.items():
        rows.sort(key=lambda r: r.start)
        # every id in one piece
        assert [r.start for r in rows] == [sum(x.length for x in rows[:n]) for n in range(len(rows))] and sum(r.length for r in rows) == rows[0].doc_tokens
        if kind[k] == "clean":
            assert rows[0].doc_tokens == len(encode(texts[k], add_special_tokens=False).ids) + 1
        if kind[k] == "passage":
            # the document with the smallest id keeps the passage
            left = texts[k] if k == 390 else texts[k].replace(passage, "")
            assert abs(rows[0].doc_tokens - len(encode(left, add_special_tokens=False).ids) - 1) <= 3
    sequences = {}
    for rows in pieces.values():
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048


def test_stages_keep_the_columns(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert stage(spark, docs.limit(0), folder).count() == 0
