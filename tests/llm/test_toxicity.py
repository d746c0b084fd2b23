"""Toxicity: held-out rows, windows of odd texts, and tables that teach nothing."""

from __future__ import annotations

import random
import time
import zlib

from helpers import EXTRA, odd_documents

from tollway.llm import toxicity as tox

BAD = ["vileword", "rottenly", "grimface", "hatespit"]


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def corpus(seed, n=900):
    """(id, text, label): every fifth document has some of four words among random ones."""
    rng = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti", "vo", "ze"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.randrange(5, 150))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() + ",")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def tables(spark, rows):
    docs = [(k, t, "x", "y", 1, 2, 3, "b", "k", 4) for k, t, _ in rows]
    labels = [(k, y, "z", 1) for k, _, y in rows]
    return (
        spark.createDataFrame(docs, f"doc_id long, text string, {EXTRA}"),
        spark.createDataFrame(labels, "doc_id long, toxic int, text string, id long"),
    )


def test_held_out_rows_are_told_apart(spark):
    rows = corpus(1)
    docs, labels = tables(spark, rows)
    model = tox.train(docs, labels)
    got = {r["doc_id"]: r for r in tox.score(docs, model).collect()}
    held = [(got[k], y) for k, _, y in rows if remainder(k) == 2]
    assert len(held) > 150
    assert sum(r["predicted"] == y for r, y in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r, _ in held)


def test_held_out_labels_are_never_read(spark):
    rows = corpus(2, 400)
    turned = [(k, t, 1 - y if remainder(k) == 2 else y) for k, t, y in rows]
    assert tox.train(*tables(spark, rows)) == tox.train(*tables(spark, turned))


def test_fewer_labelled_documents(spark):
    rows = corpus(3, 600)
    model = tox.train(*tables(spark, rows), max_labelled=60)
    got = {r["doc_id"]: r["predicted"] for r in tox.score(tables(spark, rows)[0], model).collect()}
    assert sum(got[k] == y for k, _, y in rows) >= 0.93 * len(rows)


def test_nothing_to_learn_from(spark):
    docs, labels = tables(spark, corpus(4, 40))
    for some, share in [
        (labels.limit(0), 0.0),
        (labels.where("toxic = 1"), 1.0),
        (labels.where("toxic = 0"), 0.0),
        (labels.selectExpr("doc_id", "CAST(NULL AS int) AS toxic"), 0.0),
    ]:
        model = tox.train(docs, some)
        assert {r["score"] for r in tox.score(docs, model).collect()} == {share}
    assert tox.score(docs.limit(0), tox.Model()).collect() == []
    assert tox.train(docs.limit(0), labels).weights == []


def test_odd_documents(spark):
    rows = corpus(5, 300)
    model = tox.train(*tables(spark, rows))
    odd = [(k, t, 0) for k, t in odd_documents()]
    got = tox.score(tables(spark, odd)[0], model).collect()
    assert len(got) == len(odd)
    assert all(0 <= r["score"] <= 1 and r["windows"] > 0 for r in got)
    by_text = {}
    for (k, t, _), r in zip(sorted(odd, key=str), sorted(got, key=lambda r: str((r["doc_id"],)))):
        by_text.setdefault((k, t), set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_windows_hold_every_word(monkeypatch):
    rng = random.Random(6)
    for chars in (1 << 18, 7):
        monkeypatch.setattr(tox, "PIECE_CHARS", chars)
        for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 30):
            words = [f"w{rng.randrange(99)}" for _ in range(n)]
            found = [w.removesuffix(tox._PHRASE) for w in tox.windows(", ".join(words))]
            assert len(found) >= 1
            assert set(b" ".join(found).split()) == {w.encode() for w in words}
            assert all(len(f.split()) <= tox.WINDOW for f in found)
    assert list(tox.windows(None)) == list(tox.windows("")) == [b"  " + tox._PHRASE]


def test_long_texts_take_their_length():
    distance = tox.Distance(*(tox._dictionary(w) for w in (["vile"], ["kind"])))
    start = time.process_time()
    assert distance.histogram("some kind of words here " * 100_000).sum() > 100_000
    assert distance.histogram("x" * 3_000_000).sum() > 10_000
    assert distance.histogram("." * 3_000_000).sum() == 1
    assert time.process_time() - start < 60
