"""Ranked lexical search against plain counting."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from helpers import EXTRA, documents, odd_documents

from tollway.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ls.UPPER, ls.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item, rank, id, score), as the counts say."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, Counter()).update(terms(t))
    found = []
    for item, wanted in own.items():
        scored = []
        for doc, c in counts:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(
                times
                * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in wanted.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort()
        found += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(scored[:k])]
    return sorted(found, key=str)


def items_table(spark, rows):
    data = [(k, t, "x", "y", 1, 2, 3, "b", "k", 4) for k, t in rows]
    return spark.createDataFrame(data, f"item_id long, text string, {EXTRA}")


ITEMS = [
    (1, "w1x w2x W3X, w4x w1x and more"),
    (2, "ÄÖÜ ß 中文 É é \U0001f600"),
    (3, None),
    (4, " .,;\n"),
    (5, "same word, one two TWO"),
    (5, "w7x again"),
    (None, "one"),
    (6, "nowhere-to-be-found"),
    (7, "w" + "9" * 5000 + "x one a b c d"),
]


def test_equals_plain_counting(spark):
    rows = odd_documents() + [(100 + i, f"w{i % 3}x tie of many") for i in range(60)]
    got = ls.search(documents(spark, rows), items_table(spark, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, ITEMS)


def test_blocks_pieces_and_cells_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "bb", "Ccc", "é", "x1", "中", "zz9"] + [f"r{i}" for i in range(60)]
    rows = [
        (i, "".join(rng.choice(words) + rng.choice(" ,.\n\x00~") for _ in range(rng.randrange(80))))
        for i in range(200)
    ]
    rows += [(1000, "a " * 30_000 + "w" * 9_000 + " bb"), (1001, "a" * 70_000), (1001, "zz9 zz9")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(40)]
    want = brute(rows, items, 7)
    for name, value in [("BLOCK_BYTES", 3_000), ("PIECE_BYTES", 64), ("CELLS", 50)]:
        monkeypatch.setattr(ls, name, value)
    docs = documents(spark, rows).repartition(3)
    got = ls.search(docs, items_table(spark, items), k=7).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_scanner_in_small_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ls, "PIECE_BYTES", 16)
    texts = ["Ab cd é", None, "", "ab " * 50, "x" * 100 + " ab", " cd ", "abcd", "cd-AB-cd"]
    block = ls.Block([(1, {"ab": 1, "cd": 2}), (2, {"é": 1})])
    got = {}
    for first, length, doc, term, times in ls.Scanner(block).count(pa.array(texts)):
        for i, n in enumerate(length):
            assert n == len(terms(texts[first + i]))
        for d, t, n in zip(doc, term, times):
            got[first + int(d), block.terms[t]] = int(n)
    want = {
        (i, t): n
        for i, text in enumerate(texts)
        for t, n in Counter(terms(text)).items()
        if t in block.terms
    }
    assert got == want
    assert np.array_equal(block.first, [0, 1, 2, 3])


def test_a_very_long_text(spark):
    rows = [(1, "filler words here " * 200_000 + "needle"), (2, "x" * 3_000_000), (3, "needle")]
    items = [(1, "needle"), (2, "x" * 10)]
    got = ls.search(documents(spark, rows), items_table(spark, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items)


def test_no_documents_and_no_items(spark):
    docs, items = documents(spark), items_table(spark, ITEMS)
    assert ls.search(docs.limit(0), items).collect() == []
    assert ls.search(docs, items.limit(0)).collect() == []
    assert ls.search(docs.where("doc_id IN (4, 5, 6)"), items).collect() == []
