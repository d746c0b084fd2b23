"""Texts and groups made to cost much: each within stated seconds, and with whole results."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from helpers import documents, prose
from pyspark.sql import functions as F
from test_free import arrow, in_order, plain_removal

from tollway.llm import jaccard_join, secret_scan, suffix_dedup

MEGABYTE = 1 << 20
#: Seconds, with Spark's own, for 1 MB of each; they take two or three.
SOON = 60


def test_no_text_stalls_a_secret_scan(spark, tmp_path):
    token = "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9
    rows = [
        (1, "-----BEGIN " + "A " * (MEGABYTE // 2) + "PRIVATE KEY-----"),
        (2, "eyJ" * (MEGABYTE // 3)),
        (3, "eyJaaaaaaaaa." * (MEGABYTE // 13)),
        (4, "x eyJ-" * (MEGABYTE // 6) + " PRIVATE KEY-----"),
        (5, "-----BEGIN RSA PRIVATE KEY----- " + token + " " + "A" * MEGABYTE),
        (6, "password=" * (MEGABYTE // 9)),
        (7, "x" + token),
    ]
    start = time.monotonic()
    found = secret_scan.scan(documents(spark, rows), str(tmp_path / "ledger"), "doc_id").collect()
    assert time.monotonic() - start < SOON
    kinds = {r["doc_id"]: [s["rule"] for s in r["spans"]] for r in found}
    assert sorted(kinds[5]) == ["private_key", "web_token"]
    assert kinds[1] == kinds[2] == kinds[4] == kinds[7] == []
    assert kinds[6] == ["assign"]


def headed(n):
    """Texts with one frequent short string and surroundings of their own, and some repeats."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        own = "".join(map(chr, rng.integers(97, 123, 120)))
        rows.append((i, own[:60] + " Shared header of all: " + own[60:]))
    rows += [(n + i, rows[7 * i][1][20:90] + "tail" + str(i)) for i in range(20)]
    return rows


def test_a_frequent_short_string_equals_brute_force(spark):
    rows = headed(1_500)
    got = suffix_dedup.without_earlier(documents(spark, rows)).collect()
    assert in_order(got) == plain_removal(rows)


def test_small_arrays_remove_the_same(monkeypatch):
    rows = headed(400)

    def removed():
        dealt = [
            r
            for i, p in enumerate(suffix_dedup._cut(arrow(rows)))
            for r in suffix_dedup._deal_pieces(p, 1, 2, i)
            if r[1] is not None
        ]
        mine = [dict(zip(suffix_dedup._STRETCH_NAMES, r)) for r in dealt]
        ids, keys, starts, ends = suffix_dedup._removed(mine)
        return {(k, i) for k, s, e in zip(keys, starts, ends) for i in range(s, e)}

    want = removed()
    assert want
    for size in (1, 500, 20_000):
        monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", size)
        assert removed() == want


def test_groups_are_cut_whole(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 10)
    group = np.array([0, 0, 3, 3, 3, 4, 9, 9])
    length = np.array([4, 4, 9, 9, 9, 2, 3, 3])
    cuts = [(s.start, s.stop) for s in suffix_dedup._runs_of_groups(group, length)]
    assert cuts == [(0, 2), (2, 5), (5, 8)]
    assert list(suffix_dedup._runs_of_groups(group[:0], length[:0])) == []


def test_the_filter_passes_all_that_is_wanted_and_little_else(spark):
    rows = spark.range(20_000).selectExpr("id AS row_key", "'t' AS text", "1 AS _bits")
    keys = spark.range(0, 20_000, 7).selectExpr("id AS rep")
    left = {r["row_key"] for r in jaccard_join._perhaps_in(rows, "row_key", keys).collect()}
    wanted = set(range(0, 20_000, 7))
    assert wanted <= left and len(left) < len(wanted) + 20
    none = spark.range(0).selectExpr("id AS rep")
    assert jaccard_join._perhaps_in(rows, "row_key", none).collect() == []


def test_little_is_dealt_beside_the_texts():
    rows = [(1_000_003 * i, prose(i, 300, 3000)) for i in range(400)]
    key = np.zeros(len(rows), np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array(key), pa.array([r[1] for r in rows])], ["id", "key", "text"]
    )
    dealt = [r for b in suffix_dedup._deal(50, 50)(iter([batch])) for r in b.to_pylist()]
    beside = sum(len(r["docs"]) + len(r["heads"]) for r in dealt if r["docs"] is not None)
    assert beside < 0.3 * sum(len(t) for _, t in rows)


def test_the_key_has_the_bits_that_shared_ids_take(spark):
    def keys(rows):
        docs = documents(spark, rows).select(F.col("doc_id").alias("id"), "text")
        return {r[0] for r in docs.select(suffix_dedup._key(docs)).collect()}

    assert keys([(i, f"text {i}") for i in range(50)] + [(3, "text 3")]) == {0}
    short = keys([(None, f"text {i}") for i in range(20)])
    assert len(short) == 20 and all(-(1 << 15) <= k < 1 << 15 for k in short)
    assert len(keys([(7, f"text {i}") for i in range(3000)])) == 3000


def test_texts_that_share_ids_keep_their_own_spans(spark):
    passage = prose(1, 60)
    rows = [(i % 3 or None, prose(10 + i, 15) + passage + prose(50 + i, i)) for i in range(12)] + [(0, passage)]
    got = suffix_dedup.without_earlier(documents(spark, rows)).collect()
    assert in_order(got) == plain_removal(rows)
