"""Conversation repair against an exhaustive search, both ways it can be done, and odd rows."""

from __future__ import annotations

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tollway.llm import conversation_repair as cr
from tollway.llm.queries import op11_conversation_repair

EXTRA = "conv string, place long, known boolean, key string, edit string, n long"
SPACES = " \t\n\x0b\x0c\r"


def fault(text):
    end = text.rstrip(SPACES)[-1:]
    return "blank" if not end else None if end in ".!?" else "truncated"


def brute(rows):
    """The audit of (turn, role, text) rows in order, by trying every list of edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        f = fault(text)
        faults.append(f if f == "blank" else "duplicate" if (role, text) in seen else f)
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def best(i, place, inserts):
        """(cost, edits, repaired) of the rest."""
        found = []
        if i == len(rows) and place in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            role = after[place]
            c, e, r = best(i, role, inserts + 1)
            found.append((c + 2, "I" + e, (("user:" if role == "u" else "assistant:"), *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, r = best(i + 1, place, 0)
            found.append((c + 3, "D" + e, r))
            if faults[i] not in ("blank", "duplicate"):
                cut = int(faults[i] == "truncated")
                to = {"": "su", "s": "u", "u": "a", "a": "u"}[place]
                if role[:1] and role[:1] in to:
                    c, e, r = best(i + 1, role[:1], 0)
                    found.append((c + cut, "K" + e, (f"{role}:{text}", *r)))
                now = after[place]
                c, e, r = best(i + 1, now, 0)
                name = "user" if now == "u" else "assistant"
                found.append((c + 2 + cut, "R" + e, (f"{name}:{text}", *r)))
        return min(found) if found else (10**9, "", ())

    cost, edits, repaired = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": edits,
        "repaired_sha256": hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
    }


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def random_conversations(seed, n, length=9):
    rng = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "Sam", "", None]
    texts = ["Yes.", "no", "", " \n", "Why?", "so it is", "中文。", "a!", None, "x" * 300 + ".", "ok. \t"]
    found = {}
    for conv in range(n):
        rows, turn = [], 0
        for _ in range(rng.randrange(1, length)):
            turn += rng.choice([0, 1, 1, 1, 2])
            text = rng.choice(texts)
            fresh = text if text is None or rng.random() < 0.4 else f"{conv}{turn}{rng.random()}{text}"
            rows.append((rng.choice([turn] * 9 + [None]), rng.choice(roles), fresh))
            if rng.random() < 0.1:
                rows.append(rows[-1])
        found[conv] = rows
    return found


def table(spark, conversations):
    data = [(k, t, r, x, "c", 1, True, "k", "e", 5) for k, rows in conversations.items() for t, r, x in rows]
    return spark.createDataFrame(data, f"conv_id long, turn long, role string, text string, {EXTRA}")


@pytest.mark.parametrize("held", [(cr.HELD_ROWS, cr.HELD_BYTES), (0, 0), (4, 400)])
def test_equals_every_list_of_edits_tried(spark, held):
    conversations = random_conversations(1, 300)
    df = table(spark, conversations).repartition(5)
    got = {r["conv_id"]: r.asDict() for r in cr.audit(df, held_rows=held[0], held_bytes=held[1]).collect()}
    assert got.keys() == conversations.keys()
    for k, rows in conversations.items():
        assert got[k] == {"conv_id": k, **brute(ordered(rows))}, rows


def test_rows_are_the_repaired_conversation(spark):
    conversations = random_conversations(2, 60)
    rows = cr.repair(table(spark, conversations), held_rows=5).collect()
    for k, source in conversations.items():
        own = sorted((r for r in rows if r["conv_id"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        want = brute(ordered(source))
        assert "".join(r["edit"] for r in own) == want["audit"]
        left = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
        assert hashlib.sha256(left.encode()).hexdigest() == want["repaired_sha256"]
        assert all((r["was"] is None) == (r["edit"] == "I") for r in own)
        assert all(r["turn"] is None for r in own if r["edit"] == "I")


def test_a_long_conversation_is_the_same_both_ways(spark):
    """30,000 rows, many batches, repeats, one very long text; held, and spilled."""
    rng = random.Random(5)
    rows = [(i // 2, rng.choice(["user", "assistant", "system"]), f"{i % 20_000} {rng.choice('.,')}") for i in range(30_000)]
    rows[77] = (38, "user", "long " * 400_000 + ".")
    df = table(spark, {7: rows, None: rows[:3]})
    a, b = (
        sorted(map(tuple, cr.audit(df, held_rows=n, held_bytes=1 << 30).collect()), key=str)
        for n in (100_000, 1_000)
    )
    assert a == b and len(a) == 2
    assert len([r for r in a if r[0] == 7][0][7]) >= 30_000


def test_texts_larger_than_may_be_held_go_the_other_way(spark):
    rows = [(0, "user", "a" * 5_000 + "."), (1, "assistant", "b.")]
    df = table(spark, {1: rows, 2: rows})
    a, b = (sorted(map(tuple, cr.audit(df, held_bytes=n).collect())) for n in (1_000, 1 << 20))
    assert a == b


def test_ids_of_other_kinds_and_no_rows(spark):
    df = table(spark, random_conversations(3, 4))
    named = df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert {r["conv_id"] for r in cr.audit(named).collect()} == {"c0", "c1", "c2", "c3"}
    assert cr.audit(df.limit(0)).collect() == []
    assert cr.repair(df.limit(0), held_rows=0).collect() == []


def test_query_keeps_conversations_of_which_nothing_is_left(spark, tmp_path):
    import zlib

    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hello."), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got.keys() == {lost, None}
    assert got[lost]["audit"] == "" and got[lost]["cost"] == 0
    assert got[lost]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_situations_are_few():
    assert len(cr.steps().situations) < 1_000
