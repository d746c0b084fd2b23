"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate.

A conversation should read `(s?(ua)+)?` in the initials of its roles: perhaps a system turn, then
user and assistant in turn. Blank rows and repeats of an earlier row have to go. Keep costs 0,
Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2, and a
truncated row that is not deleted 1. Of the cheapest lists of edits the ASCII-least is taken.

Method. Rows are shuffled by conversation and sorted by turn, and one pass (`mapInPandas`) walks
each conversation with the costs of the four places in the pattern (nothing yet, after system,
after user, after assistant), carried over from one Arrow batch to the next. What a row does to
these costs depends only on their differences and order, of which there are few: `Steps` lists them
all, so a row is one lookup, and a row's backpointers are one small number that says which.
Blank and repeated rows cost 3 wherever they stand and change nothing else; they need none.

Rows come out as edited rows, in order. Those that ask for digests get them from a second pass over
the same stream, without another shuffle.

Bounds. A conversation is held by its task until it ends: at most `HELD_ROWS` rows and `HELD_BYTES`
of text. Larger ones are known from a count first, and take another way, on which no task holds
more than a batch: repeats are found by an aggregation, merged before its shuffle; the walk writes
its backpointers to a table in the shared folder; a second walk reads them from the end and writes
the edits, again as a table; and a third applies these to the rows, sorted by turn. Both ways give
the same result. On both, one conversation is walked by one task, as its rows depend on each other;
a very long text costs its own length. An `audit` is as long as its conversation.

Defined results: null roles and texts are one space; a role without an initial of `s`, `u` or `a`
can only be reroled or deleted. Rows are taken by turn, nulls first, then by role and the text's
MD5, so repeated and tied rows have one order. A null conversation id is a conversation. Empty tables
give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import NOT_SPACE, store

HELD_ROWS = 100_000
HELD_BYTES = 32 << 20
#: Rows of a frame handed on to Spark, and bytes of text.
FRAME_ROWS = 5_000
FRAME_BYTES = 8 << 20

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that has to follow each place in the pattern.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE = 3, 2, 2
#: No path through a place that is this much dearer than another can be cheapest: from each place,
#: whatever follows costs at most this much more than from any other.
SLACK = 8

REPAIRED = (
    "conv string, place long, known boolean, turn long, fault string, edit string,"
    " was string, role string, text string"
)


def _kept(initial: int, place: int) -> int | None:
    """The place after a row that is kept, if it can be."""
    if initial == 0:
        return SYSTEM if place == START else None
    if initial == 1:
        return USER if place != USER else None
    return ASSISTANT if initial == 2 and place == USER else None


class Steps:
    """All situations a walk can be in, and what each kind of row makes of them.

    A situation has, for each place that can still be part of a cheapest path, its cost above the
    least one and the rank of its edits so far in ASCII order. Insertions belong to the row behind
    them, so no list of edits is the beginning of another, and ranks decide between lists whatever
    follows. They never stand before a deletion: the same list with the two swapped is less.
    """

    def __init__(self) -> None:
        first = ((0, 0), None, None, None)
        self.situations, self.number = [first], {first: 0}
        self.back: list[dict[int, tuple[int, str]]] = []
        self.then: list[int] = []
        for situation in self.situations:  # grows while it is read
            for kind in range(8):
                after, back = self._step(situation, kind // 2, kind % 2)
                if after not in self.number:
                    self.number[after] = len(self.situations)
                    self.situations.append(after)
                self.then.append(self.number[after])
                self.back.append(back)
        self.last = [self._end(s) for s in self.situations]

    @staticmethod
    def _step(situation, initial: int, truncated: int):
        best: dict[int, tuple[int, int, str, int]] = {}

        def offer(place, cost, rank, edits, origin):
            if place not in best or (cost, rank, edits) < best[place][:3]:
                best[place] = (cost, rank, edits, origin)

        for origin, told in enumerate(situation):
            if told is None:
                continue
            cost, rank = told
            offer(origin, cost + DELETE, rank, "D", origin)
            place, edits = origin, ""
            for _ in range(3):
                kept = _kept(initial, place)
                if kept is not None:
                    offer(kept, cost + truncated, rank, edits + "K", origin)
                offer(NEXT[place], cost + REROLE + truncated, rank, edits + "R", origin)
                place, cost, edits = NEXT[place], cost + INSERT, edits + "I"
        least = min(cost for cost, *_ in best.values())
        best = {p: b for p, b in best.items() if b[0] <= least + SLACK}
        order = sorted(best, key=lambda p: best[p][1:3])
        after = tuple(
            (best[p][0] - least, order.index(p)) if p in best else None for p in range(4)
        )
        return after, {p: (b[3], b[2]) for p, b in best.items()}

    @staticmethod
    def _end(situation) -> tuple[int, str]:
        """The place the walk ends at, and the insertions that complete the pattern."""
        more = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        ends = [
            (told[0] + INSERT * len(more[place]), told[1], more[place], place)
            for place, told in enumerate(situation)
            if told is not None
        ]
        return min(ends)[3], min(ends)[2]

    def trace(self, codes: list[int]) -> tuple[list[tuple[int, str]], tuple[int, str]]:
        """(place before, edits) of each row, and of the end."""
        end = self.last[self.then[codes[-1]] if codes else 0]
        place, found = end[0], []
        for code in reversed(codes):
            place, edits = self.back[code][place]
            found.append((place, edits))
        return found[::-1], end


@lru_cache(maxsize=1)
def steps() -> Steps:
    return Steps()


def kind_of(role: str, text: str) -> int:
    """The kind of a row that is neither blank nor a repeat."""
    return 2 * ("sua".find(role[:1]) % 4 if role else 3) + (fault_of(text) == "truncated")


def fault_of(text: str) -> str | None:
    end = text.rstrip(SPACES)[-1:]
    return "blank" if not end else None if end in STOPS else "truncated"


class _Frames:
    """Edited rows, handed on in frames of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = self.place = 0

    def begin(self) -> None:
        self.place = 0

    def add(self, conv, known, turn, fault, edit, was, role, text) -> None:
        self.rows.append((conv, self.place, known, turn, fault, edit, was, role, text))
        self.place += 1
        self.size += len(text)

    def inserted(self, conv, place: int, edits: str) -> int:
        """Add the turns that edits insert; the place after them."""
        for _ in range(edits.count("I")):
            place = NEXT[place]
            self.add(conv, False, 0, None, "I", None, ROLE[place], "")
        return place

    def edited(self, conv, known, turn, role, text, place: int, edits: str) -> None:
        place = self.inserted(conv, place, edits)
        edit = edits[-1]
        now = ROLE[NEXT[place]] if edit == "R" else role
        self.add(conv, known, turn, fault_of(text), edit, role, now, text)

    def deleted(self, conv, known, turn, role, text, fault) -> None:
        self.add(conv, known, turn, fault, "D", role, role, text)

    def full(self) -> bool:
        return len(self.rows) >= FRAME_ROWS or self.size >= FRAME_BYTES

    def take(self) -> pd.DataFrame:
        columns = [c.split()[0] for c in REPAIRED.split(", ")]
        frame = pd.DataFrame(self.rows, columns=columns)
        self.rows, self.size = [], 0
        return frame


def _conversations(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, tuple]]:
    """The rows of all batches, and whether a row is the first of its conversation."""
    last: object = _conversations  # no conversation
    for frame in frames:
        for row in zip(*(frame[c].tolist() for c in frame.columns)):
            yield row[0] != last, row
            last = row[0]


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edited rows of conversations that may be held whole."""
    table, out = steps(), _Frames()
    held: list[tuple] = []  # (row, whether it is in the walk)
    codes: list[int] = []
    seen: set[tuple[str, str]] = set()
    situation = 0

    def finish() -> None:
        nonlocal situation
        out.begin()
        found, (place, more) = table.trace(codes)
        traced = iter(found)
        for (conv, known, turn, role, text, _), fault in held:
            if fault:
                out.deleted(conv, known, turn, role, text, fault)
            else:
                out.edited(conv, known, turn, role, text, *next(traced))
        if held:
            out.inserted(held[0][0][0], place, more)
        held.clear(), codes.clear(), seen.clear()
        situation = 0

    for is_first, row in _conversations(frames):
        if is_first:
            finish()
            if out.full():
                yield out.take()
        _, _, _, role, text, key = row
        if fault_of(text) == "blank":
            held.append((row, "blank"))
        elif (role, key) in seen:
            held.append((row, "duplicate"))
        else:
            seen.add((role, key))
            held.append((row, None))
            code = 8 * situation + kind_of(role, text)
            codes.append(code)
            situation = table.then[code]
    finish()
    yield out.take()


def _codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A backpointer for each row of the walk, and one more row, the end, for each conversation."""
    table, situation, i, last = steps(), 0, 0, None
    end: Callable[[], tuple] = lambda: (last[0], i, True, 0, "", "", -1 - situation)
    columns = ["conv", "i", "known", "turn", "role", "key", "code"]
    rows: list[tuple] = []
    for is_first, row in _conversations(frames):
        if is_first:
            if last is not None:
                rows.append(end())
            situation = i = 0
        last = row
        code = 8 * situation + row[5]
        rows.append((row[0], i, *row[1:5], code))
        situation, i = table.then[code], i + 1
        if len(rows) >= FRAME_ROWS:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if last is not None:
        rows.append(end())
    yield pd.DataFrame(rows, columns=columns)


def _trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of each row, from backpointers that come last row first."""
    table, place = steps(), 0
    columns = ["conv", "part", "known", "turn", "role", "key", "origin", "edits"]
    rows: list[tuple] = []
    for _, (conv, _, known, turn, role, key, code) in _conversations(frames):
        if code < 0:
            place, edits = table.last[-1 - code]
            rows.append((conv, 1, known, turn, role, key, place, edits))
        else:
            place, edits = table.back[code][place]
            rows.append((conv, 0, known, turn, role, key, place, edits))
        if len(rows) >= FRAME_ROWS:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    yield pd.DataFrame(rows, columns=columns)


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edited rows, from rows and edits in one order, the edits of a row right before it."""
    out, edit = _Frames(), None
    for is_first, row in _conversations(frames):
        conv, part, known, turn, role, _, text, origin, edits = row
        if is_first:
            out.begin()
            edit = None
        if part:
            out.inserted(conv, int(origin), edits)
        elif edits is not None:
            edit = (int(origin), edits)
        elif edit is not None:
            out.edited(conv, known, turn, role, text, *edit)
            edit = None
        else:
            fault = "blank" if fault_of(text) == "blank" else "duplicate"
            out.deleted(conv, known, turn, role, text, fault)
        if out.full():
            yield out.take()
    yield out.take()


AUDIT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, audit string, repaired_sha256 string"
)
_LEGAL = {"su", "ua", "au"}
_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation, from its edited rows in order."""
    names = [c.split()[0] for c in AUDIT.split(", ")]
    rows: list[tuple] = []
    conv, counts, illegal, cost, audit = None, {}, 0, 0, bytearray()
    turns, sha, initial, begun = [0, 0, 0], hashlib.sha256(), None, False

    def told() -> tuple:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        faults = (counts.get(f, 0) for f in ("blank", "duplicate", "truncated"))
        return (conv, gaps, *faults, illegal, cost, audit.decode(), sha.hexdigest())

    for is_first, row in _conversations(frames):
        if is_first:
            if begun:
                rows.append(told())
                if len(rows) >= FRAME_ROWS or sum(len(r[7]) for r in rows[-1:]) >= FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            conv, counts, illegal, cost, audit = row[0], {}, 0, 0, bytearray()
            turns, sha, initial, begun, repaired = [0, 0, 0], hashlib.sha256(), None, True, False
        _, _, known, turn, fault, edit, was, role, text = row
        if edit != "I":
            if initial is not None and initial + was[:1] not in _LEGAL:
                illegal += 1
            initial = was[:1]
            if known and not (turns[2] and turns[1] == turn):  # turns come in order
                turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
        if fault:
            counts[fault] = counts.get(fault, 0) + 1
        cost += _COST[edit] + (fault == "truncated" and edit != "D")
        audit += edit.encode()
        if edit != "D":
            sha.update(("\n" if repaired else "").encode() + f"{role}:{text}".encode())
            repaired = True
    if begun:
        rows.append(told())
    yield pd.DataFrame(rows, columns=names)


def _rows(conversations: DataFrame, conv_col, turn_col, role_col, text_col) -> DataFrame:
    # ids as strings and turns that are never null: pandas has no other nullable whole numbers
    return conversations.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).isNotNull().alias("known"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
    )


def _small_stream(rows: DataFrame) -> DataFrame:
    return (
        rows.repartition("conv")
        .withColumn("key", F.md5("text"))
        .sortWithinPartitions("conv", "known", "turn", "role", "key")
        .mapInPandas(_walk, REPAIRED)
    )


def _large_stream(rows: DataFrame) -> DataFrame:
    order = ["conv", "known", "turn", "role", "key"]
    keyed = rows.withColumn("key", F.md5("text"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.position(F.left("role", F.lit(1)), F.lit("sua"))
    kind = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(3) * 2
    kind = kind + F.when(end.isin(*STOPS), 0).otherwise(1)
    # the first of equal rows is in the walk, the others are repeats of it
    walked = (
        keyed.where(F.col("text").rlike(NOT_SPACE))
        .groupBy("conv", "role", "key", kind.cast("long").alias("kind"))
        .agg(F.min(F.struct("known", "turn")).alias("at"))
        .select("conv", "at.known", "at.turn", "role", "key", "kind")
    )
    codes = (
        walked.repartition("conv")
        .sortWithinPartitions(*order)
        .mapInPandas(
            _codes, "conv string, i long, known boolean, turn long, role string, key string, code long"
        )
    )
    codes = store(codes, "conversation-codes")
    edits = (
        codes.repartition("conv")
        .sortWithinPartitions("conv", F.desc("i"))
        .mapInPandas(
            _trace,
            "conv string, part long, known boolean, turn long, role string, key string,"
            " origin long, edits string",
        )
    )
    edits = store(edits, "conversation-edits")
    columns = ["conv", "part", "known", "turn", "role", "key", "text", "origin", "edits"]
    both = keyed.withColumns(
        {"part": F.lit(0).cast("long"), "origin": F.lit(0).cast("long"), "edits": F.lit(None).cast("string")}
    ).select(*columns)
    both = both.unionByName(edits.withColumn("text", F.lit("")).select(*columns))
    return (
        both.repartition("conv")
        .sortWithinPartitions(
            "conv", "part", "known", "turn", "role", "key", F.col("edits").isNull()
        )
        .mapInPandas(_apply, REPAIRED)
    )


def _streams(rows: DataFrame, held_rows: int, held_bytes: int) -> list[DataFrame]:
    """Edited rows, each conversation's in one partition and in order."""
    sizes = rows.groupBy("conv").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size")
    )
    large = store(
        sizes.where((F.col("n") > held_rows) | (F.col("size") > held_bytes)).select("conv"),
        "large-conversations",
    )
    if large.isEmpty():
        return [_small_stream(rows)]
    is_large = large.select(F.col("conv").alias("large_conv"))
    same = F.col("conv").eqNullSafe(F.col("large_conv"))
    return [
        _small_stream(rows.join(is_large, same, "left_anti")),
        _large_stream(rows.join(is_large, same, "left_semi")),
    ]


def _union(streams: list[DataFrame]) -> DataFrame:
    found = streams[0]
    for more in streams[1:]:
        found = found.unionAll(more)
    return found


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    held_rows: int = HELD_ROWS,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """(conv, place, turn, fault, edit, was, role, text): every row, and every inserted one.

    `place` orders a conversation's rows; rows whose `edit` is not `D` are the repaired
    conversation. `was` is the role before, null for inserted rows, as is their `turn`.
    """
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    kind = conversations.schema[conv_col].dataType
    found = _union(_streams(rows, held_rows, held_bytes))
    return found.select(
        F.col("conv").cast(kind).alias(conv_col),
        "place",
        F.when(F.col("known"), F.col("turn")).alias("turn"),
        "fault", "edit", "was", "role", "text",
    )


def audit(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    held_rows: int = HELD_ROWS,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """What was wrong with each conversation, what its repair costs and what it comes to.

    (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). `gaps` are the
    numbers missing between the first and last turn, `illegal` the neighbours in an order that
    the pattern does not have, `audit` the initials of the edits.
    """
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    kind = conversations.schema[conv_col].dataType
    streams = _streams(rows, held_rows, held_bytes)
    found = _union([s.mapInPandas(_digests, AUDIT) for s in streams])
    return found.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with some turns dropped, emptied, cut, repeated or given to the user.

    Which ones depends on conv_id and turn alone; nulls are one space.
    """

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    key = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    of_twenty = F.crc32(key.cast("binary")) % 20
    hit = conversations.select("conv_id", "turn", "role", "text", of_twenty.alias("hit"))
    text = (
        F.when(F.col("hit") == 1, "")
        .when(F.col("hit") == 2, F.translate(filled("text"), STOPS, ""))
        .otherwise(filled("text"))
    )
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.where(F.col("hit") != 0).select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")
