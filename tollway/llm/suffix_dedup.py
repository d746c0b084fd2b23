"""Removal of byte strings that an earlier document has, by sorted suffixes.

Each byte covered by a string of `LENGTH` bytes that also starts in a document with a smaller id is
removed. The strings are found with a suffix array built by the difference-cover algorithm: sort
sampled triples, recurse on their names, merge the remaining suffixes, compare adjacent prefixes.

Sorting every suffix of a large corpus in one array moves each of them several times, tens of
bytes for each byte of text. So the text is dealt out first such that suffixes that can be equal
meet, and arrays are built where they meet:

1. A window is a string of `LENGTH` bytes. Its anchor is the least hash of the short strings in it,
   so equal windows have equal anchors. Neighbouring windows with one anchor are kept together as
   one stretch, a fraction of the windows to move. Of equal stretches in a task only those of the
   least id go on; the others are known to be removed.
2. Stretches are dealt by anchor into buckets of bounded size. Of a bucket, stretches whose anchor
   only one document has are done with, and equal ones need no sorting either, nor do those none of
   whose windows has the hash of another. All other distinct stretches are the text of suffix arrays,
   of whole anchors and about `SORTED_BYTES` each: the work
   needs some 25 bytes for each byte in an array, the rest of a bucket a few. Adjacent suffixes that agree in `LENGTH` bytes are one
   string, and its least id tells which of its occurrences go.
3. The removed stretches of a document are merged where its text is sent, packed.

What is sent of a stretch is its text, length and place, and where in it the anchor is, from which the
anchor is had again. A document goes by its id; only as many bits of its text's hash go with it as it
takes to tell the texts of rows that share an id apart, none if no two such texts differ.

Nulls and odd input: a null or empty text has no bytes. A null id comes after all others, and rows
without one are each other's equals. Rows that share an id are one document to each other: they
remove nothing from one another. Repeated rows keep their rows. Other columns, whatever their
names, are ignored. An empty table gives an empty result. The id has to be an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import store, whole
from tollway.llm.hashing import Stretches, mix

LENGTH = 50  # bytes
ANCHOR = 12  # bytes
PIECE = 2 << 20  # bytes of text handled at once
DEALT_BYTES = 8 << 20  # bytes of text whose stretches are dealt at once
BUCKET_BYTES = 6 << 20  # bytes of text for each bucket
SORTED_BYTES = 2 << 20  # bytes of stretches in one suffix array, if an anchor does not have more
NO_ID = np.iinfo(np.int64).max

_SPAN_SCHEMA = "home bigint, spans binary"
_SPAN = np.dtype([("id", "<i8"), ("key", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _pack(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes first, which packs better."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=6).compress(planes.tobytes())


def _unpack(x: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _words(data: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each position on as a number; past the end they are zero."""
    kind = np.uint32 if size == 4 else np.uint64
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.zeros(len(data), kind)
    for k in range(size):
        out |= padded[k : k + len(data)].astype(kind) << kind(8 * k)
    return out


def _mixed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """The hash of short strings, of which these are four bytes each."""
    h = first * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) + second * np.uint32(0x85EBCA77)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + third * np.uint32(0x27D4EB2F)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x165667B1)
    return h ^ (h >> np.uint32(13))


def short_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the short string at each position that has one."""
    four = _words(data, 4)
    n = len(data) - ANCHOR + 1
    return _mixed(four[:n], four[4 : n + 4], four[8 : n + 8])


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position that has one, by the hashes of the short strings."""
    width, least = 1, hashes
    wanted = LENGTH - ANCHOR + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, anchor, where in it the anchor is) of the stretches of all pieces.

    `bounds` is where pieces begin.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint8)
    if len(data) < LENGTH:
        return none
    hashes = short_hashes(data)
    least = anchors(hashes)
    fits = np.ones(len(least), bool)
    for k in range(1, LENGTH):  # windows that would cross a bound
        at = bounds[1:-1] - k
        fits[at[(at >= 0) & (at < len(fits))]] = False
    at = np.flatnonzero(fits)
    if not len(at):
        return none
    breaks = np.flatnonzero((np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])) + 1
    first = np.concatenate([[0], breaks])
    last = np.append(breaks, len(at)) - 1
    in_window = np.lib.stride_tricks.sliding_window_view(hashes, LENGTH - ANCHOR + 1)
    where = in_window[at[first]].argmin(1).astype(np.uint8)
    return at[first], at[last] + LENGTH, least[at[first]], where


def _anchors_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of the short strings at some positions."""
    four = text[at[:, None] + np.arange(ANCHOR)].view("<u4")
    return _mixed(four[:, 0], four[:, 1], four[:, 2])


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    at = np.repeat((starts - before).astype(np.int64), lengths)
    at += np.arange(len(at))
    return data[at]


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `s`, sorted, by the difference cover {1, 2} modulo 3.

    `s` holds numbers from 1 on, below 2**31.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.uint64), np.zeros(3, np.uint64)])
    shift = np.uint64(32)
    # one more of those at 1 modulo 3 keeps both halves of the shorter string apart
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])

    # where three numbers, or two and a rank, fit in 64 bits, they are sorted as one
    bits, rank_bits = int(s.max()).bit_length(), n.bit_length()

    def names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.unique(first << shift | second, return_inverse=True)[1].astype(np.uint64)

    if 3 * bits <= 64:
        two = np.uint64(bits)
        key = (s[sample] << two | s[sample + 1]) << two | s[sample + 2]
        order = np.argsort(key)
        key = key[order]
        triple = np.empty(len(key), np.uint64)
        triple[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        triple = names(names(s[sample], s[sample + 1]), s[sample + 2]) + np.uint64(1)
    if len(triple) and int(triple.max()) < len(triple):
        order = suffix_order(triple)
    else:
        order = np.argsort(triple, kind="stable")
    rank = np.zeros(n + 3, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    # the others by their first number and the rank of what follows
    others = np.arange(0, n, 3)
    key = s[others] << shift | rank[others + 1]
    others = others[np.argsort(key, kind="stable")]
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    # how many of the others come before each sampled suffix: one number and a rank decide for
    # those at 1 modulo 3, two numbers and a rank for those at 2
    before = np.empty(len(sorted_sample), np.int64)
    one = sorted_sample % 3 == 1
    at = sorted_sample[one]
    before[one] = np.searchsorted(
        s[others] << shift | rank[others + 1], s[at] << shift | rank[at + 1]
    )
    at = sorted_sample[~one]
    both = np.concatenate([others, at])
    if 2 * bits + rank_bits <= 64:
        pair = (s[both] << np.uint64(bits) | s[both + 1]) << np.uint64(rank_bits) | rank[both + 2]
    else:
        pair = names(s[both], s[both + 1]) << shift | rank[both + 2]
    before[~one] = np.searchsorted(pair[: len(others)], pair[len(others) :])
    out = np.empty(n, np.int64)
    place = np.arange(len(sorted_sample)) + before
    out[place] = sorted_sample
    free = np.ones(n, bool)
    free[place] = False
    out[free] = others
    return out


def _least_ids(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every window of the stretches, one after the other, the least id that has it."""
    lengths = ends - starts
    # a zero between stretches
    spaced = np.zeros(int((lengths + 1).sum()), np.uint64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    inside = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    spaced[inside] = _gather(text, starts, lengths).astype(np.uint64) + np.uint64(1)
    n_windows = lengths - LENGTH + 1
    window_at = np.full(len(spaced), -1, np.int64)
    total = int(n_windows.sum())
    at = np.repeat(begin - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(total)
    window_at[at] = np.arange(total)
    owner = np.repeat(ids, n_windows)
    order = suffix_order(spaced + np.uint64(1))
    order = order[window_at[order] >= 0]
    eight = _words(spaced.astype(np.uint16).astype(np.uint8), 8)  # a byte of 255 is 0 here
    nine = spaced.astype(np.uint16) >> 8
    # compare adjacent prefixes, eight bytes at a time
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= eight[order[1:] + k] == eight[order[:-1] + k]
    if nine.any():
        for k in range(LENGTH):
            same &= nine[order[1:] + k] == nine[order[:-1] + k]
    string = np.concatenate([[0], np.cumsum(~same)])
    window = window_at[order]
    least = np.full(int(string[-1]) + 1, NO_ID)
    np.minimum.at(least, string, owner[window])
    out = np.empty(total, np.int64)
    out[window] = least[string]
    return out


def _runs(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags that do not cross an edge: the part, the first and the last of each."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    part = np.searchsorted(edges, at, "right") - 1
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1
    first = np.concatenate([[0], breaks])
    last = np.append(breaks, len(at)) - 1
    return part[first], at[first], at[last]


def _home(ids: np.ndarray, keys: np.ndarray, homes: int) -> np.ndarray:
    """The group of documents that one with this id and key belongs to."""
    of_id = mix(np.ascontiguousarray(ids, np.int64).view(np.uint64))
    mixed = mix(of_id + np.ascontiguousarray(keys, np.int64).view(np.uint64))
    return (mixed % np.uint64(homes)).astype(np.int64)


def _spans(ids, keys, starts, ends, homes: int) -> Iterator[tuple[int, bytes]]:
    """Removed spans, packed for each home, the group of documents they belong to."""
    spans = np.empty(len(ids), _SPAN)
    spans["id"], spans["key"], spans["start"], spans["end"] = ids, keys, starts, ends
    home = _home(spans["id"], spans["key"], homes)
    order = np.lexsort((spans["start"], spans["id"], home))
    spans, home = spans[order], home[order]
    cuts = np.flatnonzero(np.diff(home)) + 1
    for part in np.split(np.arange(len(home)), cuts) if len(home) else ():
        yield int(home[part[0]]), _pack(spans[part])


_STRETCH_NAMES = ["bucket", "docs", "heads", "texts", "home", "spans"]
_STRETCH_SCHEMA = "bucket bigint, docs binary, heads binary, texts binary, home bigint, spans binary"
_HEAD = np.dtype([("length", "<u4"), ("doc", "<u4"), ("start", "<u4"), ("where", "u1")])


def _cut(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Pieces (id, key, start, bytes) of the texts, about `PIECE` bytes at a time.

    A longer text is cut into pieces that overlap by all but one byte of a window.
    """
    some: list[tuple[int, int, int, bytes]] = []
    size = 0
    for k, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
        data = text.encode()
        for start in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
            piece = data[start : start + PIECE + LENGTH - 1]
            if some and size + len(piece) > PIECE:
                yield some
                some, size = [], 0
            some.append((NO_ID if k is None else k, key, start, piece))
            size += len(piece)
    if some:
        yield some


def _deal(buckets: int, homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr, some, size = 0, [], 0
        for pieces in (p for batch in batches for p in _cut(batch)):
            some.append(_stretches_of(pieces))
            size += len(some[-1][0])
            if size >= DEALT_BYTES:
                yield _batch(_deal_stretches(some, buckets, homes, nr))
                nr, some, size = nr + 1, [], 0
        if some:
            yield _batch(_deal_stretches(some, buckets, homes, nr))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, _STRETCH_NAMES)


def _deal_pieces(pieces, buckets: int, homes: int, nr: int) -> list[tuple]:
    return _deal_stretches([_stretches_of(pieces)], buckets, homes, nr)


def _stretches_of(pieces) -> tuple[np.ndarray, ...]:
    """The bytes, ids and keys of pieces, and of their stretches the place in the bytes and in the
    text, the end, the anchor and where it is, the piece and the hash."""
    ids = np.array([p[0] for p in pieces], np.int64)
    keys = np.array([p[1] for p in pieces], np.int64)
    offset = np.array([p[2] for p in pieces], np.int64)
    bounds = np.cumsum([0, *[len(p[3]) for p in pieces]])
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    starts, ends, anchor, where = stretches(data, bounds)
    piece = np.searchsorted(bounds, starts, "right") - 1
    at = starts - bounds[piece] + offset[piece]
    own = Stretches(data).hash(starts, ends)
    return data, ids, keys, starts, at, ends, anchor, where, piece, own


def _deal_stretches(some: list[tuple], buckets: int, homes: int, nr: int) -> list[tuple]:
    sizes, pieces = [len(x[0]) for x in some], [len(x[1]) for x in some]
    count = [len(x[3]) for x in some]
    data, ids, keys, starts, at, ends, anchor, where, piece, own = map(np.concatenate, zip(*some))
    shift = np.repeat(np.cumsum(sizes) - sizes, count)
    starts, ends = starts + shift, ends + shift
    piece = piece + np.repeat(np.cumsum(pieces) - pieces, count)
    order = np.lexsort((ids[piece], own))
    starts, at, ends, anchor, where, piece, own = (
        x[order] for x in (starts, at, ends, anchor, where, piece, own)
    )
    new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.empty(0, bool)
    least = ids[piece[new]][np.cumsum(new) - 1]
    gone = ids[piece] > least
    rows = [
        (nr % buckets, None, None, None, home, spans)
        for home, spans in _spans(
            ids[piece[gone]], keys[piece[gone]], at[gone], (at + ends - starts)[gone], homes
        )
    ]
    starts, at, ends, anchor, where, piece = (
        x[~gone] for x in (starts, at, ends, anchor, where, piece)
    )
    bucket = (mix(anchor.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((starts, bucket))
    bucket, starts, piece = bucket[order], starts[order], piece[order]
    heads = np.empty(len(order), _HEAD)
    heads["length"], heads["start"], heads["where"] = (ends[order] - starts), at[order], where[order]
    if len(at) and at.max() >= 1 << 32:
        raise ValueError("a text of 4 GB or more")
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = heads[a:b]
        used, doc = np.unique(piece[a:b], return_inverse=True)
        mine["doc"] = np.diff(doc, prepend=0)
        texts = _gather(data, starts[a:b], mine["length"].astype(np.int64))
        docs = _pack(np.stack([np.diff(ids[used], prepend=0), keys[used]]))
        rows.append((int(bucket[a]), docs, _pack(mine), _pack(texts), None, None))
    return rows


def _hash_all(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + PIECE, "right")), first + 1)
        base = starts[first]
        out[first:last] = Stretches(text[base : ends[last - 1]]).hash(
            starts[first:last] - base, ends[first:last] - base
        )
        first = last
    return out


def _compare(homes: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told = [(r["home"], r["spans"]) for r in rows if r["docs"] is None]
        rows = [r for r in rows if r["docs"] is not None]
        if rows:
            told += _spans(*_removed(rows), homes)
        return pa.table({
            "home": pa.array([h for h, _ in told], pa.int64()),
            "spans": pa.array([s for _, s in told], pa.binary()),
        })

    return run


def _runs_of_groups(group: np.ndarray, length: np.ndarray) -> Iterator[slice]:
    """Whole groups of stretches, about `SORTED_BYTES` of them at a time."""
    if not len(group):
        return
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    bounds = np.append(first, len(group))
    total = np.concatenate([[0], np.cumsum(length)])[bounds]
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SORTED_BYTES, "right")) - 1)
        yield slice(int(bounds[i]), int(bounds[j]))
        i = j


def _have_repeats(text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the stretches of a text have a window whose hash comes twice or more.

    Equal windows have equal hashes, so no other stretch can share a window; most share none, only
    an anchor, and need no sorting.
    """
    n = length - LENGTH + 1
    begin = np.repeat(np.cumsum(length) - length - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = Stretches(text).hash(begin, begin + LENGTH)
    order = np.sort(own)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(length), bool)
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return np.bitwise_or.reduceat(twice[at] == own, np.cumsum(n) - n)


def _removed(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(id, key, start, end) of all that one bucket's stretches tell to remove."""
    ids, keys, anchor, length, start, text = [], [], [], [], [], []
    for r in rows:
        docs = _unpack(r["docs"], np.int64).reshape(2, -1)
        heads, mine = _unpack(r["heads"], _HEAD), _unpack(r["texts"], np.uint8)
        doc, size = np.cumsum(heads["doc"]), heads["length"].astype(np.int64)
        ids.append(np.cumsum(docs[0])[doc])
        keys.append(docs[1][doc])
        length.append(size)
        start.append(heads["start"].astype(np.int64))
        anchor.append(_anchors_at(mine, np.cumsum(size) - size + heads["where"]))
        text.append(mine)
    ids, keys, anchor, length, start, text = map(
        np.concatenate, (ids, keys, anchor, length, start, text)
    )
    ends = np.cumsum(length)
    starts = ends - length
    own = _hash_all(text, starts, ends)
    order = np.lexsort((ids, own, anchor))
    ids, keys, anchor, length, start, own, starts = (
        x[order] for x in (ids, keys, anchor, length, start, own, starts)
    )
    # by anchor: only where two documents have it
    group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
    first = np.flatnonzero(np.diff(group, prepend=-1))
    several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
    mine = several[group]
    ids, keys, group, length, start, own, starts = (
        x[mine] for x in (ids, keys, group, length, start, own, starts)
    )
    if not len(ids):
        return ids, keys, start, start
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (own[1:] != own[:-1])])
    string = np.cumsum(new) - 1
    least = ids[new]  # ids are sorted within equal stretches
    per_group = np.bincount(group[new])[group]
    alone = per_group == 1
    gone = alone & (ids > least[string])
    out = [(ids[gone], keys[gone], start[gone], (start + length)[gone])]
    mixed = np.flatnonzero(~alone)
    shown = new & ~alone
    for some in _runs_of_groups(group[mixed], length[mixed]):
        rows = mixed[some]
        mine = rows[shown[rows]]
        n_windows = length[mine] - LENGTH + 1
        at = np.cumsum(n_windows) - n_windows
        # a window that no other string has is its own string's
        found = np.repeat(ids[mine], n_windows)
        again = _have_repeats(_gather(text, starts[mine], length[mine]), length[mine])
        if again.any():
            some = mine[again]
            found[np.repeat(again, n_windows)] = _least_ids(
                text, starts[some], (starts + length)[some], ids[some]
            )
        # every occurrence has the windows of its string
        of = string[rows] - string[rows[0]]
        of = np.searchsorted(string[mine] - string[rows[0]], of)
        count = n_windows[of]
        edges = np.cumsum(count) - count
        window = np.repeat(at[of] - edges, count) + np.arange(count.sum())
        flags = found[window] < np.repeat(ids[rows], count)
        part, a, b = _runs(flags, edges)
        who = rows[part]
        begin = start[who] + a - edges[part]
        out.append((ids[who], keys[who], begin, start[who] + b - edges[part] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out))


def _finish(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Of one home: what is left of each document."""
    spans = np.concatenate(
        [np.empty(0, _SPAN), *[_unpack(x, _SPAN) for x in found["spans"].to_pylist()]]
    )
    spans = spans[np.lexsort((spans["start"], spans["key"], spans["id"]))]
    rows, unpack = [], zstandard.ZstdDecompressor().decompress
    for k, key, packed in zip(*(docs[c].to_pylist() for c in ("id", "key", "text"))):
        data = unpack(packed)
        of = NO_ID if k is None else k
        mine = spans[np.searchsorted(spans["id"], of) : np.searchsorted(spans["id"], of, "right")]
        a, b = np.searchsorted(mine["key"], key), np.searchsorted(mine["key"], key, "right")
        mine = mine[a:b]
        kept, at, removed, runs = [], 0, 0, 0
        if len(mine):
            reach = np.maximum.accumulate(mine["end"])
            first = np.flatnonzero(np.concatenate([[True], mine["start"][1:] > reach[:-1]]))
            for i, j in zip(first, [*first[1:] - 1, len(mine) - 1]):
                start, end = int(mine["start"][i]), int(reach[j])
                kept.append(data[at:start])
                at, removed, runs = end, removed + end - start, runs + 1
        kept.append(data[at:])
        rows.append((k, len(data), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
    kinds = [docs["id"].type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def without_earlier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    keyed = rows.withColumn("key", _key(rows)).select("id", "key", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, size // BUCKET_BYTES)
    found = store(
        keyed.mapInArrow(_deal(n, n), _STRETCH_SCHEMA)
        .groupBy("bucket")
        .applyInArrow(_compare(n), _SPAN_SCHEMA),
        "removed-spans",
    )
    at_home = keyed.mapInArrow(_with_home(n), "home bigint, id bigint, key bigint, text binary")
    result = (
        at_home.groupBy("home")
        .cogroup(found.groupBy("home"))
        .applyInArrow(
            _finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        )
    )
    return result.withColumnRenamed("id", id_col)


def _key(rows: DataFrame) -> Column:
    """What tells the texts of rows that share an id apart: a few bits of their hash, or all.

    The stretches of a document carry it to every bucket, so it is as short as these rows allow.
    """
    whole_key = F.xxhash64("id", "text")
    for key in (F.lit(0).cast("bigint"), F.shiftright(whole_key, 48), F.shiftright(whole_key, 32)):
        shared = rows.select("id", key.alias("short"), whole_key.alias("key")).groupBy("id", "short")
        differ = shared.agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b")
        if differ.isEmpty():
            return key
    return whole_key


def _with_home(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(NO_ID))
            home = _home(ids, np.asarray(batch.column(1)), homes)
            packed = [pack(text.encode()) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(home), batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                ["home", "id", "key", "text"],
            )

    return run
