"""Exact Jaccard join of documents on word shingles, over a token-group matrix.

1. Documents with equal sets are one class; only classes are compared.
2. The matrix has a row for each token and a column for each group. Groups must be found without
   comparing sets, and no link may be lost: if two sorted sets share all but H of their tokens,
   the H differences cut the shared ones into at most H + 1 runs, so one run has at least
   `shared / (H + 1)` tokens, side by side in both. The least hash of `k` neighbours within every
   such run is the same for both sets. These least neighbours are the groups a class belongs to,
   and all of a group's classes have its k tokens.
3. A group of one class is never opened. For each other group the union of what its classes have
   is a bitmap of token parities; for two classes, the bits in which they differ bound their
   distance from below. Only classes that the sizes and this bound allow are opened: their sets
   are read and compared token by token.
4. In groups of more than `ALL_PAIRS` classes, every class is first compared with the group's
   least only. Links found so far are joined into components, and then only classes of one group
   that still are in different components are compared, by bitmaps and in blocks of bounded size,
   until nothing new is found. So a large group of near copies is not expanded into all pairs, and
   no link between components is lost.

The result has a row for each document. Texts and tokens are never gathered on the driver.

Nulls and odd input: a null or empty text, or one of white space, has an empty set and is linked
with nothing, not even with another empty one. A null id keeps its row; its component is the least
id of its class or component, or null if that has none. Repeated rows are repeated. Other columns,
whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import store
from tollway.llm.components import components
from tollway.llm.hashing import fold, groups, mix, shingle_sets, text_bytes

GROUP_BYTES = 2 << 20  # of texts handled at once
ALL_PAIRS = 32  # classes in a group that are all compared with each other
FILTER_BITS = 1 << 26  # 8 MB, of the texts whose sets are read
SKETCH = 8  # numbers of 64 bits
BLOCK = 4_096  # classes of a large group in a block
CELLS = 1 << 20  # pairs whose bitmaps are compared at once
BUCKET_BYTES = 24 << 20  # of text, for each bucket of groups


def least_run(size: int, num: int, den: int) -> int:
    """Tokens side by side that two different linked sets of at least `size` tokens must share."""
    best = None
    for h in range(1, 4 * den * den):
        shared = max(-(-num * h // (den - num)), size - h)
        run = -(-shared // (h + 1))
        best = run if best is None else min(best, run)
    return best


@lru_cache
def channels(num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, neighbours, windows) of small and of large sets.

    Two linked sets are both small or both large, so they meet in one channel at least.
    """
    longest = -(-num // (den - num))
    size = next(s for s in range(1, 100 * den) if least_run(s, num, den) >= longest)
    out = []
    for low, high, run in (
        (1, size * den // num + 1, least_run(1, num, den)),
        (size, 1 << 60, longest),
    ):
        k = max(2, run // 2) if run > 1 else 1
        out.append((low, high, k, run - k + 1))
    return out


def _signatures(
    h: np.ndarray, owner: np.ndarray, sizes: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """The groups of every set: (signature, owner), each once."""
    signs, owners = [], []
    for nr, (low, high, k, windows) in enumerate(channels(num, den)):
        fits = ((sizes >= low) & (sizes <= high))[owner]
        x, of = h[fits], owner[fits]
        if len(x) < k + windows - 1:
            continue
        least = grams = fold([x[i : len(x) - k + 1 + i] for i in range(k)])
        # least of each `windows` neighbouring grams
        for i in range(1, windows):
            least = np.minimum(least[: len(grams) - i], grams[i:])
        inside = of[: len(least)] == of[len(of) - len(least) :]
        signs.append(mix(least[inside] + np.uint64(nr)))
        owners.append(of[: len(least)][inside])
    if not signs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sign, of = np.concatenate(signs), np.concatenate(owners)
    order = np.lexsort((of, sign))
    sign, of = sign[order], of[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (of[1:] != of[:-1])
    return sign[new], of[new]


def _class_ids(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of every set; that of the empty set is 0."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.searchsorted(owner, np.arange(n + 1))
    total = sums[ends[1:]] - sums[ends[:-1]]
    return np.where(ends[1:] > ends[:-1], mix(total) | np.uint64(1), np.uint64(0))


def _sketches(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Parities of the number of tokens in 64 * SKETCH cells, as bits."""
    cell = (h >> np.uint64(20)).astype(np.int64) % (64 * SKETCH)
    odd = (np.bincount(owner * 64 * SKETCH + cell, minlength=n * 64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, -1), axis=1).view(np.int64).reshape(n, SKETCH)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for first, last in groups(offsets, GROUP_BYTES):
        own = offsets[first : last + 1]
        yield first, last, *shingle_sets(data[own[0] : own[-1]], own - own[0], width)


def _describe(width: int):
    names = ["id", "class", "n", *[f"s{k}" for k in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, h, owner, sizes in _sets(batch.column(1), width):
                n = last - first
                sketch = _sketches(h, owner, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(_class_ids(h, owner, n).view(np.int64)),
                        pa.array(sizes.astype(np.int64)),
                        *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH)],
                    ],
                    names,
                )

    return run


def _memberships(width: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, h, owner, sizes in _sets(batch.column(0), width):
                ids = _class_ids(h, owner, last - first)
                sign, of = _signatures(h, owner, sizes, num, den)
                classes = ids[of]
                # copies within this run of texts are told once
                bucket = (sign >> np.uint64(32)) % np.uint64(buckets)
                order = np.lexsort((classes, sign, bucket))
                sign, classes, bucket = sign[order], classes[order], bucket[order]
                new = np.ones(len(sign), bool)
                new[1:] = (sign[1:] != sign[:-1]) | (classes[1:] != classes[:-1])
                sign, classes, bucket = sign[new], classes[new], bucket[new]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate([[0], cuts]) if len(bucket) else cuts
                ends = np.append(cuts, len(bucket)) if len(bucket) else cuts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[starts].astype(np.int64)),
                        pa.array([sign[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                        pa.array([classes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["bucket", "signs", "classes"],
                )

    return run


def _open_groups(table: pa.Table) -> pa.Table:
    """Of one bucket: pairs to compare (sign null), and members of large groups (b null)."""
    sign = np.frombuffer(b"".join(table["signs"].to_pylist()), np.uint64)
    classes = np.frombuffer(b"".join(table["classes"].to_pylist()), np.int64)
    order = np.lexsort((classes, sign))
    sign, classes = sign[order], classes[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (classes[1:] != classes[:-1])
    sign, classes = sign[new], classes[new]
    starts = np.flatnonzero(np.diff(sign, prepend=~sign[:1]) != 0)
    lengths = np.diff(np.append(starts, len(sign)))
    several = np.repeat(lengths, lengths) > 1
    large = np.repeat(lengths, lengths) > ALL_PAIRS
    first = np.repeat(starts, lengths)
    at = np.arange(len(sign))
    pairs = [np.empty((0, 2), np.int64)]
    for step in range(1, ALL_PAIRS):  # each class with the one `step` places before it
        here = np.flatnonzero(several & ~large & (at - step >= first))
        if len(here):
            pairs.append(np.stack([classes[here - step], classes[here]], 1))
    star = np.flatnonzero(large & (at != first))
    pairs.append(np.stack([classes[first[star]], classes[star]], 1))
    pair = np.unique(np.concatenate(pairs), axis=0)
    member = np.flatnonzero(large)
    nulls = lambda n: pa.nulls(n, pa.int64())
    return pa.table({
        "a": pa.concat_arrays([pa.array(pair[:, 0]), pa.array(classes[member])]),
        "b": pa.concat_arrays([pa.array(pair[:, 1]), nulls(len(member))]),
        "sign": pa.concat_arrays([nulls(len(pair)), pa.array(sign[member].view(np.int64))]),
    })


def _read_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, h, owner, _ in _sets(batch.column(1), width):
                n = last - first
                ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                wanted = batch.column(0).slice(first, n)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                found = pa.RecordBatch.from_arrays([wanted, tokens], ["class", "tokens"])
                # an id may have rows of other classes too
                own = pa.array(_class_ids(h, owner, n).view(np.int64))
                yield found.filter(pc.equal(wanted, own))

    return run


def _links(
    pairs: DataFrame, info: DataFrame, texts: DataFrame, width: int, num: int, den: int
) -> DataFrame:
    """Of pairs of classes (a, b), those that are linked."""
    sides = [info.select(*[F.col(c).alias(f"{s}_{c}") for c in info.columns]) for s in "ab"]
    likely = pairs.join(sides[0], F.col("a") == F.col("a_class")).join(
        sides[1], F.col("b") == F.col("b_class")
    )
    differ = sum(
        (F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(SKETCH)), F.lit(0)
    )
    total = F.col("a_n") + F.col("b_n")
    # shared >= num / (num + den) of the total, so the distance is at most this much of it
    likely = store(
        likely.where(
            (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num)
            & (differ * (den + num) <= total * (den - num))
        ).select("a", "b", "a_rep", "b_rep", "a_n", "b_n"),
        "likely",
    )
    wanted = store(
        likely.select(F.col("a").alias("class"), F.col("a_rep").alias("rep"))
        .unionAll(likely.select("b", "b_rep"))
        .distinct(),
        "wanted",
    )
    few = _perhaps_in(texts, "row_key", wanted.select("rep"))
    sets = store(
        few.join(wanted, few["row_key"] == wanted["rep"])
        .select("class", "text")
        .mapInArrow(_read_sets(width), "class bigint, tokens array<bigint>"),
        "sets",
    )
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return (
        likely.join(left, "a")
        .join(right, "b")
        .where(shared * den >= (total - shared) * num)
        .select("a", "b")
    )


def join(
    docs: DataFrame,
    width: int = 3,
    num: int = 90,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id): sets link if den * shared >= num * union."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = ", ".join(f"s{k} bigint" for k in range(SKETCH))
    described = store(
        rows.mapInArrow(_describe(width), f"id {kind}, class bigint, n bigint, {sketch}"), "described"
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    opened = store(
        rows.select("text")
        .mapInArrow(
            _memberships(width, num, den, buckets), "bucket bigint, signs binary, classes binary"
        )
        .groupBy("bucket")
        .applyInArrow(_open_groups, "a bigint, b bigint, sign bigint"),
        "opened",
    )
    # a class is read from the row with its least id
    info = described.where("n > 0").groupBy("class").agg(
        F.min("id").alias("rep"), F.max("n").alias("n"),
        *[F.max(f"s{k}").alias(f"s{k}") for k in range(SKETCH)],
    ).where("rep is not null")
    texts = rows.withColumnRenamed("id", "row_key")
    pairs = store(opened.where("sign is null").select("a", "b").distinct(), "pairs")
    links = store(_links(pairs, info, texts, width, num, den), "links")
    large = opened.where("sign is not null").select("sign", F.col("a").alias("class"))
    if not large.isEmpty():
        links = _between_components(large, pairs, links, info, texts, width, num, den)
    found = components(links)
    least = (
        found.join(info.select(F.col("class").alias("node"), "rep"), "node")
        .groupBy("component")
        .agg(F.min("rep").alias("least"))
    )
    of_class = found.join(least, "component").select(F.col("node").alias("class"), "least")
    reps = info.select("class", "rep").join(of_class, "class", "left").select(
        "class", F.coalesce("least", "rep").alias("component_id")
    )
    return described.select("id", "class", "n").join(reps, "class", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _nearest_strays(limit: int | None, num: int, den: int):
    """Of one cell of a large group: pairs of different components that bitmaps and sizes allow.

    Each class outside the group's main component is compared with all of the cell. Of the pairs
    of one class the `limit` nearest by the bitmaps are told, or all.
    """

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table[c].to_numpy()
        block, classes, part, n = get("block"), get("class"), get("component"), get("n")
        stray = part != get("main")
        bits = np.stack([get(f"s{k}") for k in range(SKETCH)], 1).view(np.uint64)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        pairs = [np.empty((0, 2), np.int64)]
        for rows, columns in ((left[stray[left]], right), (right[stray[right]], left)):
            step = max(1, CELLS // max(len(columns), 1))
            for first in range(0, len(rows), step):
                some = rows[first : first + step]
                differ = np.zeros((len(some), len(columns)), np.int64)
                for k in range(SKETCH):
                    differ += np.bitwise_count(bits[some, k][:, None] ^ bits[columns, k][None, :])
                a, b = n[some][:, None], n[columns][None, :]
                likely = (
                    (part[some][:, None] != part[columns][None, :])
                    & (differ * (den + num) <= (a + b) * (den - num))
                    & (np.minimum(a, b) * den >= np.maximum(a, b) * num)
                )
                if limit and limit < len(columns):
                    differ[~likely] = 1 << 40
                    near = np.argpartition(differ, limit, axis=1)[:, :limit]
                    x = np.repeat(np.arange(len(some)), limit)
                    y = near.reshape(-1)
                    keep = likely[x, y]
                    x, y = x[keep], y[keep]
                else:
                    x, y = np.nonzero(likely)
                pairs.append(np.stack([classes[some[x]], classes[columns[y]]], 1))
            if block.min() == block.max():
                break
        pair = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    return run


def _split_groups(large: DataFrame, links: DataFrame, info: DataFrame) -> DataFrame:
    """Members of large groups that have more than one component, dealt into cells.

    A group is cut into blocks of about `BLOCK` classes, and every two blocks are a cell, so a
    cell has a bound whatever the group's size.
    """
    found = components(links).select(F.col("node").alias("class"), "component")
    placed = large.join(found, "class", "left").select(
        "sign", "class", F.coalesce("component", "class").alias("component")
    )
    main = (
        placed.groupBy("sign", "component")
        .agg(F.count("*").alias("k"))
        .groupBy("sign")
        .agg(
            F.max_by("component", F.struct("k", "component")).alias("main"),
            F.count("*").alias("parts"),
            F.sum("k").alias("members"),
        )
        .where("parts > 1")
    )
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    return store(
        placed.join(main, "sign")
        .join(info.drop("rep"), "class")
        .withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("parts", "members", "other"),
        "split-groups",
    )


def _perhaps_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among `keys`: a filter of `FILTER_BITS` bits, sent to every task.

    It has a row for each 32,768 bits, 8 MB together at most, however many keys there are; the more
    there are, the more other rows pass.
    """
    (name,) = keys.columns

    def bit(c):
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    place = (bit(name) % 32_768).alias("place")
    found = keys.select(F.shiftright(bit(name), 15).alias("_part"), place)
    filters = found.groupBy("_part").agg(F.bitmap_construct_agg("place").alias("_filter"))
    at = (bit(key) % 32_768).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_filter"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10)
    # bit k of a byte is worth 2 to the k
    has = F.floor(byte.cast("int") / F.pow(F.lit(2), at % 8)) % 2 == 1
    part = F.shiftright(bit(key), 15)
    return (
        rows.join(F.broadcast(store(filters, "filter")), part == F.col("_part"))
        .where(has)
        .select(*rows.columns)
    )


def _between_components(
    large: DataFrame, pairs: DataFrame, links: DataFrame, info: DataFrame, texts: DataFrame,
    width: int, num: int, den: int,
) -> DataFrame:
    """More links, from large groups whose classes are not yet of one component.

    First every class outside a group's main component is compared with the few nearest of other
    components only, since one link is enough to join two; then with more, and at last with all
    that are left, until all pairs that the bitmaps allow are compared or of one component.
    """
    rounds = [4, 64]
    split = _split_groups(large, links, info)
    while not split.isEmpty():
        limit = rounds.pop(0) if rounds else None
        fresh = store(
            split.groupBy("sign", "low", "high")
            .applyInArrow(_nearest_strays(limit, num, den), "a bigint, b bigint")
            .distinct()
            .join(pairs, ["a", "b"], "left_anti"),
            "fresh-pairs",
        )
        if fresh.isEmpty():
            if limit is None:
                break
            continue
        more = store(_links(fresh, info, texts, width, num, den), "links")
        pairs = pairs.unionAll(fresh)
        if not more.isEmpty():
            links = links.unionAll(more)
            split = _split_groups(large, links, info)
    return links


def one_of_each(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents of which none with a smaller id is in their component, all columns kept.

    Rows that repeat an id are one document: they stay or go together.
    """
    kept = (
        join(docs, width, num, den, id_col, text_col)
        .where(F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))
        .select(F.col(id_col).alias("kept_id"))
        .distinct()
    )
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
