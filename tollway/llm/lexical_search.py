"""Ranked lexical search: every item against every document, by one scan of the texts.

There is no index of the documents. All terms of the items go into one automaton (Aho-Corasick),
each guarded by a space on both sides; documents are read once with every separator turned into
a space, and each place where the automaton stops is one whole term. So term frequencies come
straight from the text, and the terms lead to the items that have them.

Two scans, neither with a shuffle of documents. The first counts how many documents have each
term, how many have any, and all terms of all documents; a task sends one row a term. The second
scores: a task keeps the best `k` documents of each item, so what it sends is bounded by the
items. The best of all tasks are found in two steps, so that no task ranks an item's rows of the
whole cluster.

Bounds. The items are cut into blocks of `BLOCK_BYTES` of terms, by measured size (a single item may be
more); documents are scanned for one block after the other, against the same counts, so the blocks
change no score. A block's terms and its documents' counts go through the driver. In a task, texts
are scanned in pieces of `PIECE_BYTES`, cut at separators, and scored `CELLS` pairs of document
and item, or of a term found and an item that has it, at a time. A very long text costs a few bytes for each of its own beyond that.

Terms are runs of letters, digits and all characters beyond ASCII; only A-Z are lower-cased.

Defined results: null texts and texts without a term are no documents in the counts and are never
found; items without a term find nothing. Rows that share an item's id are one item, with the terms
of all of them. Rows that share a document's id are documents of their own; among equal scores the
lesser id comes first, null last. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tollway.llm.columns import store
from tollway.llm.hashing import groups, text_bytes

BEST = 20
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
CELLS = 1 << 20
SALTS = 32

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = 0x20
#: A byte of a text as the automaton reads it: separators are spaces, A-Z are lower case.
_READ = np.arange(256, dtype=np.uint8)
_READ[:0x80] = _SPACE
for _c in "0123456789" + LOWER:
    _READ[ord(_c)] = ord(_c)
    _READ[ord(_c.upper())] = ord(_c)


class Block:
    """The items of a block: their terms, and which items have a term how often."""

    def __init__(self, items: list[tuple[Any, dict[str, int]]]):
        self.ids = [k for k, _ in items]
        self.terms = sorted({t for _, own in items for t in own})
        number = {t: i for i, t in enumerate(self.terms)}
        links = sorted(
            (number[t], item, times) for item, (_, own) in enumerate(items) for t, times in own.items()
        )
        table = np.array(links, np.int64).reshape(-1, 3)
        self.item, self.times = table[:, 1], table[:, 2]
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.terms) + 1))


class Scanner:
    """Counts a block's terms in texts."""

    def __init__(self, block: Block):
        self.block = block
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(block.terms):
            self.automaton.add_word(f" {term} ".encode().decode("latin-1"), i)
        self.automaton.make_automaton()

    def _found(self, read: np.ndarray) -> np.ndarray:
        """(place of the space behind, term) of every term; `read` begins and ends with a space."""
        ends = self.automaton.iter(read.tobytes().decode("latin-1"))
        return np.fromiter(chain.from_iterable(ends), np.int64).reshape(-1, 2)

    def _long(self, read: np.ndarray) -> np.ndarray:
        """The same of a text of any length, in pieces that share the space they are cut at."""
        parts, begin = [], 0
        while begin < len(read) - 1:
            end = min(begin + PIECE_BYTES, len(read) - 1)
            while read[end] != _SPACE:  # the last byte is a space
                behind = np.flatnonzero(read[end : end + 4096] == _SPACE)
                end += int(behind[0]) if len(behind) else min(4096, len(read) - 1 - end)
            parts.append(self._found(read[begin : end + 1])[:, 1])
            begin = end
        terms = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return np.stack([np.zeros_like(terms), terms], axis=1)

    def count(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of a batch's texts: the first's number, terms in each text, and (text, term, times)."""
        data, offsets = text_bytes(column)
        n_terms = max(len(self.block.terms), 1)
        for first, last in groups(offsets, PIECE_BYTES):
            own = offsets[first : last + 1] - offsets[first]
            # a space in front of every text, and one at the end
            read = np.full(own[-1] + last - first + 1, _SPACE, np.uint8)
            starts = own[:-1] + np.arange(1, last - first + 1)
            inside = np.ones(len(read), bool)
            inside[starts - 1] = inside[-1] = False
            read[inside] = _READ[data[offsets[first] : offsets[last]]]
            letter = read != _SPACE
            begins = np.zeros(len(read) + 1, np.int64)
            np.cumsum(letter[1:] & ~letter[:-1], out=begins[2:])
            bounds = np.append(starts, len(read))
            length = begins[bounds[1:]] - begins[bounds[:-1]]
            if last - first == 1:
                found = self._long(read)
            else:
                found = self._found(read)
                found[:, 0] = np.searchsorted(starts, found[:, 0], "right") - 1
            keys, times = np.unique(found[:, 0] * n_terms + found[:, 1], return_counts=True)
            yield first, length, keys // n_terms, keys % n_terms, times


class Best:
    """The best documents of each item so far."""

    def __init__(self, k: int, n_items: int, id_type: pa.DataType):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = pa.array([], id_type)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of documents (rows) for items (columns)."""
        if len(scores) > self.k:
            own = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            floor = np.maximum(self.floor, own)
        else:
            floor = self.floor
        doc, item = np.nonzero(scores >= floor)
        if not len(doc):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[doc, item[len(self.item) :]]])
        ids = pa.concat_arrays([self.ids, ids.take(pa.array(doc))])
        rank = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -score, item))
        item, score = item[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        self.item, self.score = item[kept], score[kept]
        self.ids = ids.take(pa.array(order[kept]))
        last = place[kept] == self.k - 1
        self.floor[self.item[last]] = self.score[last]


def scores_of(
    block: Block, weight: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray
) -> np.ndarray:
    """Scores of the documents for all items, from (document, term, times) and each document's `m`."""
    value = weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
    links = block.first[term + 1] - block.first[term]
    scores = np.zeros(len(m) * len(block.ids), np.int64)
    # a term that many items have stands for as many rows; CELLS of them at a time
    ends = np.cumsum(links)
    begin = 0
    while begin < len(term):
        before = ends[begin] - links[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        n, own = links[begin:end], term[begin:end]
        at = np.repeat(block.first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(doc[begin:end] * len(block.ids), n) + block.item[at]
        np.add.at(scores, cell, np.repeat(value[begin:end], n) * block.times[at])
        begin = end
    return scores.reshape(len(m), len(block.ids))


@lru_cache(maxsize=2)
def _scanner(_key: str, sent: Any) -> Scanner:
    return Scanner(sent.value)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times) of every term of every item."""
    words = F.split(F.translate(text_col, UPPER, LOWER), SEPARATORS, -1)
    return (
        items.select(F.col(id_col).alias("item"), F.explode(words).alias("term"))
        .where(F.col("term") != "")
        .groupBy("item", "term")
        .agg(F.count("*").alias("times"))
    )


def _blocks(terms: DataFrame) -> Iterator[Block]:
    """The items in blocks of measured size."""
    size = F.sum(F.octet_length("term") + 16).alias("size")
    total = terms.agg(size).first()[0] or 0
    n = 64 * (total // BLOCK_BYTES + 1)
    bucket = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    ranges: list[list[int]] = []
    room = 0
    for r in sorted(terms.groupBy(bucket.alias("bucket")).agg(size).collect()):  # n rows
        if r["size"] > room:
            ranges.append([r["bucket"], r["bucket"]])
            room = BLOCK_BYTES
        ranges[-1][1] = r["bucket"]
        room -= r["size"]
    for first, last in ranges:
        own: dict[Any, dict[str, int]] = {}
        for r in terms.where(bucket.between(first, last)).collect():  # its size was measured
            own.setdefault(r["item"], {})[r["term"]] = r["times"]
        yield Block(list(own.items()))


def _counts(texts: DataFrame, key: str, sent: Any, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents with each of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, sent)
        having, n_docs, all_terms = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for _, length, _, term, _ in scanner.count(batch.column(1)):
                having += np.bincount(term, minlength=n_terms)
                n_docs += int((length > 0).sum())
                all_terms += int(length.sum())
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(some, [-1, -2]), pa.int64()),
                pa.array(np.append(having[some], [n_docs, all_terms]), pa.int64()),
            ],
            ["term", "n"],
        )

    rows = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, totals = np.zeros(n_terms, np.int64), {-1: 0, -2: 0}
    for r in rows.collect():  # one row a term of the block
        if r["term"] < 0:
            totals[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return totals[-1], totals[-2], df


def _best(
    texts: DataFrame, key: str, sent: Any, weight: np.ndarray, n_docs: int, all_terms: int, k: int, item_type: str
) -> DataFrame:
    """(item, id, score) of the best documents of every task."""
    id_type = to_arrow_type(texts.schema["id"].dataType)
    item_arrow = to_arrow_type(texts.sparkSession.createDataFrame([], f"item {item_type}").schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, sent)
        block = scanner.block
        best = Best(k, len(block.ids), id_type)
        step = max(1, CELLS // len(block.ids))
        for batch in batches:
            for first, length, doc, term, times in scanner.count(batch.column(1)):
                m = np.array([75 + 25 * int(n) * n_docs // all_terms for n in length], np.int64)
                for a in range(0, len(m), step):
                    i, j = np.searchsorted(doc, [a, a + step])
                    own = m[a : a + step]
                    scores = scores_of(block, weight, own, doc[i:j] - a, term[i:j], times[i:j])
                    best.add(scores, batch.column(0).slice(first + a, len(own)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block.ids[i] for i in best.item], item_arrow),
                best.ids,
                pa.array(best.score, pa.int64()),
            ],
            ["item", "id", "score"],
        )

    id_kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"item {item_type}, id {id_kind}, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score) of each item's `k` highest-scoring documents, with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    item_type = items.schema[item_col].dataType.simpleString()
    kind = docs.schema[id_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item {item_type}, rank int, id {kind}, score long")
    for block in _blocks(item_terms(items, item_col, item_text_col)):
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)
        n_docs, all_terms, df = _counts(texts, key, sent, len(block.terms))
        if n_docs:
            weight = np.array(
                [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64
            )
            rows = _best(texts, key, sent, weight, n_docs, all_terms, k, item_type)
            order = [F.desc("score"), F.asc_nulls_last("id")]
            salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
            for keys in (["item", "salt"], ["item"]):
                place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
                salted = salted.withColumn("rank", place).where(F.col("rank") <= k)
            found = found.unionAll(store(salted.select("item", "rank", "id", "score"), "search"))
        sent.destroy()
    return found.select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )
