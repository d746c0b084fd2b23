"""Benchmark decontamination: every training passage is a query against the benchmark's items.

The items of a benchmark, a small table, are an inverted index with BM25 weights. Documents are
cut into overlapping passages, each long enough to hold any item whole. A passage is scored as
block-max WAND does: first against the sum of its words' largest weights, then against the largest
weights in each block of items; only in blocks that could still reach the threshold are items
scored. The threshold of an item is a share of the score it gives itself, and all items above it
are retrieved. Each is then verified on the words: its shingles of five words must be in the
passage, and both its question and its answer must be there. An item of fewer than five words has
to be there as it is, word after word. In scripts without spaces each character is a word.

Benchmarks of more than `SHARD_BYTES` are split by hash into shards, each with its own index and
its own pass over the documents, so what is sent to the executors has a bound. Documents are never
shuffled.

Nulls and odd input: a null or empty text has no passage and is clean. Items without a word are
ignored; repeated items are found each by its id. Null ids are told as null. Repeated rows are
each searched. Other columns, whatever their names, are carried along by `without_leaks` and
ignored by `find_leaks`. Without items, or without documents, nothing is found.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from math import log
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BLOCK = 16
COMMON = 0.05  # of the items, for a word to be common
SHARE = 0.7  # of an item's own score, to be retrieved
SHINGLE = 5
OVERLAP = 0.8  # of an item's shingles, to be a leak
PART_OVERLAP = 0.5  # of the question's, and of the answer's
SHARD_BYTES = 8 << 20
GROUP_CHARS = 1 << 20  # of documents searched at once
CELLS = 1 << 20  # of passages by blocks, and of words, in one array

# characters of scripts that put no spaces between words: Han, kana, Thai, Lao, Burmese, Khmer;
# with the marks that belong to them
_UNSPACED = (
    "ก-ฺเ-๎๐-๙ກ-ໟက-၉ၐ-႟ក-៓"
    "々-〇ぁ-゚ゝ-ゟァ-ヺー-ヿㇰ-ㇿ"
    "㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
)
_SPACED_WORD = re.compile(r"[^\W_]+")
_WORD = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SENTENCE_END = re.compile(r"[.?!]\s+|\n+")


def split_words(text: str) -> list[str]:
    """Runs of letters or digits; of scripts without spaces, each character."""
    text = text.lower()
    return (_WORD if _ANY_UNSPACED.search(text) else _SPACED_WORD).findall(text)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Shingles of five words; of fewer words, all of them as one."""
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.rstrip())]
    if ends and split_words(text[: ends[-1]]) and split_words(text[ends[-1] :]):
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _ranges(offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions from `offsets[t]` up to `offsets[t + 1]` for each t, and the places of t."""
    starts, lengths = offsets[of], offsets[of + 1] - offsets[of]
    before = np.cumsum(lengths) - lengths
    at = np.repeat(starts - before, lengths) + np.arange(lengths.sum())
    return at, np.repeat(np.arange(len(of)), lengths)


class Index:
    """Items with BM25 weights, in blocks, and what the search needs of each block."""

    def __init__(self, items: list[tuple[Any, str]]):
        kept = [(k, text, split_words(text)) for k, text in items]
        # items that share their first words lie in one block
        kept = sorted((x for x in kept if x[2]), key=lambda x: (x[2], str(x[0])))
        self.ids = [k for k, _, _ in kept]
        self.longest = max((len(words) for _, _, words in kept), default=1)
        self.shingles = [shingles(words) for _, _, words in kept]
        self.runs = [f" {' '.join(words)} " if len(words) < SHINGLE else "" for _, _, words in kept]
        self.parts = [
            tuple(shingles(split_words(part)) for part in question_and_answer(text))
            for _, text, _ in kept
        ]
        self.vocabulary: dict[str, int] = {}
        for _, _, words in kept:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        n, v = len(kept), len(self.vocabulary)
        self.n_blocks = -(-n // BLOCK)
        found_in = Counter(word for _, _, words in kept for word in set(words))
        mean = sum(len(words) for _, _, words in kept) / max(n, 1)
        self.own = np.zeros(n)
        postings: list[tuple[int, int, float]] = []  # word, item, weight
        for i, (_, _, words) in enumerate(kept):
            for word, tf in Counter(words).items():
                idf = log(1 + (n - found_in[word] + 0.5) / (found_in[word] + 0.5))
                weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                postings.append((self.vocabulary[word], i, weight))
                self.own[i] += weight
        postings.sort()
        # the postings of word t are those from `offsets[t]` on; items, so blocks, are in order
        words_of = np.array([t for t, _, _ in postings], np.int64)
        self.items = np.array([i for _, i, _ in postings], np.int64)
        self.weights = np.array([w for _, _, w in postings])
        self.offsets = np.searchsorted(words_of, np.arange(v + 1))
        # for each word and block of items, the largest weight
        first = np.flatnonzero(
            np.diff(words_of * (self.n_blocks + 1) + self.items // BLOCK, prepend=-1)
        )
        self.block_of = self.items[first] // BLOCK
        self.block_max = np.maximum.reduceat(self.weights, first) if n else self.weights
        self.block_offsets = np.searchsorted(words_of[first], np.arange(v + 1))
        # the last entry is for words that no item has
        self.word_max = np.zeros(v + 1)
        np.maximum.at(self.word_max, words_of, self.weights)
        self.threshold = SHARE * self.own
        self.block_threshold = np.array(
            [self.threshold[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.n_blocks)]
        )
        # words of many items decide little: what an item can get from them is bounded by what it
        # has of them, so a passage needs the rest from its rare words
        common = np.array([found_in[w] > COMMON * n for w in self.vocabulary], bool)
        from_common = np.bincount(
            self.items, np.where(common[words_of], self.weights, 0.0), len(self.ids)
        )
        self.least = (self.threshold - from_common).min(initial=np.inf)
        self.rare_max = np.where(np.append(common, True), 0.0, self.word_max)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Passages and items whose score reaches the item's threshold, and the scores.

        `passage` and `term` are the distinct terms of `n` passages, side by side.
        """
        at, of = _ranges(self.block_offsets, term)
        bounds = np.bincount(
            passage[of] * self.n_blocks + self.block_of[at], self.block_max[at], n * self.n_blocks
        )
        opened = bounds.reshape(n, self.n_blocks) + 1e-9 >= self.block_threshold
        some = opened.any(axis=1)[passage]
        passage, term = passage[some], term[some]
        at, of = _ranges(self.offsets, term)
        to_score = opened[passage[of], self.items[at] // BLOCK]
        at, of = at[to_score], of[to_score]
        pairs, nr = np.unique(passage[of] * len(self.ids) + self.items[at], return_inverse=True)
        scores = np.bincount(nr, self.weights[at], len(pairs))
        found, item = pairs // len(self.ids), pairs % len(self.ids)
        hits = scores + 1e-9 >= self.threshold[item]
        return found[hits], item[hits], scores[hits]

    def verified(self, i: int, words: list[str]) -> tuple[float, float, float] | None:
        """Overlap of the item, its question and its answer with a passage, if it is a leak."""
        if self.runs[i]:
            # fewer words than a shingle: all of them, one after the other, hold the parts as well
            return (1.0, 1.0, 1.0) if self.runs[i] in f" {' '.join(words)} " else None
        there = shingles(words)

        def overlap(part: set) -> float:
            return len(part & there) / len(part) if part else 1.0

        whole = overlap(self.shingles[i])
        if whole < OVERLAP:
            return None
        question, answer = (overlap(part) for part in self._fitting(i, there))
        if min(question, answer) < PART_OVERLAP:
            return None
        return whole, question, answer

    def _fitting(self, i: int, there: set[tuple[str, ...]]) -> list[set]:
        # a part of fewer than five words is held against the words of the passage
        parts = []
        for part in self.parts[i]:
            short = next((x for x in part if len(x) < SHINGLE), None)
            if short is None:
                parts.append(part)
            else:
                words = {w for x in there for w in x}
                parts.append(there and {next(iter(there))} if set(short) <= words else {()})
        return parts

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float, float]]]:
        """For each text the items it leaks: share of the own score, and the three overlaps."""
        found: list[dict[int, tuple[float, float, float, float]]] = [{} for _ in texts]
        if not self.ids:
            return found
        none, span = len(self.vocabulary), 2 * self.longest
        per_call = max(1, CELLS // (self.n_blocks + span))
        for first, last in _groups([len(t or "") for t in texts]):
            words = [split_words(t or "") for t in texts[first:last]]
            n = np.array([len(w) for w in words])
            terms = np.fromiter(
                map(self.vocabulary.get, chain.from_iterable(words), repeat(none)), np.int64, n.sum()
            )
            begins = np.cumsum(n) - n
            passages = np.maximum(-(-n // self.longest) - 1, 1)
            owner = np.repeat(np.arange(len(n)), passages)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(passages) - passages, passages)
            starts = begins[owner] + nth * self.longest
            ends = np.minimum(starts + span, (begins + n)[owner])
            sums = np.concatenate([[0.0], np.cumsum(self.rare_max[terms])])
            likely = np.flatnonzero(sums[ends] - sums[starts] + 1e-6 >= self.least)
            for k in range(0, len(likely), per_call):
                some = likely[k : k + per_call]
                lengths = ends[some] - starts[some]
                at = np.repeat(starts[some] - np.cumsum(lengths) + lengths, lengths)
                at += np.arange(len(at))
                passage = np.repeat(np.arange(len(some)), lengths)
                known = terms[at] != none
                keys = np.unique(passage[known] * none + terms[at][known])
                for p, i, score in zip(*self.retrieve(keys // none, keys % none, len(some))):
                    doc, start = int(owner[some[p]]), int(starts[some[p]] - begins[owner[some[p]]])
                    overlaps = self.verified(i, words[doc][start : start + span])
                    if overlaps:
                        told = (float(score / self.own[i]), *overlaps)
                        seen = found[first + doc]
                        seen[int(i)] = max(seen.get(int(i), told), told)
        return found


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts that together have about `GROUP_CHARS` characters, or are one text."""
    first = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > GROUP_CHARS:
            yield first, i
            first, total = i, 0
        total += n
    if lengths:
        yield first, len(lengths)


@lru_cache(maxsize=2)
def _index(_key: str, broadcast: Any) -> Index:
    return Index(broadcast.value)


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, Any]]:
    """Broadcast rows of each shard of the items, with a key for the executors' index."""
    rows = items.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size * 2 // SHARD_BYTES) or 1
    for k in range(n):
        shard = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        sent = items.sparkSession.sparkContext.broadcast([tuple(r) for r in shard.collect()])
        yield uuid.uuid4().hex, sent


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap) of every leak, once a row and item."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {docs.schema[id_col].dataType.simpleString()},"
        f" item {items.schema[item_col].dataType.simpleString()},"
        " score double, overlap double, question_overlap double, answer_overlap double"
    )
    found = None
    for key, sent in _shards(items, item_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], key=key, sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent)
            for batch in batches:
                out = [
                    (k, index.ids[i], *told)
                    for k, found in zip(batch.column(0), index.leaks(batch.column(1).to_pylist()))
                    for i, told in sorted(found.items())
                ]
                ids = [k.as_py() for k, *_ in out]
                columns = [pa.array(ids, batch.schema.field(0).type)]
                columns.append(pa.array([x[1] for x in out], item_type))
                columns += [pa.array([x[c] for x in out], pa.float64()) for c in range(2, 6)]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = ["id", "item", "score", "overlap", "question_overlap", "answer_overlap"]
        item_type = _arrow_type(items, item_col)
        shard = rows.mapInArrow(search, schema)
        found = shard if found is None else found.unionAll(shard)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    at = docs.columns.index(text_col)
    for key, sent in _shards(items, item_col, item_text_col):

        def clean(batches: Iterator[pa.RecordBatch], key=key, sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent)
            for batch in batches:
                keep = [not found for found in index.leaks(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
