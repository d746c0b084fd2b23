"""Toxicity by compression distance: two zstandard dictionaries, and how well each shortens a text.

A text is cut into windows of a few words. Each window is compressed twice, with a dictionary of
toxic text and with one of ordinary text; the bytes that the toxic one saves are the window's
distance. A document's score comes from its windows: how many, and which share, save at least a
calibrated number of bytes, and how much the best of them save.

Training. Of the labelled documents that are not held out, up to `MAX_LABELLED` of each label are
taken by the hash of their id (all others are never read for this). Two thirds of them train the
dictionaries: Spark counts in how many toxic and ordinary documents each word is; words that are told
apart by these counts (likelihood ratio) fill the toxic dictionary, most telling words last, where
zstandard finds them cheapest, and the most frequent words of ordinary text the other, which is as
long. Documents that share their least five-word shingle, as near copies mostly do, count as one and
are in one part, so that copies neither make words telling nor check themselves.
The remaining third calibrates: how telling a word must be (`LEAST_TELLING`), how many bytes a
window must save (`LEAST_SAVED`) and the weights of a logistic regression are those with the
least loss there, each label weighted by its true number. Only words' counts (at most `MAX_WORDS`
words) and a histogram of `2 * SPAN + 1` numbers for each calibration document and choice reach
the driver.

Scoring is one pass without a shuffle; the model is a few KB. Texts are read in pieces of
`PIECE_CHARS`, so a very long one costs little beyond its own size, and counts as a whole.

Words are runs of letters and digits in lower case, cut after `WORD_CHARS`; in scripts without
spaces a word is such a piece of a sentence. Defined results: a null or empty text, or one without
a word, has one empty window. With no label, or one only, there is nothing to tell apart, and every
score is the share of toxic labels (0 if there are none). A null label is none; a document with
differing labels is toxic. A null id is never learned from, nor held out. Repeated rows are scored
each; a repeated id that is labelled is learned from as often as it is there. Empty tables give no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import store

MAX_LABELLED = 10_000
MAX_WORDS = 512
#: Choices of how telling a word must be (likelihood ratio) to be in the toxic dictionary.
LEAST_TELLING = (12.0, 20.0, 30.0, 50.0, 100.0, 200.0)
#: Choices of how many bytes a window must save to count.
LEAST_SAVED = tuple(range(1, 9))
WINDOW, STEP = 3, 2
WORD_CHARS = 24
PIECE_CHARS = 1 << 18
SPAN = 16
TOXIC_AT = 0.3

#: Stands behind every window and in front of both dictionaries, so that each window has a match to
#: tell. The first match costs as much as a short word saves; this way both frames have paid for it.
_PHRASE = bytes(b for b in range(27) if b not in b"\t\n\r")

_WORD = re.compile(rf"[^\W_]{{1,{WORD_CHARS}}}")


def remainder(id_col: str) -> Column:
    """The fold of a row, 0 to 3, from its id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _words(text: str) -> Iterator[list[str]]:
    """The words of a text, piece by piece."""
    begin = 0
    while begin < len(text):
        end = min(begin + PIECE_CHARS, len(text))
        limit = min(end + PIECE_CHARS, len(text))
        while end < limit and text[end].isalnum():
            end += 1
        yield _WORD.findall(text[begin:end].lower())
        begin = end


def windows(text: str | None) -> Iterator[bytes]:
    """Windows of `WINDOW` words, each `STEP` words after the one before; all words are in one."""
    left: list[str] = []
    some = False
    for more in _words(text or ""):
        some_words = left + more
        at = 0
        while len(some_words) - at >= WINDOW:
            yield f" {' '.join(some_words[at : at + WINDOW])} ".encode() + _PHRASE
            at += STEP
            some = True
        left = some_words[at:]
    if len(left) > (WINDOW - STEP if some else 0) or not some:
        yield f" {' '.join(left)} ".encode() + _PHRASE


class Distance:
    """Bytes that a dictionary of toxic words saves on a window, against one of ordinary words."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = (self._compressor(x) for x in (toxic, ordinary))

    @staticmethod
    def _compressor(content: bytes):
        # tables as small as the dictionaries, since each window starts with a copy of them
        parameters = zstandard.ZstdCompressionParameters(
            window_log=14, hash_log=10, chain_log=10, search_log=3, min_match=5,
            strategy=zstandard.STRATEGY_DFAST,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        kind = zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

    def histogram(self, text: str | None) -> np.ndarray:
        """Windows of a text by the bytes saved, from -SPAN to SPAN."""
        toxic, ordinary = self.toxic, self.ordinary
        saved = Counter(len(ordinary(w)) - len(toxic(w)) for w in windows(text))
        found = np.zeros(2 * SPAN + 1, np.int64)
        for s, n in saved.items():
            found[min(max(s, -SPAN), SPAN) + SPAN] += n
        return found


def features(histograms: np.ndarray, least_saved: int) -> np.ndarray:
    """What a score is made of, one row a document."""
    n = histograms.sum(axis=1)
    value = np.arange(-SPAN, SPAN + 1)
    hits = histograms[:, least_saved + SPAN :].sum(axis=1)
    # the mean of the three windows that save most
    above = np.cumsum(histograms[:, ::-1], axis=1)
    top = np.minimum(above, 3)
    three = (np.diff(top, axis=1, prepend=0) * value[::-1]).sum(axis=1) / np.maximum(top[:, -1], 1)
    return np.stack(
        [np.ones(len(n)), np.minimum(hits, 5), hits > 0, hits / n, three / SPAN,
         histograms @ value / n, np.log1p(n)],
        axis=1,
    )


@dataclass
class Model:
    """Dictionaries, the calibrated threshold of a window, and the weights of the features."""

    toxic: bytes = b""
    ordinary: bytes = b""
    least_saved: int = 1
    weights: list[float] = field(default_factory=list)
    share: float = 0.0

    def scores(self, histograms: np.ndarray) -> np.ndarray:
        z = features(histograms, self.least_saved) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, with a small penalty; and its mean loss."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 1.0)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()
    return w, float(loss)


def _dictionary(words: list[str]) -> bytes:
    return _PHRASE + f" {' '.join(words)} ".encode()


def _learnable(labels: DataFrame, id_col: str, label_col: str, max_labelled: int):
    """(id, toxic) of the documents to learn from, and how many there are of each label."""
    toxic = F.max((F.col(label_col) != 0).cast("int")).alias("toxic")
    all_of = (
        labels.where(F.col(label_col).isNotNull() & (remainder(id_col) != 2))
        .groupBy(F.col(id_col).alias("id"))
        .agg(toxic)
    )
    # one row a label
    of = {r["toxic"]: r["n"] for r in all_of.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("id")
    taken = [all_of.where(F.col("toxic") == t).orderBy(order, "id").limit(max_labelled) for t in (0, 1)]
    return taken[0].unionAll(taken[1]), of


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of five words in a row; near copies mostly share it."""
    for batch in batches:
        least = []
        for text in batch.column(0).to_pylist():
            best, before = None, []
            for some in _words(text or ""):
                ws = before + some
                for i in range(max(len(ws) - 4, 1)):
                    h = xxhash.xxh64_intdigest(" ".join(ws[i : i + 5])) >> 1
                    best = h if best is None or h < best else best
                before = ws[-4:]
            least.append(best or 0)
        columns = [batch.column(0), batch.column(1), pa.array(least, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["text", "toxic", "least"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(least shingle, word, in toxic text, in ordinary text) of each batch, once each."""
    for batch in batches:
        seen: dict[tuple[int, str], int] = {}
        for text, is_toxic, least in zip(*(batch.column(i).to_pylist() for i in range(3))):
            bit = 1 if is_toxic else 2
            for w in {w for some in _words(text or "") for w in some}:
                seen[least, w] = seen.get((least, w), 0) | bit
        columns = [
            pa.array([least for least, _ in seen], pa.int64()),
            pa.array([w for _, w in seen], pa.string()),
            *[pa.array([x & bit > 0 for x in seen.values()], pa.bool_()) for bit in (1, 2)],
        ]
        yield pa.RecordBatch.from_arrays(columns, ["least", "word", "toxic", "ordinary"])


def _ratio(n_toxic: int, n_ordinary: int) -> Column:
    """How sure it is that toxic text has a word more often: likelihood ratio, 0 if not."""
    n = n_toxic + n_ordinary
    have = F.col("toxic") + F.col("ordinary")

    def part(seen: Column, of: int, total: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (total * of))).otherwise(0.0)

    sum_of = (
        part(F.col("toxic"), n_toxic, have)
        + part(F.col("ordinary"), n_ordinary, have)
        + part(n_toxic - F.col("toxic"), n_toxic, n - have)
        + part(n_ordinary - F.col("ordinary"), n_ordinary, n - have)
    )
    more = F.col("toxic") * n_ordinary > F.col("ordinary") * n_toxic
    return F.when(more, 2 * sum_of).otherwise(0.0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Fit on up to `max_labelled` documents of each label that are not held out."""
    chosen, of = _learnable(labels, id_col, label_col, max_labelled)
    share = of.get(1, 0) / max(sum(of.values()), 1)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, "id").select("text", "toxic")
    rows = rows.mapInArrow(_least_shingles, "text string, toxic int, least long")
    rows = store(
        rows.withColumn("calibrates", F.pmod(F.xxhash64("least"), F.lit(3)) == 0), "toxicity-labelled"
    )
    grouped = rows.groupBy("calibrates", "toxic").agg(F.count("*").alias("n"))
    n = {(r["calibrates"], r["toxic"]): r["n"] for r in grouped.collect()}
    learn = [n.get((False, 1), 0), n.get((False, 0), 0)]
    if not all(learn):
        return Model(share=share)

    learned = rows.where(~F.col("calibrates"))
    found = (
        learned.select("text", "toxic", "least")
        .mapInArrow(_vocabulary, "least long, word string, toxic boolean, ordinary boolean")
        .groupBy("least", "word")
        .agg(F.bool_or("toxic").alias("toxic"), F.bool_or("ordinary").alias("ordinary"))
    )
    seen = [F.count_if(c).alias(c) for c in ("toxic", "ordinary")]
    total = learned.groupBy("toxic").agg(F.count_distinct("least").alias("n")).collect()
    texts_of = {r["toxic"]: r["n"] for r in total}
    vocabulary = found.groupBy("word").agg(*seen).withColumn("ratio", _ratio(texts_of[1], texts_of[0]))
    vocabulary = store(vocabulary, "toxicity-words")
    telling = [
        (r["word"], r["ratio"])
        for r in vocabulary.where(F.col("ratio") >= min(LEAST_TELLING))
        .orderBy(F.desc("ratio"), "word")
        .limit(MAX_WORDS)
        .collect()
    ]
    usual = [
        r["word"] for r in vocabulary.where("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(MAX_WORDS).collect()
    ]
    choices = []
    for least in LEAST_TELLING:
        some = [w for w, ratio in telling if ratio >= least]
        if some and (not choices or len(some) < len(choices[-1][0])):
            choices.append((some, usual[: len(some)]))
    if not choices:
        return Model(share=share)
    # the most telling words at the end, where the reach is shortest
    content = [(_dictionary(a[::-1]), _dictionary(b[::-1])) for a, b in choices]

    calibrates = F.col("calibrates") if all(n.get((True, t), 0) for t in (0, 1)) else F.lit(True)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [Distance(*c) for c in content]
        for batch in batches:
            found = [
                np.concatenate([d.histogram(text) for d in distances]).tolist()
                for text in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["toxic", "found"]
            )

    spread = rows.where(calibrates).select("text", "toxic").repartition(
        docs.sparkSession.sparkContext.defaultParallelism
    )
    told = spread.mapInArrow(measure, "toxic int, found array<long>").collect()
    y = np.array([r["toxic"] for r in told], float)
    found = np.array([r["found"] for r in told], np.int64).reshape(len(told), len(content), -1)
    weight = np.where(y == 1, of[1] / max(y.sum(), 1), of[0] / max((1 - y).sum(), 1))
    weight *= len(y) / weight.sum()
    best = None
    for c, (toxic, ordinary) in enumerate(content):
        for least_saved in LEAST_SAVED:
            w, loss = _fit(features(found[:, c], least_saved), y, weight)
            if best is None or loss < best[0] - 1e-9:
                best = (loss, Model(toxic, ordinary, least_saved, w.tolist(), share))
    return best[1]


@lru_cache(maxsize=2)
def _distance(toxic: bytes, ordinary: bytes) -> Distance:
    return Distance(toxic, ordinary)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, windows, hits) of every row.

    `windows` a text has, and `hits` among them, which save as much as the calibration asks for.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "score", "predicted", "windows", "hits"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model.weights:
                distance = _distance(model.toxic, model.ordinary)
                found = np.array([distance.histogram(t) for t in texts]).reshape(len(texts), 2 * SPAN + 1)
                scores = model.scores(found) if len(texts) else np.zeros(0)
                n, hits = found.sum(axis=1), found[:, model.least_saved + SPAN :].sum(axis=1)
            else:
                scores = np.full(len(texts), model.share)
                n = hits = np.zeros(len(texts), np.int64)
            columns = [
                batch.column(0),
                pa.array(scores, pa.float64()),
                pa.array((scores >= TOXIC_AT).astype(np.int32)),
                pa.array(n, pa.int64()),
                pa.array(hits, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, score double, predicted int, windows long, hits long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
