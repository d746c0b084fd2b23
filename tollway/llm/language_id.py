"""Language identification in two steps: the family, then the language within it.

Features are hashed runs of two to four bytes of the lower-cased text, as shares of all such runs.
Linear support vector machines tell the families apart, one against one, and then the languages
of the family found, one against one. Votes decide, then the sum of margins. The score is how sure
the weakest of the decisive machines is.

The machines are fitted on a bounded sample of labelled rows: of each language the
same number, those whose ids have the smallest hashes (all rows of a language with fewer),
`MAX_ROWS` rows in all. Prediction reads the whole text and nothing else.

Nulls and odd input: a null text, or one without a letter, is `und` with score 0. If no row can be
learned from, every text is; if there is one language, every text with a letter is in it. A null
id is not held out and not learned from. Repeated rows are repeated. Other columns, whatever their
names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollway.llm.hashing import groups, text_bytes

MAX_ROWS = 1_000
FEATURES = 1 << 14
ORDERS = (2, 3, 4)
STEPS = 120
PENALTY = 1e-4
GROUP_BYTES = 1 << 20  # of texts handled at once
UNKNOWN = "und"

#: Families of languages by code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi bn ur mr gu pa ne",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "finnic": "fi et",
    "baltic": "lt lv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# letters in lower case, bytes of other scripts as they are, all else a space
_CODE = np.full(256, ord(" "), np.uint64)
_CODE[128:] = np.arange(128, 256)
for _c in range(26):
    _CODE[ord("a") + _c] = _CODE[ord("A") + _c] = ord("a") + _c


def family_of(language: str) -> str:
    return _FAMILY.get(language, language)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of all texts, one after the other, and where each text begins."""
    code = _CODE[data]
    n = len(code)
    parts = []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for order in ORDERS:
        h = np.full(n, order, np.uint64)
        for k in range(order):
            h[: n - k] = h[: n - k] * np.uint64(0x100000001B3) + code[k:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        number = (h >> np.uint64(50)).astype(np.int32)
        # runs that leave the text count for nothing
        number[np.arange(n) + order > ends] = FEATURES
        parts.append(number)
    return np.stack(parts, 1).reshape(-1), offsets * len(ORDERS)


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss; y is 1 or -1."""
    scale = np.float32(1 / max(float(np.sqrt((x * x).sum(1).mean())), 1e-12))
    x = np.hstack([x * scale, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    # both classes weigh the same; the largest slope of the loss bounds the step
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight = weight.astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v)
    largest = float(v @ (x.T @ (weight * (x @ v))))
    rate = np.float32(1 / (2.2 * largest + PENALTY))
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ z))
        after = z - rate * (np.float32(PENALTY) * z - 2 * (x.T @ (weight * y * slack)))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = after + np.float32((before - 1) / t) * (after - w)
        w = after
    return np.append(w[:-1] * scale, w[-1])


@dataclass
class Model:
    """Languages by family, and a column of weights for each machine (a, b): above 0 it is a."""

    families: dict[str, list[str]]
    machines: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES + 1, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of margins for every text; texts are not empty."""
        number, starts = features(data, offsets)
        sums = np.add.reduceat(self.weights[number], starts[:-1], axis=0, dtype=np.float64)
        used = np.add.reduceat(number < FEATURES, starts[:-1], dtype=np.int64)
        return sums / np.maximum(used, 1)[:, None] + self.bias

    def choose(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name most machines vote for, and how sure the weakest of its machines is."""
        if len(names) == 1:
            return names[0], 1.0
        votes = {}
        for name in names:
            own = [m if a == name else -m for (a, b), m in margin.items() if name in (a, b)]
            votes[name] = (sum(m > 0 for m in own), sum(own), min(own))
        best = max(names, key=lambda name: votes[name][:2])
        return best, float(1 / (1 + np.exp(-np.clip(2 * votes[best][2], -50, 50))))

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        of = dict(zip(self.machines, margins.tolist()))
        families = list(self.families)
        between = {(a[7:], b[7:]): m for (a, b), m in of.items() if a.startswith("family ")}
        family, sure = self.choose(families, between)
        languages = self.families[family]
        inside = {k: m for k, m in of.items() if k[0] in languages and k[1] in languages}
        language, surer = self.choose(languages, inside)
        return language, min(sure, surer)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model of sampled rows: (language, numbers of features, their shares)."""
    languages = sorted({language for language, _, _ in rows})
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(family_of(language), []).append(language)
    model = Model(families)
    columns = []

    def add(a: str, of_a: list[str], b: str, of_b: list[str]) -> None:
        mine = [r for r in rows if r[0] in of_a or r[0] in of_b]
        x = np.zeros((len(mine), FEATURES), np.float32)
        for i, (_, number, share) in enumerate(mine):
            x[i, number] = share
        columns.append(fit_machine(x, np.array([1.0 if r[0] in of_a else -1.0 for r in mine])))
        model.machines.append((a, b))

    for a, b in combinations(families, 2):
        add(f"family {a}", families[a], f"family {b}", families[b])
    for members in families.values():
        for a, b in combinations(members, 2):
            add(a, [a], b, [b])
    if columns:
        stacked = np.stack(columns, 1)
        model.bias = stacked[-1]
        model.weights = np.vstack([stacked[:-1], np.zeros((1, len(columns)))]).astype(np.float32)
    return model


def remainder(id_col: str) -> Column:
    """The fold of a row, 0 to 4, from its id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for first, last in groups(offsets, GROUP_BYTES):
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, shares = [], []
        for _, _, data, offsets in _texts(batch.column(1)):
            number, starts = features(data, offsets)
            for a, b in zip(starts[:-1], starts[1:]):
                count = np.bincount(number[a:b], minlength=FEATURES + 1)[:FEATURES]
                there = np.flatnonzero(count)
                numbers.append(there.astype(np.int32))
                shares.append((count[there] / max(count.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(numbers, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["lang", "number", "share"],
        )


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Fit on at most `max_rows` rows that are not held out, as many of each language, or all it has.

    If there are more languages than `max_rows`, each has one row.
    """
    able = docs.where(
        (remainder(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    ).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"),
    )
    # one row a language
    of = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not of:
        return Model({})
    # rows that languages with few leave unused are shared out among the others
    each, left = {}, max(max_rows, len(of))
    for k, (language, n) in enumerate(sorted(of.items(), key=lambda x: (x[1], x[0]))):
        each[language] = min(n, left // (len(of) - k))
        left -= each[language]
    # hashes below a threshold that more than enough rows meet go to the exact choice, so what a
    # language brings to it is bounded; a language that has too few below it brings all its rows
    def limited(shares: dict[str, float]) -> Column:
        share = F.lit(0.0)
        for language, x in shares.items():
            share = F.when(F.col("lang") == language, F.lit(x)).otherwise(share)
        return F.col("h") < share * (1 << 30)

    shares = {x: min(1.0, (2 * m + 50) / of[x]) for x, m in each.items()}
    near = able.where(limited(shares))
    enough = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    few = [x for x, m in each.items() if enough.get(x, 0) < m]
    if few:
        near = able.where(limited(shares | dict.fromkeys(few, 1.0)))
    limit = F.lit(0)
    for language, m in each.items():
        limit = F.when(F.col("lang") == language, F.lit(m)).otherwise(limit)
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"), "text")
    chosen = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    rows = chosen.select("lang", "text").mapInArrow(
        _sampled, "lang string, number array<int>, share array<float>"
    )
    return fit([
        (r["lang"], np.array(r["number"], np.int64), np.array(r["share"], np.float32))
        for r in rows.collect()
    ])


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features by machines, no more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found: list[tuple[str, float]] = []
            for _, _, data, offsets in _texts(batch.column(1)):
                filled = np.flatnonzero(np.diff(offsets))
                margins = np.zeros((len(offsets) - 1, len(model.machines)))
                if len(filled):
                    bounds = np.append(offsets[filled], offsets[-1])
                    margins[filled] = model.margins(data, bounds)
                found += [model.predict(m) if model.families else (UNKNOWN, 0.0) for m in margins]
            letter = batch.column(2).to_pylist()
            told = [x if is_text else (UNKNOWN, 0.0) for x, is_text in zip(found, letter)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())],
                ["id", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed(
        "id", id_col
    )
