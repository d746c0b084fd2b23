"""Mixing documents to target weights with soft membership.

1. A classifier is learned from the labels: words that tell the domains apart, each with its share
   of the labelled documents of every domain. It is fitted on at most `max_labelled` labelled
   documents, those with the smallest hash of the id, and keeps at most `max_words` words.
2. Every document gets a posterior over the domains, in steps of one hundredth.
3. Nonnegative rates of the documents are fitted by projected gradient (with momentum) so that
   the expected tokens of each domain, summed over all documents, are the target. The gradient is
   taken in the metric of a document's tokens; then documents with equal posteriors have equal
   rates, and each step sums over cells of equal posterior. Their number is bounded by the number
   of domains and the hundredths (5,151 cells for three domains), not by the documents. Up to
   `MAX_LOCAL_CELLS` of them are summed on the driver; of more, each step brings it two numbers a
   domain. Steps and tolerance are relative to each domain, so a rare one is fitted as closely as
   a frequent one.

A rate is how often a document is read: 0 leaves it out, 2.5 reads it twice and half of the time
once more.

Nulls and odd input: a null text has no words, so its posterior is the share of the domains among
the labels, and its rate counts for nothing. Null or repeated ids stay rows. Labels with a null id
or of no document are ignored; if a document has several labels, each counts. Without any label,
the domains are equally likely. Other columns, whatever their names, are carried along, but for
those this operator adds, which it replaces. An empty table gives an empty table. If the targets
cannot be reached with nonnegative rates, the rates come as near as least squares can, with
each domain's miss relative to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import free_prefix, store, whole, words

#: Domains of the table `labels`, by SQL; the first that holds counts.
DOMAINS = {"toxic": "toxic = 1", "good": "quality = 1", "poor": "true"}
#: Tokens of each domain, as shares of the budget.
TARGETS = {"toxic": 0.0, "good": 0.95, "poor": 0.05}
BUDGET = 0.5  # of the tokens there are
MAX_LABELLED = 20_000
MAX_WORDS = 512
LEAST_EFFECT = 0.04
STEPS = 500
TOLERANCE = 1e-3  # of a domain's target; of its tokens if the target is 0
STALLED = 1e-6  # of the same, from one step to the next
PATIENCE = 5  # steps in a row that move no domain
MAX_LOCAL_CELLS = 20_000  # more are summed by Spark in each step
HUNDREDTHS = 100


def _distinct_words(text: Column) -> Column:
    """Words in lower case, and each character that is no letter, digit or space."""
    plain = F.array_distinct(
        F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+", -1), "")
    )
    marks = F.split(F.regexp_replace(whole(text), r"[\p{L}\p{N}\s]+", ""), "", -1)
    return F.concat(plain, F.array_remove(F.array_distinct(marks), ""))


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over the words that a document has and those it has not.

    `start` is the score of a document without any of the words, `weights` what each word adds.
    """

    domains: tuple[str, ...]
    start: tuple[float, ...]
    words: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]

    def describe(self, df: DataFrame, text_col: str, p: str) -> DataFrame:
        """`df` with the posterior in whole hundredths, which sum to 100, as `<p>q`.

        Each share is rounded down and the largest gets the rest. One column a step, so that
        nothing is computed more than once.
        """
        start = F.array(*[F.lit(x) for x in self.start])
        scores = start
        if self.words:
            vocabulary = F.array(*[F.lit(w) for w in self.words])
            weights = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.weights])
            scores = F.aggregate(
                F.array_intersect(_distinct_words(F.col(text_col)), vocabulary),
                start,
                lambda acc, word: F.zip_with(
                    acc,
                    F.get(weights, F.array_position(vocabulary, word).cast("int") - 1),
                    lambda a, b: a + b,
                ),
            )
        add = lambda a, b: a + b
        step = df.withColumn(f"{p}s", scores).withColumn(f"{p}best", F.array_max(f"{p}s"))
        step = step.withColumn(f"{p}w", F.transform(f"{p}s", lambda s: F.exp(s - F.col(f"{p}best"))))
        step = step.withColumn(f"{p}total", F.aggregate(f"{p}w", F.lit(0.0), add))
        step = step.withColumn(
            f"{p}low",
            F.transform(f"{p}w", lambda w: F.floor(w * HUNDREDTHS / F.col(f"{p}total")).cast("int")),
        )
        step = step.withColumns({
            f"{p}rest": HUNDREDTHS - F.aggregate(f"{p}low", F.lit(0), add),
            f"{p}top": F.array_position(f"{p}w", F.array_max(f"{p}w")).cast("int") - 1,
        })
        return step.withColumn(
            f"{p}q",
            F.transform(
                f"{p}low",
                lambda x, i: x + F.when(i == F.col(f"{p}top"), F.col(f"{p}rest")).otherwise(0),
            ),
        )


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    domains: Mapping[str, str] = DOMAINS,
    max_labelled: int = MAX_LABELLED,
    max_words: int = MAX_WORDS,
    least_effect: float = LEAST_EFFECT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Classifier:
    """Learn from labelled documents.

    A word counts if its chi-square against the domains is `least_effect` of the documents or more.
    """
    import math

    domain = F.coalesce(*[F.when(F.expr(sql), F.lit(name)) for name, sql in domains.items()])
    chosen = (
        labels.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), domain.alias("domain"))
        .where("domain is not null")
        .orderBy(F.xxhash64("id"), "id", "domain")
        .limit(max_labelled)
    )
    # at most max_labelled rows of an id and a name
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "id"
    )
    found = read.select("domain", F.explode(F.concat(F.array(F.lit("")), _distinct_words(F.col("text")))).alias("word"))
    names = tuple(domains)
    counts = store(
        found.groupBy("word").agg(
            *[F.count(F.when(F.col("domain") == n, 1)).alias(f"n{k}") for k, n in enumerate(names)]
        ),
        "word-counts",
    )
    # every document has the empty word once
    totals = counts.where("word = ''").first()
    of = [totals[f"n{k}"] if totals else 0 for k in range(len(names))]
    n = sum(of)
    prior = tuple((x + 1) / (n + len(of)) for x in of)
    if not n:
        return Classifier(names, tuple(map(math.log, prior)), (), ())
    with_word = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0))
    score = F.lit(0.0)
    for k, x in enumerate(of):
        for there, all_there in ((F.col(f"n{k}"), with_word), (x - F.col(f"n{k}"), n - with_word)):
            expected = all_there * x / n
            score += F.when(expected > 0, F.pow(there - expected, F.lit(2)) / expected).otherwise(0.0)
    best = (
        counts.where("word <> ''")
        .withColumn("score", score)
        .where(F.col("score") >= least_effect * n)
        .orderBy(F.desc("score"), "word")
        .limit(max_words)
        .collect()  # at most max_words rows
    )
    share = [[(row[f"n{k}"] + 0.5) / (x + 1) for k, x in enumerate(of)] for row in best]
    without = tuple(
        math.log(prior[k]) + sum(math.log(1 - row[k]) for row in share) for k in range(len(of))
    )
    weights = tuple(tuple(math.log(p / (1 - p)) for p in row) for row in share)
    return Classifier(names, without, tuple(row["word"] for row in best), weights)


def _rate(start: float, steps: Sequence[tuple[float, Sequence[float]]], posterior: Column) -> Column:
    """The rate after all steps, from the gradients that were added up over the documents.

    A step is (momentum, gradient of each domain, scaled): the rate moves against the gradient
    weighted by the posterior, and not below 0.
    """
    first = F.struct(F.lit(start).alias("r"), F.lit(start).alias("y"))
    if not steps:
        return first
    told = F.array(*[
        F.struct(F.lit(m).alias("m"), F.array(*[F.lit(g) for g in gradient]).alias("g"))
        for m, gradient in steps
    ])

    def move(state: Column, step: Column) -> Column:
        slope = F.aggregate(
            F.zip_with(step["g"], posterior, lambda g, q: g * q / HUNDREDTHS),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        r = F.greatest(state["y"] - slope, F.lit(0.0))
        return F.struct(r.alias("r"), (r + step["m"] * (r - state["r"])).alias("y"))

    return F.aggregate(told, first, move)


def _spark_sums(cells: DataFrame, start: float, k: int) -> Callable[[list], list[float]]:
    """Expected tokens of each domain after the steps: at the point looked ahead to, and at the rates."""
    part = lambda i: F.col("q")[i] / HUNDREDTHS

    def sums(taken: list) -> list[float]:
        state = cells.withColumn("s", _rate(start, taken, F.col("q")))
        row = state.agg(*[F.sum(F.col("n") * F.col(f"s.{c}") * part(i)) for c in "yr" for i in range(k)]).first()
        return [float(x) for x in row]

    return sums


def _local_sums(cells: list, start: float) -> Callable[[list], list[float]]:
    """The same over few cells, with the last step added to the state kept here."""
    import numpy as np

    q = np.array([row["q"] for row in cells], dtype=float) / HUNDREDTHS
    n = np.array([row["n"] for row in cells], dtype=float)
    r = y = np.full(len(n), float(start))

    def sums(taken: list) -> list[float]:
        nonlocal r, y
        if taken:
            momentum, gradient = taken[-1]
            after = np.maximum(y - q @ np.array(gradient), 0.0)
            r, y = after, after + momentum * (after - r)
        return [*map(float, (n * y) @ q), *map(float, (n * r) @ q)]

    return sums


def fit_rates(
    cells: DataFrame, targets: Sequence[float], start: float, steps: int = STEPS,
    max_local: int = MAX_LOCAL_CELLS,
) -> list[tuple[float, list[float]]]:
    """Projected gradient over cells (q: hundredths of each domain, n: tokens); the steps taken.

    Each domain counts by its own size: the gradient is scaled by the diagonal of the Gram matrix,
    and a miss is a share of the domain's target, or of its tokens if the target is 0. Momentum
    starts anew when a step leads away.
    """
    import numpy as np

    k = len(targets)
    part = lambda i: F.col("q")[i] / HUNDREDTHS
    first = cells.agg(
        F.count("*"),
        *[F.coalesce(F.sum(F.col("n") * part(i)), F.lit(0.0)) for i in range(k)],
        *[F.coalesce(F.sum(F.col("n") * part(i) * part(j)), F.lit(0.0)) for i in range(k) for j in range(k)],
    ).first()
    gram = np.array(first[1 + k :], dtype=float).reshape(k, k)
    own = np.diag(gram)
    scale = np.where(own > 0, 1 / np.where(own > 0, own, 1.0), 0.0)
    size = np.array([t if t > 0 else x for t, x in zip(targets, first[1 : 1 + k])], dtype=float)
    largest = float(np.linalg.eigvalsh(gram * np.sqrt(np.outer(scale, scale))).max())
    taken: list[tuple[float, list[float]]] = []
    if largest <= 0:
        return taken
    sums = _local_sums(cells.collect(), start) if first[0] <= max_local else _spark_sums(cells, start, k)
    momentum, t, still = 0.0, 1.0, 0
    least, before = float("inf"), None
    for _ in range(steps):
        both = np.array(sums(taken))
        ahead, off = both[:k] - targets, both[k:] - targets
        if (abs(off) <= TOLERANCE * size).all():
            break
        still = still + 1 if before is not None and (abs(off - before) <= STALLED * size).all() else 0
        if still == PATIENCE:
            break  # as near as it gets
        miss = float((off * off * scale).sum())
        if miss > least:
            t = 1.0
        least, before = miss, off
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, t = (t - 1) / after, after
        taken.append((momentum, [float(x) for x in ahead * scale / largest]))
    return taken


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domains: Mapping[str, str] = DOMAINS,
    targets: Mapping[str, float] = TARGETS,
    budget: float = BUDGET,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """`docs` with `n_tokens` (long), `p_<domain>` and `rate` (double)."""
    classifier = fit_classifier(docs, labels, domains, max_labelled, id_col=id_col, text_col=text_col)
    p = free_prefix(docs, "__m")
    names = list(domains)

    def described(df: DataFrame) -> DataFrame:
        n = F.size(words(whole(F.col(text_col))))
        return classifier.describe(df.withColumn(f"{p}n", n.cast("long")), text_col, p)

    cells = store(
        described(docs.select(text_col))
        .groupBy(F.col(f"{p}q").alias("q"))
        .agg(F.sum(f"{p}n").alias("n")),
        "cells",
    )
    tokens = cells.agg(F.sum("n")).first()[0] or 0
    wanted = [float(targets[name]) * budget * tokens for name in names]
    steps = fit_rates(cells, wanted, budget)
    own = {"n_tokens", "rate", *[f"p_{name}".lower() for name in names]}
    return described(docs).select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own],
        F.col(f"{p}n").alias("n_tokens"),
        *[(F.col(f"{p}q")[k] / HUNDREDTHS).alias(f"p_{name}") for k, name in enumerate(names)],
        _rate(budget, steps, F.col(f"{p}q"))["r"].alias("rate"),
    )
