"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document. The ledger keeps, per document, what was measured and
one bit per failed rule; a policy is a versioned mask of bits. Changing a policy, comparing two of
them, or asking what a rule costs reads the ledger only, never the texts.

Nulls and odd input: a null or empty text has no words and fails `few_words`. A null id stays a
row with a null id. Repeated rows give repeated rows. Other columns, whatever their names, are
ignored by `ledger` and carried along by `keep_good`. An empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import free_prefix, lines, where_computed, whole, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule with its bit; `fails` is SQL over the measurements."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: Bits are never given to another rule, so that ledgers of different age can be read together.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count: a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        by_name = {rule.name: rule.mask for rule in RULES}
        return sum(by_name[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
FULL = Policy("full-1", tuple(rule.name for rule in RULES))


def _measured(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """`docs` with the measurements as columns, their names prefixed.

    Windows of three words are found twice by sorting: each window is one number, its hash above
    and its position below, so equal windows become neighbours. Neighbours with equal hashes are
    compared word by word. No step is worse than n log n in the words of a text.
    """
    p = prefix
    step = docs.withColumn(f"{p}text", whole(F.col(text)))
    step = step.withColumns({
        f"{p}w": words(F.col(f"{p}text")),
        f"{p}lines": lines(F.col(f"{p}text")),
    })
    step = step.withColumns({
        f"{p}n_words": F.size(f"{p}w").cast("long"),
        f"{p}word_chars": F.length(F.array_join(f"{p}w", "")).cast("long"),
        f"{p}n_symbols": F.when(
            F.col(f"{p}text").rlike(SYMBOLS),
            F.length(f"{p}text") - F.length(F.regexp_replace(f"{p}text", SYMBOLS, "")),
        ).otherwise(0).cast("long"),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": (
            F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))
        ).cast("long"),
        # as many low bits as the largest position needs
        f"{p}bits": F.length(F.bin(F.size(f"{p}w").cast("long"))),
    })
    step = step.withColumn(
        f"{p}sorted",
        F.expr(
            f"sort_array(transform(slice({p}w, 1, greatest(size({p}w) - 2, 0)), (x, i) ->"
            f" shiftleft(xxhash64(x, get({p}w, i + 1), get({p}w, i + 2)), {p}bits)"
            f" | cast(i as bigint)))"
        ),
    )
    step = step.withColumn(
        f"{p}at",
        F.expr(f"transform({p}sorted, x -> cast(x & (shiftleft(1L, {p}bits) - 1) as int))"),
    )

    def same(other: str) -> str:
        return (
            f"(shiftright(get({p}sorted, {other}), {p}bits) = shiftright(x, {p}bits)"
            + "".join(
                f" and get({p}w, get({p}at, i) + {k}) = get({p}w, get({p}at, {other}) + {k})"
                for k in range(3)
            )
            + ")"
        )

    step = step.withColumn(
        f"{p}twice",
        F.expr(
            f"filter({p}sorted, (x, i) -> coalesce({same('i - 1')}, false)"
            f" or coalesce({same('i + 1')}, false))"
        ),
    )
    covered = (
        f"size(array_distinct(flatten(transform({p}twice, x -> transform(array(0, 1, 2),"
        f" k -> (x & (shiftleft(1L, {p}bits) - 1)) + k)))))"
    )
    return step.withColumn(f"{p}n_repeat_words", F.expr(covered).cast("long"))


def _failed(prefix: str, rules: Iterable[Rule] = RULES) -> Column:
    """Failure bits of the rules, over prefixed measurements."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        fails = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{prefix}\1`", rule.fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(rule.mask)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, every measurement, and `failed`, the bits of failed rules."""
    step = _measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "q_")
    return step.select(
        F.col("id").alias(id_col),
        *[F.col(f"q_{m}").alias(m) for m in MEASURES],
        _failed("q_").alias("failed"),
    )


def fails(policy: Policy, failed: str | Column = "failed") -> Column:
    column = F.col(failed) if isinstance(failed, str) else failed
    return column.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def verdicts(rows: DataFrame, policies: Iterable[Policy]) -> DataFrame:
    """The ledger with a boolean `kept_<version>` for each policy."""
    return rows.withColumns({f"kept_{p.version}": ~fails(p) for p in policies})


def ablations(rows: DataFrame, policies: Iterable[Policy]) -> DataFrame:
    """What each rule of each policy decides: (policy, rule, n_failing, n_only_rule, n_kept, n_kept_without).

    Documents are first counted by their failure bits, on the map side, so at most two to the
    number of rules rows go on, however many documents there are.
    """
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p.version, p.mask, r.name, r.mask) for p in policies for r in RULES if p.mask & r.mask]
    named = F.array(*[
        F.struct(
            F.lit(version).alias("policy"), F.lit(mask).cast("long").alias("mask"),
            F.lit(rule).alias("rule"), F.lit(bit).cast("long").alias("bit"),
        )
        for version, mask, rule, bit in cases
    ])
    seen = F.col("failed").bitwiseAND(F.col("c.mask"))
    rest = F.col("failed").bitwiseAND(F.col("c.mask").bitwiseXOR(F.col("c.bit")))
    total = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
    return (
        counts.select("failed", "n", F.explode(named).alias("c"))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            total(F.col("failed").bitwiseAND(F.col("c.bit")) != 0, "n_failing"),
            total(seen == F.col("c.bit"), "n_only_rule"),
            total(seen == 0, "n_kept"),
            total(rest == 0, "n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = FULL, text_col: str = "text") -> DataFrame:
    """The documents that fail no rule of the policy, with the columns they came with."""
    prefix = free_prefix(docs, "__q")
    step = _measured(docs, text_col, prefix)
    judged = step.withColumn(f"{prefix}failed", _failed(prefix))
    kept = where_computed(judged, ~fails(policy, f"{prefix}failed"), f"{prefix}row")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
