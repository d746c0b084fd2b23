"""Secret scans over a ledger of blobs.

Every version of every file is addressed by the SHA-256 of its text. The ledger, a folder of
Parquet files, holds for each scanned blob the rule versions it was scanned with and the spans
found. A run scans only the pairs of blob and rule version that the ledger does not have, appends
them in one write, and joins the spans back to every path that has the blob. So copies are scanned
once, unchanged files never again, and a changed rule only runs by itself.

Positions come from the pieces between matches: a match starts after all pieces and matches before
it, which is a running sum within the blob. The rows of a blob are no more than its matches.

Nulls and odd input: a null text is the empty blob. A null path stays a row. Repeated rows stay
repeated. Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tollway.llm.columns import whole
from tollway.sources.workdir import new_folder

LEDGER_SCHEMA = (
    "blob binary, rules array<string>, spans array<struct<rule:string, start:int, end:int>>"
)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost first; those with a short `group` do not count.

    `hint` is a string that every match contains, to pass over most texts quickly.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_length: int = 0
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns. `(?i)` folds only ASCII letters. A run of 16 hex digits or more is the same
#: match whether runs are found first and short ones dropped, or long ones are looked for.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    # few words, since the engine's stack grows with the times a group repeats
    Rule(
        "private_key",
        2,
        r"-----BEGIN (?:[A-Z]{1,20} ){0,8}PRIVATE KEY-----",
        hint="PRIVATE KEY-----",
    ),
    # only at the start of a run of its letters, and nothing given back: each run is read a few times
    Rule(
        "web_token",
        2,
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
        hint="eyJ",
    ),
)
RULES = BASE_RULES + MORE_RULES


def address(text: Column) -> Column:
    return F.unhex(F.sha2(whole(text), 256))


def _hits(rule: Rule) -> Column:
    """Array of (rule, i, gap, length, value): each match with the length of the text before it."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(
        F.transform(pieces, F.length).alias("gap"),
        F.transform(found, F.length).alias("length"),
        F.transform(value, F.length).alias("value"),
    )
    # the last piece has no match after it
    hits = F.transform(
        F.slice(zipped, 1, F.size(found)),
        lambda x, i: F.struct(
            F.lit(rule.kind).alias("rule"), i.alias("i"), x["gap"].alias("gap"),
            x["length"].alias("length"), x["value"].alias("value"),
        ),
    )
    due = F.array_contains("pending", rule.name) & text.rlike(rule.pattern)
    if rule.hint:
        due = text.contains(rule.hint) & due
    return F.when(due, hits).otherwise(
        F.array().cast("array<struct<rule:string,i:int,gap:int,length:int,value:int>>")
    )


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for blobs with the names of `pending` rules."""
    matches = blobs.select(
        "blob", "pending", F.explode_outer(F.concat(*[_hits(r) for r in rules])).alias("m")
    ).select("blob", "pending", "m.*")
    running = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ends = matches.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(running).cast("int"))
    enough = F.lit(False)
    for rule in rules:
        enough |= (F.col("rule") == rule.kind) & (F.col("value") >= rule.min_length)
    span = F.struct("rule", (F.col("end") - F.col("length")).alias("start"), "end")
    return ends.groupBy("blob").agg(
        F.first("pending").alias("rules"),
        F.collect_list(F.when(enough, span)).alias("spans"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`; empty if nothing was written there yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(
    texts: DataFrame, path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Scan what is new in `texts`, append it to the ledger at `path`, and read that back."""
    spark = texts.sparkSession
    text = whole(F.col(text_col))
    blobs = texts.select(address(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    names = F.array(*[F.lit(rule.name) for rule in rules])
    known = read_ledger(spark, path)
    if not known.isEmpty():
        done = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn(
            "pending", F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
        )
    else:
        blobs = blobs.withColumn("pending", names)
    _scan(blobs.where(F.size("pending") > 0), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def scan(
    versions: DataFrame,
    ledger: str | None = None,
    path_col: str = "path",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """(path, spans) for every row of `versions`; spans are (rule, start, end), sorted by start.

    Offsets are code points, ends exclusive. Without a `ledger` a new one is begun in the shared
    folder. At one start, spans are in the order of `rules`.
    """
    ledger = ledger or new_folder(versions.sparkSession, "blob-ledger")
    known = update_ledger(versions, ledger, text_col, rules)
    order = F.array(*[F.lit(rule.kind) for rule in rules])
    current = F.array(*[F.lit(rule.name) for rule in rules])
    # spans of an older version of a rule stay in the ledger and are not told
    kinds = F.transform(F.array_intersect("rules", current), lambda n: F.split_part(n, F.lit("@"), F.lit(1)))
    found = (
        known.select("blob", F.filter("spans", lambda s: F.array_contains(kinds, s["rule"])).alias("s"))
        .where(F.size("s") > 0)
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("s")).alias("s"))
    )
    ordered = F.array_sort(
        F.transform(
            "s",
            lambda s: F.struct(
                s["start"].alias("start"), F.array_position(order, s["rule"]).alias("nr"),
                s["end"].alias("end"), s["rule"].alias("rule"),
            ),
        )
    )
    spans = F.transform(ordered, lambda s: F.struct(s["rule"], s["start"], s["end"]))
    paths = versions.select(F.col(path_col).alias("p"), address(F.col(text_col)).alias("blob"))
    return paths.join(found.select("blob", spans.alias("spans")), "blob", "left").select(
        F.col("p").alias(path_col),
        F.coalesce("spans", F.array().cast("array<struct<rule:string,start:int,end:int>>")).alias(
            "spans"
        ),
    )


def as_text(spans: Column) -> Column:
    """Spans as `kind:start:end`, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
