"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A text of at most `CHUNK` characters is encoded in one task. A longer one is cut into chunks that
overlap, which are dealt out over the cluster and encoded with offsets. Two neighbours are spliced
in their overlap, at the first place that follows a white space character. There the tokens of
both sides cannot depend on each other: the tokenizer drops white space before it merges, it does
not normalise across it, and no special token contains any. The splice also has to be seen: both
chunks must have the same tokens, at the same offsets, from there to the last such place in the
overlap. Where no place is found or the tokens differ, the overlap of that document is widened and
it is encoded again; after the last widening it is encoded as a whole.

Nulls and odd input: a null text counts as empty, which has no tokens. Null ids and repeated rows
keep their rows; equal huge texts are encoded once. Other columns, whatever their names, are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollway.llm.columns import store, whole

CHUNK = 32_768  # characters
OVERLAPS = (256, 4_096, 65_536)  # characters, one round after the other
TEXTS = 256  # handled at once
KNOWN_WORDS = 500_000  # kept by a task

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_CHUNK_SCHEMA = "key string, nr int, last boolean, left string, right string, n bigint"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def counts(texts: list[str], path: str, known: dict[bytes, int] | None = None) -> list[int]:
    """Tokens of each text.

    Every white space character is a stable boundary (see above), so the tokens of a text are
    those of its words, and each distinct word is encoded once. `known` keeps their counts.
    """
    known = {} if known is None else known
    out: list[int] = []
    for first in range(0, len(texts), TEXTS):
        # split() of bytes knows no white space but these six characters
        words = [text.encode().split() for text in texts[first : first + TEXTS]]
        new = list(set().union(*words).difference(known))
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = list(set().union(*words))
        encoded = tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        known.update(zip(new, map(len, encoded)))
        out += [sum(map(known.__getitem__, w)) for w in words]
    return out


def splice_places(text: str, start: int, end: int) -> list[int]:
    """First and last place in [start, end] that follows white space; none, one or two."""
    places = [m.end() for m in _SPACE.finditer(text, start, end)]
    return places[:1] + places[-1:] if len(places) > 1 else places


def chunk_row(text: str, nr: int, overlap: int, last: bool, path: str) -> tuple:
    """What the neighbours of a chunk need: (last, left, right, tokens between the splices).

    `left` and `right` tell the place and the tokens of the overlap, relative to its start; they
    are null where there is no place.
    """
    encoded = tokenizer(path).encode(text, add_special_tokens=False)
    spans = list(zip(encoded.offsets, encoded.ids))

    def told(start: int) -> tuple[str | None, int]:
        places = splice_places(text, start, min(start + overlap, len(text)))
        if not places:
            return None, start
        first, end = places[0], places[-1]
        seen = [(a - start, b - start, i) for (a, b), i in spans if a >= first and b <= end]
        return f"{first - start} {end - start} {seen}", first

    left, begin = (None, 0) if nr == 0 else told(0)
    right, end = (None, len(text)) if last else told(CHUNK)
    return last, left, right, sum(a >= begin and b <= end for (a, b), _ in spans)


def _count_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            n = pa.array(counts(batch.column(2).to_pylist(), path, known), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n"])

    return run


def _cut(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = -(-len(text) // CHUNK)
                # a last chunk within the overlap of the one before is no chunk of its own
                if n > 1 and len(text) - (n - 1) * CHUNK <= overlap:
                    n -= 1
                for nr in range(n):
                    end = len(text) if nr == n - 1 else (nr + 1) * CHUNK + overlap
                    yield pa.RecordBatch.from_pylist(
                        [{"key": key, "nr": nr, "last": nr == n - 1, "text": text[nr * CHUNK : end]}],
                        pa.schema([("key", pa.string()), ("nr", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]),
                    )

    return run


def _encode(overlap: int, path: str):
    schema = pa.schema([
        ("key", pa.string()), ("nr", pa.int32()), ("last", pa.bool_()), ("left", pa.string()),
        ("right", pa.string()), ("n", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (r["key"], r["nr"], *chunk_row(r["text"], r["nr"], overlap, r["last"], path))
                for r in batch.to_pylist()
            ]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _count_huge(texts: DataFrame, path: str, overlaps: tuple[int, ...]) -> DataFrame:
    """(key, n) for distinct huge texts (key, text)."""
    done = None
    for overlap in overlaps:
        chunks = (
            texts.mapInArrow(_cut(overlap), "key string, nr int, last boolean, text string")
            .repartition("key", "nr")
            .mapInArrow(_encode(overlap, path), _CHUNK_SCHEMA)
        )
        order = Window.partitionBy("key").orderBy("nr")
        joined = chunks.withColumn("next", F.lead("left").over(order)).withColumn(
            "fits", F.col("last") | F.coalesce(F.col("right") == F.col("next"), F.lit(False))
        )
        summed = store(
            joined.groupBy("key").agg(F.sum("n").alias("n"), F.min("fits").alias("fits")), "spliced"
        )
        good = summed.where("fits").select("key", "n")
        done = good if done is None else done.unionAll(good)
        failed = summed.where("not fits").select("key")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "key", "left_semi")
    rest = texts.select(F.col("key").alias("id"), F.lit(0).cast("bigint").alias("n_bytes"), "text")
    rest = rest.mapInArrow(_count_whole(path), "id string, n_bytes bigint, n bigint")
    return done.unionAll(rest.select("id", "n"))


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    overlaps: tuple[int, ...] = OVERLAPS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, with the tokenizers file at `path`."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).select(
        "id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text"
    )
    is_huge = F.char_length("text") > CHUNK
    short = rows.where(~is_huge).mapInArrow(
        _count_whole(path), f"id {kind}, n_bytes bigint, n bigint"
    )
    huge = rows.where(is_huge).withColumn("key", F.sha2("text", 256))
    texts = store(huge.select("key", "text").dropDuplicates(["key"]), "huge-texts")
    found = _count_huge(texts, path, overlaps)
    long = huge.select("id", "n_bytes", "key").join(found, "key").select("id", "n_bytes", "n")
    return short.unionAll(long).select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.col("n").alias("n_tokens"),
        (F.col("n") > limit).alias("over_limit"),
    )
