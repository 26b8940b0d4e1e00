"""Hashes of word shingles as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import SPACE

WORDS = 5


def with_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns `keep`, and hashes of the text's words between ASCII white space as _words; none for a null or blank text."""
    words = F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", r"[\x20\x09-\x0D]+"))
    trimmed = df.select(*keep, F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)).alias("_trimmed"))
    return trimmed.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_words"))


def shingle_hashes(column: str, n: int = WORDS) -> Column:
    """64-bit hashes of all runs of `n` hashed words in the array column; of fewer words, one of them all; of none, none.

    `column` must be a column of its own in the frame below: as it stands here several times, Spark then keeps it apart
    instead of splitting the text again for every shingle.
    """
    run = ", ".join(f"{column}[i + {k}]" for k in range(n))
    many = f"transform(sequence(0, size({column}) - {n}), i -> xxhash64({run}))"
    return F.expr(f"CASE WHEN size({column}) >= {n} THEN {many} WHEN size({column}) > 0 THEN array(xxhash64({column})) ELSE CAST(array() AS array<bigint>) END")
