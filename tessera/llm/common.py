"""Helpers that the corpus operators share: table access, written cuts of a plan, word hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import batches_of, settle  # noqa: F401

#: Characters that part words, as a regular expression class for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of any name can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def word_list(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, parted by the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, alike in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Odd multipliers, one for each place in a shingle.
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word shingles in order; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(size, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            total += words[k : n - width + 1 + k] * _PLACE[k]
    return mix64(total)


def md5_key(*parts: Column) -> Column:
    """A reproducible random key of its parts (nulls count as the word null)."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
