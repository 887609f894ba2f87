"""Fill-in-middle: documents cut into prefix, middle and suffix and rearranged around sentinels, in SQL functions alone.

A text is an array of units (a run of letters, or one other character). Hexadecimal groups of a hash of the document's id
give the cuts and the form, so the result depends on neither partitions nor order. Slices of the array are joined into the
arrangement; a text that holds a sentinel stays as it is, so that splitting at sentinels always restores what was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"


def _number(digest: str, group: int) -> Column:
    """The group-th eight hexadecimal digits of a digest, as a number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output for each row of ``docs``.

    A null text is empty; an empty one and one that holds a sentinel are plain, as are ``plain_percent`` of the others;
    ``spm_percent`` of what is left has the suffix first. A null doc_id is hashed as an empty string. Texts are cut whole
    whatever their length; repeated rows are cut each, alike if their ids are; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = (
        only(docs, "doc_id", "text")
        .select("doc_id", text.alias("text"), digest.alias("h"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"))
        .withColumn("n", F.size("units").cast("long"))
        .withColumn("a", _number("h", 0) % (F.col("n") + 1))
        .withColumn("b", _number("h", 1) % (F.col("n") + 1))
    )
    plain = (F.col("n") == 0) | F.col("text").rlike(SENTINEL) | (_number("h", 2) % 100 >= 100 - plain_percent)
    low, high = F.least("a", "b").cast("int"), F.greatest("a", "b").cast("int")
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = cut.select(
        "doc_id", "n", F.when(plain, "plain").when(_number("h", 3) % 100 < spm_percent, "spm").otherwise("psm").alias("form"), "text",
        part(F.lit(1), low).alias("p"), part(low + 1, high - low).alias("m"), part(high + 1, F.col("n").cast("int") - high).alias("s"),
    )
    is_plain = F.col("form") == "plain"
    return parts.select(
        "doc_id", "n", "form",
        F.when(~is_plain, F.length("p")).cast("long").alias("prefix_chars"), F.when(~is_plain, F.length("m")).cast("long").alias("middle_chars"),
        F.when(is_plain, F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m"))
        .otherwise(F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made of: it is split at its sentinels."""
    p = F.split(output, SENTINEL)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``transform``, the text restored from output and form."""
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    return transform(docs).select(*columns, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u FROM documents
), c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
  FROM d
), p AS (
  SELECT doc_id, text, n, CASE WHEN n = 0 OR regexp_matches(text, '{SENTINEL}') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1:n], '') AS suf
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
