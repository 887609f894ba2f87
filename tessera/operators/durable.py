"""Tables that are kept by month and changed in place by numbered batches, each of which counts once.

A change rewrites the months that it touches and no other: Spark's dynamic partition overwrite writes the new files beside
the table and moves them in when the job commits. Each row tells the last batch that changed it, and a log the batches
that are done. A batch that is run again, whole or after it stopped between its rows and its log entry, leaves rows that it has
changed already as they are; so even changes that add up are applied once.

A row stays in the month that it came with, whatever time a change gives it, so a key is in one month. Columns ``_batch``, ``_live`` and
``_month`` belong to the table. Batches are applied one after the other, with growing numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import settle

OWN = ("_batch", "_live", "_month")
#: Months that one batch may touch: their names are the only thing that comes to the driver.
MOST_MONTHS = 2_400


def month(ts: Column) -> Column:
    """The partition of a time; a missing one has a partition of its own."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("none"))


class MonthTable:
    """A table below ``path``, with unique keys in ``key`` and the time that gives a new row its month in ``ts``."""

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str):
        self.spark, self.path, self.key, self.ts = spark, path.rstrip("/"), key, ts

    def create(self, rows: DataFrame) -> MonthTable:
        """Begin the table with ``rows`` in place of any there was, and an empty log."""
        begun = rows.withColumns({"_batch": F.lit(-1).cast("long"), "_live": F.lit(True), "_month": month(F.col(self.ts))})
        begun.hint("rebalance", "_month").write.mode("overwrite").partitionBy("_month").parquet(f"{self.path}/rows")
        begun.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        self.spark.range(0).select(F.col("id").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/log")
        return self

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """The rows that the table holds."""
        return self._all().filter("_live").drop(*OWN)

    def done(self, batch: int) -> bool:
        """Whether the log names the batch."""
        return bool(self.spark.read.parquet(f"{self.path}/log").filter(F.col("batch") == batch).take(1))

    def _rewrite(self, batch: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace the touched months (a column _month) by what ``change`` makes of their rows, and log the batch."""
        months = [r[0] for r in touched.select("_month").distinct().limit(MOST_MONTHS + 1).collect()]
        if len(months) > MOST_MONTHS:
            raise ValueError(f"batch {batch} touches more than {MOST_MONTHS} months")
        if months:
            rows = settle(change(self._all().filter(F.col("_month").isin(months))), f"batch_{batch}")
            # a month without a row would keep its files, so one dead row stays in it
            dead = rows.filter("NOT _live").groupBy("_month").agg(F.min_by(F.struct(*rows.columns), F.struct(self.key)).alias("r")).select("r.*")
            kept = rows.filter("_live").unionByName(dead).hint("rebalance", "_month")
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_month").parquet(f"{self.path}/rows")
        self._log(batch)
        return True

    def _log(self, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.path}/log")

    def upsert(self, batch: int, changes: DataFrame, merge: dict[str, Callable[[Column, Column], Column]] | None = None, insert_only: bool = False) -> bool:
        """Apply ``changes`` (the table's columns or some of them, key and time among them; keys unique) and tell whether
        that was still to be done.

        A new key is inserted, missing columns null. Of a known one the columns of ``changes`` are replaced, or become
        ``merge[column](old, new)``; with ``insert_only`` it stays as it is. A null key is a key."""
        if self.done(batch):
            return False
        columns = self._all().drop(*OWN).columns
        given = [c for c in changes.columns if c in columns]
        new = settle(changes.select(*given), f"changes_{batch}")
        old, key = self._all(), self.key
        known = old.select(F.col(key).alias("_key"), F.col("_month").alias("_at"), F.col("_live").alias("_had"))  # no other column is read
        placed = new.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_month", F.coalesce("_at", month(F.col(self.ts))))
        placed = settle(placed.select(F.struct(*[F.col(c) for c in given]).alias("_new"), F.col("_month").alias("_to"), F.coalesce("_had", F.lit(False)).alias("_known")), f"placed_{batch}")
        placed = placed.filter("NOT _known") if insert_only else placed

        def change(rows: DataFrame) -> DataFrame:
            both = rows.join(placed, F.col(key).eqNullSafe(F.col(f"_new.{key}")), "full_outer")
            there, said = F.col("_batch").isNotNull(), F.col("_new").isNotNull()
            live = F.coalesce(F.col("_live"), F.lit(False))
            takes = said & (F.col("_batch").isNull() | (F.col("_batch") < batch))

            def value(c: str) -> Column:
                if c not in given:
                    return F.when(takes & ~live, F.lit(None)).otherwise(F.col(c))
                fresh = F.col(f"_new.{c}")
                merged = merge[c](F.col(c), fresh) if merge and c in merge else fresh
                return F.when(takes, F.when(live, merged).otherwise(fresh)).otherwise(F.col(c))

            kinds = dict(rows.dtypes)
            return both.select(
                *[value(c).cast(kinds[c]).alias(c) for c in columns], F.when(takes, F.lit(batch)).otherwise(F.col("_batch")).cast("long").alias("_batch"),
                F.when(takes, F.lit(True)).otherwise(live).alias("_live"), F.when(there, F.col("_month")).otherwise(F.col("_to")).alias("_month"),
            )

        return self._rewrite(batch, placed.select(F.col("_to").alias("_month")), change)

    def _where(self, batch: int, condition: Column) -> Column:
        return F.col("_live") & (F.col("_batch") < batch) & F.coalesce(condition, F.lit(False))

    def update(self, batch: int, condition: Column, values: dict[str, Column]) -> bool:
        """New values in the rows where the condition holds (null: it doesn't)."""
        if self.done(batch):
            return False
        hit = self._where(batch, condition)

        def change(rows: DataFrame) -> DataFrame:
            kinds = dict(rows.dtypes)
            marked = rows.withColumn("_hit", hit)
            new = {c: F.when(F.col("_hit"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}
            return marked.withColumns(new | {"_batch": F.when(F.col("_hit"), F.lit(batch).cast("long")).otherwise(F.col("_batch"))}).drop("_hit")

        return self._rewrite(batch, self._all().filter(hit), change)

    def delete(self, batch: int, condition: Column) -> bool:
        """Take out the rows where the condition holds."""
        if self.done(batch):
            return False
        hit = self._where(batch, condition)
        return self._rewrite(batch, self._all().filter(hit), lambda rows: rows.withColumn("_live", F.col("_live") & ~hit))


def follow(stream: DataFrame, table: MonthTable, checkpoint: str, changes: Callable[[DataFrame], DataFrame], merge: dict[str, Callable[[Column, Column], Column]] | None = None) -> None:
    """Apply what ``changes`` makes of each micro-batch of ``stream`` to the table, once, until nothing is left to read.

    The number of a micro-batch is that of its batch. Started again with the same checkpoint, the stream repeats the batch that did
    not end under its old number."""

    def step(rows: DataFrame, number: int) -> None:
        table.upsert(number, changes(rows), merge)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
