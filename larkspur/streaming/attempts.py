"""Retailers' lifetime figures over a stream of attempts: merged batch by batch, so that neither a replayed batch nor a repeated attempt counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.learning import KEEP_ATTEMPTS, attempt_kinds

LOG = "domain string, run string, wid string, kind string, ts timestamp"
TOTALS = "domain string, found_total bigint, first_try timestamp, last_found timestamp, last_try timestamp"


def merge_attempts(log: DataFrame, totals: DataFrame, batch: DataFrame, keep: int = KEEP_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(log, totals) after a batch of attempts (domain, wid, run, outcome, n_listings, ts).

    log: LOG, the last attempt of each run and item, the `keep` newest of a retailer
    by (ts, run, wid). totals: TOTALS; found_total counts the runs and items whose
    last attempt found something, also those that have left the log. An attempt not
    newer than the logged one of its run and item is a replay, and so is one older
    than all that a full log holds, as it would leave at once. Attempts that say
    nothing, or have no time or domain, are ignored; null runs and items are keys.

    The state is `keep` rows a retailer. A batch is reduced to a row for each retailer,
    run and item in partial sums, and the cut keeps `keep` rows a task before it shuffles.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    new = attempt_kinds(batch).where("ts IS NOT NULL").select("domain", text("run").alias("run"), text("wid").alias("wid"), "kind", F.col("ts").cast("timestamp").alias("ts"))
    new = new.groupBy("domain", "run", "wid").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.max("ts").alias("ts"), F.min("ts").alias("_since"), F.max(F.when(F.col("kind") == "found", F.col("ts"))).alias("_found"))
    oldest = log.groupBy("domain").agg(F.count(F.lit(1)).alias("_held"), F.min(F.struct("ts", "run", "wid")).alias("_oldest"))
    held = log.select("domain", "run", "wid", F.col("kind").alias("_kind"), F.col("ts").alias("_ts"))
    both = held.join(new, ["domain", "run", "wid"], "full").join(oldest, "domain", "left")
    late = F.col("_ts").isNull() & (F.coalesce("_held", F.lit(0)) >= keep) & (F.struct("ts", "run", "wid") < F.col("_oldest"))
    takes = F.col("ts").isNotNull() & ~late & (F.col("_ts").isNull() | (F.struct("ts", "kind") > F.struct("_ts", "_kind")))
    both = both.withColumn("_takes", F.coalesce(takes, F.lit(False))).where(F.col("_takes") | F.col("_ts").isNotNull())
    step = lambda c: F.when(F.col(c) == "found", 1).otherwise(0)
    change = both.where("_takes").groupBy("domain").agg(F.sum(step("kind") - step("_kind")).alias("_change"), F.min("_since").alias("_first"), F.max("_found").alias("_last_found"), F.max("ts").alias("_last"))
    after = totals.join(change, "domain", "full").select(
        "domain", (F.coalesce("found_total", F.lit(0)) + F.coalesce("_change", F.lit(0))).cast("bigint").alias("found_total"),
        F.least("first_try", "_first").alias("first_try"), F.greatest("last_found", "_last_found").alias("last_found"), F.greatest("last_try", "_last").alias("last_try"),
    )
    rows = both.select("domain", "run", "wid", F.when(F.col("_takes"), F.col("kind")).otherwise(F.col("_kind")).alias("kind"), F.when(F.col("_takes"), F.col("ts")).otherwise(F.col("_ts")).alias("ts"))
    newest = Window.partitionBy("domain").orderBy(F.desc("ts"), F.desc("run"), F.desc("wid"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n"), after


class LifetimeYield:
    """Log and totals in a shared folder, for `writeStream.foreachBatch(LifetimeYield(folder).record)`.

    The state after a batch is written beside that before it, into one of two places
    in turn, and each says of which batch it is. So a batch that is run again, after
    its executors or the driver were lost, starts from the same state as the first
    time. One query writes a folder; batches come in order, as a query numbers them.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _read(self, spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        df = spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{batch_id % 2}/{name}")
        if not df.where(F.col("batch") != batch_id).isEmpty():
            raise ValueError(f"{self.folder} doesn't hold the state after batch {batch_id}: another query has written it, or a checkpoint was lost")
        return df.drop("batch")

    def state(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(log, totals) after a batch."""
        return self._read(spark, "log", LOG, batch_id), self._read(spark, "totals", TOTALS, batch_id)

    def record(self, batch: DataFrame, batch_id: int) -> None:
        before = self.state(batch.sparkSession, batch_id - 1)
        batch = batch.persist()
        try:
            for name, df in zip(("log", "totals"), merge_attempts(*before, batch)):
                df.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/{batch_id % 2}/{name}")
        finally:
            batch.unpersist()
