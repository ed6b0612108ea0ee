"""New files compared as they come: a file stream, each batch against what is stored, results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidloom.operators.pairs import tidy_pools

POOLS = {"phones": "phone", "id_numbers": "id_number", "emails": "email", "bank_accounts": "bank_account"}


def new_links(batch: DataFrame, stored: DataFrame, pools: dict[str, str] = POOLS) -> DataFrame:
    """(left, right, kind, value), left < right: what groups share where at least one has it from the batch. Only what
    is new is joined with the rest, so links among stored records are not formed again."""
    fresh, old = tidy_pools(batch, "bid_group", pools), tidy_pools(stored, "bid_group", pools)
    kept = old.join(fresh.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    every = fresh.unionByName(kept).distinct().withColumnRenamed("group", "_g")
    met = fresh.join(every, ["kind", "value"]).where(F.col("group") != F.col("_g"))
    return met.select(F.least("group", "_g").alias("left"), F.greatest("group", "_g").alias("right"), "kind", "value").distinct()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def contact_stream(spark: SparkSession, incoming: str, stored: str, links: str, checkpoint: str, schema: str, pools: dict[str, str] = POOLS, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Personnel files that arrive in ``incoming``: their links to all earlier ones go to ``links``, they themselves to
    ``stored``. A batch that is run again replaces what it wrote, by its number. ``prepare`` adds what further pools need."""

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        once = batch.dropDuplicates(["person_id"])
        before = once.limit(0).withColumn("_batch", F.lit(0))
        if _exists(session, stored):  # any failure to read what is there must fail the batch, or its links are lost
            before = session.read.schema(f"{schema}, _batch int").parquet(stored).where(F.col("_batch") != number)
        ready = prepare or (lambda df: df)
        new_links(ready(once), ready(before), pools).write.mode("overwrite").parquet(f"{links}/_batch={number}")
        once.write.mode("overwrite").parquet(f"{stored}/_batch={number}")

    return spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, kind, n) of events by window, for a stream (late events within ``late`` count) as for a table."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", width).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
