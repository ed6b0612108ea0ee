"""Reading and writing of what an analysis leaves: history, cached texts, progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators.summaries import lightened

ID = "^[A-Za-z0-9_-]+$"


def write_history(pairs: DataFrame, folder: str, at: str) -> None:
    """Append compared pairs, lightened, partitioned by the day of ``at``."""
    lightened(pairs, "matches").withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(folder)


def read_history(spark: SparkSession, folder: str, schema: str, key: str | None = None) -> DataFrame:
    """All entries that fit the schema; entries that cannot be parsed are skipped. With ``key`` only those whose
    identifier is the name of their file."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    if key is None:
        return rows
    return rows.where(F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "") == F.col(key).cast("string"))


def history_entry(history: DataFrame, key: str, value: str) -> DataFrame:
    """The entry of an identifier; identifiers with other than letters, figures, lines and underscores have none."""
    return history.where((F.col(key).cast("string") == F.lit(value)) & F.lit(value).rlike(ID))


def delete_history(spark: SparkSession, folder: str, schema: str, key: str, value: str) -> None:
    """Removes an entry: the days that hold it are written anew without it, other days are not touched."""
    held = read_history(spark, folder, f"{schema}, day date")
    days = [r[0] for r in history_entry(held, key, value).select("day").distinct().collect()]  # the days of one entry
    from bidloom.session import materialize

    for day in days:
        rest = materialize(held.where((F.col("day") == F.lit(day)) & (F.col(key).cast("string") != F.lit(value))).drop("day"))
        rest.write.mode("overwrite").json(f"{folder}/day={day}")


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose content and settings (``cache_key``) no cached text answers for."""
    return files.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def cached_texts(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with the text that is cached for their content, wherever the same bytes were met before."""
    return files.join(cache.select("cache_key", "text").where("text <> ''").dropDuplicates(["cache_key"]), "cache_key")


def write_events(events: DataFrame, folder: str) -> None:
    """Progress events as JSON lines."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)
