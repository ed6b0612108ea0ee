"""Summaries of comparisons: counts by condition, pivots, timelines, lightened records, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(c: Column) -> Column:
    """A risk level in its one spelling; null if it is none."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("substantial", "suspicious", "template"), s)


def pair_counts(segments: DataFrame, pair: str, risk: str, abnormal: str) -> DataFrame:
    """(pair, total, n_abnormal, n_template, n_substantial, n_suspicious) in one aggregation."""
    of = level(F.col(risk))
    return segments.groupBy(pair).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(abnormal)).alias("n_abnormal"),
        *[F.count_if(of == x).alias(f"n_{x}") for x in ("template", "substantial", "suspicious")],
    )


def by_level(segments: DataFrame, pair: str, risk: str, order: list[Column], most: int) -> DataFrame:
    """The first segments of each pair by severity of level, then by the given order, with their rank."""
    severity = F.when(level(F.col(risk)) == "substantial", 0).when(level(F.col(risk)) == "suspicious", 1).when(level(F.col(risk)) == "template", 2).otherwise(3)
    return segments.withColumn("severity", severity).withColumn("rank", F.row_number().over(Window.partitionBy(pair).orderBy("severity", *order))).where(F.col("rank") <= most)


def timeline(runs: DataFrame, at: str, value: str, high: float) -> DataFrame:
    """(day, n, average, n_high) of each day; runs without a time have none."""
    return runs.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("average"), F.count_if(F.col(value) >= high).alias("n_high"))


def totals(runs: DataFrame, value: str, steps: list[float]) -> DataFrame:
    """One row: number, mean, maximum, share in percent of the highest bin and a histogram by the given steps; nulls count
    apart."""
    edges = [float("-inf"), *steps, float("inf")]
    bins = [F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(f"bin_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    top = F.round(F.count_if(F.col(value) >= edges[-2]) * 100.0 / F.count(F.col(value)), 4)
    return runs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_null"), F.round(F.avg(value), 4).alias("average"), F.max(value).alias("highest"), top.alias("highest_pct"), *bins)


def pivot(rows: DataFrame, by: str, across: str, names: list[str], value: Column) -> DataFrame:
    """One row a ``by``, a column a name, and how many of them have a value and whether all that have it agree."""
    cells = rows.groupBy(by).pivot(across, names).agg(value)
    each = F.array(*[F.col(f"`{n}`") for n in names])
    known = F.filter(each, lambda x: x.isNotNull())
    return cells.withColumn("n_values", F.size(known)).withColumn("same_all", F.size(F.array_distinct(known)) <= 1)


def agreement(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n_values, same_all): how many rows of a group state a value, and whether all that do state the same; a
    group of one value or none agrees."""
    v = F.when(F.trim(value) != "", F.col(value))
    return rows.groupBy(*by).agg(F.count(v).alias("n_values"), (F.countDistinct(v) <= 1).alias("same_all"))


def lightened(pairs: DataFrame, matches: str, longest: int = 200) -> DataFrame:
    """Records for storage: the texts of their matches cut to ``longest`` characters and what stands around them to
    twice as many, everything else as it is."""
    fields = pairs.schema[matches].dataType.elementType.names
    limits = {"text": longest, "ctx1": 2 * longest, "ctx2": 2 * longest}

    def cut(m: Column) -> Column:
        for name, most in limits.items():
            if name in fields:
                m = m.withField(name, F.substring(m.getField(name), 1, most))
        return m

    return pairs.withColumn(matches, F.transform(matches, cut))


def cache_keys(files: DataFrame, content: str, settings: str) -> DataFrame:
    """files with ``cache_key``: the digest of a file's content and of the settings it is read with; null for empty
    content, which is never kept."""
    key = F.sha2(F.concat(F.col(content).cast("binary"), F.lit("\x00" + settings).cast("binary")), 256)
    return files.withColumn("cache_key", F.when(F.length(content) > 0, key))


def least_recent(entries: DataFrame, used: str, key: str, most: int) -> DataFrame:
    """The entries beyond the ``most`` latest used, which a cache of that size drops.

    The time of the last entry kept is found by a top-k, so no task sorts all entries.
    """
    rows = entries.where(F.col(used).isNotNull())
    kept = rows.orderBy(F.desc(used), F.desc(key)).limit(most).select(key)
    return rows.join(kept, key, "left_anti")


def volumes_joined(files: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """(group, n_volumes, text): the texts of a group's files put together in order, a line end between them."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("n_volumes"), F.array_join(F.transform(parts, lambda x: x.getField("_t")), "\n").alias(text))


def coverage(files: DataFrame, kind: Column, text: str, error: str) -> DataFrame:
    """(kind, n_files, n_error, n_empty, n_chars): how much of each kind of file was read."""
    return files.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col(error).isNotNull()).alias("n_error"),
        F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("n_empty"),
        F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("n_chars"),
    )
