"""Pairwise comparison of groups as joins on what they share, never on all pairs.

A value that very many groups share says nothing about two of them and would make a quadratic join; it is reported with
its number of groups, and pairs are formed for values of up to ``most_groups`` groups only where the caller asks for
pairs. Nothing is lost: ``shared_values`` has every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy_pools(records: DataFrame, group: str, pools: dict[str, str]) -> DataFrame:
    """(group, kind, value) once each, from array columns; pools maps a column to its kind. Nulls and blanks give none."""

    def values(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = [values(column, kind) for column, kind in pools.items()]
    rows = records.select(F.col(group).alias("group"), F.explode(F.concat(*each)).alias("x")).select("group", "x.kind", "x.value")
    return rows.where("group is not null and trim(value) <> ''").distinct()


def tidy_fields(records: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, kind, value) from scalar columns, without nulls and empty values."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).cast("string").alias("value")) for f in fields]))
    return records.select(F.col(group).alias("group"), each.alias("x")).select("group", "x.*").where("group is not null and value is not null and trim(value) <> ''").distinct()


def shared_values(tidy: DataFrame, least: int = 2) -> DataFrame:
    """(kind, value, n_groups, first_group, last_group) of values in at least ``least`` groups."""
    return (
        tidy.groupBy("kind", "value")
        .agg(F.countDistinct("group").alias("n_groups"), F.min("group").alias("first_group"), F.max("group").alias("last_group"))
        .where(F.col("n_groups") >= least)
    )


def sharing_pairs(tidy: DataFrame, most_groups: int | None = None) -> DataFrame:
    """(left, right, kind, value), left < right: pairs of groups that share a value.

    Values of one group are removed before the join. With ``most_groups`` the values of more groups are left to
    ``shared_values``.
    """
    n = shared_values(tidy).where(F.lit(True) if most_groups is None else F.col("n_groups") <= most_groups).select("kind", "value")
    kept = tidy.join(n, ["kind", "value"], "left_semi")
    other = kept.select("kind", "value", F.col("group").alias("right"))
    return kept.withColumnRenamed("group", "left").join(other, ["kind", "value"]).where("left < right").select("left", "right", "kind", "value")


def linked_groups(tidy: DataFrame, most_groups: int) -> DataFrame:
    """(left, right, kind, value, n_groups): every link between groups that share a value, in two forms. Values of up to
    ``most_groups`` groups give all pairs, left < right. A value of more gives its class: one row for each of its groups,
    left being the first of them. Whoever follows links reaches the same groups either way, at every size."""
    n = shared_values(tidy).select("kind", "value", "n_groups", "first_group")
    small, large = n.where(F.col("n_groups") <= most_groups), n.where(F.col("n_groups") > most_groups)
    kept = tidy.join(small, ["kind", "value"])
    between = kept.withColumnRenamed("group", "left").join(kept.select("kind", "value", F.col("group").alias("right")), ["kind", "value"]).where("left < right").select("left", "right", "kind", "value", "n_groups")
    star = tidy.join(large, ["kind", "value"]).where(F.col("group") != F.col("first_group")).select(F.col("first_group").alias("left"), F.col("group").alias("right"), "kind", "value", "n_groups")
    return between.unionByName(star)


def cross_attribute_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, value): groups where one's attribute is the other's other attribute; both sides (group, value)."""
    a, b = left.select(F.col("group").alias("left"), "value").distinct(), right.select(F.col("group").alias("right"), "value").distinct()
    return a.join(b, "value").where("left <> right").select("left", "right", "value")


def frequent_everywhere(tidy: DataFrame, scope: Column, least_groups: int = 3, ratio: float = 0.8) -> DataFrame:
    """(scope, kind, value, n_groups, n_all): values that at least ``ratio`` of a scope's groups have, and at least
    ``least_groups`` of them: the tender's own data, printed in every bid."""
    scoped = tidy.withColumn("scope", scope).where("scope is not null")
    everyone = scoped.groupBy("scope").agg(F.countDistinct("group").alias("n_all"))
    return scoped.groupBy("scope", "kind", "value").agg(F.countDistinct("group").alias("n_groups")).join(everyone, "scope").where((F.col("n_groups") >= least_groups) & (F.col("n_groups") >= ratio * F.col("n_all")))


def without(tidy: DataFrame, removed: DataFrame, on: list[str]) -> DataFrame:
    """tidy without the values in removed."""
    return tidy.join(removed.select(*on).distinct(), on, "left_anti")


def overlap_rates(sets: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """(left, right, n_left, n_right, n_shared, rate) of given pairs; sets: (group, value). The rate is that of the
    smaller set; pairs where a set has fewer than ``least`` members are left out."""
    once = sets.where("group is not null and value is not null").distinct()
    size = once.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    p = pairs.select("left", "right").where("left is not null and right is not null").distinct()
    p = p.join(size.select(F.col("group").alias("left"), F.col("n").alias("n_left")), "left").join(size.select(F.col("group").alias("right"), F.col("n").alias("n_right")), "right")
    a = p.select("left", "right").join(once.withColumnRenamed("group", "left"), "left")
    both = a.join(once.withColumnRenamed("group", "right"), ["right", "value"]).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n_shared"))
    joined = p.join(both, ["left", "right"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return joined.withColumn("rate", F.col("n_shared") / F.least("n_left", "n_right"))


def pair_numbers(groups: DataFrame, scope: str, group: str) -> DataFrame:
    """(scope, n_groups, n_unordered, n_ordered): how many pairs of groups a scope has; they need not be enumerated."""
    n = groups.where(F.col(scope).isNotNull() & F.col(group).isNotNull()).groupBy(scope).agg(F.countDistinct(group).alias("n_groups"))
    return n.withColumn("n_unordered", F.expr("n_groups * (n_groups - 1) div 2")).withColumn("n_ordered", F.expr("n_groups * (n_groups - 1)"))


def first_known(rows: DataFrame, group: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row a group: of each field the first value, in the given order, that is neither null nor empty."""
    each = [F.min(F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.struct(*[F.col(o) for o in order], F.col(f).alias("x")))).getField("x").alias(f) for f in fields]
    return rows.groupBy(group).agg(*each)


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name_id: str, name: str, most_names: int = 100_000, most_chars: int = 4_000_000) -> DataFrame:
    """(key, name_id): texts that contain a name. Names within both bounds are sent out as one automaton; more are joined
    by their first characters with every place of a text, so no number of names is too large."""
    import pandas as pd

    once = names.select(name_id, name).where(F.length(name) > 0).distinct()
    size = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(name)), F.lit(0)).alias("c"), F.min(F.length(name)).alias("shortest")).first()
    if size["n"] > most_names or size["c"] > most_chars:
        from bidloom.operators.segments import containments

        found = containments(once.select(F.col(name_id).alias("id"), F.col(name).alias("form")), texts.select(F.col(key).alias("id"), F.col(text).alias("form")), int(size["shortest"]))
        return found.select(F.col("hay").alias(key), F.col("needle").alias(name_id))
    rows = [(r[0], r[1]) for r in once.collect()]  # within both bounds
    shared = texts.sparkSession.sparkContext.broadcast(rows)
    made: dict[int, object] = {}

    def find(batches):  # noqa: ANN001, ANN202
        import ahocorasick

        if 0 not in made:
            automaton = ahocorasick.Automaton()
            at: dict[str, list] = {}
            for i, n in shared.value:
                at.setdefault(n, []).append(i)
            for n, ids in at.items():
                automaton.add_word(n, ids)
            automaton.make_automaton()
            made[0] = automaton if at else None
        for batch in batches:
            out = [(k, i) for k, t in zip(batch["k"], batch["t"], strict=True) for i in (sorted({i for _, ids in made[0].iter(t) for i in ids}) if made[0] else ())]
            yield pd.DataFrame(out, columns=[key, name_id])

    schema = f"{key} {dict(texts.dtypes)[key]}, {name_id} {dict(names.dtypes)[name_id]}"
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(find, schema)


def ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in the given order, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
