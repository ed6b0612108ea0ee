"""Comparison of totals and of priced items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.text import item_name
from bidloom.session import is_empty, materialize


def ex_tax(total: Column, rate: Column) -> Column:
    """round(total / (1 + rate), 2); null if either is."""
    return F.round((total / (1 + rate)).cast("decimal(20,6)"), 2)


def equal_totals(totals: DataFrame, scope: str, group: str, total: str) -> DataFrame:
    """(scope, total, n_groups, n_pairs): totals, to the cent, that several groups of a scope state. Exact decimals."""
    rows = totals.select(F.col(scope).alias("scope"), F.col(group).alias("group"), F.col(total).cast("decimal(20,2)").alias("total")).where("scope is not null and group is not null and total > 0").distinct()
    return rows.groupBy("scope", "total").agg(F.count(F.lit(1)).alias("n_groups")).where("n_groups > 1").withColumn("n_pairs", F.expr("n_groups * (n_groups - 1) div 2"))


def ladders(totals: DataFrame, scope: list[str], total: str, least: int = 3) -> DataFrame:
    """(scope..., n, gap): scopes whose distinct totals, in order, all lie the same positive gap apart, to the cent."""
    rows = totals.select(*scope, F.col(total).cast("decimal(20,2)").alias("_t")).where("_t is not null").distinct()
    gaps = rows.withColumn("_g", F.col("_t") - F.lag("_t").over(Window.partitionBy(*scope).orderBy("_t")))
    summed = gaps.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.min("_g").alias("gap"), F.max("_g").alias("_most"))
    return summed.where((F.col("n") >= least) & (F.col("gap") == F.col("_most"))).select(*scope, "n", "gap")


def spreads(rows: DataFrame, by: list[str], value: str, who: str) -> DataFrame:
    """(by..., n, n_who, n_distinct, lowest, highest, spread_pct): how far the values of a group lie apart."""
    v = rows.where(F.col(value) > 0).select(*by, F.col(who).alias("_who"), F.col(value).cast("decimal(20,2)").alias("_v"))
    out = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_who").alias("n_who"), F.countDistinct("_v").alias("n_distinct"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"))
    return out.withColumn("spread_pct", F.round((F.col("highest") - F.col("lowest")) / F.col("lowest") * 100, 2))


def total_kpis(totals: DataFrame, scope: str, group: str, total: str) -> DataFrame:
    """(scope, n_bidders, n_priced, majority, lowest, highest, spread_pct, n_shared_values): of each scope how many groups
    there are and state a total, whether these are at least half, how far the totals lie apart and how many are stated
    by several groups. Exact decimals; totals of nothing or less count as none."""
    v = F.col(total).cast("decimal(20,2)")
    rows = totals.where(F.col(scope).isNotNull() & F.col(group).isNotNull()).select(F.col(scope), F.col(group).alias("_g"), F.when(v > 0, v).alias("_v")).distinct()
    known = rows.groupBy(scope).agg(F.countDistinct("_g").alias("n_bidders"), F.countDistinct(F.when(F.col("_v").isNotNull(), F.col("_g"))).alias("n_priced"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    shared = rows.where("_v is not null").groupBy(scope, "_v").agg(F.countDistinct("_g").alias("n")).where("n > 1").groupBy(scope).agg(F.count(F.lit(1)).alias("s"))
    spread = F.round((F.col("hi") - F.col("lo")).cast("double") / F.col("lo").cast("double") * 100, 2)
    return known.join(shared, scope, "left").select(scope, "n_bidders", "n_priced", (F.col("n_priced") * 2 >= F.col("n_bidders")).alias("majority"), F.col("lo").cast("double").alias("lowest"), F.col("hi").cast("double").alias("highest"), spread.alias("spread_pct"), F.coalesce("s", F.lit(0)).alias("n_shared_values"))


def sum_differences(items: DataFrame, key: str, amount: str, totals: DataFrame, total: str, tolerance: float = 0.05) -> DataFrame:
    """(key, n_items, item_sum, total, off): whether the items of a record add up to its total, within the tolerance."""
    sums = items.where(F.col(amount).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col(amount).cast("decimal(20,2)")).alias("item_sum"))
    t = totals.select(key, F.col(total).cast("decimal(20,2)").alias("total")).where("total > 0").dropDuplicates([key])
    return sums.join(t, key).withColumn("off", F.abs(F.col("item_sum") - F.col("total")) > F.col("total") * tolerance)


def plausible_items(items: DataFrame, name: str, unit_price: str, total: str, least: float = 100) -> DataFrame:
    """Items whose name is no sum, number or long sentence, whose total is not negligible and whose unit price is not
    above 1.5 times the total."""
    n = F.trim(F.col(name))
    named = n.isNotNull() & (F.length(n).between(2, 15)) & ~n.rlike(r"[0-9]{4,}|合计|总计|小计|^[-/. \t\n]+\z|税金")
    priced = (F.col(total) >= least) & (F.col(unit_price).isNull() | (F.col(unit_price) <= 1.5 * F.col(total)))
    return items.where(named & priced)


def without_echoes(items: DataFrame, key: str, amount: str, others: DataFrame, other: str, within: float = 1.0) -> DataFrame:
    """Items whose amount does not echo (lie less than ``within`` from) an amount of the same record in others."""
    o = others.select(F.col(key).alias("_k"), F.col(other).alias("_o")).where("_o is not null").distinct()
    return items.join(o, (F.col(key) == F.col("_k")) & (F.abs(F.col(amount) - F.col("_o")) < within), "left_anti")


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def substrings(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def alike_pairs(forms: DataFrame, least: float = 0.55, common: int | None = 6) -> DataFrame:
    """(scope, id1, id2, jaccard), id1 < id2, of names (scope, id, form) of one scope that are alike: by the pairs of
    characters they consist of, or by ``common`` successive characters in common.

    Only the rarest pairs of a name are joined on, as many as two names with that similarity must share one of; so a
    pair of characters that all names have ("费用") joins nothing. Names of fewer than four characters are alike none.
    """
    rows = forms.where(F.length("form") >= 4).select("scope", "id", "form", bigrams(F.col("form")).alias("grams"))
    rows = rows.withColumn("n", F.size("grams"))
    each = rows.select("scope", "id", "n", F.explode("grams").alias("g"))
    counted = each.join(each.groupBy("g").agg(F.count(F.lit(1)).alias("f")), "g")
    rarest = counted.groupBy("scope", "id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("l"))
    keep = F.col("n") - F.ceil(F.col("n") * least) + 1
    keys = rarest.select("scope", "id", F.explode(F.slice("l", F.lit(1), keep.cast("int"))).alias("x")).select("scope", "id", F.col("x.g").alias("k"))
    if common:
        keys = keys.unionByName(rows.select("scope", "id", F.explode(substrings(F.col("form"), common)).alias("k")))
    a, b = keys.withColumnRenamed("id", "id1"), keys.withColumnRenamed("id", "id2")
    met = a.join(b, ["scope", "k"]).where("id1 < id2").select("scope", "id1", "id2").distinct()
    x = rows.select("scope", F.col("id").alias("id1"), F.col("grams").alias("g1"), F.col("form").alias("f1"))
    y = rows.select("scope", F.col("id").alias("id2"), F.col("grams").alias("g2"), F.col("form").alias("f2"))
    both = met.join(x, ["scope", "id1"]).join(y, ["scope", "id2"])
    shared = F.size(F.array_intersect("g1", "g2"))
    scored = both.withColumn("jaccard", shared / (F.size("g1") + F.size("g2") - shared))
    run = F.size(F.array_intersect(substrings(F.col("f1"), common), substrings(F.col("f2"), common))) > 0 if common else F.lit(False)
    return scored.where((F.col("jaccard") >= least) | run).select("scope", "id1", "id2", "jaccard")


def similar_names(names: DataFrame, name_id: str, name: str, least: float = 0.55) -> DataFrame:
    """(id1, id2, jaccard), id1 < id2: names of one list that are alike."""
    forms = names.select(F.lit(1).alias("scope"), F.col(name_id).alias("id"), item_name(F.col(name)).alias("form")).distinct()
    return alike_pairs(forms, least, None).select("id1", "id2", "jaccard")


def item_clusters(items: DataFrame, scope: str, item_id: str, name: str, most_rounds: int = 100) -> DataFrame:
    """(scope, cluster, item_id): items of a scope around the first item, by id, that no cluster has yet; a cluster is
    named by that item.

    Not transitive: an item belongs to the first cluster whose first item it is like. This is the order-dependent
    greedy clustering, computed in rounds over the pairs that are alike: a name whose smaller neighbours all belong to
    clusters of others begins a cluster, a name with a neighbour that begins one belongs to it. Few rounds suffice and
    no task ever holds a whole scope. Items without a name are left out; unlike names are clusters of their own.
    """
    rows = items.select(F.col(scope).alias("scope"), F.col(item_id).alias("item_id"), item_name(F.col(name)).alias("form")).where("scope is not null and form <> ''").distinct()
    forms = materialize(rows.groupBy("scope", "form").agg(F.min("item_id").alias("id")).withColumn("g", F.xxhash64("form")))
    once = forms.select(F.lit(0).alias("scope"), F.col("g").alias("id"), "form").distinct()  # a name is compared once, not once a scope
    alike = materialize(alike_pairs(once).select(F.col("id1").alias("g1"), F.col("id2").alias("g2")))
    a, b = forms.select("scope", F.col("g").alias("g1"), F.col("id").alias("a")), forms.select("scope", F.col("g").alias("g2"), F.col("id").alias("b"))
    edges = materialize(alike.join(a, "g1").join(b, ["scope", "g2"]).select("scope", F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2")))
    left = edges.select("scope", F.col("id2").alias("id")).unionByName(edges.select("scope", F.col("id1").alias("id"))).distinct()
    open_edges, firsts = edges, None
    for _ in range(most_rounds):
        new = materialize(left.join(open_edges.select("scope", F.col("id2").alias("id")), ["scope", "id"], "left_anti"))
        firsts = new if firsts is None else firsts.unionByName(new)
        taken = open_edges.join(new.withColumnRenamed("id", "id1"), ["scope", "id1"], "left_semi").select("scope", F.col("id2").alias("id"))
        left = materialize(left.join(new.unionByName(taken).distinct(), ["scope", "id"], "left_anti"))
        if is_empty(left):
            break
        open_edges = open_edges.join(left.withColumnRenamed("id", "id1"), ["scope", "id1"], "left_semi").join(left.withColumnRenamed("id", "id2"), ["scope", "id2"], "left_semi")
    else:
        raise RuntimeError(f"items are left after {most_rounds} rounds")
    around = edges.join(firsts.withColumnRenamed("id", "id1"), ["scope", "id1"], "left_semi").groupBy("scope", F.col("id2").alias("id")).agg(F.min("id1").alias("cluster"))
    around = around.join(firsts, ["scope", "id"], "left_anti")
    named = forms.join(around, ["scope", "id"], "left").select("scope", "form", F.coalesce("cluster", "id").alias("cluster"))
    return rows.join(named, ["scope", "form"]).select("scope", "cluster", "item_id")
