"""The whole comparison of a set of bids, as named DataFrames; the segments are found at once, since all that follows rests
on them, the rest when it is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions.contacts import extracted_contacts
from bidloom.functions.names import FAMILY
from bidloom.functions.rules import is_template, reason_tags, risk_level, substantiality
from bidloom.operators import findings, items, layout, pairs, people, quotes, segments, summaries
from bidloom.session import materialize


@dataclass
class Analysis:
    """texts (group, text), contacts (group, kind, value), shared (pairs of groups and what they share), people, prices,
    items (what the texts state), found (common segments and near-duplicate paragraphs with origin, level, score and tags),
    counts (per pair), totals (one row over all segments), findings, headings, projects."""

    texts: DataFrame
    contacts: DataFrame
    shared: DataFrame
    people: DataFrame
    prices: DataFrame
    items: DataFrame
    found: DataFrame
    near: DataFrame
    counts: DataFrame
    totals: DataFrame
    findings: DataFrame
    headings: DataFrame
    projects: DataFrame


def analyze(files: DataFrame, references: DataFrame | None = None, least: int = 15, comparisons: DataFrame | None = None, records: DataFrame | None = None, family: str = FAMILY) -> Analysis:
    """files: (group, ord, text), the volumes of each bidder, and (scope) if they are of several tenders; references:
    (text), tender documents whose wording and contacts are not the bidders' own; comparisons: (left, right), the pairs of
    groups to compare; records: (group, properties...) of the bidders' files.

    Without comparisons those pairs are compared that can have a segment in common, found by a join on grams. With
    references the values found in them are removed whatever their frequency, without them the values of at least four
    fifths of three or more bidders of a scope.
    """
    files = files if "scope" in files.columns else files.withColumn("scope", F.lit(""))
    texts = summaries.volumes_joined(files, "group", ["ord"], "text").select("group", "text")
    scopes = files.groupBy("group").agg(F.min("scope").alias("scope"))
    contacts = extracted_contacts(texts, "group", "text")
    if references is not None:
        own = extracted_contacts(references.select(F.lit("reference").alias("group"), "text"), "group", "text")
        contacts = pairs.without(contacts, own, ["kind", "value"])
    else:
        scoped = contacts.join(scopes, "group").withColumnRenamed("scope", "_scope")
        common = pairs.frequent_everywhere(scoped, F.col("_scope")).select(F.col("scope").alias("_scope"), "kind", "value")
        contacts = scoped.join(common, ["_scope", "kind", "value"], "left_anti").select("group", "kind", "value")
    if comparisons is None:
        comparisons = segments.candidate_pairs(texts, "group", "text", least)
    compared = segments.compared_pairs(comparisons, texts, "group", "text")
    found = materialize(segments.segments_of_pairs(compared, least).withColumn("ratio", F.lit(None).cast("double")))
    near = materialize(segments.near_paragraphs(comparisons, texts, "group", "text"))
    found = levels(found, near, references, texts.join(scopes, "group"), scopes)
    counts = summaries.pair_counts(found.withColumn("pair", F.struct("left", "right")), "pair", "risk_level", "abnormal").select("pair.*", "total", "n_abnormal", "n_template", "n_substantial", "n_suspicious")
    origins = [F.count_if(F.col("origin") == o).alias(f"n_{o}") for o in ("reference", "rule", "global", "own", "near")]
    totals = found.agg(F.count(F.lit(1)).alias("total"), F.count_if("abnormal").alias("n_abnormal"), *origins)
    staff = people.extracted_people(texts, "group", "text", family)
    persons = staff.where("field = 'person'").select("group", "value", "role")
    parts = [findings.contact_findings(contacts), findings.person_findings(persons), findings.mixing_findings(texts, "group", "text", staff.where("field = 'company'").select("group", "value"))]
    if records is not None:
        reps = staff.where("field = 'authorized_rep'").select("group", "value")
        equal = findings.property_matches(records, "group")
        parts += [findings.representative_findings(reps, records), equal.select(F.lit("metadata").alias("dimension"), F.col("kind").alias("type"), "left", "right", "value", "severity")]
    prices = quotes.extracted_prices(texts, "group", "text")
    parts.append(findings.total_findings(prices.join(scopes, "group").select("scope", "group", F.col("in_tax").alias("value"))))
    lines = layout.lines(texts, "group", "text")
    return Analysis(
        texts=texts,
        contacts=contacts,
        shared=pairs.sharing_pairs(contacts),
        people=staff,
        prices=prices,
        items=items.line_items(texts, "group", "text"),
        found=found,
        near=near,
        counts=counts,
        totals=totals,
        findings=findings.all_findings(*parts),
        headings=layout.headings(texts, "group", "text"),
        projects=layout.voted(layout.project_names(lines, "group"), "group", F.col("candidate")),
    )


def levels(found: DataFrame, near: DataFrame, references: DataFrame | None, texts: DataFrame, scopes: DataFrame) -> DataFrame:
    """found with origin, template, score, risk_level, reasons, abnormal, and the near-duplicate paragraphs as rows of it.

    The first that holds gives a segment's origin: it stands in a reference, it is template wording by rule, it is part of
    what half of a scope's bidders have (three bidders or more), else it is the bidders' own and its score decides. A
    near-duplicate paragraph is substantial, its score at least 0.6 and its ratio.
    """
    if references is not None:
        known = segments.contained_in(found, "segment", "segment", references, "text").distinct()
        found = found.join(known.withColumn("in_reference", F.lit(True)), "segment", "left")
    else:
        found = found.withColumn("in_reference", F.lit(False))
    windows = segments.template_windows(texts, "scope", "group", "text").where("n_all >= 3").select("scope", "form")
    scoped = found.join(scopes.withColumnRenamed("group", "left"), "left").withColumn("_id", F.struct("scope", "segment"))
    held = segments.in_template(scoped.select("_id", "scope", "segment").distinct(), "_id", "scope", "segment", windows).withColumn("in_template", F.lit(True))
    found = scoped.join(held, "_id", "left").drop("_id", "scope")
    rule = is_template(F.col("segment"))
    origin = F.when(F.coalesce("in_reference", F.lit(False)), "reference").when(rule, "rule").when(F.coalesce("in_template", F.lit(False)), "global").otherwise("own")
    found = found.withColumn("origin", origin).withColumn("template", F.col("origin") != "own").withColumn("score", substantiality(F.col("segment"))).drop("in_reference", "in_template")
    found = found.withColumn("risk_level", risk_level(F.col("template"), F.col("score")))
    alike = near.select("left", "right", F.lit(0).alias("pos1"), F.lit(0).alias("pos2"), F.length("paragraph1").alias("length"), F.col("paragraph1").alias("segment"), F.col("paragraph1").alias("ctx1"), F.col("paragraph2").alias("ctx2"), "ratio")
    alike = alike.withColumn("origin", F.lit("near")).withColumn("template", F.lit(False)).withColumn("score", F.greatest(F.lit(0.6), F.col("ratio"))).withColumn("risk_level", F.lit("substantial"))
    every = found.unionByName(alike)
    return every.withColumn("reasons", reason_tags(F.col("segment"), F.col("template"))).withColumn("abnormal", F.col("risk_level") != "template")


def report(analysis: Analysis, most: int = 30) -> str:
    """A short report in Markdown of the pairs, what they share and their most substantial segments. Only its first
    ``most`` rows of each part leave the cluster."""
    out = ["# Comparison of bids", ""]
    rank = findings.severity_rank(F.col("severity"))
    for title, df in (
        ("Pairs", analysis.counts.orderBy(F.desc("n_substantial"), F.desc("total"), "left", "right")),
        ("Findings", findings.first_pairs(analysis.findings).orderBy(rank, "dimension", "type", "left", "right", "value")),
        ("Severities", findings.severity_counts(analysis.findings).orderBy("dimension")),
        ("Shared contacts", analysis.shared.orderBy("kind", "left", "right", "value")),
        ("Prices", analysis.prices.select("group", "in_tax", "ex_tax", "tax_rate", "quoted_rate", F.array_join("warnings", "; ").alias("warnings")).orderBy("group")),
        ("Segments", analysis.found.where("abnormal and origin = 'own'").orderBy(F.desc("score"), F.desc("length")).select("left", "right", "length", F.round("score", 3).alias("score"), F.substring("segment", 1, 80).alias("segment"))),
        ("Near-duplicate paragraphs", analysis.near.orderBy(F.desc("ratio")).select("left", "right", "ratio", F.substring("paragraph1", 1, 80).alias("paragraph1"))),
    ):
        rows = df.limit(most).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "/").replace("\n", " ") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
