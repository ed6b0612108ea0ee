"""What the comparison of bidders finds, as one tidy table: properties of files that agree, people and contacts in common,
representatives who made another's file, companies named in another's text, equal and evenly spaced totals.

A finding is (dimension, type, left, right, value, severity). Pairs come from equi-joins on what is shared. Each finding is
kept for every pair; ``first_pairs`` gives the shorter list with one pair for each thing that is shared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.pairs import cross_attribute_pairs, mentions, overlap_rates, shared_values, sharing_pairs, tidy_fields
from bidloom.session import materialize

# Properties that are compared, with their labels, and names of programs that stand in place of people.
PROPERTIES = {
    "creator": "创建者", "last_modified_by": "最后保存者", "application": "编辑程序", "template": "模板",
    "KSOProductBuildVer": "WPS版本号", "KSOTemplateDocerSaveRecord": "WPS保存记录(硬件ID+用户ID)", "ICV": "ICV",
}
SOFTWARE = r"(?i)Microsoft.{0,2}(Word|Office|Excel|PowerPoint|Windows)|\bWPS\b|Kingsoft|金山(WPS|Office|软件|办公|文档|文字|表格|演示)|Adobe[® \t]|LibreOffice|OpenOffice|Apple[ \t]+(Pages|Numbers|Keynote)|iText|pdf *kit|wkhtmltopdf|FPDF|TCPDF|Aspose\.|Spire\.|打印机|Printer|Scanner|Foxit|Nitro[ \t]+PDF|Ghostscript|®|™"
DEFAULT_TEMPLATES = ("normal.dotm", "normal.dot", "default", "默认")
NAMED_BY_PEOPLE = ("application", "last_modified_by", "creator")
GRAVE_PROPERTIES = ("KSOTemplateDocerSaveRecord", "last_modified_by")
SEVERITIES = ("critical", "high", "medium", "info")


def is_software(c: Column) -> Column:
    """Whether a property names a program instead of a person; null is none."""
    return F.coalesce(c.rlike(SOFTWARE), F.lit(False))


def is_default_template(field: Column, value: Column) -> Column:
    """Properties that very many files have by themselves: no value, a default template, a bare version number."""
    v = F.trim(value)
    return F.coalesce(v, F.lit("")).isin("") | F.lower(v).isin(*DEFAULT_TEMPLATES) | (field.isin("KSOProductBuildVer", "WPS版本号") & v.rlike(r"^[0-9.-]+$"))


def severity_rank(c: Column) -> Column:
    return reduce(lambda other, s: F.when(c == s[1], s[0]).otherwise(other), reversed(list(enumerate(SEVERITIES))), F.lit(len(SEVERITIES)))


def property_matches(records: DataFrame, group: str, fields: dict[str, str] = PROPERTIES) -> DataFrame:
    """(left, right, kind, value, severity, counts): properties that two groups have in common. Names of programs are
    "info"; ``counts`` is false for defaults, which say nothing by themselves. Nulls and empty values match nothing."""
    met = sharing_pairs(tidy_fields(records, group, [f for f in fields if f in records.columns]))
    program = F.col("kind").isin(*NAMED_BY_PEOPLE) & is_software(F.col("value"))
    severity = F.when(program, "info").when(F.col("kind").isin(*GRAVE_PROPERTIES), "high").otherwise("medium")
    return met.withColumn("severity", severity).withColumn("counts", ~program & ~is_default_template(F.col("kind"), F.col("value")))


def _finding(rows: DataFrame, dimension: str, kind: Column | str, severity: Column | str) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(dimension).alias("dimension"), as_column(kind).alias("type"), F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right"), F.col("value").cast("string").alias("value"), as_column(severity).alias("severity"))


def representative_findings(people: DataFrame, records: DataFrame) -> DataFrame:
    """Findings about representatives; people: (group, value) of authorised representatives, records: (group, creator,
    last_modified_by). A representative who made another's file (both ways), two groups with one representative, two
    groups whose files one person saved last; programs do not count as people."""
    reps = people.select("group", "value").where("value <> ''").distinct()
    creators = records.select("group", F.col("creator").alias("value")).where("value <> ''").distinct()
    savers = records.select("group", F.lit("saver").alias("kind"), F.col("last_modified_by").alias("value")).where("value <> ''").distinct()
    made = _finding(cross_attribute_pairs(reps, creators), "people", "authorized_rep_is_creator", "high")
    same = sharing_pairs(reps.select("group", F.lit("rep").alias("kind"), "value")).where(~is_software(F.col("value")))
    saved = sharing_pairs(savers)
    return made.unionByName(_finding(same, "people", "same_authorized_rep", "high")).unionByName(_finding(saved, "people", "same_last_modifier", F.when(is_software(F.col("value")), "info").otherwise("high")))


def person_findings(people: DataFrame) -> DataFrame:
    """Findings about people in two groups; people: (group, value, role). The same role is graver than another."""
    tidy = people.where("value <> ''").select("group", F.lit("person").alias("kind"), "value", F.coalesce("role", F.lit("")).alias("role")).distinct()
    names = sharing_pairs(tidy.select("group", "kind", "value").distinct())
    l, r = tidy.select(F.col("group").alias("left"), "value", F.col("role").alias("r1")), tidy.select(F.col("group").alias("right"), "value", F.col("role").alias("r2"))
    both = names.join(l, ["left", "value"]).join(r, ["right", "value"]).groupBy("left", "right", "value").agg(F.max(F.col("r1") == F.col("r2")).alias("same"))
    return _finding(both, "people", F.when(F.col("same"), "same_person_same_role").otherwise("same_person"), F.when(F.col("same"), "high").otherwise("medium"))


def contact_findings(contacts: DataFrame) -> DataFrame:
    """Findings about contacts in two groups; contacts: (group, kind, value)."""
    return _finding(sharing_pairs(contacts), "contacts", F.concat(F.lit("same_"), F.col("kind")), "high")


def overlap_findings(people: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of groups that share at least ``least`` of the people of the one with fewer; people: (group, value)."""
    rates = overlap_rates(people.select("group", "value"), pairs).where(F.col("rate") >= least)
    return _finding(rates.withColumn("value", F.concat_ws("/", "n_shared", F.least("n_left", "n_right"))), "people", "people_overlap", "medium")


def mixing_findings(texts: DataFrame, group: str, text: str, companies: DataFrame, shortest: int = 6) -> DataFrame:
    """A company's name in another bidder's text; companies: (group, value). Names of fewer than ``shortest`` characters
    and the bidder's own name are none."""
    names = companies.select(F.trim("value").alias("name"), F.col("group").alias("right")).where(F.length("name") >= shortest).distinct()
    found = mentions(texts.select(F.col(group).alias("left"), text), "left", text, names.select("name").distinct().withColumn("value", F.col("name")), "name", "value")
    own = names.select(F.col("right").alias("left"), "name").distinct()
    other = found.distinct().join(own, ["left", "name"], "left_anti").join(names, "name").where("left <> right")
    return _finding(other.withColumnRenamed("name", "value"), "mixing", "company_in_other_text", "high")


def total_findings(totals: DataFrame) -> DataFrame:
    """Equal totals of two groups of one scope; totals: (scope, group, value)."""
    rows = totals.select("scope", "group", F.col("value").cast("decimal(20,2)").alias("value")).where("scope is not null and value > 0").distinct()
    tidy = rows.select("group", F.col("scope").cast("string").alias("kind"), F.col("value").cast("string").alias("value"))
    return _finding(sharing_pairs(tidy), "price", "equal_total", "high")


def all_findings(*parts: DataFrame) -> DataFrame:
    """One table of findings, each finding once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def first_pairs(findings: DataFrame) -> DataFrame:
    """Of each thing that is shared (dimension, type, value) the first pair only, and how many pairs share it. People are
    kept by pair, since two bidders may share several."""
    by_pair = F.when(F.col("type").isin("same_person", "same_person_same_role", "people_overlap", "company_in_other_text"), F.concat_ws("|", "left", "right")).otherwise("")
    keyed = findings.withColumn("_p", by_pair)
    first = F.min(F.struct("left", "right", "severity")).alias("f")
    return keyed.groupBy("dimension", "type", "value", "_p").agg(first, F.count(F.lit(1)).alias("n_pairs")).select("dimension", "type", "f.left", "f.right", "value", "f.severity", "n_pairs")


def severity_counts(findings: DataFrame) -> DataFrame:
    """(dimension, n, n_critical, n_high, n_medium, n_info) and a row "all" of the sums."""
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]]
    each = findings.groupBy("dimension").agg(*counts)
    return each.unionByName(findings.agg(*counts).select(F.lit("all").alias("dimension"), "*"))


def shared_rows(tidy: DataFrame) -> DataFrame:
    """(kind_order, place, kind, value, n_groups): values in several groups, by kind and then by how many groups share them.

    Places are given without a task that holds a whole kind: the rows are sorted into ranges, numbered in each, and the
    numbers of rows of the ranges before are added.
    """
    kinds = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "phone", 1).when(F.col("kind") == "id_number", 2).when(F.col("kind") == "email", 3).otherwise(4)
    order = [F.desc("n_groups"), F.col("value")]
    ranges = materialize(shared_values(tidy).select(kinds.alias("kind_order"), "kind", "value", "n_groups").orderBy("kind_order", "kind", *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranges.groupBy("kind", "_p").agg(F.count(F.lit(1)).alias("_n"))  # at most one row a kind and range
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("kind").orderBy("_p")) - F.col("_n")).select("kind", "_p", "_before")
    numbered = ranges.withColumn("_k", F.row_number().over(Window.partitionBy("kind", "_p").orderBy(*order)))
    return numbered.join(before, ["kind", "_p"]).select("kind_order", (F.col("_k") + F.col("_before")).alias("place"), "kind", "value", "n_groups")


def report_name(project: Column, level: Column, at: Column, title: str = "投标文件比对报告") -> Column:
    """The name of a report file: title, project, level and time, each part left out if there is none; characters that
    file systems do not take are away and a part has at most 40."""

    def part(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|\x00-\x1f]", ""), "[  　]+", " ")
        bare = F.substring(F.regexp_replace(bare, r"^[. ]+|[. ]+\z", ""), 1, 40)
        return F.when(bare != "", F.trim(bare))

    return F.concat(F.concat_ws("_", F.lit(title), part(project), part(level), F.date_format(at, "yyyyMMdd_HHmmss")), F.lit(".docx"))
