"""Order-sensitive operators on lines: table regions, filled-down cells, wrapped rows, sections, headings, project names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How headings begin.
HEADING = r"(?i)^[ \t]*(?:第[一二三四五六七八九十0-9]+[章节篇部分]|[一二三四五六七八九十]+[、，.]|[0-9]+(?:\.[0-9]+)+|[0-9]+[. \t]+|[（(][0-9]+[）)]|[（(][A-F][）)]|Section[ \t]+[0-9]+|Appendix[ \t]+[A-F]?|附录[ \t]*[A-F0-9]*)[ \t]*."


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the lines of each text, from 0; null texts have none."""
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def islands(rows: DataFrame, by: list[str], order: list[str], inside: Column, name: str = "island") -> DataFrame:
    """The rows for which ``inside`` holds, with the number of their run of such rows (from 1, in order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")
    return flagged.withColumn("_start", starts).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in").drop("_in", "_start")


def pipe_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, region, line_no, row_no, cells): rows of tables written with bars, by region of successive rows; row 1 of
    a region is its header."""
    rows = islands(lines(texts, key, text), [key], ["line_no"], F.contains(F.col("line"), F.lit(" | ")), "region")
    number = F.row_number().over(Window.partitionBy(key, "region").orderBy("line_no"))
    return rows.select(key, "region", "line_no", number.alias("row_no"), F.split("line", r"[ \t]*\|[ \t]*").alias("cells"))


def cell_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, region, row_no, header, value): each cell of the rows below the header with the header of its column."""
    header = rows.where("row_no = 1").select(key, "region", F.col("cells").alias("names"))
    body = rows.where("row_no > 1").select(key, "region", "row_no", F.posexplode("cells").alias("i", "value"))
    return body.join(header, [key, "region"]).select(key, "region", "row_no", F.trim(F.get("names", F.col("i"))).alias("header"), F.trim("value").alias("value")).where("header is not null and header <> ''")


def filled_down(rows: DataFrame, by: list[str], order: list[str], column: str, reset: Column | None = None) -> DataFrame:
    """``column`` with empty and null cells taken from the row above, not across a row for which ``reset`` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.trim(F.col(column)) != "", F.col(column))
    if reset is None:
        return rows.withColumn(column, F.last(value, ignorenulls=True).over(w))
    numbered = rows.withColumn("_part", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))
    inner = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn(column, F.last(value, ignorenulls=True).over(inner)).drop("_part")


def wrapped_rows(rows: DataFrame, by: list[str], order: list[str], starts: Column, text: str) -> DataFrame:
    """Rows merged that one logical row was wrapped into: a row for which ``starts`` holds and those up to the next."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("row_no", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    return numbered.groupBy(*by, "row_no").agg(F.array_join(F.transform(parts, lambda x: x.getField("_t")), " ").alias(text), F.count(F.lit(1)).alias("n_rows"))


def sections(line_rows: DataFrame, key: str, marker: str, most_lines: int | None = None) -> DataFrame:
    """(key, section_no, first_line, n_lines): from each line that matches ``marker`` to the next one, or the end."""
    w = Window.partitionBy(key).orderBy("line_no")
    ends = line_rows.groupBy(key).agg(F.max("line_no").alias("_last"))
    found = line_rows.where(F.col("line").rlike(marker)).withColumn("section_no", F.row_number().over(w)).withColumn("_next", F.lead("line_no").over(w))
    n = F.coalesce(F.col("_next"), F.col("_last") + 1) - F.col("line_no")
    n = n if most_lines is None else F.least(n, F.lit(most_lines))
    return found.join(ends, key).select(key, "section_no", F.col("line_no").alias("first_line"), n.alias("n_lines"))


def headings(texts: DataFrame, key: str, text: str, most: int = 80) -> DataFrame:
    """(key, line_no, heading, rank): lines that are headings by how they begin, the first ``most`` of a text."""
    rows = lines(texts, key, text).withColumn("heading", F.trim("line")).where(F.col("line").rlike(HEADING))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("rank") <= most).select(key, "line_no", "heading", "rank")


def voted(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """(by, value, n_votes): the value most rows of a group give; ties go to the longer, then to the greater value."""
    votes = rows.select(F.col(by), value.alias("value")).where("value is not null and value <> ''").groupBy(by, "value").agg(F.count(F.lit(1)).alias("n_votes"))
    best = F.max(F.struct("n_votes", F.length("value").alias("_l"), "value"))
    return votes.groupBy(by).agg(best.alias("b")).select(by, F.col("b.value").alias("value"), F.col("b.n_votes").alias("n_votes"))


def near_lines(line_rows: DataFrame, key: str, trigger: str, before: int = 2, after: int = 8) -> DataFrame:
    """(key, line_no) of lines within reach of a line that matches ``trigger``: a range join on buckets of line numbers."""
    hits = line_rows.where(F.col("line").rlike(trigger)).select(key, F.col("line_no").alias("hit"))
    reach = hits.select(key, F.explode(F.sequence(F.greatest(F.lit(0), F.col("hit") - before), F.col("hit") + after)).alias("line_no")).distinct()
    return line_rows.select(key, "line_no").join(reach, [key, "line_no"], "left_semi")


def project_names(line_rows: DataFrame, key: str, label: str = "项目名称") -> DataFrame:
    """(key, line_no, candidate): what stands after the label on its line, or on the next line if nothing does."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = line_rows.withColumn("_next", F.lead("line").over(w)).where(F.contains(F.col("line"), F.lit(label)))
    same = F.trim(F.regexp_extract("line", f"{label}[ \t]*(?:[：:|]|为)[ \t|]*([^|：:]*)", 1))
    value = F.when(same != "", same).otherwise(F.trim("_next"))
    return rows.select(key, "line_no", F.regexp_replace(value, r"[（(]?(盖章|签字|公章).*$", "").alias("candidate")).where(F.length("candidate").between(4, 80))
