"""The query catalog of the core operators. Each query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions import amounts, contacts, names, rules, text
from bidloom.operators import layout, pairs, prices, segments, summaries
from bidloom.plans import extraction
from bidloom.plans.oracles import ORACLES
from bidloom.session import read, ship_package, spread
from bidloom.streaming.incremental import new_links, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
POOLS = {"phones": "phone", "id_numbers": "id_number", "emails": "email", "bank_accounts": "bank_account"}
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return f(spark, d)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


def _files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "summarize_file").dropDuplicates(["file_id"])


def _people(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "personnel").dropDuplicates(["person_id"])


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text", *columns))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "matches").dropDuplicates(["match_id"])


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pair_results").where("total_matches >= 1 and file1 <> file2")
    return rows.select(F.least("file1", "file2").alias("left"), F.greatest("file1", "file2").alias("right")).distinct()


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of files on record, whatever earlier runs found in them."""
    rows = read(spark, d, "pair_results").where("file1 <> file2")
    return rows.select(F.least("file1", "file2").alias("left"), F.greatest("file1", "file2").alias("right")).distinct()


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return spread(segments.compared_pairs(_recorded(spark, d), _files(spark, d), "file_name", "text"))


def _named(people: DataFrame) -> DataFrame:
    """People with their name's key as one more pool, so that persons are compared like contacts."""
    return people.withColumn("names", F.array(text.person_key(F.col("person_name"))))


def _tidy(spark: SparkSession, d: str) -> DataFrame:
    return pairs.tidy_pools(_named(_people(spark, d)), "bid_group", POOLS | {"names": "person"})


# --- scans and text


@query
def scan_type_dispatch(spark, d):
    """Files by the reader that their extension selects."""
    from bidloom.sources.files import file_kind

    return _files(spark, d).groupBy(file_kind(F.col("file_name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def corpus_coverage(spark, d):
    return summaries.coverage(_files(spark, d), text.extension(F.col("file_name")), "text", "error_msg")


@query
def norm_fold(spark, d):
    """Match form of every file text."""
    return _files(spark, d).select("file_id", text.match_form(F.col("text")).alias("form"))


@query
def norm_visible(spark, d):
    """Line ends unified, zero-width characters away, wide figures narrow, label misreadings put right."""
    return _files(spark, d).select("file_id", text.fixed_labels(text.narrow_digits(text.visible(F.col("text")))).alias("form"))


@query
def toc_dots_strip(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(text.without_leader_dots(F.col("text"))).cast("long").alias("n_left"))


@query
def control_strip(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(text.sanitize(F.col("text"))).cast("long").alias("n_left"))


@query
def fill_brackets_strip(spark, d):
    return _segments(spark, d).select("match_id", text.without_fill_brackets(F.col("text")).alias("bare"))


@query
def mask_values(spark, d):
    persons = _people(spark, d)
    ids = persons.select("person_id", F.explode("id_numbers").alias("v")).select("person_id", F.lit("id_number").alias("kind"), text.masked_id(F.col("v")).alias("masked"))
    accounts = persons.select("person_id", F.explode("bank_accounts").alias("v")).select("person_id", F.lit("bank_account").alias("kind"), text.masked_account(F.col("v")).alias("masked"))
    return ids.unionByName(accounts)


@query
def name_forms(spark, d):
    """Keys of persons and display and group names of files."""
    persons = _people(spark, d).select(F.lit("person").alias("kind"), F.col("person_id").alias("id"), text.person_key(F.col("person_name")).alias("form"))
    shown = _files(spark, d).select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), text.display_name(F.col("file_name")).alias("form"))
    group = _files(spark, d).select(F.lit("group").alias("kind"), F.col("file_id").alias("id"), text.group_name(F.col("display_name")).alias("form"))
    return persons.unionByName(shown).unionByName(group)


@query
def item_name_forms(spark, d):
    rows = read(spark, d, "costdetails").select("pricename").where("pricename is not null").distinct()
    return rows.select("pricename", text.item_name(F.col("pricename")).alias("form"))


@query
def meaningful_chars(spark, d):
    return _segments(spark, d).select("match_id", text.meaningful(F.col("text")).cast("long").alias("n"))


# --- rules on segments


@query
def template_rule_flag(spark, d):
    return _segments(spark, d).select("match_id", rules.is_template(F.col("text")).alias("template"))


@query
def template_rule_lines(spark, d):
    """Lines of all documents that are template wording, by source."""
    rows = _documents(spark, d, "source").where("text is not null").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(rules.is_template(F.col("line"))).alias("n_template"))


@query
def boilerplate_density(spark, d):
    return _segments(spark, d).select("match_id", F.round(rules.formal_density(F.col("text")), 6).alias("density"))


@query
def substantiality_score(spark, d):
    return _segments(spark, d).select("match_id", F.round(rules.substantiality(F.col("text")), 6).alias("score"))


@query
def risk_level_counts(spark, d):
    """Segments by the level that rules and score give them against the level on record."""
    rows = _segments(spark, d).where("text is not null").select(
        F.coalesce(summaries.level(F.col("risk_level")), F.lit("none")).alias("recorded"),
        rules.risk_level(rules.is_template(F.col("text")), F.round(rules.substantiality(F.col("text")), 6)).alias("given"),
    )
    return rows.groupBy("recorded", "given").agg(F.count(F.lit(1)).alias("n"))


@query
def reason_tags(spark, d):
    return _segments(spark, d).where("text is not null").select("match_id", F.explode(rules.reason_tags(F.col("text"), rules.is_template(F.col("text")))).alias("tag"))


@query
def pair_segment_counts(spark, d):
    return summaries.pair_counts(_segments(spark, d), "pair_id", "risk_level", "abnormal")


@query
def severity_topk(spark, d):
    """The three gravest segments of each pair."""
    return summaries.by_level(_segments(spark, d), "pair_id", "risk_level", [F.desc_nulls_last("score"), F.col("match_id")], 3).select("pair_id", "match_id", F.col("rank").cast("long").alias("rank"))


# --- contacts


@query
def contact_pools(spark, d):
    return _tidy(spark, d)


@query
def shared_contacts(spark, d):
    """Values in several groups, with how many."""
    return pairs.shared_values(_tidy(spark, d))


@query
def shared_contact_pairs(spark, d):
    """Pairs of groups by what they share; a value of more than 50 groups stands as a class, one row for each of its
    groups with the first group of the class, so no link is lost and none is multiplied. n_groups tells which it is."""
    return pairs.linked_groups(_tidy(spark, d), 50)


@query
def shared_name_pairs(spark, d):
    """Persons named in several groups of one tender, and in the same role or not."""
    files = _files(spark, d).select("file_id", "tender_id")
    rows = _people(spark, d).join(files, "file_id").where("person_name is not null and tender_id is not null")
    keyed = rows.select("tender_id", "bid_group", text.person_key(F.col("person_name")).alias("name"), F.coalesce(names.role_label(F.col("person_role")), F.lit("none")).alias("role")).distinct()
    return keyed.groupBy("tender_id", "name").agg(F.countDistinct("bid_group").alias("n_groups"), F.countDistinct("role").alias("n_roles")).where("n_groups > 1")


@query
def cross_role_matches(spark, d):
    """One group's representative who is another group's project manager."""
    rows = _people(spark, d).where("person_name is not null").select(F.col("bid_group").alias("group"), text.person_key(F.col("person_name")).alias("value"), names.role_label(F.col("person_role")).alias("role"))
    return pairs.cross_attribute_pairs(rows.where("role = 'authorized_rep'"), rows.where("role = 'project_manager'"))


@query
def env_noise_by_frequency(spark, d):
    """Roles that nearly all groups of a tender name."""
    files = _files(spark, d).select("bid_group", "tender_id").where("tender_id is not null").distinct()
    tidy = pairs.tidy_fields(_people(spark, d), "bid_group", ["person_role"])
    scoped = tidy.join(files, F.col("group") == F.col("bid_group"))
    return pairs.frequent_everywhere(scoped, F.col("tender_id")).select("scope", "kind", "value", "n_groups", "n_all")


@query
def env_noise_by_reference(spark, d):
    """Contacts left after those that tender documents print."""
    references = read(spark, d, "documents").where("doc_kind = 'tender'").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9]{9,25})"), 1))).alias("value"))
    left = pairs.without(_tidy(spark, d), references, ["value"])
    return left.groupBy("kind").agg(F.count(F.lit(1)).alias("n_left"))


@query
def phone_forms(spark, d):
    """Mobile numbers among the phones on record and whether they are proper."""
    rows = _people(spark, d).select("person_id", F.explode("phones").alias("phone"))
    return rows.select("person_id", "phone", contacts.mobile(F.col("phone")).alias("mobile"))


@query
def short_phone_anomaly(spark, d):
    rows = _people(spark, d).select("person_id", F.explode("phones").alias("phone"))
    return rows.where(F.length(F.regexp_replace("phone", "[^0-9]", "")) < 7)


@query
def role_counts(spark, d):
    return _people(spark, d).groupBy(F.coalesce(names.role_label(F.col("person_role")), F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query
def best_person_per_role(spark, d):
    rows = _people(spark, d).select("file_id", "person_id", "confidence", F.coalesce("person_role", F.lit("")).alias("role"))
    return pairs.ranked(rows, ["file_id", "role"], [F.desc_nulls_last("confidence"), F.col("person_id")], 1).select("file_id", "role", "person_id")


@query
def sensitive_shapes(spark, d):
    """Shapes of personal data in file texts: how many texts hold each, how many values."""
    shapes = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "digits11": "1[3-9][0-9]{9}", "digits18": "[0-9]{17}[0-9Xx]", "credit_code": "9[0-9A-Z]{17}", "landline": "0[0-9]{2,3}-[0-9]{7,8}"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.regexp_extract_all("text", F.lit(f"({p})"), 1).alias("v")) for k, p in shapes.items()]))
    rows = _files(spark, d).where("text is not null").select("file_id", each.alias("x")).select("file_id", "x.*")
    return rows.groupBy("shape").agg(F.count_if(F.size("v") > 0).alias("n_texts"), F.sum(F.size("v").cast("long")).alias("n_values"))


@query
def date_numbers(spark, d):
    """Runs of eight figures in file texts that are days."""
    runs = _files(spark, d).select("file_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).alias("run")).where("length(run) = 8")
    return runs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(amounts.is_date_number(F.col("run"))).alias("n_days"))


# --- metadata and pairs


@query
def pair_enumeration(spark, d):
    return pairs.pair_numbers(_files(spark, d), "tender_id", "bid_group")


@query
def metadata_coalesce(spark, d):
    return pairs.first_known(_files(spark, d), "bid_group", ["ord", "file_id"], ["tender_id", "display_name", "error_msg"])


@query
def overlap_rate(spark, d):
    """Cost names that linked files have in common."""
    names = _files(spark, d).select("file_id", "file_name").join(read(spark, d, "costdetails").select("file_id", "pricename"), "file_id").select(F.col("file_name").alias("group"), F.col("pricename").alias("value"))
    return pairs.overlap_rates(names, _links(spark, d)).select("left", "right", "n_left", "n_right", "n_shared", F.round("rate", 6).alias("rate"))


@query
def name_mentions(spark, d):
    """Documents that hold a whole evaluation item's first sentence, by item: names of any length, whole documents."""
    found = pairs.mentions(_documents(spark, d), "doc_id", "text", read(spark, d, "eval_items").selectExpr("item_id", "regexp_extract(text, '^[^。.!?！？]+', 0) as head"), "item_id", "head")
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query
def cost_name_mentions(spark, d):
    """Documents that name an entry of the cost list, by its whole name or an alias. The test documents name none."""
    found = pairs.mentions(_documents(spark, d), "doc_id", "text", _cost_names(spark, d), "ref_id", "name")
    return found.groupBy("ref_id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query
def typed_name_mentions(spark, d):
    """Entries of the cost list that typed names of costs hold, by entry: whole names and aliases in all cost lines."""
    typed = read(spark, d, "costdetails").select("item_id", "pricename").dropDuplicates(["item_id"])
    found = pairs.mentions(spread(typed), "item_id", "pricename", _cost_names(spark, d), "ref_id", "name")
    return found.groupBy("ref_id").agg(F.countDistinct("item_id").alias("n_items"))


def _cost_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "price_ref").select("ref_id", F.explode(F.concat(F.array("canon_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))


@query
def volumes_joined(spark, d):
    """Texts of bidders, their volumes put together in order."""
    return summaries.volumes_joined(_files(spark, d), "bid_group", ["ord", "file_id"], "text").select("bid_group", "n_volumes", F.md5("text").alias("digest"))


@query
def pair_file_lookup(spark, d):
    """Compared pairs with the groups of both files; pairs whose file is unknown keep null."""
    files = _files(spark, d).select("file_name", "bid_group").dropDuplicates(["file_name"])
    p = read(spark, d, "pair_results").dropDuplicates(["pair_id"]).select("pair_id", "file1", "file2")
    a = p.join(files.select(F.col("file_name").alias("file1"), F.col("bid_group").alias("group1")), "file1", "left")
    return a.join(files.select(F.col("file_name").alias("file2"), F.col("bid_group").alias("group2")), "file2", "left").select("pair_id", "group1", "group2")


# --- text in common


@query
def exact_duplicate_docs(spark, d):
    return segments.text_classes(_documents(spark, d), "doc_id", "text")


@query
def template_windows(spark, d):
    """Windows of text that at least half of a tender's bidders have."""
    return segments.template_windows(_files(spark, d), "tender_id", "bid_group", "text").select("scope", F.md5("form").alias("digest"), "n_groups", "n_all")


@query
def line_template_index(spark, d):
    """Lines that at least three documents of a source have."""
    docs = _documents(spark, d, "source").where("text is not null")
    rows = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).withColumn("form", text.match_form(F.col("line"))).where(F.length("form") >= 30)
    return rows.groupBy("source", "form").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 3").select("source", F.md5("form").alias("digest"), "n_docs")


@query
def reference_subtraction(spark, d):
    """Lines of tender documents that stand in an evaluation item."""
    lines = layout.lines(_documents(spark, d), "doc_id", "text").select("line").distinct()
    return segments.contained_in(lines, "line", "line", read(spark, d, "eval_items"), "text").distinct()


@query
def paragraphs(spark, d):
    """The longest paragraphs of each document."""
    return segments.paragraphs(_documents(spark, d), "doc_id", "text").select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("n_form").cast("long").alias("n_form"), F.col("rank").cast("long").alias("rank"))


@query
def common_runs(spark, d):
    """All maximal runs of characters that the files of recorded pairs have in common, by places in match form."""
    return segments.runs_of_pairs(_compared(spark, d)).select("left", "right", *[F.col(c).cast("long").alias(c) for c in ("pos1", "pos2", "length")])


@query
def common_segments(spark, d):
    """Common segments of all recorded pairs of files, chosen among the runs so that no text is used twice."""
    return segments.segments_of_pairs(_compared(spark, d)).select("left", "right", "pos1", "pos2", "length", "segment")


@query
def near_paragraph_bands(spark, d):
    """How many paragraphs of like length each recorded pair of files has to compare."""
    forms = segments.paragraph_forms(_files(spark, d), "file_name", "text")
    return segments.paragraph_bands(_recorded(spark, d), forms).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


@query
def near_duplicate_paragraphs(spark, d):
    """Paragraphs of all recorded pairs of files that are alike but not the same."""
    return segments.near_paragraphs(_recorded(spark, d), _files(spark, d), "file_name", "text")


@query
def similarity_levels(spark, d):
    """Each segment on record by why it counts or does not: in a reference, template by rule, or by its score."""
    rows = _segments(spark, d).where("text is not null").select("match_id", "text")
    held = segments.contained_in(rows, "match_id", "text", read(spark, d, "eval_items"), "text").distinct().withColumn("ref", F.lit(True))
    level = rules.risk_level(rules.is_template(F.col("text")), F.round(rules.substantiality(F.col("text")), 6))
    return rows.join(held, "match_id", "left").select("match_id", F.when(F.col("ref"), "reference").when(rules.is_template(F.col("text")), "rule").otherwise(level).alias("level"))


# --- layout


@query
def pipe_table_rows(spark, d):
    return layout.pipe_rows(_documents(spark, d), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("region").cast("long").alias("region"), F.col("row_no").cast("long").alias("row_no"), F.size("cells").cast("long").alias("n_cells"))


@query
def pipe_cell_values(spark, d):
    """Cells of all tables in documents by the header of their column."""
    cells = layout.cell_values(layout.pipe_rows(_documents(spark, d), "doc_id", "text"), "doc_id")
    return cells.groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_distinct"))


@query
def forward_fill_cells(spark, d):
    """Units of cost lines, missing ones from the line above."""
    rows = read(spark, d, "costdetails").dropDuplicates(["item_id"]).select("file_id", "item_id", "unit")
    return layout.filled_down(rows, ["file_id"], ["item_id"], "unit")


@query
def wrapped_row_islands(spark, d):
    """Lines of file texts merged into rows that begin with a line with bars; what stands before the first is row 0."""
    rows = layout.lines(_files(spark, d), "file_id", "text")
    merged = layout.wrapped_rows(rows, ["file_id"], ["line_no"], F.contains(F.col("line"), F.lit(" | ")), "line")
    return merged.select("file_id", F.col("row_no").cast("long").alias("row_no"), F.md5("line").alias("digest"), "n_rows")


@query
def empty_line_streaks(spark, d):
    """Runs of empty lines in documents."""
    rows = layout.islands(layout.lines(_documents(spark, d), "doc_id", "text"), ["doc_id"], ["line_no"], F.trim("line") == "", "streak")
    return rows.groupBy("doc_id").agg(F.max("streak").cast("long").alias("n_streaks"), F.count(F.lit(1)).alias("n_empty"))


@query
def section_slices(spark, d):
    """Parts of documents from one numbered question or entry to the next."""
    found = layout.sections(layout.lines(_documents(spark, d), "doc_id", "text"), "doc_id", "^(问[0-9]+：|[0-9]+\\. )")
    return found.select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("first_line").cast("long").alias("first_line"), F.col("n_lines").cast("long").alias("n_lines"))


@query
def headings(spark, d):
    return layout.headings(_files(spark, d), "file_id", "text").select("file_id", F.col("line_no").cast("long").alias("line_no"), "heading", F.col("rank").cast("long").alias("rank"))


@query
def trigger_reach_lines(spark, d):
    """Lines of file texts within reach of a line about deviation or identity."""
    rows = layout.near_lines(layout.lines(_files(spark, d), "file_id", "text"), "file_id", "偏离|归档号|file mark|File mark")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def project_vote(spark, d):
    """The project name that most files of a tender carry."""
    name = F.regexp_replace("display_name", r"(技术册|商务册|资格册|报价册)?(_[0-9]+)?\.[A-Za-z]+$", "")
    return layout.voted(_files(spark, d).where("tender_id is not null"), "tender_id", name)


# --- prices and items


@query
def amount_parse(spark, d):
    """Totals as written against the number they state."""
    rows = read(spark, d, "prices").select("price_id", "totalprice").where("totalprice is not null").distinct()
    return rows.select("price_id", amounts.arabic_amount(F.col("totalprice")).alias("amount"))


@query
def amount_parse_all(spark, d):
    """The same in Arrow batches, Chinese numerals included."""
    rows = read(spark, d, "prices").select("price_id", "totalprice").where("totalprice is not null").distinct()
    return rows.select("price_id", amounts.parsed_amount_udf("totalprice").alias("amount"))


@query
def bid_totals_tax(spark, d):
    """Totals without tax from totals with tax and the quoted rate."""
    rows = read(spark, d, "prices").dropDuplicates(["price_id"])
    r = amounts.rate(F.col("taxrate"))
    return rows.select("price_id", F.round(r, 6).alias("rate"), prices.ex_tax(F.col("totalpriceintax").cast("decimal(20,2)"), r.cast("decimal(10,6)")).cast("double").alias("ex_tax"))


@query
def price_spread(spark, d):
    """How far the unit prices of a cost name lie apart within a tender."""
    rows = read(spark, d, "costdetails").dropDuplicates(["item_id"]).where("pricename is not null and tender_id is not null")
    out = prices.spreads(rows, ["tender_id", "pricename"], "unitprice", "file_id").where("n > 1")
    return out.select("tender_id", "pricename", "n", "n_who", "n_distinct", F.col("lowest").cast("double").alias("lowest"), F.col("highest").cast("double").alias("highest"), F.col("spread_pct").cast("double").alias("spread_pct"))


@query
def comparison_pivot(spark, d):
    """Segments by level and whether they are abnormal, with whether both numbers agree."""
    rows = _segments(spark, d).select(F.coalesce(summaries.level(F.col("risk_level")), F.lit("none")).alias("level"), F.col("abnormal").cast("string").alias("abnormal"))
    out = summaries.pivot(rows, "level", "abnormal", ["true", "false"], F.count(F.lit(1)))
    return out.select("level", F.col("true").alias("n_true"), F.col("false").alias("n_false"), F.col("n_values").cast("long").alias("n_values"), "same_all")


@query
def sum_vs_total(spark, d):
    """Cost lines of a file against its stated cost."""
    items = read(spark, d, "costdetails").dropDuplicates(["item_id"])
    out = prices.sum_differences(items, "file_id", "totalprice", read(spark, d, "prices").groupBy("file_id").agg(F.max("cost_total").alias("cost_total")), "cost_total")
    return out.select("file_id", "n_items", F.col("item_sum").cast("double").alias("item_sum"), F.col("total").cast("double").alias("total"), "off")


@query
def plausible_items(spark, d):
    items = read(spark, d, "costdetails").dropDuplicates(["item_id"])
    out = prices.plausible_items(items, "pricename", "unitprice", "totalprice")
    return out.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("totalprice").cast("decimal(20,2)")).cast("double").alias("total"))


@query
def bond_echo_exclusion(spark, d):
    """Cost lines that do not echo an amount of the file's price record."""
    items = read(spark, d, "costdetails").dropDuplicates(["item_id"]).select("item_id", "file_id", "totalprice")
    others = read(spark, d, "prices").select("file_id", F.explode(F.array("revenue", "cost_total")).alias("o"))
    return prices.without_echoes(items, "file_id", "totalprice", others, "o").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query
def item_jaccard(spark, d):
    return prices.similar_names(read(spark, d, "price_ref"), "ref_id", "canon_name", 0.3).select("id1", "id2", F.round("jaccard", 6).alias("jaccard"))


@query
def item_clusters(spark, d):
    """Cost names of a tender, clustered around the first that has no cluster."""
    return prices.item_clusters(read(spark, d, "costdetails").dropDuplicates(["item_id"]), "tender_id", "item_id", "pricename")


@query
def channel_priority(spark, d):
    """Of each file the price from the channel that counts most: with tax, as written, revenue, cost."""
    rows = read(spark, d, "prices").dropDuplicates(["price_id"])
    channels = (F.col("totalpriceintax"), amounts.arabic_amount(F.col("totalprice")), F.col("revenue"), F.col("cost_total"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), c.alias("value")) for i, c in enumerate(channels)]))
    found = rows.select("file_id", "price_id", each.alias("x")).select("file_id", "price_id", "x.*").where("value is not null and file_id is not null")
    return pairs.ranked(found, ["file_id"], [F.col("channel"), F.col("price_id")], 1).select("file_id", "channel", "value")


# --- history and statistics


def _runs(spark, d):
    return read(spark, d, "pair_results").dropDuplicates(["pair_id"])


@query
def stats_totals(spark, d):
    return summaries.totals(_runs(spark, d), "total_matches", [1, 2, 4, 8])


@query
def stats_timeline(spark, d):
    return summaries.timeline(_runs(spark, d), "run_at", "total_matches", 3)


@query
def stats_dimensions(spark, d):
    rows = _runs(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("n")) for c in ("total_matches", "abnormal_count", "template_count")])).alias("x")).select("x.*")
    return rows.groupBy("dimension").agg(F.count_if(F.col("n") > 0).alias("n_hit"), F.sum(F.col("n").cast("long")).alias("total"))


@query
def stats_recent(spark, d):
    """The eight latest runs."""
    return _runs(spark, d).where("run_at is not null").orderBy(F.desc("run_at"), F.desc("pair_id")).limit(8).select("pair_id", "total_matches")


@query
def history_lighten(spark, d):
    """Matches as they are stored: texts of at most 200 characters."""
    rows = summaries.lightened(_runs(spark, d).where("size(matches) > 0"), "matches")
    return rows.select("pair_id", F.explode("matches").alias("m")).select("pair_id", "m.match_id", "m.text")


@query
def sql_functions(spark, d):
    """The extractors called by name from SQL, over all segments: what they find of each kind."""
    amounts.register(spark)
    _segments(spark, d).select("match_id", "text").createOrReplaceTempView("bidloom_segments")
    return spark.sql("SELECT match_id, size(contacts_in(text)) AS n_contacts, size(people_in(text)) AS n_people, size(prices_in(text)) AS n_prices, parsed_amount(text) AS amount FROM bidloom_segments")


@query
def contact_stream(spark, d):
    """Contacts and people shared by groups as the stream finds them: personnel files come in as a stream, by batches."""
    from uuid import uuid4

    from bidloom.session import ensure_checkpoint_dir
    from bidloom.streaming.incremental import contact_stream as start

    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    table = read(spark, d, "personnel")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    start(spark, f"{d}/personnel.parquet*", f"{at}/stored", f"{at}/links", f"{at}/checkpoint", schema, POOLS | {"names": "person"}, _named).awaitTermination()
    return spark.read.parquet(f"{at}/links/_batch=*").select("left", "right", "kind", "value").distinct()


@query
def cache_keys(spark, d):
    return summaries.cache_keys(_files(spark, d), "text", "v1").select("file_id", "cache_key")


@query
def cache_dedup(spark, d):
    """One file for each content that is worth keeping."""
    keyed = summaries.cache_keys(_files(spark, d), "text", "v1").where("cache_key is not null")
    return keyed.groupBy("cache_key").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n"))


@query
def cache_lru(spark, d):
    """Entries beyond the 200 latest used."""
    return summaries.least_recent(_files(spark, d), "loaded_at", "file_id", 200).select("file_id")


@query
def window_counts(spark, d):
    """Events by hour and kind, as the stream counts them."""
    out = windowed_counts(read(spark, d, "events"), "ts", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query
def incremental_links(spark, d):
    """Links that people loaded from 2025 on add to those loaded before."""
    persons = _named(_people(spark, d))
    at = F.coalesce(F.year("loaded_at") >= 2025, F.lit(False))
    return new_links(persons.where(at), persons.where(~at), POOLS | {"names": "person"})


@query
def gap_sessions(spark, d):
    """Sessions of users: events with less than half an hour between them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").select("user_id", "event_id", "ts").withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w)) > F.expr("interval 30 minutes"), F.lit(True)).cast("int"))
    return rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id").agg(F.max("session").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Compared pairs of files with their groups, how their segments are rated and how much of their costs overlap."""
    counts = pair_segment_counts(spark, d)
    return pair_file_lookup(spark, d).join(counts, "pair_id").select("pair_id", "group1", "group2", "total", "n_abnormal", "n_substantial")


for _extraction_query in extraction.queries().values():
    query(_extraction_query)


def queries() -> dict[str, Query]:
    return {"flagship": flagship} | QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | extraction.oracle_sql()
