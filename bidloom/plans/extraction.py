"""Queries of the extraction half: prices, people, items, properties and findings, with their SQL.

Two kinds beside those on plain tables: ``*_cases`` read small texts whose expected rows are written by hand in
``cases``; the others render whole tables as the pages of a bid (a cover, a staff table, a price table) and read them
back, so their SQL states what was recorded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import amounts, contacts, names, rules, text
from bidloom.operators import findings, items, layout, pairs, people, prices, quotes, segments, summaries
from bidloom.plans import cases, small_files
from bidloom.session import read, spread
from bidloom.sources import files

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str, types: str) -> str:
    """A SELECT of literal rows; columns and types by blanks."""
    c, t = columns.split(), types.split()
    casts = ", ".join(f"CAST({a} AS {b}) AS {a}" for a, b in zip(c, t, strict=True))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({', '.join(c)})"


def _texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def _once(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    return spread(read(spark, d, table).dropDuplicates([key]))


FILES = "(SELECT DISTINCT ON (file_id) * FROM summarize_file)"
PEOPLE = "(SELECT DISTINCT ON (person_id) * FROM personnel)"
ITEMS = "(SELECT DISTINCT ON (item_id) * FROM costdetails)"
PRICES = "(SELECT DISTINCT ON (price_id) * FROM prices)"
SEGMENTS = "(SELECT DISTINCT ON (match_id) * FROM matches)"

# --- hand-written cases


@query(values([(i, *map(lambda v: float(v) if isinstance(v, int) else v, c[1:])) for i, c in enumerate(cases.PRICES)], "id in_tax ex_tax tax_rate quoted_rate", "BIGINT DOUBLE DOUBLE DOUBLE VARCHAR"))
def price_cases(spark, d):
    """Prices stated by small texts."""
    found = quotes.extracted_prices(_texts(spark, [c[0] for c in cases.PRICES]), "id", "text")
    return _texts(spark, [c[0] for c in cases.PRICES]).select("id").join(found, "id", "left").select("id", "in_tax", "ex_tax", "tax_rate", "quoted_rate")


@query(values([(i, t, None if v is None else float(v)) for i, (t, v) in enumerate(cases.AMOUNTS)], "id written amount", "BIGINT VARCHAR DOUBLE"))
def amount_cases(spark, d):
    """Amounts as written, in figures and in numerals."""
    rows = _texts(spark, [t for t, _ in cases.AMOUNTS])
    return rows.select("id", F.col("text").alias("written"), F.round(amounts.parsed_amount_udf("text"), 2).alias("amount"))


@query(values([(i, *r) for i, (_, want) in enumerate(cases.PEOPLE) for r in want], "id field value role", "BIGINT VARCHAR VARCHAR VARCHAR"))
def people_cases(spark, d):
    """People and labelled fields of small texts."""
    return people.extracted_people(_texts(spark, [c[0] for c in cases.PEOPLE]), "id", "text").select("id", "field", "value", "role")


@query(values([(i, *r) for i, (_, want) in enumerate(cases.ITEMS) for r in want], "id source name total_ex", "BIGINT VARCHAR VARCHAR DOUBLE"))
def item_cases(spark, d):
    """Priced items and costs of small texts."""
    return items.line_items(_texts(spark, [c[0] for c in cases.ITEMS]), "id", "text").select("id", "source", "name", "total_ex")


@query(values([(i, *c[1:]) for i, c in enumerate(cases.RULES)], "id template role heading form", "BIGINT BOOLEAN VARCHAR BOOLEAN VARCHAR"))
def rule_cases(spark, d):
    """Template rules, roles, headings and match forms of small segments."""
    c = F.col("text")
    return _texts(spark, [x[0] for x in cases.RULES]).select("id", rules.is_template(c).alias("template"), names.role_label(c).alias("role"), c.rlike(layout.HEADING).alias("heading"), text.match_form(c).alias("form"))


@query(
    values([("name", i, n, str(ok).lower()) for i, (n, ok) in enumerate(cases.NAMES)] + [("company", i, *c) for i, c in enumerate(cases.COMPANIES)] + [("phone", i, *c) for i, c in enumerate(cases.PHONES)] + [("digits", i, *c) for i, c in enumerate(cases.DIGITS)] + [("broken", i, *c) for i, c in enumerate(cases.BROKEN_NAMES)] + [("padded", i, *c) for i, c in enumerate(cases.PADDED)], "kind id given form", "VARCHAR BIGINT VARCHAR VARCHAR")
)
def cleaner_cases(spark, d):
    """Names told apart, companies and phones cleaned."""
    parts = (("name", [n for n, _ in cases.NAMES], names.is_person_name(F.col("text")).cast("string")), ("company", [c for c, _ in cases.COMPANIES], names.clean_company_column(F.col("text"))), ("phone", [p for p, _ in cases.PHONES], contacts.clean_phone(F.col("text"))))
    parts += tuple((kind, [t for t, _ in of], form) for kind, of, form in (("digits", cases.DIGITS, text.joined_digits(F.col("text"))), ("broken", cases.BROKEN_NAMES, text.joined_names(F.col("text"))), ("padded", cases.PADDED, text.tightened(F.col("text")))))
    out = [_texts(spark, given).select(F.lit(kind).alias("kind"), "id", F.col("text").alias("given"), form.alias("form")) for kind, given, form in parts]
    return reduce(DataFrame.unionByName, out)


@query(values([(i, n) for i, (_, want) in enumerate(cases.PROJECTS) for n in want], "id candidate", "BIGINT VARCHAR"))
def project_cases(spark, d):
    """Project names that small texts state."""
    lines = layout.lines(_texts(spark, [t for t, _ in cases.PROJECTS]), "id", "text")
    return layout.project_names(lines, "id").select("id", "candidate")


@query(values(small_files.LINES, "path line_no kind text", "VARCHAR INT VARCHAR VARCHAR"))
def file_lines_cases(spark, d):
    """Lines of small files of each kind, in document order."""
    held = spark.createDataFrame([(n, bytearray(b)) for n, b in small_files.FILES], "path string, content binary")
    return files.file_lines(held).where("error is null").select("path", "line_no", "kind", "text")


@query(values(small_files.PROPERTIES, "path name value", "VARCHAR VARCHAR VARCHAR"))
def file_property_cases(spark, d):
    """What small files of each kind say about themselves."""
    held = spark.createDataFrame([(n, bytearray(b)) for n, b in small_files.FILES], "path string, content binary")
    return files.file_properties(held).select("path", F.explode("properties").alias("name", "value"))


def _bidders(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = spark.createDataFrame([(g, t) for g, _, t in cases.BIDDERS], "group string, text string")
    records = spark.createDataFrame([(g, *(p.get(f) for f in findings.PROPERTIES)) for g, p, _ in cases.BIDDERS], "group string, " + ", ".join(f"{f} string" for f in findings.PROPERTIES))
    return files, records, people.extracted_people(files, "group", "text")


def _bidder_findings(spark: SparkSession) -> DataFrame:
    files, records, found = _bidders(spark)
    staff = found.where("field = 'person'").select("group", "value", "role")
    reps = found.where("field = 'authorized_rep'").select("group", "value")
    phones = contacts.extracted_contacts(files, "group", "text")
    equal = findings.property_matches(records, "group")
    metadata = equal.select(F.lit("metadata").alias("dimension"), F.col("kind").alias("type"), "left", "right", "value", "severity")
    companies = found.where("field = 'company'").select("group", "value")
    return findings.all_findings(metadata, findings.contact_findings(phones), findings.person_findings(staff), findings.representative_findings(reps, records), findings.mixing_findings(files, "group", "text", companies))


@query(values(cases.BIDDER_FINDINGS, "dimension type left_group right_group value severity", "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR"))
def finding_cases(spark, d):
    """All findings about three small bids."""
    return _bidder_findings(spark).withColumnRenamed("left", "left_group").withColumnRenamed("right", "right_group")


@query("SELECT dimension, count(*) AS n, 0::BIGINT AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'info') AS n_info FROM (" + values(cases.BIDDER_FINDINGS, "dimension type left_group right_group value severity", "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR") + ") AS f, (VALUES (1), (2)) AS x(k) WHERE k = 1 GROUP BY dimension UNION ALL SELECT 'all', 14, 0, 10, 3, 1")
def finding_severities(spark, d):
    """How many findings of each severity the three small bids have."""
    return findings.severity_counts(_bidder_findings(spark))


# --- prices


@query(
    f"""SELECT price_id, round(t, 2) AS in_tax, true AS ex_tax_fits, r AS tax_rate FROM (
SELECT price_id, totalpriceintax AS t, CASE WHEN regexp_matches(taxrate, '^[0-9]{{1,2}}%$') AND CAST(replace(taxrate, '%', '') AS INT) BETWEEN 1 AND 30 THEN CAST(replace(taxrate, '%', '') AS DOUBLE) END AS r FROM {PRICES}) AS p WHERE t >= 5000"""
)
def extracted_prices(spark, d):
    """Price records rendered as summaries of bids, among a deposit and a ceiling, in four notations, and read back."""
    rows = _once(spark, d, "prices", "price_id").where("totalpriceintax >= 5000")
    plain = F.format_string("%.2f", "totalpriceintax")
    grouped = F.format_number("totalpriceintax", 2)
    amount = F.when(F.pmod("price_id", F.lit(4)) == 0, F.concat(F.lit("投标总价：￥"), grouped, F.lit("元"))).when(F.pmod("price_id", F.lit(4)) == 1, F.concat(F.lit("投标总价（含税）： 【"), plain, F.lit("】元")))
    amount = amount.when(F.pmod("price_id", F.lit(4)) == 2, F.concat(F.lit("投标报价\n小写：__"), plain, F.lit("__元"))).otherwise(F.concat(F.lit("人民币："), grouped, F.lit("元整")))
    rate = F.when(F.col("taxrate").rlike("^[0-9]{1,2}%$") & F.expr("try_cast(replace(taxrate, '%', '') as int)").between(1, 30), F.concat(F.lit("税率 "), "taxrate", F.lit("\n"))).otherwise("")
    page = F.concat(F.lit("目录\n一、投标函........1\n开标一览表\n最高限价：￥99,999,999.00元\n"), amount, F.lit("\n"), rate, F.lit("投标保证金：20000元\n工期：120日历天\n"))
    found = quotes.extracted_prices(rows.select("price_id", page.alias("text")), "price_id", "text")
    fits = F.abs(F.col("ex_tax") * (1 + F.coalesce("tax_rate", F.lit(0)) / 100) - F.col("in_tax")) < 0.02
    return found.select("price_id", "in_tax", fits.alias("ex_tax_fits"), "tax_rate")


@query()
def file_prices(spark, d):
    """What the texts of all files state about prices."""
    return quotes.extracted_prices(_once(spark, d, "summarize_file", "file_id").select("file_id", "text"), "file_id", "text")


@query()
def document_prices(spark, d):
    """What all documents state about prices, with the channel it was found in."""
    return quotes.price_candidates(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"SELECT tender_id, t AS total, n AS n_groups, n * (n - 1) // 2 AS n_pairs FROM (SELECT tender_id, CAST(t AS DOUBLE) AS t, count(DISTINCT bid_group) AS n FROM (SELECT f.tender_id, p.bid_group, CAST(round(p.totalpriceintax / 1000) * 1000 AS DECIMAL(20,2)) AS t FROM {PRICES} AS p JOIN {FILES} AS f USING (file_id)) WHERE tender_id IS NOT NULL AND bid_group IS NOT NULL AND t > 0 GROUP BY tender_id, t) WHERE n > 1")
def equal_totals(spark, d):
    """Totals, to the thousand, that several bidders of a tender state."""
    rows = _tender_totals(spark, d).withColumn("total", F.round(F.col("totalpriceintax") / 1000) * 1000)
    return prices.equal_totals(rows, "tender_id", "bid_group", "total").select(F.col("scope").alias("tender_id"), F.col("total").cast("double").alias("total"), "n_groups", "n_pairs")


@query(values(cases.TOTALS_FOUND, "kind tender value n", "VARCHAR VARCHAR DOUBLE BIGINT"))
def total_cases(spark, d):
    """Equal and evenly spaced totals among those of small tenders."""
    rows = spark.createDataFrame(cases.TOTALS, "tender string, bidder string, total double")
    ladders = prices.ladders(rows.where("tender is not null"), ["tender"], "total").select(F.lit("ladder").alias("kind"), "tender", F.col("gap").cast("double").alias("value"), "n")
    equal = prices.equal_totals(rows, "tender", "bidder", "total").select(F.lit("equal").alias("kind"), F.col("scope").alias("tender"), F.col("total").cast("double").alias("value"), F.col("n_groups").alias("n"))
    return ladders.unionByName(equal)


def _tender_totals(spark: SparkSession, d: str) -> DataFrame:
    files = _once(spark, d, "summarize_file", "file_id").select("file_id", "tender_id")
    return _once(spark, d, "prices", "price_id").select("file_id", "bid_group", "totalpriceintax", "taxrate", "bidrate").join(files, "file_id")


def _ladder(by: str, value: str, source: str) -> str:
    return f"SELECT {by}, count(*) AS n, CAST(min(g) AS DOUBLE) AS gap FROM (SELECT {by}, t, t - lag(t) OVER (PARTITION BY {by} ORDER BY t) AS g FROM (SELECT DISTINCT {by}, {value} AS t FROM {source}) WHERE t IS NOT NULL) GROUP BY {by} HAVING count(*) >= 3 AND min(g) = max(g)"


@query(_ladder("tender_id", "CAST(totalpriceintax AS DECIMAL(20,2))", f"(SELECT f.tender_id, p.totalpriceintax FROM {PRICES} AS p JOIN {FILES} AS f USING (file_id) WHERE f.tender_id IS NOT NULL) AS x"))
def price_ladder(spark, d):
    """Tenders whose totals, in order, lie evenly apart."""
    out = prices.ladders(_tender_totals(spark, d).where("tender_id is not null"), ["tender_id"], "totalpriceintax")
    return out.select("tender_id", "n", F.col("gap").cast("double").alias("gap"))


@query(_ladder("file_id, pricename", "CAST(qty AS DECIMAL(20,2))", f"(SELECT file_id, pricename, qty FROM {ITEMS} WHERE pricename IS NOT NULL) AS x"))
def cluster_ladder(spark, d):
    """Items of one name in one file whose quantities lie evenly apart."""
    out = prices.ladders(_once(spark, d, "costdetails", "item_id").where("pricename is not null"), ["file_id", "pricename"], "qty")
    return out.select("file_id", "pricename", "n", F.col("gap").cast("double").alias("gap"))


_FIELDS = "SELECT tender_id, field, v FROM (SELECT f.tender_id, unnest([{'field': 'bidrate', 'v': bidrate}, {'field': 'taxrate', 'v': taxrate}], recursive := true) FROM " + PRICES + " AS p JOIN " + FILES + " AS f USING (file_id) WHERE f.tender_id IS NOT NULL)"


@query(f"SELECT tender_id, field, count(*) FILTER (WHERE v <> '') AS n_values, count(DISTINCT v) FILTER (WHERE v <> '') <= 1 AS same_all FROM ({_FIELDS}) GROUP BY tender_id, field")
def comparison_fields(spark, d):
    """Of each tender and field how many bids state it and whether all that do agree."""
    rows = _tender_totals(spark, d).where("tender_id is not null")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("bidrate", "taxrate")]))
    return summaries.agreement(rows.select("tender_id", each.alias("x")).select("tender_id", "x.*"), ["tender_id", "field"], "v")


@query(
    f"""WITH t AS (SELECT DISTINCT f.tender_id, p.bid_group, CAST(p.totalpriceintax AS DECIMAL(20,2)) AS v FROM {PRICES} AS p JOIN {FILES} AS f USING (file_id) WHERE f.tender_id IS NOT NULL AND p.bid_group IS NOT NULL),
k AS (SELECT tender_id, count(DISTINCT bid_group) AS n_bidders, count(DISTINCT bid_group) FILTER (WHERE v > 0) AS n_priced, min(v) FILTER (WHERE v > 0) AS lo, max(v) FILTER (WHERE v > 0) AS hi FROM t GROUP BY tender_id)
SELECT tender_id, n_bidders, n_priced, n_priced * 2 >= n_bidders AS majority, CAST(lo AS DOUBLE) AS lowest, CAST(hi AS DOUBLE) AS highest, round((hi - lo)::DOUBLE / lo::DOUBLE * 100, 2) AS spread_pct, coalesce(s, 0) AS n_shared_values
FROM k LEFT JOIN (SELECT tender_id, count(*) AS s FROM (SELECT tender_id, v FROM t WHERE v > 0 GROUP BY tender_id, v HAVING count(DISTINCT bid_group) > 1) GROUP BY tender_id) USING (tender_id)"""
)
def price_kpis(spark, d):
    """Of each tender how many bidders state a total, the lowest and highest, their spread and how many totals are shared."""
    return prices.total_kpis(_tender_totals(spark, d), "tender_id", "bid_group", "totalpriceintax")


# --- items


@query(
    f"""SELECT file_id, count(*) AS n_items, CAST(sum(t) AS DOUBLE) AS total, count(tax) AS n_taxed FROM (SELECT file_id, CAST(totalprice AS DECIMAL(20,2)) AS t, unitprice, nullif(regexp_extract(tax, '([0-9]+)', 1), '') AS tax FROM {ITEMS}
WHERE length(trim(regexp_replace(pricename, '[ |\\n\\t]+', ' ', 'g'), ' ')) >= 2 AND NOT regexp_matches(pricename, '经理|工程师|工人|主任|主管|专员|总监|总裁|董事长|秘书|助理|合同|协议|订单|项目 *名称|供应商|投标人|采购人|灵敏度|dB|MHz|GHz|指标 *要求|功能 *要求|验收测试|测试评审|联通测试|差旅|交通|住宿|会议内容|出差|^其他$|^无$|^备注$|^说明$|^小计$|硬件费用|软件费用|其他费用|有限公司|有限责任|公司|集团|大学|学院|研究所')
AND regexp_matches(pricename, '^[一-鿿]+$') AND NOT regexp_matches(pricename, '^(合计|总价|小计|总计)') AND totalprice > 0 AND (unitprice IS NULL OR CAST(unitprice AS DECIMAL(20,2)) <= 1.5 * CAST(totalprice AS DECIMAL(20,2)))) GROUP BY file_id"""
)
def rendered_items(spark, d):
    """Cost lines rendered as price tables of their files and read back; lines whose name is plain ideographs."""
    rows = _once(spark, d, "costdetails", "item_id").where("totalprice > 0").where(F.col("pricename").rlike("^[一-鿿]+$"))
    cell = lambda c: F.coalesce(F.regexp_replace(c, "[|\n]", " "), F.lit(""))
    money = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit(""))
    line = F.concat_ws(" | ", F.col("item_id").cast("string"), cell(F.col("pricename")), cell(F.col("unit")), F.when(F.col("unitprice").isNull(), F.lit("")).otherwise(money("unitprice")), money("totalprice"), cell(F.col("tax")))
    parts = F.array_sort(F.collect_list(F.struct("item_id", line.alias("l"))))
    pages = rows.groupBy("file_id").agg(F.concat(F.lit("分项报价表\n序号 | 名称 | 单位 | 单价 | 总价 | 税率\n"), F.array_join(F.transform(parts, lambda p: p.getField("l")), "\n"), F.lit("\n合计 | | | | 1 | ")).alias("text"))
    found = items.pipe_items(pages, "file_id", "text")
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("total_ex").cast("decimal(20,2)")).cast("double").alias("total"), F.count("tax").alias("n_taxed"))


@query()
def file_items(spark, d):
    """Priced items and costs in the texts of all files."""
    return items.line_items(_once(spark, d, "summarize_file", "file_id").select("file_id", "text"), "file_id", "text")


_LINES = "(SELECT file_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM " + FILES + " WHERE text IS NOT NULL)"
_REGIONS = f"(SELECT file_id, line_no, line, dense_rank() OVER (PARTITION BY file_id ORDER BY g) AS region FROM (SELECT file_id, line_no, line, line_no - row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS g FROM {_LINES} WHERE contains(line, ' | ')))"


@query(
    "SELECT file_id, region, CAST("
    + " + ".join(f"CASE WHEN contains(t, '{w}') THEN {n} ELSE 0 END" for ws, n in ((("单价", "总价", "税率", "金额", "价格", "报价", "不含税", "含税"), 3), (("出差事由", "合同金额", "项目名称", "职务", "岗位", "职称", "联系人", "联系电话", "项目经理", "指标要求", "功能要求"), -2)) for w in ws)
    + f" + least(10, len(regexp_extract_all(t, '\\b[0-9]{{5,}}(?:\\.[0-9]{{2}})?\\b'))) AS INT) AS score FROM (SELECT file_id, region, string_agg(line, chr(10)) AS t FROM {_REGIONS} GROUP BY file_id, region)"
)
def table_scores(spark, d):
    """How much each table in file texts is about prices."""
    rows = layout.pipe_rows(_once(spark, d, "summarize_file", "file_id"), "file_id", "text")
    return items.region_scores(rows, "file_id").select("file_id", F.col("region").cast("long").alias("region"), "score")


# --- people


def _family(spark: SparkSession, d: str) -> str:
    return names.family_names(read(spark, d, "personnel"), "person_name")


# Written here again, apart from the package: the commonest family names and the words that no name holds.
_FAMILY_SQL = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖樊兰殷施洪翟安倪牛温芦季俞章鲁葛伍申尤毕聂柴焦关阎欧庞颜梅庄凌祝童甘岳单滕项管华齐柳左纪霍阮包"
_NO_NAME_SQL = "公司|集团|项目|人员|经理|委托|授权|代表|负责|职务|本人|教授|工程师"
_KEY = "regexp_replace(translate(person_name, '•・‧∙', '····'), '[ \\t\\n\\x{A0}\\x{3000}\\x{200B}-\\x{200D}\\x{FEFF}\\x{AD}]+', '', 'g')"
_FIRST = f"(SELECT substring(n, 1, 1) AS c FROM (SELECT DISTINCT person_name AS n FROM personnel WHERE regexp_matches(person_name, '^[一-鿿]{{2,4}}$')) GROUP BY 1 HAVING count(*) >= 3)"
_IS_NAME = f"(regexp_matches(n, '^[一-鿿]{{2,4}}$') AND (substring(n, 1, 1) IN (SELECT c FROM {_FIRST}) OR contains('{_FAMILY_SQL}', substring(n, 1, 1))) AND NOT regexp_matches(n, '{_NO_NAME_SQL}'))"


@query(f"SELECT person_id, {_IS_NAME} AS is_name FROM (SELECT person_id, {_KEY} AS n FROM {PEOPLE} WHERE person_name IS NOT NULL)")
def person_name_filter(spark, d):
    """Which recorded names can be names of people; family names are the commonest and those that begin several names."""
    rows = _once(spark, d, "personnel", "person_id").where("person_name is not null")
    return rows.select("person_id", names.is_person_name(text.person_key(F.col("person_name")), _family(spark, d)).alias("is_name"))


_ROLE = "CASE WHEN contains(person_role, '法定代表人') THEN 'legal_rep' WHEN contains(person_role, '授权') THEN 'authorized_rep' WHEN contains(person_role, '项目经理') OR contains(person_role, 'project_manager') THEN 'project_manager' WHEN contains(person_role, '技术') THEN 'technical_lead' WHEN contains(person_role, '安全') THEN 'safety' WHEN contains(person_role, '质') THEN 'quality' END"


@query(f"SELECT file_id, n AS name, {_ROLE} AS role_label, count(*) AS n FROM (SELECT file_id, person_role, {_KEY} AS n FROM {PEOPLE} WHERE person_name IS NOT NULL AND file_id IS NOT NULL) WHERE {_IS_NAME} GROUP BY 1, 2, 3")
def staff_tables(spark, d):
    """People of each file rendered as its staff table and read back."""
    rows = _once(spark, d, "personnel", "person_id").where("person_name is not null and file_id is not null")
    phone = F.coalesce(F.array_join("phones", "/"), F.lit(""))
    line = F.concat_ws(" | ", "person_name", F.coalesce("person_role", F.lit("")), phone)
    pages = rows.groupBy("file_id").agg(F.concat(F.lit("项目团队\n姓名 | 职务 | 联系电话\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")).alias("text"))
    found = people.table_people(pages, "file_id", "text", _family(spark, d))
    return found.groupBy("file_id", "name", "role_label").agg(F.count(F.lit(1)).alias("n"))


_NEEDED = "(person_role = '授权代表' OR person_role = '法定代表人' OR person_role = '项目经理')"


@query(f"SELECT person_id, CASE person_role WHEN '授权代表' THEN 'authorized_rep' WHEN '法定代表人' THEN 'legal_rep' ELSE 'project_manager' END AS field, n AS value FROM (SELECT person_id, person_role, {_KEY} AS n FROM {PEOPLE} WHERE {_NEEDED}) WHERE {_IS_NAME}")
def labelled_fields(spark, d):
    """Representatives rendered as labelled lines of a cover and read back by native expressions."""
    rows = _once(spark, d, "personnel", "person_id").where(F.expr(_NEEDED) & F.col("person_name").isNotNull())
    page = F.concat(F.lit("投标函\n"), "person_role", F.when(F.pmod("person_id", F.lit(2)) == 0, "（签字）：__").otherwise("："), "person_name", F.lit("\n联系电话：无\n"))
    return people.labelled_fields(rows.select("person_id", page.alias("text")), "person_id", "text", family=_family(spark, d)).select("person_id", "field", "value").distinct()


@query(f"SELECT person_id, field, n AS value FROM (SELECT person_id, CASE person_role WHEN '授权代表' THEN 'authorized_rep' ELSE 'legal_rep' END AS field, {_KEY} AS n FROM {PEOPLE} WHERE person_role = '授权代表' OR person_role = '法定代表人') WHERE {_IS_NAME} UNION ALL SELECT person_id, 'company', '某某第' || person_id || '工程有限公司' FROM {PEOPLE} WHERE person_role = '法定代表人' AND person_name IS NOT NULL")
def letter_people(spark, d):
    """Representatives rendered as letters of authorisation, names spaced or split over lines, and read back."""
    rows = _once(spark, d, "personnel", "person_id").where("person_role in ('授权代表', '法定代表人') and person_name is not null")
    spaced = F.array_join(F.split("person_name", ""), " ")
    agent = F.concat(F.lit("授权委托书\n兹委托 "), F.when(F.pmod("person_id", F.lit(2)) == 0, spaced).otherwise(F.col("person_name")), F.lit(" 同志为我方代\n理人，负责签署投标文件。\n"))
    legal = F.concat(F.lit("法定代表人资格证明书\n（"), "person_name", F.lit("）系（某某第"), "person_id", F.lit("工程有限公司）的法定代表\n人。\n特此证明\n"))
    pages = rows.select("person_id", F.when(F.col("person_role") == "授权代表", agent).otherwise(legal).alias("text"))
    return people.extracted_people(pages, "person_id", "text", _family(spark, d)).where("field in ('authorized_rep', 'legal_rep', 'company')").select("person_id", "field", "value")


@query(
    f"""WITH p AS (SELECT person_id, id_numbers, emails, bank_accounts FROM {PEOPLE})
SELECT DISTINCT person_id, 'id_number' AS kind, v AS value FROM (SELECT person_id, unnest(id_numbers) AS v FROM p) WHERE regexp_matches(v, '^[0-9]{{17}}[0-9X]$') AND substring(v, 7, 2) IN ('18', '19', '20') AND substring(v, 11, 2) BETWEEN '01' AND '12' AND substring(v, 13, 2) BETWEEN '01' AND '31'
UNION ALL SELECT DISTINCT person_id, 'email', lower(v) FROM (SELECT person_id, unnest(emails) AS v FROM p) WHERE regexp_matches(v, '^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\\.)+[A-Za-z]{{2,}}$')
UNION ALL SELECT DISTINCT person_id, 'bank_account', v FROM (SELECT person_id, unnest(bank_accounts) AS v FROM p) WHERE regexp_matches(v, '^[0-9]{{9,25}}$')"""
)
def extracted_contacts(spark, d):
    """Contacts of people rendered as labelled lines, numbers in groups, and read back in one Arrow pass. Numbers that are
    not of the full form on record are rendered too but not compared."""
    rows = _once(spark, d, "personnel", "person_id")
    lines = lambda column, label, form: F.coalesce(F.array_join(F.transform(F.filter(column, lambda v: v.rlike(form)), lambda v: F.concat(F.lit(label), v)), "\n"), F.lit(""))
    page = F.concat_ws("\n", lines("id_numbers", "身份证号：", "^[0-9]{17}[0-9X]$"), lines("emails", "电子邮箱：", "."), lines("bank_accounts", "账号：", "^[0-9]{9,25}$"))
    found = contacts.extracted_contacts(rows.select("person_id", page.alias("text")), "person_id", "text")
    return found.where("kind in ('id_number', 'email', 'bank_account')")


_SECTION_SQL = {
    "auth_letter": "授权委托书|法定代表人授权书|法人授权书|法人代表授权书|授权书|委托书",
    "legal_rep_proof": "法定代表人(?:[（(]单位负责人[）)])?(?:身份)?证明|法人代表证明|单位负责人证明|法定代表人资格证明",
    "personnel_table": "项目管理机构|项目组成员|主要人员|项目成员|拟投入人员|拟派人员|项目团队|组织机构|人员配备|人员配置|岗位人员|主要管理人员|人员一览表|项目人员|关键人员|人员简历|劳动力计划|技术人员情况|管理人员情况|人员与分工|项目管理班子|项目管理团队|劳动力安排|现场人员|人员到位|项目部人员",
    "qualification": "投标人基本情况表|资格审查资料|投标人资格|企业基本情况|公司简介|单位简介",
    "signature_page": "签字盖章|签章|签字或盖章|盖章签字|法定代表人或其委托代理人|投标人（盖单位章）|（单位公章）|（盖章）",
    "cover_letter": "投标函|投标书|投标文件|报价函",
}


@query(
    f"WITH l AS (SELECT *, min(CASE WHEN regexp_matches(line, '^([一二三四五六七八]、|[1-9]\\.|（[一二三四]）)') THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, max(line_no) OVER (PARTITION BY file_id) AS la FROM {_LINES}) "
    + " UNION ALL ".join(f"SELECT file_id, '{k}' AS kind, line_no AS first_line, coalesce(nx, la + 1) - line_no AS n_lines FROM l WHERE regexp_matches(line, '{p}')" for k, p in _SECTION_SQL.items())
)
def personnel_sections(spark, d):
    """Sections about people in file texts, by kind."""
    out = people.personnel_sections(_once(spark, d, "summarize_file", "file_id"), "file_id", "text")
    return out.select("file_id", "kind", F.col("first_line").cast("long").alias("first_line"), F.col("n_lines").cast("long").alias("n_lines"))


def _glue_sql(c: str) -> str:
    for p in text.PHRASES:
        c = f"regexp_replace({c}, '{'[ \\t\\n\\r\\x0b\\x0c]*'.join(p)}', '{p}', 'g')"
    return c


@query(f"SELECT file_id, md5({_glue_sql('text')}) AS glued, md5(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(12288), '  '), '[ \\t\\n\\r\\x0b\\x0c]+([：:，,。；;、）)])', '\\1', 'g'), '([（(])[ \\t\\n\\r\\x0b\\x0c]+', '\\1', 'g'), ' {{2,}}', ' ', 'g')) AS tight FROM (SELECT file_id, translate(text, '　' || chr(160), '') AS text FROM {FILES}) AS f")
def text_repairs(spark, d):
    """Split words put together again and padding around marks away, in all file texts."""
    rows = _once(spark, d, "summarize_file", "file_id").select("file_id", F.translate("text", "　\xa0", "").alias("text"))
    return rows.select("file_id", F.md5(text.glued("text")).alias("glued"), F.md5(text.tightened(F.col("text"))).alias("tight"))


@query(f"SELECT match_id, regexp_replace(regexp_replace(translate(text, '萬億貳陸圓', '万亿贰陆圆'), '(?i)\\bcny\\b', 'CNY', 'g'), '(?i)\\brmb\\b', 'RMB', 'g') AS plain FROM {SEGMENTS}")
def money_forms(spark, d):
    """Currency codes and traditional numerals of all segments in one form."""
    return _once(spark, d, "matches", "match_id").select("match_id", text.plain_money(F.col("text")).alias("plain"))


# --- properties and findings on the tables


_RECORDS = f"""(SELECT bid_group AS g, min(CASE WHEN person_role = '法定代表人' THEN {_KEY} END) AS creator, max({_KEY}) AS last_modified_by, min(CASE WHEN confidence >= 0.9 THEN 'WPS Office' ELSE 'Microsoft Word' END) AS application FROM {PEOPLE} WHERE bid_group IS NOT NULL AND person_name IS NOT NULL GROUP BY bid_group)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Properties of each bidder's files as its people would have left them."""
    rows = _once(spark, d, "personnel", "person_id").where("bid_group is not null and person_name is not null").withColumn("n", text.person_key(F.col("person_name")))
    return rows.groupBy(F.col("bid_group").alias("group")).agg(F.min(F.when(F.col("person_role") == "法定代表人", F.col("n"))).alias("creator"), F.max("n").alias("last_modified_by"), F.min(F.when(F.col("confidence") >= 0.9, "WPS Office").otherwise("Microsoft Word")).alias("application"))


@query(f"""SELECT kind, value, count(*) AS n_groups, min(g) AS first_group FROM (SELECT g, 'creator' AS kind, creator AS value FROM {_RECORDS} UNION ALL SELECT g, 'last_modified_by', last_modified_by FROM {_RECORDS} UNION ALL SELECT g, 'application', application FROM {_RECORDS}) WHERE value <> '' GROUP BY kind, value HAVING count(*) > 1""")
def property_classes(spark, d):
    """Properties that several bidders' files have in common, as classes."""
    tidy = pairs.tidy_fields(_records(spark, d), "group", ["creator", "last_modified_by", "application"])
    return pairs.shared_values(tidy).select("kind", "value", "n_groups", "first_group")


@query(
    f"""WITH r AS (SELECT * FROM {_RECORDS}), a AS (SELECT DISTINCT bid_group AS g, {_KEY} AS v FROM {PEOPLE} WHERE person_role = '授权代表' AND bid_group IS NOT NULL AND person_name IS NOT NULL)
SELECT type, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT 'authorized_rep_is_creator' AS type, a.g AS l, r.g AS r, v AS value FROM a JOIN r ON r.creator = a.v AND r.g <> a.g
UNION ALL SELECT 'same_authorized_rep', x.g, y.g, x.v FROM a AS x JOIN a AS y ON x.v = y.v AND x.g < y.g UNION ALL SELECT 'same_last_modifier', x.g, y.g, x.last_modified_by FROM r AS x JOIN r AS y ON x.last_modified_by = y.last_modified_by AND x.g < y.g) GROUP BY type"""
)
def representative_findings(spark, d):
    """Representatives who made another's file, who stand for several bidders, and files saved by one person."""
    rows = _once(spark, d, "personnel", "person_id").where("person_role = '授权代表' and bid_group is not null and person_name is not null")
    reps = rows.select(F.col("bid_group").alias("group"), text.person_key(F.col("person_name")).alias("value"))
    found = findings.representative_findings(reps, _records(spark, d))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


_TIDY = f"(SELECT DISTINCT g, kind, value FROM (SELECT bid_group AS g, 'phone' AS kind, unnest(phones) AS value FROM {PEOPLE} UNION ALL SELECT bid_group, 'email', unnest(emails) FROM {PEOPLE}) WHERE g IS NOT NULL AND trim(value, ' ') <> '')"


_TIDY_PEOPLE = f"(SELECT DISTINCT g, kind, value FROM (SELECT g, kind, value FROM {_TIDY} UNION ALL SELECT bid_group, 'person', {_KEY} FROM {PEOPLE} WHERE person_name IS NOT NULL AND bid_group IS NOT NULL))"


@query(f"SELECT CASE kind WHEN 'person' THEN 0 WHEN 'phone' THEN 1 ELSE 3 END AS kind_order, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS place, kind, value, n AS n_groups FROM (SELECT kind, value, count(*) AS n FROM {_TIDY_PEOPLE} GROUP BY kind, value HAVING count(*) > 1)")
def shared_value_order(spark, d):
    """Shared names, phones and addresses in the order a reader sees them: by kind, then by how many bidders share them."""
    return findings.shared_rows(_tidy_people(spark, d)).withColumn("place", F.col("place").cast("long"))


def _tidy_people(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "personnel", "person_id").withColumn("names", F.array(text.person_key(F.col("person_name"))))
    return pairs.tidy_pools(rows, "bid_group", {"phones": "phone", "emails": "email", "names": "person"})


@query(f"""SELECT 'same_' || kind AS type, value, min(l) AS "left", count(*) AS n_pairs FROM (SELECT x.kind, x.value, x.g AS l, y.g AS r FROM {_TIDY_PEOPLE} AS x JOIN {_TIDY_PEOPLE} AS y ON x.kind = y.kind AND x.value = y.value AND x.g < y.g) GROUP BY kind, value, CASE WHEN kind = 'person' THEN l || r END""")
def first_pair_findings(spark, d):
    """Of each shared contact the first pair of bidders and how many pairs share it; shared names by pair."""
    found = findings.contact_findings(_tidy_people(spark, d))
    return findings.first_pairs(found).select("type", "value", "left", "n_pairs")


@query(f"SELECT file_id, '投标文件比对报告_' || substring(display_name, 1, 40) || '_' || strftime(modified_at, '%Y%m%d_%H%M%S') || '.docx' AS name FROM {FILES} WHERE regexp_matches(display_name, '^[一-鿿A-Za-z0-9_.]+$') AND modified_at IS NOT NULL")
def report_names(spark, d):
    """The names that reports about all files would have."""
    rows = _once(spark, d, "summarize_file", "file_id").where(F.col("display_name").rlike("^[一-鿿A-Za-z0-9_.]+$") & F.col("modified_at").isNotNull())
    return rows.select("file_id", findings.report_name(F.col("display_name"), F.lit(None).cast("string"), F.col("modified_at")).alias("name"))


# --- templates

_FORM = lambda c: f"translate(regexp_replace(regexp_replace({c}, '{text.TOC_DOTS}', '', 'g'), '{text.SKIPPED}', '', 'g'), '{text.FOLD_FROM.replace(chr(39), chr(39) * 2)}', '{text.FOLD_TO.replace(chr(39), chr(39) * 2)}')"
_LINE_FORMS = f"(SELECT source, doc_id, {_FORM('line')} AS form FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL))"


@query(
    f"""WITH l AS (SELECT * FROM {_LINE_FORMS}), w AS (SELECT source, form FROM l WHERE length(form) >= 30 GROUP BY source, form HAVING count(DISTINCT doc_id) >= 3), s AS (SELECT DISTINCT source, form FROM l WHERE length(form) >= 20)
SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM w WHERE w.source = s.source AND (contains(w.form, s.form) OR contains(s.form, w.form)))) AS n_template FROM s GROUP BY source"""
)
def template_subtraction(spark, d):
    """Different lines of each source's documents, and how many of them are lines that three of its documents have, stand in
    such a line or hold one."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text", "source")).where("text is not null and source is not null")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", text.match_form(F.col("line")).alias("form")).where(F.length("form") >= 20)
    windows = lines.where(F.length("form") >= 30).groupBy("source", "form").agg(F.countDistinct("doc_id").alias("n")).where("n >= 3").withColumnRenamed("source", "scope")
    rows = lines.select("source", "form").distinct().withColumn("id", F.struct("source", "form"))
    held = segments.in_template(rows, "id", "source", "form", windows).select("id.source", "id.form").withColumn("held", F.lit(1))
    return rows.join(held, ["source", "form"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.count("held").alias("n_template"))


def queries() -> dict[str, object]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
