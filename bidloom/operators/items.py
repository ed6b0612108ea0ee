"""Priced items and costs of bids: tables with bars by native operators, tables flattened into running text and cost lines
by one Arrow pass, and the row that states their total."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.amounts import is_day, parsed_amount
from bidloom.operators.layout import pipe_rows
from bidloom.operators.quotes import readable

# Words in headers of price tables, by column, the first that fits.
COLUMNS = (
    ("no", "序 *号"),
    ("tax", "税 *率"),
    ("unit_price", "单 *价"),
    ("total_ex", "(?:不含税|税前).{0,4}(?:总价|金额|合价|价)|(?:总价|金额|合价).{0,3}不含税"),
    ("total_in", "(?:含税|税后).{0,4}(?:总价|金额|合价|价)|(?:总价|金额|合价).{0,3}含税"),
    ("total_ex", "总 *价|合 *价|金 *额|小 *计|价格|报价"),
    ("qty", "数 *量|工程量"),
    ("unit", "单 *位"),
    ("name", "名 *称|分项|产品|服务|项目|内容|元器件"),
    ("model", "型号|规格|厂家|制造商|品牌|备注"),
)
FIELDS = ("name", "unit", "qty", "unit_price", "total_ex", "total_in", "tax")
HEADER_WORDS = "序号|名称|分项|数量|单位|单价|总价|税率|型号|规格|厂家|备注|产品|服务"
# Words that speak for and against a table of prices, and what each is worth.
FOR_PRICES, FOR_WORTH = ("单价", "总价", "税率", "金额", "价格", "报价", "不含税", "含税"), 3
AGAINST_PRICES, AGAINST_WORTH = ("出差事由", "合同金额", "项目名称", "职务", "岗位", "职称", "联系人", "联系电话", "项目经理", "指标要求", "功能要求"), -2
# Names that are no priced item.
NO_ITEM = (
    "经理|工程师|工人|主任|主管|专员|总监|总裁|董事长|秘书|助理|合同|协议|订单|项目 *名称|供应商|投标人|采购人|灵敏度|dB|MHz|GHz|指标 *要求|功能 *要求"
    "|验收测试|测试评审|联通测试|差旅|交通|住宿|会议内容|出差|^其他$|^无$|^备注$|^说明$|^小计$|硬件费用|软件费用|其他费用|有限公司|有限责任|公司|集团|大学|学院|研究所"
)
TOTAL_WORDS = "^(合计|总价|小计|总计|注：)"
# What names of costs end in, and what they are not.
COST_WORDS = (
    "费|成本|支出|投入|工资|薪酬|酬金|折旧|摊销|租赁|租金|维护|保养|检测|试验|测试|设计|开发|研制|采购|运输|差旅|会议|培训|办公|印刷|咨询|审计|评估|保险|税费|利息|手续费|管理|服务|劳务|材料|设备|仪器|软件"
    "|许可|专利|著作|技术|外协|加工|燃料|动力|事务|不可预见|预备|风险|收益|利润|税金|公积金|基金"
)
NO_COST = re.compile("项目预计成本|预计成本|小计|合计|总价|总计|委员会|协会|公司|有限|集团|事务所|证监会|财政部|(?:师|人|员|专家)$|成立于|于$|成为|自$|见后附|次会议|授权|证书|编号|注册|登记|代码|序列|评估项目|\\d{4}")
PAST_WORK = re.compile("合同金额|合同价款|签约合同价|业绩一览|类似项目|项目业绩|业绩证明")
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_COST_WORD = re.compile(COST_WORDS)
_FIRST_HAN, _HAN = re.compile("[一-鿿]"), re.compile("[一-鿿]+")


def column_of(header: Column) -> Column:
    """Which column of a price table a header cell names; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(COLUMNS):
        out = F.when(header.rlike(words), name).otherwise(out)
    return out


def region_scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, region, score): how much a table's words and large numbers speak for prices; rows: of layout.pipe_rows."""
    t = rows.groupBy(key, "region").agg(F.array_join(F.collect_list(F.array_join("cells", " | ")), "\n").alias("t"))
    words = sum((F.when(F.contains("t", F.lit(w)), n).otherwise(0) for ws, n in ((FOR_PRICES, FOR_WORTH), (AGAINST_PRICES, AGAINST_WORTH)) for w in ws), F.lit(0))
    large = F.least(F.lit(10), F.regexp_count(F.col("t"), F.lit(r"\b[0-9]{5,}(?:\.[0-9]{2})?\b")))
    return t.select(key, "region", (words + large).cast("int").alias("score"))


def _is_header(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.rlike(HEADER_WORDS)) & ~F.exists(cells, lambda c: c.rlike(r"[0-9]{4,}|^[0-9]+[0-9.,]*\z"))


def headed_cells(rows: DataFrame, key: str) -> DataFrame:
    """(key, region, row_no, i, header, value): the cells below a table's header. A header may go on over several rows:
    all rows at the top of a region that hold header words and neither a long number nor a cell of figures only; their cells are put together."""
    up = Window.partitionBy(key, "region").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_top", F.min(F.when(_is_header(F.col("cells")), 1).otherwise(0)).over(up))
    cells = marked.select(key, "region", "row_no", "_top", F.posexplode("cells").alias("i", "value")).withColumn("value", F.trim("value"))
    parts = F.array_sort(F.collect_list(F.struct("row_no", "value")))
    heads = cells.where("_top = 1 and value <> ''").groupBy(key, "region", "i").agg(F.array_join(F.array_distinct(F.transform(parts, lambda p: p.getField("value"))), "").alias("header"))
    return cells.where("_top = 0").select(key, "region", "row_no", "i", "value").join(heads, [key, "region", "i"])


def amount_of(c: Column) -> Column:
    """The number in a cell without Python; 万 after it multiplies."""
    bare = F.regexp_replace(c, "[,， ]", "")
    n = F.regexp_extract(bare, r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(n != "", n.cast("double") * F.when(bare.rlike(r"[0-9]元?万"), 10_000.0).otherwise(1.0))


def pipe_items(texts: DataFrame, key: str, text: str, least_score: int = 5) -> DataFrame:
    """(key, region, row_no, name, unit, qty, unit_price, total_ex, total_in, tax) of tables with bars that are about
    prices. An empty name is that of the row above; rows of totals, groups without a price and names that are no item
    are left out, and so are rows whose unit price is above 1.5 times their total."""
    rows = pipe_rows(texts, key, text)
    scored = region_scores(rows, key).where(F.col("score") >= least_score).select(key, "region")
    cells = headed_cells(rows.join(scored, [key, "region"], "left_semi"), key).withColumn("field", column_of(F.col("header"))).where("field is not null")
    by = [key, "region", "row_no"]
    first = {f: F.min_by("value", F.when(F.col("field") == f, F.col("i"))) for f in FIELDS}
    wide = cells.groupBy(*by).agg(*[c.alias(f) for f, c in first.items()], F.max(F.when(F.col("field").isin("no", "name") & F.col("value").rlike(TOTAL_WORDS), 1)).alias("_sum"))
    down = Window.partitionBy(key, "region").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim(F.regexp_replace("name", r"^[0-9]+(?:\.[0-9]+)*[.、 ]+", ""))
    wide = wide.withColumn("name", F.last(F.when((bare != "") & F.col("_sum").isNull(), bare), ignorenulls=True).over(down))
    numbers = [amount_of(F.col(f)).alias(f) for f in ("qty", "unit_price", "total_ex", "total_in")]
    tax = F.regexp_extract(F.translate("tax", "％", "%"), "([0-9]+(?:\\.[0-9]+)?)", 1)
    out = wide.where("_sum is null").select(*by, "name", F.when(F.trim("unit") != "", F.col("unit")).alias("unit"), *numbers, F.when(tax != "", tax.cast("double")).alias("tax"))
    total = F.coalesce("total_ex", "total_in")
    return out.where((F.length("name") >= 2) & ~F.col("name").rlike(NO_ITEM) & (total > 0) & (F.col("unit_price").isNull() | (F.col("unit_price") <= 1.5 * total)))


def summary_totals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, total_ex, total_in): the first row of sums in a table with bars, its last two large amounts; a single one
    counts for both. Words of sums come first in the order 总计, 合计, 总价, 小计."""
    order = F.when(F.col("c") == "总计", 0).when(F.col("c") == "合计", 1).when(F.col("c") == "总价", 2).when(F.col("c") == "小计", 3)
    rows = pipe_rows(texts, key, text).withColumn("c", F.regexp_extract(F.array_join("cells", "|"), r"(?:^|\|)[ ]*(总计|合计|总价|小计)[ ]*\|", 1)).where("c <> ''")
    large = F.filter(F.transform("cells", lambda c: F.coalesce(amount_of(c), F.lit(0.0))), lambda v: v >= 10_000)
    rows = rows.withColumn("large", large).where(F.size("large") > 0)
    best = rows.groupBy(key).agg(F.min_by("large", F.struct(order, F.col("line_no"))).alias("l"))
    n = F.size("l")
    return best.select(key, F.when(n > 1, F.element_at("l", -2)).otherwise(F.element_at("l", -1)).alias("total_ex"), F.element_at("l", -1).alias("total_in"))


# --- running text


def _columns(header: str) -> list[str]:
    """The columns of a flattened table in the order of its header's words; words that name none are left out."""
    named = (next((name for name, words in COLUMNS if re.search(words, word)), None) for word in header.split())
    return [c for c in named if c]


def flattened_items(text: str) -> Iterator[tuple[str, float | None, float | None, float | None, float | None, float | None]]:
    """(name, qty, unit_price, total_ex, total_in, tax) of a table whose cells are apart by blanks only. Its header is the
    first line with three column words. A line without an amount is the beginning of the next row's name; a line of
    figures only goes on with the row before. The figures of a row fill the numeric columns of the header from the right."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if "|" not in x and sum(w in x for w in ("序号", "名称", "型号", "规格", "数量", "单价", "总价", "税率", "备注")) >= 3), None)
    if at is None:
        return
    numeric = [c for c in _columns(lines[at]) if c in ("qty", "unit_price", "total_ex", "total_in", "tax")]
    numeric = [("total_in" if c == "total_ex" and c in numeric[:i] else c) for i, c in enumerate(numeric)]
    rows: list[list[str]] = []
    waiting = ""
    for line in (x.strip() for x in lines[at + 1 :]):
        if re.match(f"{TOTAL_WORDS}|^备注：|^[三四五六七八九十]、", line):
            break
        if not line or re.fullmatch(r"\d{1,3}", line) or "|" in line:
            continue
        if re.fullmatch(r"[\d\s.,%％‰\\/万元（）()-]+", line) and rows and not waiting:
            rows[-1][1] += " " + line
        elif re.search(r"\d{4,}|\d[\d,]{4,}|[\d.]+\s*万", line):
            rows.append([waiting, line])
            waiting = ""
        else:
            waiting += line
    for name, data in rows:
        data = re.sub(r"^\d{1,3}\s+", "", data)
        words = data.split()
        figures = [w for w in words if re.fullmatch(rf"[¥￥]?{_NUMBER}\s*(?:万元?|元)?|\d{{1,2}}(?:\.\d+)?[%％]?", w)]
        text_part = [w for w in words[: next((i for i, w in enumerate(words) if w in figures), len(words))]]
        name = re.sub(r"^\d+\s*", "", name) + (text_part[0] if text_part else "")
        values = [parsed_amount(w) or 0.0 for w in figures]
        if len(name) < 2 or re.search(NO_ITEM, name) or sum(v >= 100 for v in values) < 2:
            continue
        row = dict(zip(reversed(numeric), reversed(values), strict=False))
        if (row.get("unit_price") or 0) <= 1.5 * (row.get("total_ex") or row.get("total_in") or 0):
            yield name, row.get("qty"), row.get("unit_price"), row.get("total_ex"), row.get("total_in"), row.get("tax")


def _numbered(head: str) -> bool:
    """Whether what stands before a name is nothing but numbering: figures, numerals and marks."""
    return len(head) <= 8 and not head.strip(" \t0123456789.、()（）一二三四五六七八九十")


def cost_lines(text: str) -> Iterator[tuple[int, str, float, bool]]:
    """(place, name, amount, whether it is income) of lines that name a cost and its amount, each name once. The amount
    stands behind the name, or alone on the next line. Tables of earlier work, years, days, small figures and names of
    bodies or people are none; an amount needs its currency on the line or in the next 30 characters, unless bars or the
    words 本项目 … 为 mark it as a cell."""
    lines = text.split("\n")
    seen: set[str] = set()
    place = 0
    for line, following in zip(lines, [*lines[1:], ""], strict=True):
        at, place = place, place + len(line) + 1
        bare = re.sub(r"^\s*[（(][一二三四五六七八九十\d]+[）)]|^\s*\d+(?:\.\d+)*[.、]?", "", line)
        first = _FIRST_HAN.search(bare)
        if not first or not _numbered(bare[: first.start()]):
            continue
        run = _HAN.match(bare, first.start())[0]
        rest = bare[first.start() + len(run) :]
        name = run.removeprefix("本项目").removesuffix("为")
        if name in seen or len(name) > 15 or not _COST_WORD.search(name) or NO_COST.search(name):
            continue
        alone = not rest.strip(" \t：:")
        m = re.match(rf"[ \t]*(?P<bar>\|?)[ \t：:]*(?P<n>{_NUMBER})[ \t]*(?P<u>万?)(?P<y>元?)", following if alone else rest)
        if not m or alone and following[m.end() :].strip():
            continue
        value = parsed_amount(m["n"] + m["u"]) or 0.0
        cell = bool(m["bar"]) or run.startswith("本项目") and run.endswith("为")
        behind = (following if alone else rest)[m.end() :] + ("\n" + following if not alone else "")
        stated = m["u"] or m["y"] or cell or re.search("[元万￥¥]|CNY|RMB", behind[:30])
        small = not m["u"] and not cell and (len(re.sub(r"\D", "", m["n"])) < 4 or 1990 <= value <= 2030 or 500 <= value <= 999)
        if small or not stated or value < 100 or is_day(value) and not m["u"] or PAST_WORK.search(text, max(0, at - 300), at):
            continue
        seen.add(name)
        yield at, name, value, "收益" in name or "利润" in name


def text_items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, place, name, qty, unit_price, total_ex, total_in, tax): items of flattened tables (source "table"),
    costs ("cost") and incomes ("income") in running text, in one Arrow pass. Null and empty texts have none."""
    names = ["source", "place", "name", "qty", "unit_price", "total_ex", "total_in", "tax"]

    def rows(t: str) -> Iterator[tuple]:
        whole = readable(t)
        for i, (name, qty, unit, ex, inc, tax) in enumerate(flattened_items(whole)):
            yield "table", i, name, qty, unit, ex, inc, tax
        for place, name, value, income in cost_lines(whole):
            yield "income" if income else "cost", place, name, None, None, value, value, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *r) for k, t in zip(batch["k"], batch["t"], strict=True) for r in rows(t)]
            yield pd.DataFrame(out, columns=[key, *names]).astype({c: "float64" for c in names[3:]})

    kind = dict(texts.dtypes)[key]
    found = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''").mapInPandas(run, f"{key} {kind}, source string, place int, name string, qty double, unit_price double, total_ex double, total_in double, tax double")
    for c in names[3:]:
        found = found.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return found


def line_items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, place, name, unit, qty, unit_price, total_ex, total_in, tax): all priced items and costs."""
    pipes = pipe_items(texts, key, text).select(key, F.lit("pipe").alias("source"), (F.col("region") * 100_000 + F.col("row_no")).cast("int").alias("place"), "name", "unit", "qty", "unit_price", "total_ex", "total_in", "tax")
    return pipes.unionByName(text_items(texts, key, text).withColumn("unit", F.lit(None).cast("string")))
