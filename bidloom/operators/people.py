"""People and labelled fields in bid texts: tables of staff, labels of forms, letters of authorisation, rows of names and
functions, and the sections they stand in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.contacts import contacts, response_date
from bidloom.functions.names import FAMILY, FUNCTIONS, MEMBERS, NameTest, clean_company, clean_name, function_label, is_person_name, role_label
from bidloom.functions.text import BLANKS, joined_digits, person_key
from bidloom.operators.layout import cell_values, lines, pipe_rows

# Words in the header of a staff table, and labels in letters, covers and signature pages.
COLUMNS = (("name", "姓 *名|人员名称|拟投入.{0,6}人员|主要人员|关键人员|项目人员|名字|^人员$"), ("phone", "电话|手 *机|联系方式"), ("id_number", "身 *份 *证|证件号码"), ("role", "职 *务|岗 *位|拟任|担任|职位|角 *色|职 *称|职 *责"))
LABELS = {
    "legal_rep": "法定代表人|法人代表",
    "authorized_rep": "授权代表|授权委托人|委托代理人|被授权人",
    "project_manager": "项目经理|项目负责人",
    "contact": "联系人",
    "company": "投标人|供应商|投标单位|单位名称",
}
# What begins a section about people, by kind, and how the next section begins.
SECTIONS = (
    ("auth_letter", "授权委托书|法定代表人授权书|法人授权书|法人代表授权书|授权书|委托书"),
    ("legal_rep_proof", "法定代表人(?:[（(]单位负责人[）)])?(?:身份)?证明|法人代表证明|单位负责人证明|法定代表人资格证明"),
    ("personnel_table", "项目管理机构|项目组成员|主要人员|项目成员|拟投入人员|拟派人员|项目团队|组织机构|人员配备|人员配置|岗位人员|主要管理人员|人员一览表|项目人员|关键人员|人员简历|劳动力计划|技术人员情况|管理人员情况|人员与分工|项目管理班子|项目管理团队|劳动力安排|现场人员|人员到位|项目部人员"),
    ("qualification", "投标人基本情况表|资格审查资料|投标人资格|企业基本情况|公司简介|单位简介"),
    ("signature_page", "签字盖章|签章|签字或盖章|盖章签字|法定代表人或其委托代理人|投标人（盖单位章）|（单位公章）|（盖章）"),
    ("cover_letter", "投标函|投标书|投标文件|报价函"),
)
NEXT_SECTION = "^([一二三四五六七八]、|[1-9]\\.|（[一二三四]）)"


def _column(header: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(COLUMNS):
        out = F.when(header.rlike(words), name).otherwise(out)
    return out


def table_people(texts: DataFrame, key: str, text: str, family: str = FAMILY) -> DataFrame:
    """(key, region, row_no, name, role, role_label, phones, id_number) of staff tables: tables whose header names a
    column of names. An empty name cell is that of the row above; rows without a proper name are left out."""
    cells = cell_values(pipe_rows(texts, key, text), key).withColumn("field", _column(F.col("header"))).where("field is not null")
    by = [key, "region", "row_no"]
    rows = cells.groupBy(*by).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f, _ in COLUMNS]).where("name is not null")
    down = Window.partitionBy(key, "region").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("name", person_key(F.last(F.when(F.trim("name") != "", F.col("name")), ignorenulls=True).over(down)))
    phones = F.array_distinct(F.regexp_extract_all(joined_digits(F.coalesce("phone", F.lit(""))), F.lit("(1[3-9][0-9]{9})"), 1))
    return rows.where(is_person_name(F.col("name"), family)).select(*by, "name", "role", role_label(F.col("role")).alias("role_label"), phones.alias("phones"), F.upper(joined_digits(F.col("id_number"))).alias("id_number"))


def labelled_fields(texts: DataFrame, key: str, text: str, labels: dict[str, str] = LABELS, family: str = FAMILY) -> DataFrame:
    """(key, field, value, place): what stands after each label, on its line or the next, in the order of the text.
    Blanks inside names and bracketed hints after the label are away; persons must have the form of a name, companies
    at least six characters. Native expressions only: one extraction a label."""
    value = f"[{BLANKS}_＿]*((?:[^\\n：:，,。；;|（(]){{2,40}})"
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract_all(F.col(text), F.lit(f"(?:{w})(?:[（(][^）)\\n]{{0,12}}[)）])?[{BLANKS}]*[：:]{value}"), 1).alias("v")) for f, w in labels.items()]))
    found = texts.where(F.col(text).isNotNull()).select(key, each.alias("x")).select(key, "x.field", F.posexplode("x.v").alias("place", "raw"))
    bare = F.regexp_replace(F.regexp_replace("raw", f"[{BLANKS}_＿]+", ""), "(盖章|签字|盖单位章|身份证|电话|日期|职务|地址).*$", "")
    ok = F.when(F.col("field") == "company", F.length("value") >= 6).otherwise(is_person_name(F.col("value"), family))
    return found.withColumn("value", bare).where(ok).select(key, "field", "value", "place")


def personnel_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, first_line, n_lines): sections about people, each from the line that names one to the next numbered
    heading or the end. A line that names several kinds begins one of each."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines(texts, key, text)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.min(F.when(F.col("line").rlike(NEXT_SECTION), F.col("line_no"))).over(ahead)).withColumn("_last", F.max("line_no").over(Window.partitionBy(key)))
    kinds = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in SECTIONS]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(kinds).alias("kind"), F.col("line_no").alias("first_line"), (F.coalesce("_next", F.col("_last") + 1) - F.col("line_no")).alias("n_lines"))


# --- people in running text

_LABEL = re.compile(
    r"(?P<sign>法定代表人或其?(?:委托|授权)代理人)|(?P<legal>法定代表人|法人代表)|(?P<agent>授权委托代理人|委托代理人|授权委托人|授权代表人?|被授权人|受托人|签字代表|投标代表|代理人)"
    r"|(?P<contact>联系人)|(?P<name>姓\s*名)|(?P<duty>(?:现任|拟任|任中|担任)?[职職][务務]|岗位|角色)|(?P<company>投标人名称|供应商名称|单位名称|公司名称|企业名称|投标人|供应商|投标单位)"
    r"|(?P<other>性\s*别|年\s*龄|联系电话|移动电话|电话|手机|传真|邮箱|邮编|地址|身份证号?码?|学历|职称|日期|盖章|签字)"
)
_AFTER_LABEL = re.compile(r"(?:\s*[（(][^）)\n]{0,14}[）)])?(?P<sep>\s*[：:][_＿\s]*|[_＿]+|[ \t]+)")
_PERSON = "[一-鿿]{2,4}?|[一-鿿]{2,4}(?:[·•・][一-鿿]{2,4}){1,2}"
_FORM_NAME = r"(?:[（(]姓名[）)])?"
_HEADING = re.compile(r"^\s*(?:[一二三四五六七八九十]{1,3}、|第.{1,3}章)?\s*\S{0,10}(?:委托书|授权书|证明书?|投标函)\s*$", re.M)
_LEGAL = re.compile(rf"(?:本人(?P<a>{_PERSON}){_FORM_NAME}|[（(](?P<b>{_PERSON})[）)]{_FORM_NAME}|(?P<c>{_PERSON})[（(]姓名[）)])系")
_COMPANY = re.compile(r"系[（(]?(?P<c>[^，。；：（()）]{4,40}?)[）)]?(?:[（(][^）)]{0,12}[）)]?)?的(?:法定代表人|法人代表)")
_AGENT = re.compile(rf"(?:委托|授权|委派|委任)(?P<n>{_PERSON}){_FORM_NAME}(?:同志|先生|女士)?为(?:我方|我单位|我公司|本公司|本单位|我)?[^，。]{{0,8}}?(?:代理|代表)")
_FUNCTION_WORDS = frozenset([w for w, _ in FUNCTIONS] + list(MEMBERS))
_DUTY_END = re.compile("(?:职务|職務|岗位|崗位|角色|职责|職責|分工)$")
GATE = re.compile("姓|法定|法人|委托|授权|委派|委任|职务|联系人|负责人|经理|工程师|总监|员|投标人|供应商|单位名称|地址|日期")


def _value(text: str, at: int) -> str:
    """What a label's value may be: up to the next label, mark or line end."""
    end = re.search(r"[，,。；;|\n]|$", text[at:]).start() + at
    following = _LABEL.search(text, at, end)
    return text[at : following.start() if following else end]


def _person(value: str, is_name: NameTest) -> str | None:
    """The name that a value begins with: its first word, or single ideographs apart put together."""
    bare = value.strip("_＿ \t　：:（(）)")
    parts = bare.split()
    if not parts:
        return None
    spaced = []
    for p in parts:
        if len(p) > 1:
            break
        spaced.append(p)
    for candidate in ("".join(spaced), parts[0], "".join(parts[:2]) if len(parts[0]) == 1 else "", bare):
        name = clean_name(candidate)
        if name and is_name(name):
            return name
    return None


def _from_labels(text: str, is_name: NameTest) -> Iterator[tuple[str, str, str | None, float]]:
    pending: str | None = None  # a name whose function may follow on a later line
    proof = bool(re.search("身份证明|资格证明", text))
    for m in _LABEL.finditer(text):
        after = _AFTER_LABEL.match(text, m.end())
        if not after or m.start() and m.lastgroup in ("legal", "company") and text[m.start() - 1] in "的其或":
            continue
        if m.lastgroup == "company":
            if "：" in after[0] or ":" in after[0]:
                name = clean_company(text[after.end() :].split("\n", 1)[0])
                if len(name) >= 4 and re.fullmatch(r"[一-鿿A-Za-z0-9（）()·&\-]{4,40}", name) and not re.match("盖|（|签", name):
                    yield "company", name, None, 0.85
            continue
        value = _value(text, after.end())
        if m.lastgroup == "duty":
            role = next((w for w in sorted(_FUNCTION_WORDS, key=len, reverse=True) if value.strip().startswith(w)), None)
            if role and pending:
                yield "person", pending, function_label(role), 0.8
                pending = None
            continue
        name = _person(value, is_name) if m.lastgroup != "other" else None
        if m.lastgroup == "name":
            pending = name
        if not name:
            continue
        if m.lastgroup == "legal" or m.lastgroup == "name" and proof:
            yield "legal_rep", name, "legal_rep", 0.9
        elif m.lastgroup == "agent":
            yield "authorized_rep", name, "authorized_rep", 0.9
        elif m.lastgroup == "contact":
            yield "person", name, "bid_contact", 0.8
        elif m.lastgroup == "sign":
            yield "person", name, "signatory", 0.75
        elif m.lastgroup == "name":
            yield "person", name, None, 0.7


def _from_letters(text: str, is_name: NameTest) -> Iterator[tuple[str, str, str | None, float]]:
    compact = re.sub(r"[\s_＿]+", "", _HEADING.sub("", text))
    for m in _LEGAL.finditer(compact):
        name = clean_name(m["a"] or m["b"] or m["c"])
        if is_name(name):
            yield "legal_rep", name, "legal_rep", 0.95
    for m in _COMPANY.finditer(compact):
        company = clean_company(m["c"])
        if len(company) >= 4 and "名称" not in company:
            yield "company", company, None, 0.95
    for m in _AGENT.finditer(compact):
        name = clean_name(m["n"])
        if is_name(name):
            yield "authorized_rep", name, "authorized_rep", 0.95


def _from_rows(text: str, is_name: NameTest) -> Iterator[tuple[str, str, str | None, float]]:
    """Names and functions that stand on one line: a function belongs to the name before it, or on lines that begin with
    a function to the name after it. Never across lines."""
    for line in text.split("\n"):
        if "|" in line or len(line) > 120 or "。" in line:
            continue
        marks: list[tuple[str, str]] = []
        for token in re.split(r"[\s、：:，,（）()/]+", line):
            if token in _FUNCTION_WORDS:
                marks.append(("function", token))
            elif token and not _DUTY_END.search(token) and is_name(token):
                marks.append(("name", token))
        if len({k for k, _ in marks}) < 2:
            continue
        for (a, x), (b, y) in zip(marks, marks[1:], strict=False) if marks[0][0] == "name" else zip(marks[::2], marks[1::2], strict=False):
            if a != b and a == marks[0][0]:
                name, role = (x, y) if a == "name" else (y, x)
                yield "person", name, function_label(role), 0.8


def people_of(raw: str, is_name: NameTest | None = None) -> list[tuple[str, str, str | None, float]]:
    """(field, value, role, confidence) of a text: legal_rep, authorized_rep, company, person, phone, address,
    response_date; each once, the most certain first."""
    from bidloom.operators.quotes import readable

    is_name = is_name or NameTest()
    text = readable(raw)
    out = [*_from_letters(text, is_name), *_from_labels(text, is_name), *_from_rows(text, is_name)]
    out += [(kind, value, None, 0.9) for kind, value in contacts(text) if kind in ("phone", "address")]
    if day := response_date(text):
        out.append(("response_date", day, None, 0.9))
    best: dict[tuple[str, str, str | None], float] = {}
    for f, v, r, c in out:
        best[f, v, r] = max(c, best.get((f, v, r), 0.0))
    known = {v for (f, v, r) in best if r}
    return [(f, v, r, c) for (f, v, r), c in best.items() if r or f != "person" or v not in known]


def text_people(texts: DataFrame, key: str, text: str, family: str = FAMILY) -> DataFrame:
    """(key, field, value, role, confidence) of running texts, in one Arrow pass over those that hold any such word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_name = NameTest(family)
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch["k"], batch["t"], strict=True) if GATE.search(t) for r in people_of(t, is_name)]
            yield pd.DataFrame(rows, columns=[key, "field", "value", "role", "confidence"])

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''").mapInPandas(run, f"{key} {kind}, field string, value string, role string, confidence double")


def extracted_people(texts: DataFrame, key: str, text: str, family: str = FAMILY) -> DataFrame:
    """(key, field, value, role, confidence): what tables and running text say about people, each fact once with its
    highest confidence. Null and empty texts say nothing."""
    tables = table_people(texts, key, text, family).select(key, F.lit("person").alias("field"), F.col("name").alias("value"), F.coalesce("role_label", F.lit("team_member")).alias("role"), F.lit(0.85).alias("confidence"))
    return tables.unionByName(text_people(texts, key, text, family)).groupBy(key, "field", "value", "role").agg(F.max("confidence").alias("confidence"))
