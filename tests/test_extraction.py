import pytest

from bidloom.functions.names import NameTest, family_names
from bidloom.operators import items, people, quotes
from bidloom.operators.people import people_of
from bidloom.plans import cases


def facts(text):
    return {(f, v, r) for f, v, r, _ in people_of(text)}


@pytest.mark.parametrize(
    ("text", "there", "not_there"),
    [
        ("项目团队\n王强 项目经理\n李勇 施工员\n", {("person", "李勇", "team_member")}, {("person", "李勇", "project_manager")}),
        ("项目团队\n姓名：张三 学历：本科\n姓名：李四 职务：项目经理\n", {("person", "李四", "project_manager")}, {("person", "张三", "project_manager")}),
        ("投标函\n联系人：王五 传真：(010)1234-5678\n", {("person", "王五", "bid_contact")}, {("person", "王五传真", "bid_contact")}),
        ("项目团队\n陈刚 任職務 项目经理\n", {("person", "陈刚", "project_manager")}, {("person", "任職務", "project_manager")}),
        ("授权委托书\n本人  某某  （姓名）系  北京某某航天技术有限公司  （供应商名称）的法定代表人\n", {("company", "北京某某航天技术有限公司", None)}, {("legal_rep", "某某", "legal_rep")}),
        ("二、法定代表人（单位负责人）身份证明\n投标人名称： 某某机电制造有限公司\n姓名： 【张三】 性别： 【男】 职务： 【总经理】\n系 某某机电制造有限公司 （投标人名称）的法定代表人（单位\n负责人）。\n", {("legal_rep", "张三", "legal_rep"), ("company", "某某机电制造有限公司", None)}, set()),
        ("授权委托书\r\n委托代理人\u200b：李\u2060勇\r被授权人：王\xad强\n", {("authorized_rep", "李勇", "authorized_rep"), ("authorized_rep", "王强", "authorized_rep")}, set()),
        ("授权委托书\n法定代表入：王强\n联系电活：13912345678\n", {("legal_rep", "王强", "legal_rep"), ("phone", "13912345678", None)}, set()),
        ("本人张某某系北京某\n某大学的法定\n代\n表\n人（单位负责人），现委托李四为我方委托代\n理人。", {("legal_rep", "张某某", "legal_rep"), ("company", "北京某某大学", None), ("authorized_rep", "李四", "authorized_rep")}, set()),
        ("日期：2024年3月5日\n", {("response_date", "2024-03-05", None)}, set()),
        ("", set(), set()),
    ],
)
def test_people(text, there, not_there):
    found = facts(text)
    assert there <= found and not not_there & found


def test_family_names_come_from_the_table(spark):
    rows = [(n,) for n in ("钭一", "钭二", "钭三", "昝一", "昝一", "昝二", None, "", "abc")]
    family = family_names(spark.createDataFrame(rows, "n string"), "n")
    assert "钭" in family and "昝" not in family and NameTest(family)("昝三") is False and NameTest(family)("钭渡")


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "投标总价：5000.00元", "z"), (3, "投标总价：5000.00元", "z")], "k int, t string, value string")
    assert {(r.k, r.in_tax) for r in quotes.extracted_prices(df, "k", "t").collect()} == {(3, 5000.0)}
    assert people.extracted_people(df, "k", "t").count() == 0 and items.line_items(df, "k", "t").count() == 0
    assert quotes.extracted_prices(df.limit(0), "k", "t").count() == 0


def test_totals_that_echo_or_belong_to_others():
    totals = lambda t: [r.value for r in quotes.price_rows(t) if r.kind == "total"]
    assert totals("投标总价：￥2,200元\n履约保证金 0.22万元") == []
    assert totals("注册资金人民币2000万元") == [] and totals("人民币 2014年注册") == []
    assert totals("投标总价：￥5000/月") == []


def test_warnings(spark):
    df = spark.createDataFrame([(1, "开标一览表\n投标总价（大写）：壹佰万元整\n（小写：1000000元）"), (2, "合计 \\ 1838529 5002800 \\"), (3, cases.PRICES[13][0])], "k int, t string")
    got = {r.k: r.warnings for r in quotes.extracted_prices(df, "k", "t").collect()}
    assert got[1] == [] and "兜底" in got[2][0] and "不一致" in got[3][0]


def test_summary_rows(spark):
    df = spark.createDataFrame([(1, "名称 | 金额 | 含税\n设备 | 3 | 4\n合计 | 893,000元 | 91.97万元"), (2, "总计 | 893000\n小计 | 10000"), (3, None), (4, "合计 | 12")], "k int, t string")
    assert sorted(map(tuple, items.summary_totals(df, "k", "t").collect())) == [(1, 893000.0, 919700.0), (2, 893000.0, 893000.0)]
