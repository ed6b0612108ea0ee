import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidloom.functions import amounts, contacts, names, rules, text
from bidloom.functions.amounts import chinese_number, parsed_amount
from bidloom.operators.segments import match_map


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.match_form, "第一章 ........ 7​（Ａ）", "第一章7(a)"),
        (text.match_form, None, None),
        (text.match_form, "", ""),
        (text.visible, "甲\r\n乙 丙​", "甲\n乙\n丙"),
        (text.narrow_digits, "１２a", "12a"),
        (text.fixed_labels, "法定代表入：联糸电活", "法定代表人：联系电话"),
        (text.without_fill_brackets, "姓名：【张三】\n【工作表】报价", "姓名：张三\n【工作表】报价"),
        (text.joined_digits, "139 1234 5678 与 1O9 l2", "13912345678 与 109 l2"),
        (text.joined_ideographs, "张 三\n李 四", "张三\n李四"),
        (text.masked_id, "320101199001011234", "320101****"),
        (text.masked_account, "1100923456789", "1100******6789"),
        (text.masked_account, "1234", "1234"),
        (text.person_key, "买买提•江 ", "买买提·江"),
        (text.display_name, "up/0a1b2c3d_标书.docx", "标书.docx"),
        (text.group_name, "甲公司_2.docx", "甲公司"),
        (text.item_name, "1.人工 成本（含税）", "人工成本"),
        (text.extension, "a/b.DOCX", "docx"),
        (contacts.mobile, "+86 139-1234-5678", "13912345678"),
        (contacts.mobile, "12912345678", None),
        (names.role_label, "项目经理（兼）", "project_manager"),
        (names.role_label, "其他", None),
        (names.is_person_name, "张三丰", True),
        (names.is_person_name, "项目经理", False),
        (names.is_person_name, "欧阳修远", True),
        (amounts.rate, "９％", 0.09),
        (amounts.rate, "1.8‰", 0.0018),
        (amounts.rate, "", None),
        (amounts.arabic_amount, "￥1,838,529.30元", 1838529.3),
        (amounts.arabic_amount, "12.5万元", 125000.0),
        (amounts.arabic_amount, "详见报价表", None),
        (amounts.is_date_number, "20250826", True),
        (amounts.is_date_number, "20251326", False),
    ],
)
def test_scalars(spark, f, given, want):
    got = one(spark, given, f)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_control_characters_and_leader_dots(spark):
    assert one(spark, "a\x01b\tc", text.sanitize) == "ab\tc"
    assert one(spark, "章....3", text.without_leader_dots) == "章3"
    assert one(spark, "法 定 代 表 人", text.glued) == "法定代表人"


@pytest.mark.parametrize(
    ("s", "want"),
    [("壹佰贰拾叁万元整", 1230000), ("壹亿贰仟陆佰壹拾捌万壹仟玖佰柒拾陆元叁角", 126181976.30), ("一二三", 6), ("拾贰", 12), ("无", None), ("", None), (None, None)],
)
def test_chinese_numbers(s, want):
    assert chinese_number(s) == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(
    ("s", "want"),
    [("￥12.5万元", 125000), ("１２３４５６", 123456), ("1 261 819.76", 1261819.76), ("1O9,800", 109800), ("l2300", 12300), ("I00000", 100000), ("叁万元整", 30000), ("/", None), (None, None)],
)
def test_amounts(s, want):
    assert parsed_amount(s) == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("+8613912345678 或 139-1234-5678", [("phone", "13912345678")]),
        ("1391234\n5678", [("phone", "13912345678")]),
        ("电话：01056216031", [("phone", "010-56216031")]),
        ("Zhang＠Example.com", [("email", "zhang@example.com")]),
        ("320123\n19900101\n123X", [("id_number", "32012319900101123X")]),
        ("账号：1100923456789000123", [("bank_account", "1100923456789000123")]),
        ("保证金汇入账号：1100923456789000123", []),
        ("地址：某省某市某区某某路一号 电话：010-88886666", [("phone", "010-88886666"), ("address", "某省某市某区某某路一号")]),
        ("", []),
    ],
)
def test_contacts(s, want):
    assert contacts.contacts(s) == want


def test_extracted_contacts_of_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "电话：010-88886666", "x"), (2, None, "y"), (3, "", "z")], "value long, kind string, k string")
    got = contacts.extracted_contacts(rows.withColumnRenamed("value", "doc"), "doc", "kind")
    assert [tuple(r) for r in got.collect()] == [(1, "phone", "010-88886666")]


def test_rules(spark):
    assert one(spark, "投标人须知前附表", rules.is_template)
    assert one(spark, "目  录", rules.is_template)
    assert not one(spark, "球磨机采用GB-2020型轴承，规格45毫米", rules.is_template)
    assert one(spark, None, rules.is_template) is None
    assert one(spark, "短", rules.substantiality) == 0.0
    high, low = one(spark, "主机型号GB-20201，功率220V，规格100x200，数量1234台，总价1,234,567.89元，误差0.5%", rules.substantiality), one(spark, "我方承诺遵守规定并保证提供符合要求和条件的服务", rules.substantiality)
    assert 0 <= low < high <= 1
    assert one(spark, "型号AB-12", lambda c: rules.reason_tags(c, F.lit(False))) == ["包含具体技术型号/参数"]
    assert one(spark, "一般", lambda c: rules.reason_tags(c, F.lit(False))) == ["内容异常一致"]


def test_any_word_is_the_plain_alternation():
    import re

    words = ["甲", "甲乙", "乙丙丁", "乙丙", "（盖章）", "a.b"]
    quick, plain = re.compile(rules.any_word(words)), re.compile("|".join(map(re.escape, words)))
    for s in ("甲", "x乙丙", "axb", "a.b", "乙", "（盖章", "（盖章）", ""):
        assert bool(quick.search(s)) == bool(plain.search(s))
    assert all(re.search(rules.WORDING, w) for w in rules.WORDS)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("甲乙 .．…​ＡAa，,（(\n\t1１"), max_size=60))
def test_match_form_is_idempotent_and_keeps_places(s):
    form, places = match_map(s)
    assert match_map(form)[0] == form or ".." in form
    assert len(form) == len(places) and places == sorted(set(places))


def test_match_form_is_the_same_in_both_engines(spark):
    samples = ["第 一 章......7", "（Ａ）ＢＣ，。；", "a­b　c\x85d", "“引”《书》", "", "．．．a…b"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.match_form(F.col("s")).alias("f")).collect()
    assert all(match_map(r["s"])[0] == r["f"] for r in rows)
