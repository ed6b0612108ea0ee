"""Queries over small tables that show whether the whole job is done."""

import pytest

from bidloom.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_cost_names_are_searched_whole(spark, tables):
    d = tables(
        price_ref=([(1, "跨区桥架安装摊销与垂直运输费用", ["桥架安装费"]), (2, "备用仓库", None), (3, "无人提及", [])], "ref_id int, canon_name string, aliases array<string>"),
        documents=([(1, "含跨区桥架安装摊销与垂直运输费用。"), (2, "仅跨区桥架安装摊销与垂直"), (3, "桥架安装费与备用仓库"), (3, "备用仓库"), (4, None)], "doc_id long, text string"),
    )
    assert {tuple(r) for r in catalog.queries()["cost_name_mentions"](spark, d).collect()} == {(1, 2), (2, 1)}


def test_pairs_without_earlier_matches_are_compared(spark, tables):
    part = "投标人须在开标前三十日内提交全部设备清单与技术参数说明，并附检测机构出具的合格报告及原件扫描件备查，逾期不予受理。"
    d = tables(
        summarize_file=([(n, f"f{n}", part.replace("三十日", "四十五天") if n == 4 else part) for n in range(5)], "file_id int, file_name string, text string"),
        pair_results=([("f0", "f1", 0), ("f2", "f1", None), ("f3", "f0", 2), ("f4", "f0", 0), ("f4", None, 3), ("f2", "f2", 1)], "file1 string, file2 string, total_matches int"),
    )
    found = catalog.queries()["common_segments"](spark, d).collect()
    assert {(r.left, r.right) for r in found} == {("f0", "f1"), ("f1", "f2"), ("f0", "f3"), ("f0", "f4")}
    assert [(r.left, r.right) for r in catalog.queries()["near_duplicate_paragraphs"](spark, d).collect()] == [("f0", "f4")]


def test_no_link_of_a_common_value_is_lost(spark, tables):
    """A value of many groups stands as one class: following the rows reaches all of its groups."""
    fields = "person_id int, bid_group string, person_name string, phones array<string>, id_numbers array<string>, emails array<string>, bank_accounts array<string>"
    d = tables(personnel=([(n, f"G{n:02}", None, ["13800000000"] + (["13900000000"] if n < 3 else []), None, None, None) for n in range(52)], fields))
    found = catalog.queries()["shared_contact_pairs"](spark, d).collect()
    assert {(r.left, r.right, r.n_groups) for r in found if r.value == "13900000000"} == {("G00", "G01", 3), ("G00", "G02", 3), ("G01", "G02", 3)}
    common = [r for r in found if r.value == "13800000000"]
    assert {r.left for r in common} | {r.right for r in common} == {f"G{n:02}" for n in range(52)} and all(r.n_groups == 52 for r in common)
    assert {(r.left, r.right) for r in common} == {("G00", f"G{n:02}") for n in range(1, 52)}
