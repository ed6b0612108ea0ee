import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidloom.operators import layout, pairs, prices, segments, summaries


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def pools(spark):
    rows = [("A", ["1", "2", None, " "], "x"), ("B", ["1"], "x"), ("C", ["1", "3"], None), ("D", None, "x"), (None, ["1"], "x"), ("A", ["1"], "x")]
    return spark.createDataFrame(rows, "g string, phones array<string>, value string")


def test_shared_values_and_pairs(pools):
    tidy = pairs.tidy_pools(pools, "g", {"phones": "phone"})
    assert tuples(tidy) == [("A", "phone", "1"), ("A", "phone", "2"), ("B", "phone", "1"), ("C", "phone", "1"), ("C", "phone", "3")]
    assert tuples(pairs.shared_values(tidy)) == [("phone", "1", 3, "A", "C")]
    assert [r[:2] for r in tuples(pairs.sharing_pairs(tidy))] == [("A", "B"), ("A", "C"), ("B", "C")]
    assert tuples(pairs.sharing_pairs(tidy, 2)) == []
    assert tuples(pairs.sharing_pairs(tidy.limit(0))) == []


@pytest.mark.parametrize(("n", "have", "removed"), [(5, 4, True), (4, 3, False), (2, 2, False), (3, 3, True)])
def test_noise_by_frequency(spark, n, have, removed):
    rows = [(f"g{i}", "phone", "1") for i in range(have)] + [(f"g{i}", "phone", f"own{i}") for i in range(n)]
    tidy = spark.createDataFrame(rows, "group string, kind string, value string")
    noise = pairs.frequent_everywhere(tidy, F.lit(1))
    assert bool(noise.where("value = '1'").count()) == removed
    assert pairs.without(tidy, noise, ["kind", "value"]).where("value = '1'").count() == (0 if removed else have)


def test_overlap_and_cross_attributes(spark):
    sets = spark.createDataFrame([("a", x) for x in "123"] + [("b", x) for x in "23"] + [("c", "1"), (None, "1"), ("a", None)], "group string, value string")
    given_pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b"), (None, "a")], "left string, right string")
    assert tuples(pairs.overlap_rates(sets, given_pairs)) == [("a", "b", 3, 2, 2, 1.0)]
    one, two = spark.createDataFrame([("a", "张")], "group string, value string"), spark.createDataFrame([("b", "张"), ("a", "张")], "group string, value string")
    assert tuples(pairs.cross_attribute_pairs(one, two)) == [("a", "b", "张")]


def test_first_known_pair_numbers_mentions(spark):
    rows = spark.createDataFrame([("g", 2, "x", None), ("g", 1, None, ""), ("g", 3, "y", "z"), ("h", 1, None, None)], "g string, ord int, a string, b string")
    assert tuples(pairs.first_known(rows, "g", ["ord"], ["a", "b"])) == [("g", "x", "z"), ("h", None, None)]
    groups = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c"), ("t", "a"), (None, "d")], "t string, g string")
    assert tuples(pairs.pair_numbers(groups, "t", "g")) == [("t", 3, 3, 6)]
    texts = spark.createDataFrame([(1, "甲公司与乙公司"), (2, None), (3, "")], "k long, t string")
    names = spark.createDataFrame([(7, "乙公司"), (8, "丙"), (9, None), (10, "乙公司")], "i int, n string")
    assert tuples(pairs.mentions(texts, "k", "t", names, "i", "n")) == [(1, 10), (1, 7)]
    assert tuples(pairs.mentions(texts, "k", "t", names.limit(0), "i", "n")) == []


# --- segments


def test_common_segments_positions_are_in_order():
    shared = "本工程采用C35混凝土并掺加减水剂四百五十公斤"
    left, right = "很长的开头很长的开头很长的开头" + shared + "甲", "短" + shared.replace("，", ",") + "乙"
    (pos1, pos2, n, segment, ctx1, ctx2), *rest = segments.common_segments(left, right)
    assert not rest and segment == shared and left[pos1:].startswith(shared) and right[pos2:].startswith(shared) and n == len(shared)
    assert shared in ctx1 and shared in ctx2


def test_leader_dots_and_blanks_do_not_matter():
    assert segments.common_segments("一、总则 ................ 7", "二、细则 ................ 79") == []
    a = "设备 安装 完成 后 应 进行 联动 调试 并 记录"
    assert segments.common_segments(a, a.replace(" ", "　"))[0][2] == len(a.replace(" ", ""))
    assert segments.common_segments("", "x" * 100) == [] and segments.common_segments("，" * 40, "，" * 40) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_common_segments_against_brute_force(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("甲乙丙丁1a") for _ in range(rng.randint(5, 30))) for _ in range(4)]
    a, b = "".join(rng.choices(pool, k=5)), "".join(rng.choices(pool, k=5))
    found = segments.common_segments(a, b)
    for pos1, pos2, n, segment, _, _ in found:
        assert a[pos1 : pos1 + n] == b[pos2 : pos2 + n] == segment and n >= 15
    used = [range(p, p + n) for p, _, n, *_ in found]
    assert len(set().union(*used)) == sum(map(len, used)) if used else True
    longest = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    assert bool(found) == (longest.size >= 15)


def test_near_paragraphs_are_those_of_all_comparisons(spark):
    rng = random.Random(5)
    words = ["投标人应当", "在合同签订后", "三十日内", "完成全部设备", "的安装调试工作", "并提交完整的", "竣工资料", "和培训记录", "以备验收", "，逾期不予受理"]

    base = ["".join(rng.choices(words, k=rng.randint(9, 12))) for _ in range(6)]

    def page():
        out = []
        for _ in range(rng.randint(0, 4)):
            line = rng.choice(base)
            out += [line, line.replace("三十", "四十五").replace("完整", "齐全"), line][: rng.randint(1, 3)]
        return "\n".join(out)

    texts = {f"f{i}": page() for i in range(8)} | {"f8": None, "f9": ""}
    links = [(f"f{i}", f"f{j}") for i in range(10) for j in range(i, 10)] + [("f3", "f1"), (None, "f1")]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "k string, text string, ord int")
    got = {}
    for r in segments.near_paragraphs(spark.createDataFrame(links, "left string, right string"), df, "k", "text").collect():
        got.setdefault((r.left, r.right), []).append(r.ratio)
    want = {}
    forms = {k: [f for f in (segments.match_map(x.strip())[0] for x in (t or "").split("\n")) if 40 <= len(f) <= 500] for k, t in texts.items()}
    for i, j in {(min(x), max(x)) for x in links if None not in x and x[0] != x[1]}:
        for a in forms[i]:
            near = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for b in forms[j] if abs(len(a) - len(b)) <= 0.3 * max(len(a), len(b))]
            near = [r for r in near if 0.8 <= r < 0.98]
            if near:
                want.setdefault((i, j), []).append(round(max(near), 3))
    assert want and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="甲乙", max_size=40), st.text(alphabet="甲乙", max_size=40), st.sampled_from([3, 2_000_000]))
def test_runs_against_brute_force(a, b, block):
    want = set()
    for i in range(len(a) - 3):
        for j in range(len(b) - 3):
            if a[i : i + 4] == b[j : j + 4] and not (i and j and a[i - 1] == b[j - 1]):
                n = 4
                while a[i + n : i + n + 1] == b[j + n : j + n + 1] != "":
                    n += 1
                want.add((i, j, n))
    assert segments.common_runs(a, b, 4, block) == sorted(want)


def test_candidate_pairs_miss_nothing(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(10, 20))) for _ in range(8)]
    texts = {i: "".join(rng.sample(pool, 2)) + "".join(rng.choice("子丑寅卯") for _ in range(12)) for i in range(20)} | {20: None, 21: ""}
    got = {(r.left, r.right) for r in segments.candidate_pairs(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t").collect()}
    sharing = {(i, j) for i in range(20) for j in range(i + 1, 20) if segments.common_runs(texts[i], texts[j])}
    assert sharing and sharing <= got


def test_containment_and_templates(spark):
    needles = spark.createDataFrame([(1, "乙丙丁"), (2, "丙丁"), (3, "子"), (4, "甲乙丙丁"), (5, None)], "id int, form string")
    hay = spark.createDataFrame([(7, "甲乙丙丁戊丙丁"), (8, "丙丁"), (9, None), (10, "")], "id int, form string")
    assert tuples(segments.containments(needles, hay, 2)) == [(1, 7), (2, 7), (2, 8), (4, 7)]
    window = "".join(f"第{i}项由投标人自行负责并承担费用" for i in range(3))
    segs = spark.createDataFrame([(1, "t", window), (2, "t", window[3:30]), (3, "u", window), (4, "t", "前" * 5 + window + "后"), (5, "t", window[:10]), (6, None, window), (7, "t", None)], "k int, s string, x string")
    assert [r.k for r in segments.in_template(segs, "k", "s", "x", spark.createDataFrame([("t", segments.match_map(window)[0])], "scope string, form string")).orderBy("k").collect()] == [1, 2, 4]


def test_names_beyond_the_bound_are_joined(spark):
    texts = spark.createDataFrame([(1, "甲公司与乙公司"), (2, None), (3, "丙")], "k long, t string")
    names = spark.createDataFrame([(7, "乙公司"), (8, "丙"), (9, None), (10, "乙公司")], "i int, n string")
    assert tuples(pairs.mentions(texts, "k", "t", names, "i", "n", most_names=1)) == tuples(pairs.mentions(texts, "k", "t", names, "i", "n"))


def test_segments_of_pairs_with_nulls(spark):
    shared = "项目部应在合同签订后十五日内提交施工组织设计方案"
    texts = spark.createDataFrame([("a", shared + "一", 1), ("b", "二" + shared, 2), ("c", None, 3), ("a", shared + "一", 1)], "f string, text string, left int")
    links = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "c"), ("a", "a"), (None, "a")], "left string, right string")
    got = segments.segments_of_pairs(segments.compared_pairs(links, texts, "f", "text")).collect()
    assert [(r.left, r.right, r.segment) for r in got] == [("a", "b", shared)]


def test_template_windows_and_containment(spark):
    page = "".join(f"第{i}条投标人应遵守本办法之规定。" for i in range(30))
    rows = [("t", g, page + g * 200) for g in "abc"] + [("t", "d", None), (None, "e", page), ("u", "f", page)]
    got = segments.template_windows(spark.createDataFrame(rows, "t string, g string, text string"), "t", "g", "text")
    assert {r["scope"] for r in got.collect()} == {"t"} and got.count() > 3
    seg = spark.createDataFrame([(1, "遵守 本办法之规定。第2条"), (2, "短句"), (3, None)], "k int, s string")
    assert tuples(segments.contained_in(seg, "k", "s", spark.createDataFrame([(page,), (None,)], "r string"), "r")) == [(1,)]


# --- layout


def test_tables(spark):
    t = spark.createDataFrame([(1, "标题\n名称 | 数量\n轴 | 3\n泵 | \n正文\n甲 | 乙\n丙 | 丁"), (2, None), (3, "")], "k int, t string")
    rows = layout.pipe_rows(t, "k", "t")
    assert [(r.region, r.row_no, len(r.cells)) for r in rows.orderBy("line_no").collect()] == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 1, 2), (2, 2, 2)]
    cells = layout.cell_values(rows, "k").where("region = 1")
    assert tuples(cells.select("row_no", "header", "value")) == [(2, "名称", "轴"), (2, "数量", "3"), (3, "名称", "泵"), (3, "数量", "")]


def test_fill_wrap_sections(spark):
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, ""), (1, 4, "合计"), (1, 5, None)], "g int, o int, v string")
    assert [x.v for x in layout.filled_down(r, ["g"], ["o"], "v").orderBy("o").collect()] == ["a", "a", "a", "合计", "合计"]
    assert [x.v for x in layout.filled_down(r, ["g"], ["o"], "v", F.col("o") == 3).orderBy("o").collect()] == ["a", "a", None, "合计", "合计"]
    merged = layout.wrapped_rows(r, ["g"], ["o"], F.col("v").isin("a", "合计"), "v").orderBy("row_no").collect()
    assert [(m.v, m.n_rows) for m in merged] == [("a  ", 3), ("合计 ", 2)]
    lines = layout.lines(spark.createDataFrame([(1, "前\n问1：x\n答\n问2：y")], "k int, t string"), "k", "t")
    assert tuples(layout.sections(lines, "k", "^问[0-9]+：")) == [(1, 1, 1, 2), (1, 2, 3, 1)]
    assert tuples(layout.near_lines(lines, "k", "答", 1, 0)) == [(1, 1), (1, 2)]


def test_headings_and_votes(spark):
    t = spark.createDataFrame([(1, "第一章 总则\n正文\n（1）范围\n1.2 内容\n2025年")], "k int, t string")
    assert [h.heading for h in layout.headings(t, "k", "t").orderBy("line_no").collect()] == ["第一章 总则", "（1）范围", "1.2 内容"]
    v = spark.createDataFrame([("g", "甲"), ("g", "乙乙"), ("g", None), ("g", ""), ("h", "丙")], "g string, v string")
    assert tuples(layout.voted(v, "g", F.col("v"))) == [("g", "乙乙", 1), ("h", "丙", 1)]
    lines = layout.lines(spark.createDataFrame([(1, "项目名称：某某工程\n项目名称：\n另一个工程")], "k int, t string"), "k", "t")
    assert [r.candidate for r in layout.project_names(lines, "k").orderBy("line_no").collect()] == ["某某工程", "另一个工程"]


# --- prices


def test_totals(spark):
    rows = spark.createDataFrame([("t", "a", 1950000.0), ("t", "b", 2000000.0), ("t", "c", 2050000.0), ("t", "c", None), ("u", "a", 5.0), ("u", "b", 5.0), (None, "x", 5.0)], "t string, g string, v double")
    assert [(r.t, r.n, float(r.gap)) for r in prices.ladders(rows.where("t is not null"), ["t"], "v").collect()] == [("t", 3, 50000.0)]
    assert [(r["scope"], float(r.total), r.n_groups, r.n_pairs) for r in prices.equal_totals(rows, "t", "g", "v").collect()] == [("u", 5.0, 2, 1)]
    s = prices.spreads(rows, ["t"], "v", "g").where("t = 'u'").first()
    assert (s.n, s.n_who, s.n_distinct, float(s.spread_pct)) == (2, 2, 1, 0.0)


def test_sums_echoes_plausible(spark):
    items = spark.createDataFrame([(1, "人工成本", 10.0, 500.0), (1, "合计", 1.0, 500.0), (1, None, None, 200.0), (2, "设备费", 900.0, 500.0)], "k int, n string, u double, v double")
    totals = spark.createDataFrame([(1, 1000.0), (2, 500.5), (3, None)], "k int, total double")
    assert [(r.k, r.off) for r in prices.sum_differences(items, "k", "v", totals, "total").orderBy("k").collect()] == [(1, True), (2, False)]
    assert [r.n for r in prices.plausible_items(items, "n", "u", "v").collect()] == ["人工成本"]
    assert prices.without_echoes(items, "k", "v", totals, "total").where("k = 2").count() == 0


def test_similar_names_and_clusters(spark):
    names = spark.createDataFrame([(1, "设备安装调试费"), (2, "设备安装调试费用"), (3, "人员培训费"), (4, None), (5, "费"), (6, "设备安装调试费")], "i int, n string")
    assert {(r.id1, r.id2) for r in prices.similar_names(names, "i", "n").collect()} == {(1, 2), (1, 6), (2, 6)}
    rng = random.Random(3)
    stems = ["设备安装调试费", "人员培训费用", "系统集成服务", "竣工资料编制费"]
    rows = [(i, "t" if i % 3 else "u", (s := rng.choice(stems))[: rng.randint(3, len(s))] + rng.choice(["", "用", "甲", "包干"])) for i in range(60)] + [(99, None, "x"), (98, "t", None), (1, "t", rng.choice(stems))]
    got = {(r["scope"], r["item_id"]): r["cluster"] for r in prices.item_clusters(spark.createDataFrame(rows, "item_id int, t string, n string"), "t", "item_id", "n").collect()}

    def like(a, b):
        x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
        return len(a) >= 4 and len(b) >= 4 and (len(x & y) / len(x | y) >= 0.55 or bool({a[i : i + 6] for i in range(len(a) - 5)} & {b[i : i + 6] for i in range(len(b) - 5)}))

    for scope in "tu":
        first: dict[str, int] = {}
        for i, t, n in sorted(r for r in rows if r[1] == scope and r[2]):
            first.setdefault(n, i)
        heads: list[tuple[str, int]] = []
        for n, i in sorted(first.items(), key=lambda x: x[1]):
            head = next((h for m, h in heads if like(m, n)), None)
            if head is None:
                heads.append((n, i))
            assert got[scope, i] == (i if head is None else head)


# --- summaries


def test_counts_and_history(spark):
    m = spark.createDataFrame([(1, " Substantial", True, 0.9, 1), (1, "template", None, None, 2), (1, None, False, 0.1, 3), (2, "x", True, 0.2, 4)], "p int, risk string, ab boolean, score double, i int")
    assert tuples(summaries.pair_counts(m, "p", "risk", "ab")) == [(1, 3, 1, 1, 1, 0), (2, 1, 1, 0, 0, 0)]
    assert [r.i for r in summaries.by_level(m.where("p = 1"), "p", "risk", [F.col("i")], 2).orderBy("rank").collect()] == [1, 2]
    files = spark.createDataFrame([("g", 2, "乙", 5), ("g", 1, "甲", 4), ("g", 3, None, 3)], "g string, o int, t string, used int")
    assert summaries.volumes_joined(files, "g", ["o"], "t").first()["t"] == "甲\n乙\n"
    assert [r.t for r in summaries.least_recent(files, "used", "o", 2).collect()] == [None]
    keys = [r.cache_key for r in summaries.cache_keys(files, "t", "v1").collect()]
    assert keys[2] is None and keys[0] != keys[1] and keys[0] != summaries.cache_keys(files, "t", "v2").first().cache_key
    runs = spark.createDataFrame([(1, [("a" * 300,)]), (2, [])], "p int, matches array<struct<text:string>>")
    assert [len(r.matches[0].text) for r in summaries.lightened(runs, "matches").where("p = 1").collect()] == [200]


def test_pivot_agrees_where_one_value_is_missing(spark):
    rows = spark.createDataFrame([("x", "a", 1), ("x", "b", 1), ("y", "a", 1), ("y", "b", 2), ("z", "a", 3)], "f string, g string, v int")
    got = {r.f: (r.n_values, r.same_all) for r in summaries.pivot(rows, "f", "g", ["a", "b"], F.max("v")).collect()}
    assert got == {"x": (2, True), "y": (2, False), "z": (1, True)}
