import math
import os
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidloom.llm import canonical_names, groups, leakage, lookalikes, packing, queries, residue, scan_repair, shared_spans, spam

DATA = "/root/testdata/sf0.001"


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 1 scan repair


BODY = "项目部应在合同签订后十五日内提交施工组织设计方案，并报送监理单位备案。"


def clean_texts(n):
    rng = random.Random(1)
    parts = ["供货方承诺所用设备均为全新产品，符合设计要求。", "未发现遗漏的质量检验记录经档案室签字后归档。", "本标段合同工期为八十日历天，质保期两年。", BODY, "技术负责人应在三日内核对全部材料清单。"]
    return [(i, "\n".join("".join(rng.choices(parts, k=3)) for _ in range(3))) for i in range(n)]


def wrapped(text, width=16):
    return "\n".join(line[i : i + width] for line in text.split("\n") for i in range(0, len(line), width))


def test_scan_repair(spark):
    clean = clean_texts(80)
    header = "某某水厂 技术标书"
    scans = [
        (100, wrapped(BODY)),
        (101, f"{header}\n{BODY}\n— 3 —\n{header}\n{BODY}\n— 4 —"),
        (102, BODY[:14] + "\n第 7 页 共 9 页\n" + BODY[14:]),
        (103, BODY.replace("日内", "曰内")),
        (104, BODY.replace("十五", "l5")),
    ]
    fine = [(200, f"{header}\n{BODY}"), (201, f"名称 | 数量 | 单价\n轴流泵 | 18 | 2928.00\n{BODY}"), (202, f"3.3 {BODY}\n详见第11页材料清单。"), (203, BODY.replace("，", ",​")), (204, None), (205, ""), (206, "x" * 50_000 + "。")]
    rows = spark.createDataFrame(clean + scans + fine + [scans[0]], "id long, text string").withColumn("repaired", F.lit("clash"))
    got = {r.id: r for r in scan_repair.repaired_texts(rows, "id", "text").collect()}
    assert {i for i, r in got.items() if r.damaged} == {i for i, _ in scans}
    assert got[100].repaired == BODY and got[101].repaired == f"{header}\n{BODY}\n{BODY}" and got[102].repaired == BODY and got[103].repaired == BODY
    assert got[104].repaired == BODY.replace("十五", "15") and got[204].repaired is None and got[205].repaired == ""
    assert all(got[i].repaired == t for i, t in clean + fine)
    empty = scan_repair.repaired_texts(rows.limit(0), "id", "text")
    assert empty.count() == 0


@pytest.mark.parametrize(
    ("given_value", "want"),
    [
        ("9943811968\n02195992", "994381196802195992"),
        ("99372219800-\n4161798", "993722198004161798"),
        ("9962\n— 33 —\n46200203185369", "996246200203185369"),
        ("9967221972O4030272", "996722197204030272"),
        ("9960 2219610125 9231", "996022196101259231"),
        ("99066819721120905X", "99066819721120905X"),
        ("997849901114649", "997849901114649"),
        ("997806********7243", "997806********7243"),
        ("E78221247", "E78221247"),
        ("997990 20020318 6390", "997990200203186390"),
        ("", ""),
    ],
)
def test_identity_numbers(given_value, want):
    assert scan_repair.repaired_number(given_value) == want


def test_identity_numbers_of_records(spark):
    rows = spark.createDataFrame([(1, ["99\n0668197211209051", None]), (2, None), (3, [])], "id long, v array<string>")
    assert tuples(scan_repair.repaired_numbers(rows, "id", "v").select("id", "damaged")) == [(1, True)]


def test_the_line_model_tells_misread_headers(spark):
    """A running header that is misread each time stands once as it is; no rule of the weak labels covers it."""
    clean = clean_texts(120)
    header = "某某水厂 技术标书"
    scans = [(300 + i, f"{header}\n{wrapped(BODY)}\n— {i} —\n{header}\n{wrapped(BODY)}\n— {i + 1} —") for i in range(30)]
    odd = f"{header}\n{BODY[:20]}\n— 3 —\n某某水广 技木标书\n{BODY[20:]}\n— 4 —"
    labels = scan_repair.suggested(scan_repair.observe(odd.split("\n")))
    assert labels[3] == -1
    got = {r.id: r.repaired for r in scan_repair.repaired_texts(spark.createDataFrame([*clean, *scans, (900, odd)], "id long, text string"), "id", "text").collect()}
    assert got[900] == f"{header}\n{BODY}" and all(got[i] == t for i, t in clean)


# --- 2 shared spans


def brute_pairs(rows, n):
    seen, pairs = {}, set()
    for i, t in dict(rows).items():
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    for s in seen.values():
        pairs |= {(a, b) for a in s for b in s if a < b}
    return pairs


def some_segments(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("甲乙丙丁戊己庚辛ab1，。", k=k))
    pool = [text(rng.randint(20, 90)) for _ in range(12)]
    rows = [(i, text(rng.randint(0, 30)) + rng.choice(pool) + text(rng.randint(0, 30))) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "短"), rows[3]]


@pytest.mark.parametrize(("seed", "alike"), [(1, False), (2, True)])
def test_shared_spans_against_brute_force(spark, seed, alike):
    rows = some_segments(seed)
    df = spark.createDataFrame(rows, "id long, text string").withColumn("rep", F.lit(0)).withColumn("seed", F.lit(1))
    passages, members = shared_spans.shared_passages(df, "id", "text", alike=alike)
    long = df.where(F.length("text") >= 50).select(F.col("id").alias("rep")).distinct()
    assert set(tuples(shared_spans.sharing_pairs(passages, members, long))) == brute_pairs(rows, 50)
    seen, want = {}, {}
    for i, t in dict(rows).items():
        for k in range(len(t or "") - 49):
            seen.setdefault(t[k : k + 50], set()).add(i)
    for i, t in dict(rows).items():
        if t is not None:
            want[i] = len({p for k in range(len(t) - 49) if len(seen[t[k : k + 50]]) > 1 for p in range(k, k + 50)})
    assert {r.rec_id: r.n_shared for r in shared_spans.shared_amount(df, "id", "text", passages, members).collect()} == want


def test_near_passage_and_empty_table(spark):
    a = "".join(chr(0x4E00 + i) for i in range(100))
    b = a[:48] + "异" + a[49:96]
    passages, _ = shared_spans.shared_passages(spark.createDataFrame([(1, a), (2, b)], "id long, text string"), "id", "text", alike=True)
    (p,) = passages.collect()
    assert not p.runs and p.identity > 0.95 and p.end1 - p.start1 >= 90
    none, members = shared_spans.shared_passages(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert none.count() == 0 and members.count() == 0


def test_recall_on_edited_copies(spark):
    """Passages of 120 to 240 characters, one character in about 40 changed, left out or put in, among other text."""
    rng = random.Random(11)
    text = lambda k: "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", k=k))
    rows = []
    for n in range(150):
        passage = text(rng.randint(120, 240))
        edited = "".join(rng.choice(["", c + "改", "异"]) if rng.random() < 1 / 40 else c for c in passage)
        rows += [(2 * n, text(rng.randint(0, 60)) + passage + text(rng.randint(0, 60))), (2 * n + 1, text(rng.randint(0, 60)) + edited + text(rng.randint(0, 60)))]
    passages, _ = shared_spans.shared_passages(spark.createDataFrame(rows, "id long, text string"), "id", "text", alike=True)
    found = {(r.rep1, r.rep2): r for r in passages.collect()}
    true = {k for k in found if k[0] % 2 == 0 and k[1] == k[0] + 1}
    assert len(true) >= 0.9 * 150 and len(true) >= 0.99 * len(found)
    assert all(found[k].identity >= 0.8 or found[k].runs for k in true)


def test_keys_of_many_classes_meet_in_blocks(spark):
    rows = [(k, r) for k in (1, 2, 3) for r in range(23)] + [(4, 5), (4, 40), (5, 41), (4, 5)]
    got = shared_spans.meeting_pairs(spark.createDataFrame(rows, "key long, rep long"), block=5)
    assert tuples(got) == sorted([(a, b) for a in range(23) for b in range(a + 1, 23)] + [(5, 40)], key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=20), st.text(alphabet="abc", max_size=20))
def test_gap_alignment_counts_the_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
    assert shared_spans.aligned_gap(a, b) == best[-1][-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=25))
def test_chains_partition_the_matches_and_are_collinear(matches):
    found = shared_spans.chains(matches, 5)
    assert sorted(x for c in found for x in c) == sorted(set(matches))
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:], strict=False))


def test_first_chain_is_the_best():
    rng = random.Random(5)
    for _ in range(30):
        m = sorted({(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(8)})

        def value(c):
            return 5 + sum(min(5, b[0] - a[0], b[1] - a[1]) - shared_spans.GAP_COST * abs((b[0] - b[1]) - (a[0] - a[1])) for a, b in zip(c, c[1:], strict=False))

        best = 0.0
        for mask in range(1, 1 << len(m)):
            c = [x for i, x in enumerate(m) if mask >> i & 1]
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False)):
                best = max(best, value(c))
        assert value(shared_spans.chains(m, 5)[0]) >= 0.6 * best  # exact where seeds do not overlap


# --- 3 residue


def test_residue(spark):
    rng = random.Random(2)
    code = lambda: "".join(rng.choices("ACDEFHJKMNPRTUVWXY23467", k=7))
    content = [lambda: f"依据{code()}号单，轴流泵须符合设计。", lambda: f"弱电井图号{code()}，由项目部核对。", lambda: "投标函须注明日期与金额，不得留空。", lambda: f"接口返回503时重试3次，记录{code()}。", lambda: "会话过期后须自动注销。", lambda: '配置项为{"id": "' + code() + '"}，对应轴流泵。']
    bad = [lambda: f"投标人：{{{{bidder}}}}，图号{code()}，由项目部核对。", lambda: f"网关超时，请稍后重试。请求号{code()}", lambda: "您的浏览器已禁用脚本功能，请开启后刷新", lambda: "示例文字 请替换本段", lambda: f"Access denied. Incident {code()}"]
    rows = [(i, content[i % 6](), rng.choice(["template", " Suspicious", None]), i // 3) for i in range(300)]
    rows += [(1000 + i, bad[i % 5](), "suspicious", i // 3) for i in range(60)] + [(2000 + i, content[1](), "${level}", i) for i in range(9)]
    rows += [(3000, None, None, None), (3001, "", "template", 1), rows[0]]
    df = spark.createDataFrame(rows, "k long, t string, v string, h long").withColumn("probability", F.lit(1))
    got = {r.k: r.probability for r in residue.residue_scores(df, "k", "t", "v", "h").collect()}
    assert {k for k, p in got.items() if p >= 0.5} == {r[0] for r in rows if 1000 <= r[0] < 3000}
    figures = {r.held_out: r for r in residue.validation(df, "k", "t", "v", "h").collect()}
    assert figures["hosts"].recall > 0.9 and figures["hosts"].precision > 0.9 and {"phrases: slot", "phrases: filler", "phrases: status_latin", "phrases: status_han"} < set(figures)
    assert residue.residue_scores(df.limit(0), "k", "t", "v", "h").count() == 0


# --- 4 groups


def by_union(links):
    up: dict[str, str] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("peel", [0, 1, 4])
def test_groups_against_union_find(spark, peel):
    rng = random.Random(peel)
    links = [(f"n{rng.randint(0, 80):02d}", f"n{rng.randint(0, 80):02d}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("hub", f"h{i}") for i in range(40)] + [(None, "x"), ("y", None), ("z", "z"), ("a", "b"), ("b", "a")]
    df = spark.createDataFrame(links, "file1 string, file2 string").withColumn("v", F.lit("clash")).withColumn("p", F.lit(1))
    assert dict(tuples(groups.connected_groups(df, "file1", "file2", peel_rounds=peel))) == by_union(links)


def test_groups_of_nothing(spark):
    assert groups.connected_groups(spark.createDataFrame([(None, "x")], "a string, b string"), "a", "b").count() == 0


# --- 5 names


def test_names(spark):
    ref = spark.createDataFrame([(1, "专项样品寄送服务费", None), (2, "季度仓库保管支出", ["仓库保管费"]), (3, "季度仓库保管费用", []), (4, None, ["x"])], "ref_id int, canon_name string, aliases array<string>")
    typed = {
        10: (" 专项样品寄送服务费", 1), 11: ("（3）專项样品寄送服務费（含税）", 1), 12: ("专项样品寄送务服费", 1), 13: ("专 项 样 品 寄 送 服 务 费", 1), 14: ("本项目仓库保管费", 2), 15: ("季度仓库保管支", 2), 16: ("季度餐饮补给费用", -1),
        17: ("-", -1), 18: ("", -1), 19: ("2、季度仓库保管费用为", 3), 20: ("x" * 5000, -1), 21: ("12", -1), 22: ("【季度仓库保管支出】", 2),
    }
    rows = [(k, v) for k, (v, _) in typed.items()] + [(30, None), (31, "专项样品寄送服务费"), (10, typed[10][0])]
    df = spark.createDataFrame(rows, "item_id long, name string").withColumn("v", F.lit(1)).withColumn("ref_id", F.lit(5))
    assert dict(tuples(canonical_names.map_to_reference(df, "item_id", "name", ref))) == {k: r for k, (_, r) in typed.items()}
    assert {r.ref_id for r in canonical_names.map_to_reference(df, "item_id", "name", ref.limit(0)).collect()} == {-1}
    assert canonical_names.map_to_reference(df.limit(0), "item_id", "name", ref).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("甲乙丙", max_size=7), st.text("甲乙丙", max_size=7))
def test_symmetric_deletion_finds_every_near_name(a, b):
    def plain(x, y):
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        d[:, 0], d[0, :] = range(len(x) + 1), range(len(y) + 1)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    if plain(a, b) <= 2:
        assert canonical_names.deletions(a, 2) & canonical_names.deletions(b, 2)
        assert canonical_names.weighted_distance(a, b) <= 2


def test_joined_look_up_is_that_of_the_dictionary(spark):
    rng = random.Random(3)
    names = ["专项样品寄送服务费", "备用仓库保管支出", "夜间系统集成包干价", "桥架安装费", "仪表校准费", "人员培训", "保险"]
    typed = [None, "", "。"] + names
    for _ in range(120):
        t = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["甲", "费", "1", " ", ""])
        typed.append(rng.choice(["", "1. ", "本项目"]) + "".join(t) + rng.choice(["", "（元）", "为"]))
    rows = spark.createDataFrame(list(enumerate(typed)), "k long, v string")
    ref = spark.createDataFrame([(i, n, ["培训"] if i == 5 else None) for i, n in enumerate(names)], "ref_id int, canon_name string, aliases array<string>")
    assert tuples(canonical_names.map_to_reference(rows, "k", "v", ref, most_deletions=0)) == tuples(canonical_names.map_to_reference(rows, "k", "v", ref))


# --- 6 look-alikes


def test_equal_looking(spark):
    same = [
        ("price CNY 1,234.50", ["price СΝΥ 1,234.50", "ｐｒｉｃｅ CNY 1,234.50", "price CNY 1,2​34.50", "price CNY 𝟏,234.50"]),
        ("Véronne 人工", ["Véronne 人工", "Véronne ⼈エ"]),
        ("the supplier", ["the ѕuррlіer", "tһe supplier"]),
    ]
    other = ["price CNY 1234.50", "PRICE CNY 1,234.50", "price ① CNY", "price 1 CNY", "the supplier.", "кот", "人工 the supplier"]
    rows, want, n = [], set(), 0
    for base, variants in same:
        ids = []
        for v in (base, *variants):
            rows.append(("s", n, v))
            ids.append(n)
            n += 1
        want |= {("s", a, b) for a in ids for b in ids if a < b}
    rows += [("s", 100 + i, v) for i, v in enumerate(other)] + [("s", 200, None), ("s", 201, ""), ("s", 202, "​"), ("s", 203, rows[0][2]), ("t", 0, rows[1][2])]
    want |= {("s", a, 203) for a in range(1, 5)}
    df = spark.createDataFrame(rows, "src string, id long, text string").withColumn("v", F.lit(1)).withColumn("known", F.lit(2))
    uniform = lookalikes.uniform_text(df, ["src", "id"], "text")
    assert set(tuples(lookalikes.equal_looking_pairs(uniform, "src", "id", "text"))) == want
    forms = {(r.src, r.id): r.uniform for r in uniform.collect()}
    assert forms["s", 200] is None and forms["s", 201] == "" and forms["s", 105] == "кот"
    assert lookalikes.uniform_text(df.limit(0), ["src", "id"], "text").count() == 0


@pytest.mark.parametrize("text", ["НАТО и СССР", "НАТО", "комиссия СССР", "Москва", "κόσμος", "ΑΘΗΝΑ και Σ", "кот и о", "中文 СССР 项目"])
def test_genuine_words_of_other_scripts_stay(text):
    assert lookalikes._repair(text, {"a", "o", "is", "Москва", "CAT"}) == text


@pytest.mark.parametrize(("text", "want"), [("Москвa", "Москва"), ("сontroller", "controller"), ("the Ассess іѕ", "the Access is"), ("No VFСU", "No VFCU"), ("No Τ3Н", "No T3H"), ("хyz the", "хyz the")])
def test_tokens_go_to_their_dominant_script(text, want):
    assert lookalikes._repair(text, {"controller", "Access", "is", "Москва", "the"}) == want


def test_look_classes_and_the_join_beyond_the_bound(spark):
    df = spark.createDataFrame([("s", 1, "the supplier"), ("s", 2, "the ѕuррlіer"), ("s", 3, "the supplier"), ("s", 4, "other"), ("s", 5, None), ("t", 6, "")], "src string, id long, text string")
    few = lookalikes.uniform_text(df, ["src", "id"], "text")
    joined = lookalikes.uniform_text(df, ["src", "id"], "text", most_known=0)
    assert tuples(few) == tuples(joined)
    assert tuples(lookalikes.look_classes(few, "src", "id", "text")) == [("s", 1, 1, 3, 2), ("s", 2, 1, 3, 2), ("s", 3, 1, 3, 2)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_plain_form_is_stable_and_composed(s):
    once = lookalikes.plain_form(s)
    assert lookalikes.plain_form(once) == once and (once.isascii() or unicodedata.is_normalized("NFC", once))


# --- 7 packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 70))
def test_pack_never_overfills_or_splits(sizes, capacity):
    where = packing.pack(np.array(sizes, np.int64), capacity)
    load = np.bincount(where, sizes) if sizes else np.zeros(0)
    assert (where >= 0).all() and (load <= capacity).all()
    if sum(sizes):
        assert len([x for x in load if x]) <= 2 * -(-sum(sizes) // capacity)


def test_packed_documents(spark):
    rng = random.Random(4)
    sizes = [(i, rng.randint(1, 900)) for i in range(3000)] + [(9000, 5000), (9001, None), (9002, 0), (9003, 1024), (9004, 2048)]
    spec = spark.createDataFrame([(1, 1024), (2, 2048), (3, None), (4, 0)], "spec_id int, capacity int")
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("capacity", F.lit(1))
    pieces = packing.packed(df, spec, bins_per_shard=300)
    rows = pieces.collect()
    for s, capacity in ((1, 1024), (2, 2048)):
        mine = [r for r in rows if r.spec_id == s]
        load: dict[str, int] = {}
        by: dict[int, list] = {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
            by.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= capacity and set(by) == {i for i, _ in sizes}
        for i, n in sizes:
            parts = sorted(by[i], key=lambda r: r.piece)
            assert sum(p.n_tokens for p in parts) == (n or 0) and [p.token_from for p in parts] == [k * capacity for k in range(len(parts))]
            assert len(parts) == max(1, -(-(n or 0) // capacity))
        assert sum(load.values()) / (len(load) * capacity) > 0.985
    assert packing.packed(df.limit(0), spec).count() == 0
    assert packing.packed(df, spec.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "合同 contract"), (2, None), (3, ""), (4, "<|endoftext|>")], "d long, t string")
    n = dict(tuples(packing.token_counts(df, "d", "t")))
    encode = packing.tokenizer(*packing.default_tokenizer()).encode_ordinary
    assert n == {1: len(encode("合同 contract")), 2: 0, 3: 0, 4: len(encode("<|endoftext|>"))}


# --- 8 leakage


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    text = lambda k: "".join(rng.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯abc12，。 ", k=k))
    items = [(i, text(rng.randint(30, 160))) for i in range(25)] + [(90, None), (91, ""), (92, "短"), (3, None)]
    docs = []
    for d in range(120):
        parts = [text(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            t = items[rng.randrange(25)][1]
            a = rng.randint(0, len(t) // 2)
            piece = t[a : a + rng.randint(20, 120)]
            parts += [rng.choice([piece, piece.upper(), "".join(c + " " for c in piece), piece.replace("a", "ａ")]), text(rng.randint(0, 60))]
        docs.append((d, "".join(parts)))
    docs += [(500, None), (501, ""), (502, "x" * 200_000 + items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = leakage.leaks(df, "doc_id", "text", spark.createDataFrame(items, "i long, t string"), "i", "t").collect()
    seen = {}
    for i, t in items:
        c = leakage.letters(t or "").tobytes()
        for k in range(0, len(c) - 159, 4):
            seen.setdefault(c[k : k + 160], set()).add(i)
    want = set()
    for d, t in docs:
        c = leakage.letters(t or "").tobytes()
        want |= {(d, i) for k in range(0, len(c) - 159, 4) for i in seen.get(c[k : k + 160], ())}
    assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= 40} == want and want
    assert all(r.score >= leakage.MATCH * r.longest_run and 0 < r.share <= 1 for r in got)
    assert leakage.leaks(df, "doc_id", "text", spark.createDataFrame([], "i long, t string"), "i", "t").count() == 0


def test_recall_on_edited_copies_of_items(spark):
    """Passages of 90 to 160 characters, one in about 25 changed, and items in several parts."""
    rng = random.Random(12)
    text = lambda k: "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳", k=k))
    items = [(i, text(200)) for i in range(40)]
    docs = []
    for i, t in items:
        a = rng.randint(0, 40)
        edited = "".join(rng.choice(["", c + "改", "异"]) if rng.random() < 1 / 25 else c for c in t[a : a + rng.randint(90, 160)])
        docs.append((i, text(150) + edited + text(150)))
    df, it = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    found = {(r.doc_id, r.item_id) for r in leakage.edited_leaks(df, "d", "t", it, "i", "t").collect()}
    assert len({p for p in found if p[0] == p[1]}) >= 36 and all(a == b for a, b in found)
    one, many = (sorted(map(tuple, leakage.leaks(df, "d", "t", it, "i", "t", most_items=n).collect())) for n in (50_000, 9))
    assert [r[:3] for r in one] == [r[:3] for r in many]


def test_alignment_against_plain_smith_waterman():
    rng = random.Random(7)
    for _ in range(10):
        a = np.array([rng.randint(1, 4) for _ in range(40)], np.uint32)
        b = np.array([x for x in a for _ in range(rng.choice([1, 1, 1, 1, 0, 2]))], np.uint32)
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH), h[i - 1, j] + leakage.GAP, h[i, j - 1] + leakage.GAP)
                best = max(best, h[i, j])
        assert leakage.align([a, a[:5]], [b, b], [0, 0], band=60)[0] == best


@settings(max_examples=60, deadline=None)
@given(st.text("甲乙ab", max_size=60), st.integers(1, 21))
def test_gram_hashes_agree_exactly_where_grams_do(s, n):
    h = leakage.hashes(leakage.letters(s), n)
    grams = [s[i : i + n] for i in range(len(s) - n + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))


# --- 9 spam


def spam_corpus():
    rng = random.Random(8)
    words = ["低价耗材", "招标代理", "采购平台", "工程报价", "保函办理", "设备租赁", "培训报名", "首页", "登录", "注册", "更多", "求购"]
    name = lambda n: "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(n))
    who, what, how, place = [name(4) for _ in range(30)], [name(6) for _ in range(300)], [name(2) for _ in range(9)], [name(3) for _ in range(60)]
    sentence = lambda: f"{rng.choice(who)}应在{rng.randint(3, 900)}日内{rng.choice(how)}提交{rng.choice(place)}的{rng.choice(what)}，并报送{rng.choice(who)}备案，保存期{rng.randint(2, 30)}年。"
    good = ["".join(sentence() for _ in range(rng.randint(3, 12))) for _ in range(300)]
    good += ["序号 | 名称 | 数量 | 单价\n" + "\n".join(f"{i} | {rng.choice(what)} | {rng.randint(1, 90)} | {rng.randint(100, 99999)}.00" for i in range(1, 12)) for _ in range(20)]
    good += [sentence() * 1 + sentence() + sentence() + "\n见https://docs.example/n/1 见https://docs.example/n/2" for _ in range(20)]
    bad = [" | ".join(rng.choices(words, k=40)) for _ in range(12)] + ["\n".join(f"{rng.choice(words)}>>https://shop.example/p/{rng.randint(1, 9999)}" for _ in range(25)) for _ in range(8)]
    bad += [sentence() + "\n" + " ".join("#" + w for w in rng.choices(words, k=60)) for _ in range(8)]
    en = ["cheap valves", "bid writing", "free template", "cable wholesale", "fast approval", "pipe supplier"]
    return good, bad + [" - ".join(rng.choices(en, k=50)) for _ in range(6)]


def test_spam(spark):
    good, bad = spam_corpus()
    rows = [(i, t) for i, t in enumerate(good)] + [(10_000 + i, t) for i, t in enumerate(bad)] + [(20_000, None), (20_001, ""), (20_002, "。，、")]
    df = spark.createDataFrame(rows, "d long, t string").withColumn("text", F.lit("clash")).withColumn("doc_id", F.lit(1))
    got = {r.doc_id: r.flagged_share for r in spam.spam_scores(df, "d", "t", low_pmi=2.0).collect()}  # few words: their PMI is bounded by log(6000)
    assert 20_000 not in got and got[20_001] == got[20_002] == 0
    flagged = {d for d, s in got.items() if s >= 0.5}
    wanted = {d for d, _ in rows if 10_000 <= d < 20_000}
    assert len(flagged & wanted) >= 0.95 * len(wanted) and len(flagged - wanted) <= 0.02 * len(good)
    assert spam.spam_scores(df.limit(0), "d", "t").count() == 0
    assert spam.spam_scores(spark.createDataFrame([(1, good[0] * 3000)], "d long, t string"), "d", "t").count() == 1


def test_english_salad_has_low_pmi_and_keyword_phrases_repeat(spark):
    rng = random.Random(4)
    who, verb, what, where = ["the site engineer", "the quality officer", "the joint venture", "the storage crew"], ["shall submit", "agrees to update", "must verify", "has reviewed"], ["the cable routing drawings", "a revised quality manual", "the acceptance protocol", "the spare parts catalogue"], ["for the pumping station", "at the northern corridor", "without interruption of operation", "before the agreed milestone"]
    sentence = lambda: f"{rng.choice(who)} {rng.choice(verb)} {rng.choice(what)} {rng.choice(where)}"
    good = [". ".join(sentence() for _ in range(rng.randint(4, 12))) for _ in range(300)]
    salad = [" ".join(rng.sample(w := " ".join(rng.sample(good, 3)).replace(".", "").split(), len(w))) for _ in range(10)]
    stuffed = [", ".join(rng.choices(["cheap valves", "bid writing", "free template", "cable wholesale", "fast approval"], k=60)) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(good + salad + stuffed)]
    got = {r.doc_id: r for r in spam.spam_scores(spark.createDataFrame(rows, "d long, t string"), "d", "t", low_pmi=3.0).collect()}
    assert sum(got[i].flagged_share >= 0.5 for i in range(300)) <= 3
    assert all(got[i].low_share >= 0.5 for i in range(300, 310)) and all(got[i].repeated_share >= 0.5 for i in range(310, 320))
    assert all(r.mean_pmi is not None for r in got.values())


def test_word_hashes_are_those_of_equal_words():
    w = spam.Words(["甲乙丙 abc-d ABC 型号355 3.5 https://x.example/a b", None, "甲乙丙，型号7 www.x.example"])
    assert w.of.tolist() == [0] * 7 + [2] * 3 and w.link.tolist() == [False] * 5 + [True] + [False] * 3 + [True]
    assert w.hash[0] == w.hash[7] and w.hash[3] == w.hash[8] and w.hash[5] == w.hash[9] and len(set(w.hash.tolist())) == 7


def test_rare_words_and_pairs_have_their_own_counts_in_a_large_corpus(spark):
    rng = random.Random(6)
    words = ["".join(chr(0x4E00 + rng.randint(0, 2000)) for _ in range(3)) for _ in range(150)]
    texts = [[words[min(int(rng.expovariate(0.04)), 149)] for _ in range(12)] for _ in range(40)]  # words and pairs seen once to some ten times
    rows = [(i, "，".join(t)) for i, t in enumerate(texts)] + [(None, "，".join(texts[0])), ((1 << 60) + 1, "，".join(texts[1]))]
    df = spark.createDataFrame(rows, "d long, t string").unionByName(spark.range(10_000).selectExpr("-1 - id d", "repeat('.', 1000) t"))
    got = {r.doc_id: r.mean_pmi for r in spam.spam_scores(df, "d", "t").where("doc_id is null or doc_id >= 0").collect()}
    texts += texts[:2]
    single, pair = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    assert min(single.values()) == min(pair.values()) == 1 < max(pair.values())
    pmi = [sum(math.log(pair[p] * 12 * len(texts) / (single[p[0]] * single[p[1]])) for p in zip(t, t[1:], strict=False)) / 11 for t in texts]
    assert got == pytest.approx(dict(zip([d for d, _ in rows], pmi, strict=True)))


# --- queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    df = queries.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name in ("p6_found", "p5_missing")
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    sql = queries.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for t in ("matches", "pair_results", "documents", "eval_items", "summarize_file", "prices"):
            db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        found = db.execute(sql)
        at = [[c[0] for c in found.description].index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
