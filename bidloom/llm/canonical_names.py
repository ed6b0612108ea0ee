"""Problem 5: map freely typed values to the entries of a reference list, and report the values no entry names.

Method: a symmetric-delete dictionary of the list is broadcast (its size is checked; a larger list is joined by the same
deletions instead) and gives, for each typed value,
the entries within a bounded edit distance; candidates are ranked by a weighted Damerau-Levenshtein distance and then by
how often the entry occurs, spelt exactly, in all rows. What no entry is near enough to is reported as a miss.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.session import materialize

# Traditional forms and their simplified counterparts, as met in names of costs.
TRADITIONAL = "專備倉庫場標識數據製軟體費務網絡應設裝現車輛檢測員補償結構統類項錄處變電線纜氣熱質監驗環養護測繪評審業區遠雜險繳級訓練術報價開發廠樓園綠燈鋼鐵層壓閥門點運輸維續臨時違約罰獎勵經營紙張圖書館課題專利權認證諮詢關聯單總計稅見詳"
SIMPLIFIED = "专备仓库场标识数据制软体费务网络应设装现车辆检测员补偿结构统类项录处变电线缆气热质监验环养护测绘评审业区远杂险缴级训练术报价开发厂楼园绿灯钢铁层压阀门点运输维续临时违约罚奖励经营纸张图书馆课题专利权认证咨询关联单总计税见详"
TO_SIMPLE = str.maketrans(TRADITIONAL, SIMPLIFIED)
# What is put before or after a name without changing what it means.
LEAD = re.compile(r"^\s*(?:[①-⑳㈠-㈩]|[（(]\s*(?:\d{1,2}|[一二三四五六七八九十]{1,3})\s*[)）]|\d{1,2}(?:\.\d{1,2})*\s*[.、．)）]|\d{1,2}(?:\.\d{1,2})+\s|[一二三四五六七八九十]{1,3}\s*[、.．])\s*")
TAIL = re.compile(r"(?:[（(]\s*(?:不?含税|暂估|估|元|万元|人民币|暂列|税前|税后)\s*[)）]|[*：:；;，,。])\s*$")
OPENING = re.compile(r"^本(?:项目|工程|标段|合同)")
STRAY = re.compile(r"^\d{1,3}(?=\D)|(?<=.)为$")
NO_LETTER = re.compile(r"[\W_]+")


def bare(text: str) -> str:
    """A typed value without numbering, brackets, remarks, blanks and marks; styled and traditional forms unified."""
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    before = None
    while before != text:
        before = text
        text = TAIL.sub("", LEAD.sub("", text)).strip()
        if len(text) > 2 and text[0] in "【\"“[「'《" and text[-1] in "】\"”]」'》":
            text = text[1:-1]
    text = NO_LETTER.sub("", unicodedata.normalize("NFKC", text).translate(TO_SIMPLE)).lower()
    return OPENING.sub("", text)


def deletions(word: str, most: int) -> set[str]:
    """The word and all it can become by deleting up to ``most`` characters."""
    return {"".join(word[i] for i in range(len(word)) if i not in cut) for n in range(min(most, len(word)) + 1) for cut in map(set, combinations(range(len(word)), n))}


def weighted_distance(typed: str, name: str) -> float:
    """Damerau-Levenshtein (adjacent transpositions) where a doubled character, a swap and a trailing 为 cost less."""
    n, m = len(typed), len(name)
    d = [[float(j) for j in range(m + 1)]] + [[float(i)] + [0.0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            drop = 0.6 if i > 1 and typed[i - 1] == typed[i - 2] else 0.5 if i == n and typed[i - 1] == "为" else 1.0
            best = min(d[i - 1][j] + drop, d[i][j - 1] + 1.0, d[i - 1][j - 1] + (typed[i - 1] != name[j - 1]))
            if i > 1 and j > 1 and typed[i - 1] == name[j - 2] and typed[i - 2] == name[j - 1] and typed[i - 1] != typed[i - 2]:
                best = min(best, d[i - 2][j - 2] + 0.8)
            d[i][j] = best
    return d[n][m]


@dataclass
class Dictionary:
    """The reference list, indexed by deletions of its names and aliases."""

    names: dict[str, int]  # bare name or alias -> entry
    frequency: dict[int, int]
    most: int = 2
    index: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))
    longest: int = 0

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.names), default=0)
        for name in self.names:
            for part in deletions(name, self.edits(name)):
                self.index[part].append(name)

    def edits(self, name: str) -> int:
        """Edits that still leave a name recognisable: none up to 3 characters, one up to 5, else ``most``."""
        return 0 if len(name) <= 3 else 1 if len(name) <= 5 else self.most

    def look_up(self, typed: str) -> int:
        """The entry meant, or -1. Ties of distance go to the more frequent entry, then to the smaller number."""
        word = bare(typed)
        cut = STRAY.sub("", word)  # numbering or a trailing word that marks inside it kept bare() from seeing
        for w in (word, cut):
            if w in self.names:
                return self.names[w]
        word = cut
        if not word:
            return -1
        if len(word) > self.longest + self.most:  # no name is within the distance
            return -1
        near = {name for part in deletions(word, self.most) for name in self.index.get(part, ())}
        ranked = sorted((weighted_distance(word, n), -self.frequency.get(self.names[n], 0), self.names[n], n) for n in near)
        return next((ref for dist, _, ref, n in ranked if dist <= self.edits(n)), -1)


def reference_names(reference: DataFrame) -> DataFrame:
    """(name, ref_id): the bare names and aliases of a list, each once. A name wins over an alias, the smaller ref_id over
    the larger, where two entries read alike."""
    bare_udf = F.pandas_udf(lambda s: s.map(bare, na_action="ignore"), T.StringType())
    rows = reference.where("ref_id is not null and canon_name is not null")
    each = rows.select("ref_id", F.lit(0).alias("rank"), F.col("canon_name").alias("n")).unionByName(rows.select("ref_id", F.lit(1).alias("rank"), F.explode("aliases").alias("n")))
    named = each.where("n is not null").select("ref_id", "rank", bare_udf("n").alias("name")).where("name <> ''")
    return named.groupBy("name").agg(F.min(F.struct("rank", "ref_id")).alias("b")).select("name", F.col("b.ref_id").alias("ref_id"))


def joined_look_up(values: DataFrame, names: DataFrame, frequency: DataFrame, most: int = 2) -> DataFrame:
    """(v, ref_id) of distinct values: what Dictionary.look_up gives, for lists of any size. Values and names meet on a
    deletion they share; distance, frequency and number rank what meets, as they do in the dictionary."""
    edits = Dictionary({}, {}, most).edits

    def value_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for v in batch["v"]:
                word = bare(v)
                cut = STRAY.sub("", word)
                rows += [(v, word, True, word)] + [(v, cut, False, p) for p in (deletions(cut, most) if cut else ())]
            yield pd.DataFrame(rows, columns=["v", "word", "whole", "part"])

    def name_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, r, p) for n, r in zip(batch["name"], batch["ref_id"], strict=True) for p in deletions(n, edits(n))]
            yield pd.DataFrame(rows, columns=["name", "ref_id", "part"])

    @F.pandas_udf(T.DoubleType())
    def rank(words: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([d if (d := weighted_distance(w, x)) <= edits(x) else None for w, x in zip(words, n, strict=True)], dtype="float64")

    a = values.select("v").mapInPandas(value_parts, "v string, word string, whole boolean, part string")
    b = names.select("name", F.col("ref_id").cast("long")).mapInPandas(name_parts, "name string, ref_id long, part string")
    met = a.join(b, "part").where("not whole or word = name").select("v", "word", "whole", "name", "ref_id").distinct()
    scored = met.withColumn("d", rank("word", "name")).where("d is not null and not isnan(d)").join(frequency, "ref_id", "left")
    order = F.struct((F.col("word") != F.col("name")).alias("near"), (~F.col("whole")).alias("cut"), "d", (-F.coalesce("n", F.lit(0))).alias("f"), "ref_id")
    best = scored.groupBy("v").agg(F.min(order).alias("b")).select("v", F.col("b.ref_id").alias("ref_id"))
    return values.select("v").join(best, "v", "left").select("v", F.coalesce("ref_id", F.lit(-1)).cast("long").alias("ref_id"))


def map_to_reference(rows: DataFrame, key: str, value: str, reference: DataFrame, most_deletions: int = 1_000_000, most: int = 2) -> DataFrame:
    """(key, ref_id) of each row whose value is neither null nor, character for character, a reference name.

    ref_id is -1 where no entry is within the bounded distance (also for empty values and mere marks). Repeated rows
    of a key count once. Where the list's deletions number at most ``most_deletions`` rows are mapped where they are:
    nothing is shuffled but the repeated keys, and a value that a third of all rows share is looked up once per task.
    Beyond that the distinct values are joined with the deletions.
    """
    spark = rows.sparkSession
    known = reference.select(F.col("canon_name").alias("name")).where("name is not null").distinct()
    exact = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("name")).agg(F.count(F.lit(1)).alias("n")).join(known, "name", "left_semi")
    entries = reference.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("canon_name").alias("name")).where("ref_id is not null")
    frequency = exact.join(entries, "name").groupBy("ref_id").agg(F.max("n").alias("n"))
    names = materialize(reference_names(reference))
    length = F.length("name")
    size = names.agg(F.coalesce(F.sum(1 + length + length * (length - 1) / 2), F.lit(0)).alias("s")).first()["s"]
    typed = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v is not null").join(known, F.col("v") == F.col("name"), "left_anti")
    if size > most_deletions:
        mapped = joined_look_up(typed.select("v").distinct(), names, frequency, most)
        return typed.join(mapped, "v").select(F.col("k").alias(key), "ref_id").distinct()
    shared = spark.sparkContext.broadcast(Dictionary({r["name"]: r["ref_id"] for r in names.collect()}, {r["ref_id"]: r["n"] for r in frequency.collect()}, most))  # both within the bound

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            for v in batch["v"].unique():
                if v not in known:
                    known[v] = shared.value.look_up(v)
            yield pd.DataFrame({key: batch["k"], "ref_id": batch["v"].map(known).astype("int64")})

    return typed.mapInPandas(look_up, f"{key} long, ref_id long").distinct()
