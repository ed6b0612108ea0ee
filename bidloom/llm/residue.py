"""Problem 3: what a template, a failed page or a blocked viewer left behind in place of content.

Method: a regularized linear classifier on hashed character n-grams, length and title features (how the text and the
level begin and end), trained on weak labels from response-status wording and phrases and validated on hosts that the
training has not seen; the host of a record is what its comparison (``host`` column) belongs to.

The training sample is bounded (``most_rows`` a label, taken by the smallest hash of the key, so the same rows whatever
the partitioning); every row is scored. The weak labels only choose training rows: what is excluded is decided by the
classifier alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.leakage import hashes
from bidloom.session import materialize

BITS = 18
LEVELS = frozenset({"", "substantial", "suspicious", "template", "high", "medium", "low", "info"})
# Weak labels. Shapes of slots that a template leaves to be filled:
SLOT = re.compile(
    r"\{\{[^{}\"]{0,40}\}\}|[$#]\{[^{}\"]{0,40}\}|(?<![\{\"])\{[^{}\":]{1,40}\}(?!\})|<%[^%]{0,40}%>|<<[^<>]{1,40}>>|<[^<>\d/=]{1,12}>|%[^%\s\d，。,.]{2,20}%|@@[^@]{1,20}@@"
    r"|【(?!工作表)[^【】]{1,20}】(?![^\n]{0,12}\|)|\[(?:请|待)[^\[\]]{1,20}\]|\[object \w+\]|[×✕]{3,}|_{4,}|X{4,}(?![A-Z0-9/-])|(?<!\w)(?:undefined|null|NaN|N/A)(?!\w)|(?<![A-Za-z])TBD(?![A-Z0-9])|#(?:N/A|REF|VALUE|NAME\?|DIV/0)!?|待(?:填写|补|定)|请填写"
)
FILLER = re.compile(r"lorem ipsum|dolor sit amet|占位|示例文字|请替换|样张文本|测试数据|正文内容|sample (?:copy|text)|placeholder text", re.I)
# Response-status wording: a page that answers with an error, a refusal or a demand instead of its content.
STATUS_LATIN = re.compile(
    r"HTTP \d{3}|^\W*\d{3} (?:Not Found|Forbidden|Bad Gateway|Internal)|not found[: ]|access denied|internal error|backend not reachable|(?:null\w*|\w+exception) at line|was moved$|session (?:has )?expired"
    r"|(?:enable|switch on|turn on|needs?|requires?) (?:java)?script|service unavailable|bad gateway|too many requests|please (?:log ?in|try again|refresh|wait)|captcha",
    re.I,
)
STATUS_HAN = re.compile(
    r"页面(?:已失效|不存在)|无权限(?:查看|访问)|(?:会话|登录)已(?:过期|失效)|(?:网关|连接|数据库)\w{0,6}超时(?!阈值|后|须|应)|未能加载|转换失败|系统维护中|无法载入|脚本(?:功能|被拦截|后才能)|启用脚本|允许\s?(?:JS|JavaScript|脚本)运行|稍后(?:重试|再试)|校验浏览器|(?:开启|启用|打开)\s?(?:JS|JavaScript|Cookie|脚本)"
    r"|(?:服务|系统)器?(?:繁忙|错误|异常)(?!时|后|须|应)|请(?:刷新|稍候|重新登录)|排队编号|(?:人机|安全)验证|加载(?:中|失败)|网络(?:异常|错误)|访问(?:受限|被拒)",
    re.I,
)
FAMILIES = {"slot": SLOT, "filler": FILLER, "status_latin": STATUS_LATIN, "status_han": STATUS_HAN}
# A sentence that speaks of such things as a requirement, a setting or a record:
SPEAKS_OF = re.compile(r"不得留空|须\w{0,4}(?:注销|给出|注明|提示)|阈值|仍可|重试\s?\d+\s?次|填写完毕|配置项|script-free")
SERIAL = re.compile(r"(?=[A-Z0-9/-]*[A-Z0-9])[A-Z0-9](?:[A-Z0-9]|[/-](?=[A-Z0-9])){4,}")
OWN = {"JAVASCRIPT", "UNDEFINED"}
CLAUSE = re.compile(r"[。；;\n，]+|,(?!\d)|(?<=[a-z])[.!?]\s")


def weak_label(kind: str, clause: str) -> int:
    """1 residue, 0 content, -1 the phrases disagree (not used for training)."""
    if kind == "level":
        return int(clause.lower() not in LEVELS)
    left = any(p.search(clause) for p in FAMILIES.values())
    return -1 if left and SPEAKS_OF.search(clause) else int(left)


def simplified(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    text = SERIAL.sub(lambda m: m[0] if m[0].upper() in OWN else "§", text)
    return re.sub(r"\d+", "9", text).lower()


def shape(text: str) -> str:
    """Runs of ideographs, of other letters and of digits each as one sign, a run of one sign as such; marks stay, so a slot shows whatever it names."""
    text = re.sub(r"(.)\1{2,}", r"\1∞", text)
    return re.sub(r"[a-z]+(?:_[a-z]+)*(?!∞)", "a", re.sub(r"[一-鿿㐀-䶿]+", "字", text))


def clauses(text: str | None, level: str | None) -> list[tuple[str, str]]:
    """The parts of a record that are judged one by one: the clauses of its text and the level as it stands."""
    out = [("text", c) for c in CLAUSE.split(text or "") if c.strip()]
    level = (level or "").strip()
    return out + [("level", level)] * bool(level)


def reduced(kind: str, clause: str) -> str:
    return simplified(clause if kind == "text" else clause.lower()).strip()


def features(kind: str, t: str) -> np.ndarray:
    """Distinct hashed features of a reduced clause: n-grams of 1 to 5 characters, n-grams of its shape, its length, and its
    title, that is how it begins and ends. Levels and text have features of their own."""
    out, salt = [], 1 if kind == "text" else 101
    with np.errstate(over="ignore"):
        for part, (s, sizes) in enumerate(((t, (1, 2, 3, 4, 5)), (shape(t), (1, 2, 3, 4, 5)))):
            codes = np.frombuffer(("\u0002" + s + "\u0003").encode("utf-32-le", "surrogatepass"), "<u4")
            out += [(hashes(codes, n) + np.uint64(salt + 20 * part + n)) * np.uint64(0xC2B2AE3D27D4EB4F) for n in sizes]
        for n, title in ((30, t[:4]), (31, t[-4:])):
            codes = np.frombuffer((title + "\u0001").encode("utf-32-le", "surrogatepass"), "<u4")
            out.append((hashes(codes, len(codes)) + np.uint64(salt + n)) * np.uint64(0x165667B19E3779F9))
        out.append(np.array([salt + 1000 + min(12, len(t).bit_length())], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique((np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    known: dict[tuple[str, str], float] = field(default_factory=dict)

    def probability(self, kind: str, clause: str) -> float:
        """Of one clause; clauses that differ only in serial and other numbers are the same and computed once a task."""
        key = (kind, reduced(kind, clause))
        if key not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            z = float(self.weights[features(*key)].sum()) + self.bias
            self.known[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return self.known[key]


def train(rows: list[np.ndarray], labels: np.ndarray, l2: float = 1e-6, rate: float = 0.3, epochs: int = 30, seed: int = 1) -> Linear:
    """Logistic regression with L2, by mini-batches with adaptive steps; both labels weigh the same in sum."""
    w, grow, bias, bias_grow = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), 0.0, 1e-2
    pos = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * pos), len(labels) / (2 * max(1, len(labels) - pos)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            lengths = np.array([len(rows[i]) for i in batch])
            idx = np.concatenate([rows[i] for i in batch])
            z = np.add.reduceat(w[idx], np.append(0, np.cumsum(lengths)[:-1])) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            used, inverse = np.unique(idx, return_inverse=True)
            step = np.bincount(inverse, np.repeat(g, lengths)) + l2 * w[used]
            grow[used] += step**2
            w[used] -= rate * step / np.sqrt(grow[used])
            bias_grow += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias_grow)
    return Linear(w.astype(np.float32), bias)


def training_rows(records: DataFrame, key: str, text: str, level: str, host: str, most_rows: int) -> list[Row]:
    """(k, t, v, h, y): at most ``most_rows`` rows a label, those of the smallest key hashes. One pass labels all rows; each
    task keeps that many of a label, which no longer depends on how many rows there are."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            batch["y"] = np.array([max((weak_label(*c) for c in clauses(t, v)), default=0) for t, v in zip(batch["t"], batch["v"], strict=True)], np.int32)
            for y in (0, 1):
                mine = batch[batch["y"] == y]
                held = pd.concat([best[y], mine]) if y in best else mine
                best[y] = held.nsmallest(most_rows, "o") if len(held) > most_rows else held
        for part in best.values():
            yield part

    seen = records.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(level).alias("v"), F.col(host).cast("string").alias("h"), F.xxhash64(key).alias("o"))
    kept = materialize(seen.mapInPandas(label, "k string, t string, v string, h string, o long, y int"))
    return [r for y in (0, 1) for r in kept.where(F.col("y") == y).orderBy("o", "k", "t", "v").limit(most_rows).collect()]


def _sample(rows: list[Row]) -> dict[tuple[str, str], tuple[str, str]]:
    """The distinct clauses of rows by their reduced form."""
    distinct: dict[tuple[str, str], tuple[str, str]] = {}
    for r in rows:
        for kind, c in clauses(r["t"], r["v"]):
            distinct.setdefault((kind, reduced(kind, c)), (kind, c))
    return distinct


def _trained(clauses_: dict[tuple[str, str], tuple[str, str]]) -> Linear:
    sample = [(features(*key), y) for key, c in clauses_.items() if (y := weak_label(*c)) >= 0]
    y = np.array([v for _, v in sample], np.int64)
    if not len(y) or not y.sum() or y.all():
        return Linear(np.zeros(1 << BITS, np.float32), -1.0)
    return train([x for x, _ in sample], y)


def fitted(records: DataFrame, key: str, text: str, level: str, host: str, most_rows: int = 12_000) -> Linear:
    """The classifier, trained on the distinct clauses of the training rows of all hosts. With no rows of one label it says
    "content" to everything."""
    return _trained(_sample(training_rows(records, key, text, level, host, most_rows)))


def validation(records: DataFrame, key: str, text: str, level: str, host: str, most_rows: int = 12_000) -> DataFrame:
    """(held_out, n, n_residue, precision, recall) of classifiers that have not seen what they are tried on: a fifth of the
    hosts; and in turn each family of phrases of the weak labels, all of whose clauses are left out of the training and
    tried (recall only, beside the clauses of content of the held-out hosts for precision)."""
    rows = training_rows(records, key, text, level, host, most_rows)
    away = lambda h: zlib.crc32((h or "").encode()) % 5 == 0
    seen, unseen = _sample([r for r in rows if not away(r["h"])]), [r for r in rows if away(r["h"])]
    out = []

    def figures(name: str, p: list[bool], y: list[bool]) -> None:
        hit = sum(a and b for a, b in zip(p, y, strict=True))
        out.append((name, len(y), sum(y), hit / sum(p) if any(p) else None, hit / sum(y) if any(y) else None))

    model = _trained(seen)
    figures("hosts", [record_probability(model, r["t"], r["v"]) >= 0.5 for r in unseen], [r["y"] == 1 for r in unseen])
    other = [c for c in _sample(unseen).values() if weak_label(*c) == 0]
    for name, pattern in FAMILIES.items():
        of = {k: c for k, c in _sample(rows).items() if c[0] == "text" and pattern.search(c[1])}
        mine = [c for c in of.values() if weak_label(*c) == 1]
        if mine:
            model = _trained({k: c for k, c in seen.items() if k not in of})
            figures(f"phrases: {name}", [model.probability(*c) >= 0.5 for c in mine + other], [True] * len(mine) + [False] * len(other))
    return records.sparkSession.createDataFrame(out, "held_out string, n long, n_residue long, precision double, recall double")


def record_probability(model: Linear, text: str | None, level: str | None) -> float:
    """That of the clause most like residue; 0 if there is none."""
    return max((model.probability(*c) for c in clauses(text, level)), default=0.0)


def residue_scores(records: DataFrame, key: str, text: str, level: str, host: str, most_rows: int = 12_000) -> DataFrame:
    """(key, probability) of every record that it is residue; repeated rows stay.

    A null or empty field has no clauses; a record of two such fields is not residue (0). Texts are judged whole.
    """
    model = fitted(records, key, text, level, host, most_rows)
    shared = records.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([record_probability(shared.value, a, b) for a, b in zip(t, v, strict=True)], dtype="float64")

    return records.select(F.col(key), score(F.col(text), F.col(level)).alias("probability"))
