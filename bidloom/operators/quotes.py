"""The price that a bid states, from running text.

One Arrow pass finds every amount of money in a text, with what stands before and after it, and emits rows: candidates
for the total, each with the channel its cue belongs to; tax rates; quoted rates; and amounts written twice, in numerals
and in figures. Which candidate is the bid's total is decided afterwards by aggregation: the best channel, then the
section of the bid's summary before the rest of the text, then the stronger cue, then the earlier place.

Amounts that belong to somebody else (deposits, ceilings, earlier contracts, fees), that stand in a bank voucher, that
are rates per unit, years or days, or that echo a deposit named elsewhere, are no candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.amounts import NUMERALS, SIMPLE, TRADITIONAL, is_day, parsed_amount
from bidloom.functions.text import LABEL_FIXES, SHEET, WIDE_DIGITS, glued_text

# Labels of the bid's total, and wording that makes an amount something else.
TOTAL_LABELS = (
    "投标总价", "投标总报价", "投标总价格", "总报价", "总报价额", "报价总额", "报价总金额", "合计报价", "报价金额", "投标报价", "投标价格", "项目总价", "投标总金额", "总金额", "最终报价", "最终投标报价", "最后报价",
    "首次报价", "首轮报价", "二次报价", "响应报价", "响应总价", "磋商报价", "谈判报价", "含税总报价", "含税报价", "投标金额", "响应文件总价", "竞标报价", "投标价",
)
NOT_THE_BID = re.compile(
    "保证金|投标保证|押金|投标保函|银行保函|履约保证|合同金额|合同价款|签约合同价|中标金额|结算金额|成交金额|售价|注册资*金|出资|暂列金额|暂定价|暂定金额|最高限价|招标控制价|控制价|拦标价|暂估价|预算金?[额财]?"
    "|违约金|赔偿金|罚金|代理服务费|中标服务费|交易服务费|平台使用费|工本费|标书款|手续费|佣金"
)
VOUCHER = re.compile("账号|开户行|开户银行|电汇|汇款|转账|缴款|制单|回单|贷记|银行流水|收款人|付款人|出票|票据|凭证|业务回执|承兑|汇票|支票|本票|网银")
DEPOSIT = re.compile("投标保证金|履约保证金|投标保函|保证金|押金")
SECTION_HEADS = ("开标一览表", "开标一览", "投标报价表", "报价一览表", "报价总表", "投标总价", "报价汇总表", "价格汇总表", "报价单", "最高限价", "投标函附录", "唱标单", "开标记录表", "投标一览表", "投标函", "投标总报价", "报价书", "投标报价一览", "分项报价表")
SECTION_ENDS = ("投标分项报价", "法定代表人身份证明", "技术方案", "项目概况", "资格证明文件")
PRICE_WORDS = re.compile("元|人民币|CNY|RMB|￥|¥|报价|价格|税前|税后|含税|投标|金额|总价|开标|一览表|大写|小写|合计|总计")

_FIGURES = r"(?<![\d.,])(?:\d{1,3}(?: \d{3})+(?!\d)|\d[\d,]*)(?:\.\d+)?"
_NUMERALS = rf"[{NUMERALS}](?:\s*[{NUMERALS}])*(?:\s*[元圆]\s*[整正]?(?:\s*[{NUMERALS}]\s*[角毛])?(?:\s*零?\s*[{NUMERALS}]\s*分)?\s*[整正]?|[整正])?"
AMOUNT = re.compile(rf"(?P<n>{_FIGURES})[ \t]*(?P<u>[万亿])?[ \t]*(?P<y>元)?|(?P<cn>{_NUMERALS})")
FILL = "_＿ \t\n：:="
PLAIN_TOTALS = ("总价", "总计", "合计")
TAXED, UNTAXED, TAX_NOUNS = ("含税", "税后"), ("不含税", "税前"), ("总价格", "总价", "价格", "金额", "价")
RATE_LABELS = ("下浮率", "下浮比例", "下浮幅度", "优惠率", "优惠幅度", "折扣率", "费率", "投标报价下浮", "下浮")
RATE_UNITS = re.compile(r"[_＿\s]*(%|％|‰|个?百分点)")
_TOTAL_ROW = re.compile(r"^\s*(?:总价|报价|金额)?合\s*计\s*(?:金额)?\s*[：:]?")


@dataclass(frozen=True)
class Label:
    """What stands right before an amount: the words, a remark in brackets after them, and how they are joined to it."""

    words: str
    remark: str
    joint: str

    @classmethod
    def before(cls, text: str, joints: str = FILL) -> Label:
        core = text.rstrip(joints)
        joint, remark = text[len(core) :], ""
        if core.endswith(("）", ")")) and 0 <= (at := max(core.rfind("（"), core.rfind("("))) and len(core) - at <= 14:
            core, remark = core[:at].rstrip(), core[at + 1 : -1]
        return cls(core, remark, joint)


def cue_of(before: str, written: str) -> tuple[int, int, int] | None:
    """(channel, strength, factor) of an amount by what stands before it on its line or the one above, the first that holds:
    a currency sign; the word for the smaller writing; a label of the bid's total; a plain total with a colon; a label whose
    remark gives the unit; the word for the larger writing; a price with tax."""
    sign = before.rstrip("_＿ \t\n：:")
    if sign.endswith(("￥", "¥", "CNY", "RMB", "USD")):
        return 1, 0, 1
    if before.rstrip("_＿ \t：:").endswith("人民币"):  # on its own line only
        return 1, 1, 1
    writing = before.rstrip(FILL + "￥¥（()）").removesuffix("金额").rstrip(" （()）")
    if writing.endswith("小写") and written == "figures":
        return 2, 1, 1
    label = Label.before(before, FILL + "为是")
    if label.words.endswith(TOTAL_LABELS) and label.joint and "万" not in label.remark:
        return 2, 2, 1
    colon = "：" in label.joint or ":" in label.joint
    if label.words.removesuffix("金额").endswith(PLAIN_TOTALS) and colon and not label.remark:
        return 2, 3, 1
    unit = label.remark.replace("单位", "").replace("人民币", "").strip("：: ")
    if unit == "元" and label.words.endswith(("金额", "报价")) and colon:
        return 2, 4, 1
    if unit in ("万", "万元", "元") and label.words.endswith(TOTAL_LABELS + PLAIN_TOTALS):
        return 3, 0, 10_000 if "万" in unit else 1
    if writing.endswith("大写") and written == "numerals":
        return 4, 0, 1
    if colon and _tax_price(label.words, TAXED):
        return 8, 0, 1
    return None


def _tax_price(words: str, kinds: tuple[str, ...]) -> bool:
    words = words.removesuffix("款")
    noun = next((n for n in TAX_NOUNS if words.endswith(n)), None)
    return noun is not None and words.removesuffix(noun).endswith(kinds)


def rate_label(before: str) -> bool:
    label = Label.before(before)
    return label.words.replace(" ", "").endswith(RATE_LABELS)


GLOBAL_NOTE = "总价来自全文兜底匹配，置信度较低，建议人工复核"
SCHEMA = "kind string, channel int, strength int, outside boolean, place int, value double, other double, rate double, written string, near boolean"


@dataclass(frozen=True)
class Row:
    """kind: total, ex_tax, tax, quote, pair. value: the amount or rate; other: the amount before tax of a total, the
    figures of a pair; near: price wording stands around it."""

    kind: str
    channel: int
    strength: int
    outside: bool
    place: int
    value: float | None
    other: float | None = None
    rate: float | None = None
    written: str = "figures"
    near: bool = True


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    value: float
    written: str
    unit: bool  # 万 or 亿 stands with it


def readable(text: str) -> str:
    """The text as the cues expect it: line ends and width unified, fill brackets away, split words whole."""
    text = re.sub("\r\n?|[\x0b\x0c  ]", "\n", text)
    text = re.sub("[​-‍⁠﻿\xad]", "", text)
    for bad, good in LABEL_FIXES:
        text = text.replace(bad, good)
    text = text.replace(SHEET, "\x00").translate(str.maketrans(WIDE_DIGITS + "：，％＠＝" + TRADITIONAL, "0123456789:,%@=" + SIMPLE, "【】")).replace("\x00", SHEET)
    text = glued_text(text).replace("\xa0", " ").replace("　", " ")
    text = re.sub(r"\s+([：:，,。；;、）)])", r"\1", text)
    text = re.sub(r" {2,}", " ", re.sub(r"([（(])\s+", r"\1", text))
    return re.sub(r"(?i)\b(?:cny|rmb)\b", lambda m: m[0].upper(), text)


def mentions(text: str) -> list[Mention]:
    out = []
    for m in AMOUNT.finditer(text):
        if m["cn"]:
            bare = re.sub(r"\s", "", m["cn"])
            if len(bare) > 1 and (value := parsed_amount(bare)):
                out.append(Mention(m.start(), m.end(), value, "numerals", True))
        else:
            value = parsed_amount(m["n"].rstrip(",") + (m["u"] or ""))
            if value is not None:
                out.append(Mention(m.start(), m.end(), value, "figures", bool(m["u"])))
    return out


def summary_section(text: str, found: list[Mention]) -> tuple[int, int] | None:
    """Where the bid's price summary stands: the first heading of the most telling kind that is neither an entry of a
    table of contents nor a mention, and that a price follows; up to the next section or 3,000 characters."""
    starts = [m.start for m in found]

    def priced(lo: int, hi: int) -> bool:
        return any(m.written == "numerals" and m.value >= 100 or m.unit or m.value >= 1000 or cue_of(text[max(0, m.start - 20) : m.start], m.written) for m in found[bisect_right(starts, lo - 1) : bisect_right(starts, hi)])

    places = sorted((kind, at) for kind, head in enumerate(SECTION_HEADS) for at in _occurrences(text, head))
    for kind, at in places:
        line = text[text.rfind("\n", 0, at) + 1 : at].strip()
        after = text[at + len(SECTION_HEADS[kind]) : at + len(SECTION_HEADS[kind]) + 5].strip()
        in_contents = "..." in text[max(0, at - 40) : at]
        in_list = line.endswith(("．", ".")) and len(line) <= 3 and line[:1] not in "第" or line.endswith(("）", ")")) and line[:-1].lstrip("（(").isdigit() or after.startswith(("；", "。"))
        quoted = line.endswith(("《", "〈", "“", "‘", "\""))
        if in_contents or in_list or quoted or not priced(at, at + 400):
            continue
        return at, min([at + 3000, len(text)] + [e for w in SECTION_ENDS if (e := text.find(w, at + 30)) > at])
    return None


def _occurrences(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def _near_price(text: str, m: Mention, window: int = 200) -> bool:
    """Whether price wording stands around an amount that is not labelled as somebody else's."""
    before = text[max(0, m.start - 30) : m.start]
    if re.search(r"万元?\s*$", before):
        return False
    return bool(PRICE_WORDS.search(text[max(0, m.start - window) : m.end + window]))


def _line_start(text: str, at: int) -> int:
    """Where the line begins that an amount's label stands on: its own, or the one before if it begins its line."""
    start = text.rfind("\n", 0, at) + 1
    return start if text[start:at].strip("_＿ \t￥¥：:") or not start else text.rfind("\n", 0, start - 1) + 1


def _rows_of_totals(text: str, found: list[Mention], starts: list[int]) -> Iterator[Row]:
    """Totals in rows of tables: cells with bars, or figures apart by blanks and strokes."""
    at = 0
    for line in text.split("\n"):
        first, last = bisect_right(starts, at - 1), bisect_right(starts, at + len(line) - 1)
        here = [m for m in found[first:last] if m.written == "figures" or m.unit]
        end, begin = at + len(line), at
        at = end + 1
        if not here or not re.search(r"合\s*计|总\s*计", line):
            continue
        if "|" in line:
            if re.search(r"(?:合|总)\s*计\s*\|", line):
                large = [m.value for m in here if m.value >= 10_000]
                if len(large) > 1:
                    yield Row("total", 5, 0, True, begin, large[-1], large[-2])
                elif large and (large[0] >= 50_000 or "总计" in line):
                    yield Row("total", 5, 1, True, begin, large[0], large[0])
            continue
        label = _TOTAL_ROW.match(line) or re.search(r"(?:合|总)\s*计(?=[\s_＿])", line)
        if not label:
            continue
        after = [m for m in here if m.start >= begin + label.end()]
        if not after or text[begin + label.end() : after[0].start].strip("\\/、_＿ \t"):
            continue
        big = [m.value for m in after if m.value >= 50_000 and not is_day(m.value)]
        rate = next((m.value for m in after[1:] if 1 <= m.value <= 30 and m.end - m.start <= 2), None)
        if len(big) > 1 and label.re is _TOTAL_ROW:
            low, high = sorted(big[:2])
            pair = (high, low) if high / low <= 1.5 else (big[1], big[0])
            yield Row("total", 6, 0, True, begin, *pair, rate)
        elif big:
            yield Row("total", 6 if label.re is _TOTAL_ROW else 7, 1, True, begin, big[0], big[0], rate)


def _taxes(text: str, found: list[Mention], lo: int, hi: int) -> Iterator[Row]:
    """Amounts before and after tax with the rate between or behind them, and rates by themselves."""
    own = [m for m in found if lo <= m.start < hi and m.written == "figures"]
    for a, b, c in zip(own, own[1:], own[2:], strict=False):
        first, second = text[a.end : b.start], text[b.end : c.start]
        apart = not first.strip(" \t\n￥¥人民币：:%％") and not second.strip(" \t\n￥¥人民币：:%％")
        if not apart:
            continue
        if 1 <= b.value <= 30 and ("%" in second or "％" in second) and a.value >= 10_000 and c.value >= 10_000:
            yield Row("tax", 0, 0, False, a.start, c.value, a.value, b.value)
        elif 1 <= c.value <= 30 and c.value == int(c.value) and c.end - c.start <= 2 and a.value >= 10_000 and b.value >= 10_000 and max(a.value, b.value) / min(a.value, b.value) <= 1.25 and not is_day(a.value) and not is_day(b.value):
            yield Row("tax", 1, 0, False, a.start, b.value, a.value, c.value)
    for i, m in enumerate(own):  # a small whole number by itself
        if not 1 <= m.value <= 30 or m.value != int(m.value) or m.end - m.start > 2:
            continue
        after = text[m.end : m.end + 12].lstrip()
        amount_near = any(x.value >= 1000 and m.start - x.end <= 100 for x in own[max(0, i - 3) : i])
        if amount_near and after.startswith(("增值税", "专用", "普通", "发票")):
            yield Row("tax", 2, 1, False, m.start, None, None, m.value)
        elif after.startswith(("%", "％")):
            yield Row("tax", 2, 2, False, m.start, None, None, m.value)
        elif re.search("税率[（(]%", text[max(lo, m.start - 110) : m.start].replace(" ", "")) and not after[:1].isdigit():
            yield Row("tax", 2, 0, False, m.start, None, None, m.value)


def _quoted_rates(text: str, found: list[Mention], lo: int, hi: int) -> Iterator[Row]:
    """Rates that the bid quotes: a number with its unit behind it, or in the remark of its label."""
    for m in found:
        if not lo <= m.start < hi or m.written != "figures" or not 0 < m.value < 100:
            continue
        before = text[max(0, m.start - 40) : m.start].rsplit("\n", 1)[-1]
        unit = RATE_UNITS.match(text, m.end)
        label = Label.before(before)
        if unit and rate_label(before) or not unit and label.remark in ("%", "％") and label.words.endswith("投标报价"):
            yield Row("quote", 0, 0, False, m.start, m.value, written="‰" if unit and unit[1] == "‰" else "%")


def _pairs(text: str, found: list[Mention]) -> Iterator[Row]:
    """An amount in numerals and one in figures that is labelled as the same, within 120 characters."""
    for i, m in enumerate(found):
        if m.written != "numerals" or m.value <= 1000 or not re.search("[元圆整角分万亿]", text[m.start : m.end]):
            continue
        for other in found[i + 1 : i + 4] + found[max(0, i - 1) : i]:
            if other.written == "figures" and other.value > 1000 and abs(other.start - m.start) <= 150 and cue_of(text[max(0, other.start - 30) : other.start], "figures") == (2, 1, 1):
                yield Row("pair", 0, 0, False, m.start, m.value, other.value)
                return


def price_rows(raw: str) -> list[Row]:
    """All rows of a text; see the module."""
    text = readable(raw)
    found = mentions(text)
    starts = [m.start for m in found]
    section = summary_section(text, found) or (0, 0)
    out: list[Row] = []
    deposits = {round(n.value, 2) for d in DEPOSIT.finditer(text) for n in found[bisect_right(starts, d.end() - 1) : bisect_right(starts, d.end() + 30)] if n.unit and n.value >= 100}
    for m in found:
        if m.value < 100 and not re.search(r"[（(][^）)]*万", text[max(0, m.start - 30) : m.start]) or is_day(m.value) and not m.unit:
            continue
        if re.match(r"[ \t]*年", text[m.end :]) or re.match(r"[ \t]*(?:元[ \t]*)?[/／]|[ \t]*元?[ \t]*(?:人月|每)", text[m.end : m.end + 12]):
            continue
        start = _line_start(text, m.start)
        before = text[max(start, m.start - 60) : m.start]
        if NOT_THE_BID.search(text[start : m.start]):
            continue
        outside = not section[0] <= m.start < section[1]
        near = _near_price(text, m)
        label = Label.before(before)
        if ("：" in label.joint or ":" in label.joint) and _tax_price(label.words, UNTAXED):
            out.append(Row("ex_tax", 8, 0, outside, m.start, m.value, near=near))
            continue
        echo = any(abs(m.value - d) < 1 for d in deposits)
        voucher = bool(VOUCHER.search(text, max(0, m.start - 160), min(len(text), m.end + 160)))
        cue = cue_of(before, m.written)
        if cue is None:
            continue
        channel, strength, factor = cue
        value = m.value * (factor if not m.unit else 1)
        if channel <= 3 and (voucher or echo) or value < (1000 if channel == 4 else 100):
            continue
        kind = "scaled" if value != m.value else m.written
        out.append(Row("total", channel, strength, outside, m.start, value, value if channel < 8 else None, None, kind, near or kind != "figures"))
    out += _quote_rows(text, section)
    out += _rows_of_totals(text, found, starts)
    lo, hi = section if section[1] else (0, len(text))
    out += _taxes(text, found, lo, hi)
    out += _pairs(text, found)
    out += _quoted_rates(text, found, lo, hi)
    return out


def _quote_rows(text: str, section: tuple[int, int]) -> Iterator[Row]:
    """The row of a quotation table that has no label at all: a cell that is nothing but an amount in numerals."""
    at = section[0]
    for line in text[section[0] : section[1]].split("\n"):
        cells = [c.strip() for c in line.split("|")]
        amounts = [v for c in cells if len(cells) > 1 and re.fullmatch(rf"(?:{_NUMERALS})", c) and (v := parsed_amount(c)) and v >= 50_000]
        if amounts and not NOT_THE_BID.search(line):
            yield Row("total", 0, 0, False, at, amounts[-1], amounts[-1], written="numerals")
            return
        at += len(line) + 1


def price_candidates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, channel, strength, outside, place, value, other, rate, written, near): the rows of all texts in one
    Arrow pass. Null and empty texts have none; texts are read whole."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(getattr(r, n) for n in names)) for k, t in zip(batch["k"], batch["t"], strict=True) for r in price_rows(t)]
            yield pd.DataFrame(rows, columns=[key, *names]).astype({"value": "float64", "other": "float64", "rate": "float64"})

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''").mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def decided_prices(candidates: DataFrame, key: str, global_least: float = 5000) -> DataFrame:
    """(key, in_tax, ex_tax, tax_rate, quoted_rate, outside, warnings): what each text's price is, from its candidates.

    The total is the first by channel, summary section, strength and place. Totals from outside the summary must reach
    ``global_least`` and stand near price wording. Where numerals and figures of one amount disagree by more than 1 %
    the figures count. A rate that the two totals contradict by more than 15 % is dropped; totals apart by a factor of
    20 and more cancel each other. Without a total before tax it follows from the rate. One aggregation, no window.
    """
    c = candidates
    for name in ("value", "other", "rate"):
        c = c.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    order = F.struct("channel", "outside", "strength", "place")

    def first(kind: str, *fields: str) -> Column:
        return F.min_by(F.struct(*fields), F.when(F.col("kind") == kind, order))

    g = c.groupBy(key).agg(
        first("total", "value", "other", "rate", "outside", "near", "written", "channel").alias("t"),
        first("ex_tax", "value").alias("e"),
        first("tax", "value", "other", "rate", "channel").alias("x"),
        first("quote", "value", "written").alias("q"),
        first("pair", "value", "other").alias("p"),
    )
    doubtful = F.coalesce(F.col("t.outside"), F.lit(True))
    total = F.when(~doubtful | ((F.col("t.value") >= global_least) & F.col("t.near")), F.col("t.value"))
    pair_off = F.abs(F.col("p.value") - F.col("p.other")) > F.greatest("p.value", "p.other") * 0.01
    held_numerals = pair_off & (F.abs(total - F.col("p.value")) <= F.greatest("p.value", "p.other") * 0.01)
    both = F.col("x.value").isNotNull()
    g = g.withColumn("_pair_off", F.coalesce(pair_off & total.isNotNull(), F.lit(False))).withColumn("_switched", F.coalesce(held_numerals, F.lit(False)))
    in_tax = F.when(both, F.col("x.value")).when(F.col("_switched"), F.col("p.other")).otherwise(total)
    g = g.withColumn("in_tax", in_tax).withColumn("ex_tax", F.when(both, F.col("x.other")).otherwise(F.coalesce(F.col("e.value"), F.when(F.col("in_tax").isNotNull(), F.when(F.col("_switched"), F.col("p.other")).otherwise(F.col("t.other"))))))
    g = g.withColumn("tax_rate", F.when(F.col("in_tax").isNotNull(), F.coalesce("t.rate", "x.rate")))
    derived = F.round(F.col("in_tax") / (1 + F.col("tax_rate") / 100), 2)
    g = g.withColumn("ex_tax", F.when(F.col("tax_rate").isNotNull() & ((F.col("ex_tax") == F.col("in_tax")) | F.col("ex_tax").isNull()), derived).otherwise(F.col("ex_tax")))
    apart = F.coalesce((F.col("in_tax") / F.col("ex_tax") > 20) | (F.col("in_tax") / F.col("ex_tax") < 0.05), F.lit(False))
    odd = F.abs(F.col("in_tax") / (F.col("ex_tax") * (1 + F.col("tax_rate") / 100)) - 1) > 0.15
    figure = F.format_number(F.col("p.other"), 0)
    notes = F.array(
        F.when(F.col("_switched"), F.concat(F.lit("大写金额("), F.format_number(F.col("p.value"), 0), F.lit(")与小写("), figure, F.lit(")不一致，已采用小写值，建议人工复核"))),
        F.when(F.col("_pair_off") & ~F.col("_switched"), F.concat(F.lit("检测到大写("), F.format_number(F.col("p.value"), 0), F.lit(")与小写("), figure, F.lit(")金额不一致，请人工复核"))),
        F.when(F.col("in_tax").isNotNull() & ~both & F.col("t.outside") & (F.col("t.channel") >= 5), GLOBAL_NOTE),
    )
    return g.select(
        key,
        F.when(~apart, F.col("in_tax")).alias("in_tax"),
        F.when(~apart, F.col("ex_tax")).alias("ex_tax"),
        F.when(~apart & ~F.coalesce(odd, F.lit(False)), F.col("tax_rate")).alias("tax_rate"),
        F.when(F.col("q.value").isNotNull(), F.concat(F.regexp_replace(F.col("q.value").cast("string"), r"\.0\z", ""), F.col("q.written"))).alias("quoted_rate"),
        F.coalesce(F.col("t.outside"), F.lit(True)).alias("outside"),
        F.filter(notes, lambda x: x.isNotNull()).alias("warnings"),
    )


def extracted_prices(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The price of each text that states anything about one; see decided_prices."""
    return decided_prices(price_candidates(texts, key, text), key)
