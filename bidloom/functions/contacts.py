"""Contacts in running text: phones, identity numbers, e-mail addresses, accounts, addresses, dates.

One scan finds the runs of figures of a text, as they are written: in groups with blanks, line ends, strokes or
brackets between them, and with letters that scanning puts in place of figures. What a run is follows from how many
figures its groups have together, from dates inside it and from the label before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels in bids, and wording of the tender's own payments before an account that is not the bidder's.
PHONE_LABELS = ("联系电话", "移动电话", "手机号码", "手机", "电话", "座机", "联系方式", "传真")
ACCOUNT_LABELS = ("银行卡号", "账户号", "账号", "账户", "帐户号", "帐号", "帐户")
ADDRESS_LABELS = ("通讯地址", "联系地址", "地址")
NEXT_LABELS = ("电话", "手机", "联系", "传真", "邮编", "邮政编码", "电子邮", "邮箱", "开户", "账号", "账户", "网址", "法定代表人", "姓名", "日期")
TENDER_PAYMENT = ("保证金", "汇入", "汇至", "汇款", "缴纳", "缴付", "缴交", "招标", "代理", "工本费", "标书费", "标书款", "平台", "收费")

_RUN = re.compile(r"\+?[（(]?\d(?:[-\s()（）]{0,3}[\dOQlI|](?=[-\s()（）]{0,3}[\dOQlI|xX])|[-\s()（）]{0,3}\d)*[xX]?")
_GROUP = re.compile(r"[\dOQlI|]+[xX]?")
_TWINS = str.maketrans("OQlI|", "00111")
_MAIL = re.compile(r"[\w.%+-]+[@＠](?:[\w-]+\.)+[a-z]{2,}", re.ASCII | re.IGNORECASE)
_FILL = "_＿ \t\n：:=－-"


@dataclass
class Run:
    """Groups of figures that stand together, where they begin and what separates them."""

    start: int
    end: int
    groups: list[str]
    between: list[str]

    def spans(self, size: int) -> Iterator[tuple[int, int, str]]:
        """(first group, after the last, figures) of successive groups that have ``size`` figures together."""
        for i in range(len(self.groups)):
            joined = ""
            for j in range(i, len(self.groups)):
                joined += self.groups[j]
                if len(joined) >= size:
                    if len(joined) == size:
                        yield i, j + 1, joined
                    break


def runs(text: str) -> list[Run]:
    out = []
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 5 or text[m.start() - 1 : m.start()].isascii() and text[m.start() - 1 : m.start()].isalpha():
            continue
        parts = list(_GROUP.finditer(m[0]))
        between = [m[0][a.end() : b.start()] for a, b in zip(parts, parts[1:], strict=False)]
        out.append(Run(m.start(), m.end(), [p[0].translate(_TWINS) for p in parts], between))
    return out


def _labelled(text: str, at: int, labels: tuple[str, ...], reach: int = 12) -> bool:
    """Whether one of the labels stands right before a place, with nothing but fill between."""
    before = text[max(0, at - reach) : at].rstrip(_FILL + "（()）+")
    return re.sub(r"\s", "", before).endswith(labels)


def _is_day(s: str) -> bool:
    return "1800" <= s[:4] < "2100" and "01" <= s[4:6] <= "12" and "01" <= s[6:8] <= "31"


def _phones(run: Run, labelled: bool) -> list[str]:
    out = []
    for size in (11, 13):
        for i, j, d in run.spans(size):
            d = d[2:] if size == 13 and d.startswith("86") else d
            if len(d) == 11 and d[0] == "1" and d[1] in "3456789" and d.isdigit() and all(len(x.strip()) <= 1 for x in run.between[i : j - 1]):
                out.append(d)
    if out:
        return out
    whole = "".join(run.groups)
    area = run.groups[0] if run.groups[0][0] == "0" else ""
    if len(area) in (3, 4) and len(run.groups) > 1 and ("-" in run.between[0] or labelled or run.between[0].strip()) and len(whole) - len(area) in (7, 8) and whole.isdigit():
        return [f"{area}-{whole[len(area) :]}"]
    if labelled and whole[0] == "0" and len(whole) in (10, 11, 12) and whole.isdigit():
        cut = 3 if len(whole) in (10, 11) else 4
        return [f"{whole[:cut]}-{whole[cut:]}"]
    return []


def contacts(text: str) -> list[tuple[str, str]]:
    """(kind, value) of each contact, in order of kind and place, each once. Numbers may be broken by blanks and line
    ends; accounts whose label stands after wording of the tender's own payments are left out."""
    found: dict[str, list[str]] = {"phone": [], "id_number": [], "email": [], "bank_account": [], "address": []}
    for run in runs(text):
        account = _labelled(text, run.start, ACCOUNT_LABELS)
        whole = "".join(run.groups)
        if account:
            if 9 <= len(whole) <= 25 and whole.isdigit() and not any(w in text[max(0, run.start - 48) : run.start] for w in TENDER_PAYMENT):
                found["bank_account"].append(whole)
            continue
        ids = [d.upper() for _, _, d in run.spans(18) if d[:17].isdigit() and _is_day(d[6:14])]
        found["id_number"] += ids
        if not ids:
            found["phone"] += _phones(run, _labelled(text, run.start, PHONE_LABELS))
    found["email"] = [m[0].replace("＠", "@").lower() for m in _MAIL.finditer(text)]
    found["address"] = [a for a in map(_address, _after(text, ADDRESS_LABELS)) if a]
    return list(dict.fromkeys((k, v) for k, values in found.items() for v in values))


def _after(text: str, labels: tuple[str, ...]) -> Iterator[str]:
    """What stands on the line after each label and its colon."""
    for m in re.finditer(rf"(?:{'|'.join(labels)})[_＿\s]*[：:]([^\n]*)", text):
        yield m[1]


def _address(value: str) -> str | None:
    cut = min((i for label in NEXT_LABELS if (i := value.find(label)) > 0), default=len(value))
    bare = value[: min(cut, 100)].strip(_FILL + "　")
    return bare if len(bare) >= 8 else None


def response_date(text: str) -> str | None:
    """The date that the first 800 characters state after the word for it, as yyyy-mm-dd."""
    m = re.search(r"(?:日\s*期|时\s*间)\s*[：:]?[_＿\s]*(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})", text[:800])
    return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}" if m else None


def extracted_contacts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value): all contacts in the texts, in one Arrow pass. Null texts have none."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *c) for k, t in zip(batch["k"], batch["t"], strict=True) for c in contacts(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "value"])

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(extract, f"{key} {kind}, kind string, value string")


def mobile(c: Column) -> Column:
    """A mobile number in eleven figures, null if it is none; without Python."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    digits = F.when((F.length(digits) == 13) & digits.startswith("86"), F.substring(digits, 3, 11)).otherwise(digits)
    return F.when(digits.rlike(r"^1[3-9][0-9]{9}\z"), digits)


def clean_phone(c: Column) -> Column:
    """A phone number as it stands in a field: junk around it away, brackets and padding inside it too."""
    c = F.regexp_replace(F.regexp_replace(c, r"^[^0-9(（]+", ""), r"[^0-9()（）-]+\z", "")
    return F.regexp_replace(F.translate(c, "()（）", ""), r"(?<=[0-9-])[ \t]+(?=[0-9-])", "")
