"""Text scalars as native column expressions. All patterns name their characters one by one, so that they mean the same
in every regex engine; null in, null out."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks and invisible characters that comparisons skip.
BLANKS = r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INVISIBLE = r"\x{AD}\x{200B}-\x{200D}\x{FEFF}"
SKIPPED = f"[{BLANKS}{INVISIBLE}]+"
TOC_DOTS = "[.．…]{2,}"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
# One-to-one folding of width, case and punctuation for comparisons.
FOLD_FROM = "".join(map(chr, range(0xFF01, 0xFF5F))) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "。、‘’‚“”„【】〔〕《》〈〉『』—–―−…·×÷￥"
FOLD_TO = "".join(chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)) + "abcdefghijklmnopqrstuvwxyz" + ".,'''\"\"\"[][]<><>[]----..x/¥"
# Misreadings inside labels that are no proper words.
LABEL_FIXES = (("法定代表入", "法定代表人"), ("人民巾", "人民币"), ("委托入", "委托人"), ("电活", "电话"), ("联糸", "联系"), ("身分证", "身份证"), ("售权委托", "授权委托"))
SHEET = "【工作表】"
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def sanitize(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def without_leader_dots(c: Column) -> Column:
    """Runs of two and more dots (of a table of contents) away; they are blanks in comparisons, so length may shrink."""
    return F.regexp_replace(c, TOC_DOTS, "")


def match_form(c: Column) -> Column:
    """The form in which texts are compared: no leader dots, blanks or invisible characters; width, case and
    punctuation folded one to one."""
    return F.translate(F.regexp_replace(without_leader_dots(c), SKIPPED, ""), FOLD_FROM, FOLD_TO)


def visible(c: Column) -> Column:
    """Every kind of line end as a line feed, zero-width characters away."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x{0C}\x{0B}\x{2028}\x{2029}]", "\n")
    return F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]", "")


def narrow_digits(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS, DIGITS)


def fixed_labels(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LABEL_FIXES, c)


def without_fill_brackets(c: Column) -> Column:
    """Brackets around filled-in values away; the sheet marker keeps its own."""
    masked = F.replace(c, F.lit(SHEET), F.lit("\x00"))
    bare = F.translate(masked, "【】", "")
    return F.replace(bare, F.lit("\x00"), F.lit(SHEET))


def joined_digits(c: Column) -> Column:
    """Blanks between figures away, letters that are read for figures between figures put right."""
    c = F.regexp_replace(c, rf"(?<=[0-9])[{BLANKS}]+(?=[0-9])", "")
    c = F.regexp_replace(c, "(?<=[0-9])[OQ](?=[0-9])", "0")
    return F.regexp_replace(c, r"(?<=[0-9])[lI|](?=[0-9])", "1")


def joined_ideographs(c: Column) -> Column:
    """Blanks (not line ends) between ideographs away."""
    return F.regexp_replace(c, r"(?<=[\x{4E00}-\x{9FFF}])[ \t\x{A0}\x{3000}]+(?=[\x{4E00}-\x{9FFF}])", "")


# Words of bids that line ends and padding of a page must not split.
PHRASES = (
    "法定代表人身份证明", "法定代表人证明", "法定代表人", "单位负责人", "授权委托书", "授权委托", "委托书", "授权书", "授权代表", "授权代表人", "委托代理人", "被授权人", "受托人", "代理人", "签字代表", "投标代表",
    "签字", "签章", "盖章", "公章", "单位章", "盖单位章", "项目负责人", "项目经理", "技术负责人", "采购负责人", "项目副经理", "联系电话", "联系方式", "身份证号", "身份证",
    "供应商名称", "投标人名称", "单位名称", "公司名称", "企业名称", "招标人名称", "项目名称", "人员配备表", "技术标", "商务标", "资信标", "投标文件", "投标人",
    "开标一览表", "报价一览表", "投标报价表", "分项报价表", "报价明细表", "分项明细表", "投标总价", "含税总价", "不含税总价", "投标函", "人民币", "人民币大写", "报价函", "报价单",
    "总价", "合计", "总计", "金额", "单价", "投标价格", "投标总报价", "首次报价", "最终报价", "最终投标报价", "磋商报价", "谈判报价", "响应报价", "报价总额", "报价金额",
    "大写金额", "小写金额", "含税报价", "不含税报价", "报价总表", "银行卡号", "现委派", "兹委派",
)
_SPLIT = frozenset((p[:i], p[i:]) for p in PHRASES for i in range(1, len(p)))
_REACH = max(map(len, PHRASES)) - 1
_GAP = re.compile(r"(?<=[一-鿿])\s+(?=[一-鿿])")


def glued_text(text: str) -> str:
    """The phrases put together again where blanks or line ends split them: each gap between ideographs closes if some
    phrase stands across it, whatever other gaps that phrase has."""
    gaps = list(_GAP.finditer(text))
    if not gaps:
        return text
    out, at = [], 0
    for m in gaps:
        left = re.sub(r"\s+", "", text[max(0, m.start() - 4 * _REACH) : m.start()])[-_REACH:]
        right = re.sub(r"\s+", "", text[m.end() : m.end() + 4 * _REACH])[:_REACH]
        if any((left[-i:], right[:j]) in _SPLIT for i in range(1, len(left) + 1) for j in range(1, len(right) + 1)):
            out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def glued(s: pd.Series) -> pd.Series:
    return s.map(glued_text, na_action="ignore")


def tightened(c: Column) -> Column:
    """Padding of a page around marks away: blanks before closing marks and after opening brackets; each kind of blank as
    a plain one, one at a time."""
    c = F.translate(c, "\u00a0\u3000", "  ")
    c = F.regexp_replace(c, r"[ \t\n\r\x{0B}\x{0C}]+([：:，,。；;、）)])", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"([（(])[ \t\n\r\x{0B}\x{0C}]+", "$1"), " {2,}", " ")


# Frequent family names after which a line may end inside a name.
BROKEN_AFTER = "王李张刘陈杨黄赵周吴徐孙马胡朱郭何罗高林郑梁谢唐宋韩冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹易常武乔"


def whole_names(text: str) -> str:
    """Names put together that a line end splits after the family name: a line that ends with one takes up the next, unless
    that begins with a mark, or with a numeral and a mark as numbered headings do."""
    out: list[str] = []
    for line in text.split("\n"):
        start = line.lstrip()
        given = len(start[:2]) if all("一" <= c <= "鿿" for c in start[:2]) else 1 if "一" <= start[:1] <= "鿿" else 0
        if out and given and out[-1].rstrip()[-1:] in set(BROKEN_AFTER) and start[given : given + 1] not in set("、，。：:."):
            out[-1] = out[-1].rstrip() + start
        else:
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def joined_names(s: pd.Series) -> pd.Series:
    return s.map(whole_names, na_action="ignore")


# Traditional numerals and their simple forms.
TRADITIONAL_NUMERALS, SIMPLE_NUMERALS = "萬億貳陸圓", "万亿贰陆圆"


def plain_money(c: Column) -> Column:
    """Currency codes in capitals, traditional numerals in their simple forms."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bcny\b", "CNY"), r"(?i)\brmb\b", "RMB")
    return F.translate(c, TRADITIONAL_NUMERALS, SIMPLE_NUMERALS)


def masked_id(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 6), F.lit("****"))


def masked_account(c: Column) -> Column:
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 4), F.lit("******"), F.substring(c, -4, 4))).otherwise(c)


def person_key(c: Column) -> Column:
    """The key that one person's name has in all its spellings: kinds of middle dot unified, blanks away."""
    return F.regexp_replace(F.translate(c, "•・‧∙", "····"), SKIPPED, "")


def display_name(c: Column) -> Column:
    """A stored file name without the folder and the unique prefix (eight hexadecimal digits and a line)."""
    return F.regexp_replace(F.regexp_replace(c, "^.*/", ""), "^[0-9a-f]{8}_", "")


def group_name(c: Column) -> Column:
    """A bidder's name from a file name: without extension, volume number and marks at the end."""
    c = F.regexp_replace(c, r"\.[A-Za-z0-9]+\z", "")
    return F.regexp_replace(c, r"[_\-\t ]*[0-9]*\z", "")


def item_name(c: Column) -> Column:
    """A cost item's name for comparisons: match form without numbering in front and remarks in brackets."""
    c = F.regexp_replace(match_form(c), r"^[0-9]+([.,][0-9]+)*[.,)]?", "")
    return F.regexp_replace(F.regexp_replace(c, r"\([^()]*\)", ""), r"[.,:*\"\[\]\-]", "")


def occurrences(c: Column, words: list[str]) -> Column:
    """How often the words occur in all, each counted without overlap."""
    return reduce(lambda a, b: a + b, [(F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in words])


def meaningful(c: Column) -> Column:
    """Number of ideographs, letters and figures."""
    return F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}A-Za-z0-9]", ""))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)\z", 1))
