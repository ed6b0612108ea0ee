"""Rules that tell template wording from content, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions.text import occurrences

# Wording of signature blocks, announcements, laws and declarations that every bid repeats.
SIGNATURE = "供应商名称|法定代表人或授权代表签字|法定代表人签字|授权代表签字|法定代表人（签字）|授权委托人（签字）|法定代表人或其委托代理人|法定代表人或委托代理人|项目编号|项目名称|注：|公章|供应商全称|盖单位章|签字或盖章|（单位公章）|（盖章）|签字或印章|法定代表人盖章|委托代理人签字|日期：|年 月 日|年月日|供应商（公章）|供应商：（盖章）|投标人名称|投标人（盖章）|投标人全称|投标人地址|投标人电话|投标人传真|联系人：|联系电话：|传真：|开户银行：|账号：|银行账号：|纳税人识别号：|统一社会信用代码："
ANNOUNCEMENT = "投标人须知|投标人须知前附表|投标人须知正文|招标文件的获取|招标文件获取方式|招标文件获取时间|投标文件的递交|投标文件递交截止|投标文件递交地点|投标截止时间|开标时间|开标地点|发布公告的媒介|本招标公告在|本次招标公告在|投标保证金|投标保证金的金额|投标保证金的形式|评标办法|评标委员会|评标办法前附表|资格审查办法|资格审查方式|资格后审|资格预审|踏勘现场|不组织踏勘现场|招标代理机构|电子投标文件|电子招标投标|电子招标文件|招标条件|项目概况与招标范围|投标人资格要求|投标人应具备|本次招标不接受联合体|本次招标接受联合体|联合体投标"
LEGAL = "根据《中华人民共和国招标投标法》|依据《中华人民共和国招标投标法》|根据《中华人民共和国政府采购法》|符合《政府采购法》|根据《中华人民共和国招标投标法实施条例》|依据《招标投标法实施条例》|信用中国|中国政府采购网|失信被执行人|重大税收违法案件当事人|政府采购严重违法失信行为记录名单|信用信息查询|信用记录查询|行贿犯罪档案查询|无行贿犯罪记录|本招标项目|招标项目|招标编号"
DECLARATION = "我公司郑重承诺|我单位郑重承诺|本公司郑重声明|具有独立承担民事责任的能力|具有良好的商业信誉和健全的财务会计制度|具有履行合同所必需的设备和专业技术能力|有依法缴纳税收和社会保障资金的良好记录|近三年内在经营活动中没有重大违法记录|在参加政府采购活动前三年内|法律、行政法规规定的其他条件|具有独立法人资格|独立承担民事责任|不是联合体投标|非联合体投标|单位负责人为同一人或者存在直接控股|管理关系的不同供应商|为本项目提供整体设计、规范编制|不得同时参加本项目|中小企业声明函|残疾人福利性单位声明函|监狱企业证明文件"
NUMBERING = "(项目|采购|招标|工程|标段)[ \t\n]*(编号|代码|名称)[：:]|(包号|标段|包件|分包)[ \t\n]*[：:]|^第.{1,4}[章节条款]"
FURNITURE = r"^[ \t]*(?i:目[ \t]*录|TOC|Table of Contents)[ \t]*\z|^[ \t]*[0-9IVX]+[ \t]*\z|^[-=＿.]{5,}\z"
FORMAL = ["应当", "必须", "不得", "严禁", "应具备", "须具备", "承诺", "保证", "保证其", "确保", "遵守", "递交", "送达", "提交", "受理", "备案", "规定", "要求", "条件", "资格"]
FORMAL_SCORE = ["应当", "必须", "不得", "严禁", "遵守", "执行", "保证", "承诺", "确保", "承担", "履行", "提供", "规定", "要求", "条件", "标准", "规范", "递交", "送达", "提交"]


def any_word(words: list[str]) -> str:
    """A pattern for any of the words that looks at each character of a text once: words are grouped by how they begin,
    so a place that no word begins at costs one test instead of one for each word."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + (f"(?:{rest})" if (rest := any_word(sorted(set(tails)))) and "|" in rest else rest) for c, tails in sorted(by.items())]
    if len(parts) > 4 and len(words) > 20:  # the first character of any word, before the words are tried
        return f"(?=[{''.join(sorted(by))}])(?:{'|'.join(parts)})"
    return "|".join(parts)


WORDS = [w for group in (SIGNATURE, ANNOUNCEMENT, LEGAL, DECLARATION) for w in group.split("|")]
WORDING = any_word(WORDS).replace("\\ ", " ")
# Shapes of technical terms and of numbers. Each pattern counts by itself.
TECHNICAL = ["[A-Z]{2,}[-–][0-9]{2,}", "[A-Z][A-Z0-9-]{3,}", "[0-9]+[×xX][0-9]+", r"[0-9]+(?:\.[0-9]+)?[mMkK]?[WwVvAaHhZz]", "毫米|厘米|米|千米|克|千克|吨|升|毫升|平方米|立方米|公顷", "台|套|件|个|组|批|项|次|人|天|月|年"]
NUMERIC = [r"[0-9]{2,}\.[0-9]{2,}", r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?", r"[¥￥][ \t]*[0-9][0-9,.]*", r"[0-9]+\.[0-9]+%", "20[0-9]{2}[-/年][0-9]{1,2}[-/月][0-9]{1,2}", "[0-9]{4,}"]


def formal_density(c: Column) -> Column:
    return occurrences(c, FORMAL) / F.greatest(F.length(c), F.lit(1))


def is_template(c: Column) -> Column:
    """Whether a segment is wording that tender documents prescribe: by seven kinds of rule."""
    t = F.trim(c)
    dense = (F.length(t) >= 40) & (formal_density(t) > 0.06) & ~t.rlike("[0-9]{2,}")
    return t.rlike(WORDING) | t.rlike(NUMBERING) | t.rlike(FURNITURE) | dense


def _matched_length(c: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), F.lit(0), lambda a, x: a + F.length(x))


def substantiality(c: Column) -> Column:
    """0 to 1: how much a segment is content of its own, from its length, technical terms, numbers and formal wording."""
    n = F.greatest(F.length(c), F.lit(1))
    technical = sum((_matched_length(c, p) for p in TECHNICAL), F.lit(0))
    numeric = sum((F.regexp_count(c, F.lit(p)) for p in NUMERIC), F.lit(0))
    formal = occurrences(c, FORMAL_SCORE) / n
    penalty = F.when(c.rlike("[0-9]{2,}|[A-Z]{2,}"), F.least(F.lit(1.0), formal / 0.10) * 0.4).otherwise(F.least(F.lit(1.0), formal / 0.06))
    score = (
        F.least(F.lit(1.0), F.length(c) / 200.0) * 0.30
        + F.least(F.lit(1.0), technical / n / 0.15) * 0.30
        + F.least(F.lit(1.0), numeric / F.greatest(n / 50, F.lit(1.0))) * 0.25
        + (F.lit(1.0) - penalty) * 0.15
    )
    return F.when(F.length(c) < 15, F.lit(0.0)).otherwise(score)


def risk_level(template: Column, score: Column) -> Column:
    return F.when(template, "template").when(score >= 0.6, "substantial").when(score >= 0.3, "suspicious").otherwise("template")


def reason_tags(c: Column, template: Column) -> Column:
    """Why a shared segment is unusual; one general tag if no other holds."""
    tags = F.filter(
        F.array(
            F.when(c.rlike("[A-Z][A-Z0-9-]+"), "包含具体技术型号/参数"),
            F.when(c.rlike("健壮性|更好的前所未有|改进的联系"), "含有非标准机器翻译痕迹"),
            F.when(c.rlike(r"[0-9]+\.[0-9]+\.[0-9]+"), "包含不规范编号标记"),
            F.when((F.length(c) > 80) & ~template, "长段落逐字相同，排除独立编制的可能性"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("内容异常一致")))
