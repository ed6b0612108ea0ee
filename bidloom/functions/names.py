"""Names of persons and companies, and roles: predicates and cleaners, as column expressions and for Arrow batches.

Which characters begin a family name is a parameter: the commonest names are given, and ``family_names`` adds those that
a table of people uses, so a rare name that is on record is known in running text too.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The commonest family names, single and double.
FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖樊兰殷施洪翟安倪牛温芦季俞章鲁葛伍申尤毕聂柴焦关阎欧庞颜梅庄凌祝童甘岳单滕项管华齐柳左纪霍阮包钭宓岑庾晏祁费耿卜苗路尚舒"
DOUBLE = "欧阳|上官|司马|诸葛|夏侯|皇甫|尉迟|公孙|长孙|慕容|司徒|司空|端木|南宫|宇文|呼延|令狐|东方"
# Words that no name of a person holds, by what they are: business, places, forms, functions of staff.
NO_NAME = (
    "公司|集团|有限|责任|股份|科技|技术|工程|实业|贸易|企业|中心|研究院|航天|移动|联通|电信|石油|电力|钢铁|执业|评估师"
    "|北京|上海|深圳|广州|成都|武汉|南京|西安|杭州|苏州|天津|重庆|长沙|郑州|济南|青岛|大连|厦门|合肥|福州|昆明|沈阳"
    "|项目|人员|人員|团队|成员|机构|分工|部门|简历|配备|配置|一览|经理|投标|招标|采购|供应商|代表|委托|授权|签字|盖章|盖单位章|负责|联系|代理"
    "|经营|范围|模块|管理|通知|用户|影响|系统|部署|服务|数据|平台|功能|流程|界面|参数|版本|需求|方案|产品|业务|内容|信息|标准|规范|制度|机制|模型|算法|接口|清单|明细|报表|台账|预算|成本|费用|合同|条款|协议|文件|资料|安全|质量|承诺|小组|工资|材料"
    "|姓名|性别|民族|籍贯|学历|学位|年龄|身高|体重|毕业|专业|出生|身份证|证件|证书|资格|年限|邮箱|计算机|教授|讲师|研究员|工程师|技师|高工|总工"
)
NO_NAME_END = "(?:职务|職務|岗位|崗位|职称|角色|职责|職責|电话|传真|手机|邮箱|地址|住址|邮编|账号|账户|开户|银行|编号|日期|时间|员|主管|主任|助理|组长)"
NO_NAME_WHOLE = "(?:本人|我方|我们|该人|此人|对方|甲方|乙方|丙方|中级|高级|初级|正高|副高|助教|专员|同志|先生|女士)"
GRAMMAR = "对的了是为在与和就被以从把由因所给见"
HAN = "[一-鿿]"
DOTS = "[·•・]"
LATIN_NAME = "[A-Za-zÀ-ſ][A-Za-zÀ-ſ .'-]{1,39}"


def _patterns(family: str) -> tuple[str, str, str, str]:
    """Shapes of a name (Chinese, with middle dots, Latin) and what rules one out; the same in every regex engine."""
    chinese = f"^(?:(?:{DOUBLE}){HAN}{{1,2}}|[{family}]{HAN}{{1,3}})$"
    dotted = f"^{HAN}{{2,4}}(?:{DOTS}{HAN}{{2,4}}){{1,2}}$"
    return chinese, dotted, f"^{LATIN_NAME}$", f"{NO_NAME}|{NO_NAME_END}$|^{NO_NAME_WHOLE}$|^[{GRAMMAR}]"


def is_person_name(c: Column, family: str = FAMILY) -> Column:
    """Whether a value can be the name of a person: two to four ideographs that begin with a family name, parts joined by
    middle dots, or words of Latin letters; words of business, forms and functions are none. Null of null."""
    chinese, dotted, latin, none = _patterns(family)
    return (c.rlike(chinese) | c.rlike(dotted) | c.rlike(latin)) & ~c.rlike(none)


class NameTest:
    """The same for single values, for use inside Arrow batches."""

    def __init__(self, family: str = FAMILY) -> None:
        *shapes, none = _patterns(family)
        self.shape, self.none = re.compile("|".join(shapes)), re.compile(none)
        self.known: dict[str, bool] = {}

    def __call__(self, value: str) -> bool:
        if value not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[value] = bool(self.shape.search(value)) and not self.none.search(value)
        return self.known[value]


def family_names(people: DataFrame, name: str, least: int = 3, most: int = 5000) -> str:
    """The family names to look for: the commonest ones and every character that begins at least ``least`` different
    Chinese names on record. There are at most as many as there are ideographs, a bound that is checked."""
    from bidloom.session import bounded_rows

    first = people.select(F.col(name).alias("n")).where(F.col("n").rlike(f"^{HAN}{{2,4}}$")).distinct().groupBy(F.substring("n", 1, 1).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    rows = bounded_rows(first.where(F.col("k") >= least).select("c"), most, "characters that begin names")
    return FAMILY + "".join(sorted({r["c"] for r in rows} - set(FAMILY)))


# Roles by a word in their label, the first that fits.
ROLES = (("法定代表人", "legal_rep"), ("legal_rep", "legal_rep"), ("授权", "authorized_rep"), ("委托代理", "authorized_rep"), ("authorized_rep", "authorized_rep"), ("项目经理", "project_manager"), ("项目负责", "project_manager"), ("project_manager", "project_manager"), ("技术", "technical_lead"), ("安全", "safety"), ("质", "quality"), ("造价", "cost"), ("联系", "contact"))
# Functions of staff and the eight labels of people in bids, the first that fits; all other functions are
# those of a team member.
FUNCTIONS = (
    ("法定代表人", "legal_rep"), ("授权代表", "authorized_rep"), ("委托代理人", "authorized_rep"), ("联系人", "bid_contact"),
    ("总监理工程师", "project_manager"), ("专业监理工程师", "tech_lead"), ("项目经理", "project_manager"), ("项目负责人", "project_manager"), ("项目副经理", "project_manager"),
    ("商务经理", "project_manager"), ("财务负责人", "project_manager"), ("设计负责人", "project_manager"), ("施工负责人", "project_manager"), ("商务负责人", "project_manager"),
    ("技术负责人", "tech_lead"), ("技术总监", "tech_lead"), ("总工程师", "tech_lead"), ("安全负责人", "tech_lead"), ("安全总监", "tech_lead"),
)
MEMBERS = ("安全员", "质量员", "施工员", "材料员", "资料员", "造价员", "预算员", "监理工程师", "造价工程师", "咨询工程师", "质检员", "试验员", "测量员", "机械员", "劳务员", "标准员", "团队成员", "项目成员", "组员", "组长", "总监")


def role_label(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, label in reversed(ROLES):
        out = F.when(F.contains(c, F.lit(word)), label).otherwise(out)
    return out


def function_label(role: str) -> str:
    return next((label for word, label in FUNCTIONS if word in role), "team_member")


# Words of forms around the name of a company.
FORM_WORDS = frozenset(("投标人名称", "供应商名称", "单位名称", "公司名称", "企业名称", "单位负责人", "盖单位章", "盖章", "公章", "单位章", "签章", "签字", "全称", "单位公章", "签字或盖章"))
FORM_STARTS = ("投标人名称", "供应商名称", "招标人名称", "单位名称", "公司名称", "企业名称", "投标人", "供应商", "招标人")
_FILL = "_＿ 　\t\n：:"


def clean_company(value: str) -> str:
    """A company's name without labels in front, form words in brackets and fill. The text outside brackets stays, and so
    does what stands in closed brackets and is no form word (a place, as in 某某（北京）公司)."""
    kept, open_at, depth = [], 0, 0
    for i, c in enumerate(value):
        if c in "（(":
            kept += [value[open_at:i]] if not depth else []
            open_at, depth = (i, 1) if not depth else (open_at, depth + 1)
        elif c in "）)" and depth:
            depth -= 1
            if not depth:
                inside = value[open_at + 1 : i].strip(_FILL)
                kept += [value[open_at : i + 1]] if inside and inside not in FORM_WORDS else []
                open_at = i + 1
    kept += [value[open_at:]] if not depth else []
    name = "".join(kept).strip(_FILL + "）)")
    start = next((w for w in FORM_STARTS if name.startswith(w) and name[len(w) : len(w) + 1] in tuple(_FILL)), "")
    return name[len(start) :].strip(_FILL)


@F.pandas_udf(T.StringType())
def clean_company_column(s: pd.Series) -> pd.Series:
    return s.map(clean_company, na_action="ignore")


def clean_name(value: str) -> str:
    """A person's name without form words in brackets, words before it and blanks inside it; empty if nothing is left."""
    value = re.sub(r"[（(](?:姓名|签字|盖章|签字或盖章|单位负责人|法定代表人)[）)]", "", value)
    value = re.sub(r"[\s_＿]+", "", value)
    return re.sub(r"^(?:本人|我(?=[一-鿿]))+|(?:同志|先生|女士)$", "", value)
