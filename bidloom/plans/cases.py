"""Small texts with what must be read from them, written by hand. The extraction queries run over the texts; their SQL
states the expectations, so agreement means right, not only alike."""

from __future__ import annotations

# text, total with tax, total before tax, tax rate in percent, quoted rate
PRICES: list[tuple[str, float | None, float | None, float | None, str | None]] = [
    ("人民币（大写）：叁佰零伍万陆仟元整", 3056000, 3056000, None, None),
    ("投标总价：￥12.5万元", 125000, 125000, None, None),
    ("投标总价：壹佰贰拾叁万元整", 1230000, 1230000, None, None),
    ("小写：１２３４５６", 123456, 123456, None, None),
    ("投标保证金一份，金额为人民币：￥500000元", None, None, None, None),
    ("合计 \\ 1838529 5002800 \\", 5002800, 1838529, None, None),
    ("下浮率：12.5%", None, None, None, "12.5%"),
    ("报价费率 1.8‰", None, None, None, "1.8‰"),
    ("投标报价下浮6%", None, None, None, "6%"),
    ("投标报价（%）：98.5", None, None, None, "98.5%"),
    ("下浮率：8.5个百分点", None, None, None, "8.5%"),
    ("开标一览表\n最高限价（招标控制价）：￥1,000,000元\n投标报价：￥980,000元\n", 980000, 980000, None, None),
    ("开标一览表\n招标控制价：￥1000000元\n", None, None, None, None),
    ("开标一览表\n投标总价（大写）：壹佰万元整（小写：980000元）\n", 980000, 980000, None, None),
    ("开标一览表\n投标总价（元）：1 234 567.89\n税率 6%", 1234567.89, 1164686.69, 6, None),
    ("小写：20250826", None, None, None, None),
    ("开标一览表\n1,838,529 1893684 3\n", 1893684, 1838529, 3, None),
    ("开标一览表\n小写：22000.00元/月\n服务单价 340000/人月\n投标总价：1120000元\n", 1120000, 1120000, None, None),
    ("开标一览表\n投标总价\n大写：壹佰壹拾贰万元\n小写：1120000.00元\n账号 30210000000123\n开户行 某某银行\n金额\n人民币：22,000.00\n", 1120000, 1120000, None, None),
    ("投标函\n投标总价：980000元\n投标保证金\n2.2万元\n附证明材料\n人民币：22000\n", 980000, 980000, None, None),
    ("投标保证金（大写）：贰万元整\n其他材料\n人民币：20000\n开标一览表\n小写：980000.00元\n", 980000, 980000, None, None),
    ("报价汇总表\n合计（万元）：89.3\n", 893000, 893000, None, None),
    ("序号 | 名称 | 金额\n合计 | 全部 | 89.3万元 | 91.97万元", 919700, 893000, None, None),
    ("开标一览表\n01 | 甲公司工程集团有限公司 | 贰佰万元整 | 2000000 元", 2000000, 2000000, None, None),
    ("大写：壹佰贰拾\n叁万元整\n", 1230000, 1230000, None, None),
    ("报价表\n税前价：1189450.24\n", None, 1189450.24, None, None),
    ("投标函\n违约金：人民币50000元\n招标代理服务费：￥30000\n开标一览表\n小写：980000.00元\n", 980000, 980000, None, None),
    ("开标一览表\n暂定价：500000元\n投标总价为98万元\n", 980000, 980000, None, None),
    ("人民巾（大写）：壹佰貳拾萬元整", 1200000, 1200000, None, None),
    ("没有价格的一段话", None, None, None, None),
]
# text, (field, value, role) that must be read
PEOPLE: list[tuple[str, list[tuple[str, str, str | None]]]] = [
    ("授权委托代理人：赵六\n", [("authorized_rep", "赵六", "authorized_rep")]),
    ("授权委托书\n兹委托 李 勇 同志为我方代理人。", [("authorized_rep", "李勇", "authorized_rep")]),
    ("法定代表人资格证明书\n（兰某某）系（北京某某航天技术有限公司）的法定代表人。\n", [("company", "北京某某航天技术有限公司", None), ("legal_rep", "兰某某", "legal_rep")]),
    ("本人 李林\n三、售权委托书\n（姓名） 系 某某管路配件有限公司 （投标人名称） 的法定代表人（单\n 位负责人） ，现委托 王 小 明 为我方代理人。", [("authorized_rep", "王小明", "authorized_rep"), ("company", "某某管路配件有限公司", None), ("legal_rep", "李林", "legal_rep")]),
    ("项目团队\n王强 项目经理\n李勇 施工员\n", [("person", "李勇", "team_member"), ("person", "王强", "project_manager")]),
    ("项目团队\n项目经理 王强 技术负责人 李四\n", [("person", "李四", "tech_lead"), ("person", "王强", "project_manager")]),
    ("项目团队\n陈刚 任中职务 项目经理\n", [("person", "陈刚", "project_manager")]),
    ("项目团队\n姓名：张三 性别：男\n现任职务：项目经理\n", [("person", "张三", "project_manager")]),
    ("签字盖章页\n法定代表人或委托代理人（签字）：___赵六___\n", [("person", "赵六", "signatory")]),
    ("投标函\n联系人：周八\n联系电话：010 - 1234 5678\n地址：北京市海淀区上地十街10号 传真：无\n", [("address", "北京市海淀区上地十街10号", None), ("person", "周八", "bid_contact"), ("phone", "010-12345678", None)]),
    ("四、授权委托书\n本人 （姓名）系 （投标人名称）的法定代表人（单位负责人），现委托\n姓名：性别：男 身份证号：\n", []),
    ("项目管理机构\n职务：项目经理 姓名：项目团队\n经营范围：管理模块\n", []),
]
# text, (source, name, total before tax) that must be read
ITEMS: list[tuple[str, list[tuple[str, str, float]]]] = [
    ("成本明细\n人工成本 350万元\n设备购置费 12000元\n", [("cost", "人工成本", 3500000), ("cost", "设备购置费", 12000)]),
    ("成本明细\n1. 材料费：340,000.00元\n（二）人工成本：350万\n", [("cost", "人工成本", 3500000), ("cost", "材料费", 340000)]),
    ("业绩一览表\n项目名称\n合同金额\n(元)\n2023年\n站产品采购\n3500万\n中国移动\n2000万\n", []),
    ("检测报告\n检测20250826批次\n差旅费20250826\n", []),
    ("报价明细表\n序号 名称 数量 单价 总价 税率\n1 服务器 2 30000 60000 13%\n2 交换\n机 1 20000 20000 13%\n合计 80000", [("table", "交换机", 20000), ("table", "服务器", 60000)]),
    ("报价明细表\n序号 | 名称 | 数量 | 单价 | 总价\n1 | 服务器 | 2 | 30000 | 60000\n2 | 交换机 | 1 | 20000 | 20000\n合计 | | | | 980000\n", [("pipe", "交换机", 20000), ("pipe", "服务器", 60000)]),
    ("序号 | 设备 | 数量 | 不含税 | 含税 | 税率\n | 名称 | | 总价 | 总价 |\n1 | 水泵 | 2 | 1000.50 | 1130.57 | 13%\n | | 1 | 20,000 | 22600 | 13%", [("pipe", "水泵", 1000.5), ("pipe", "水泵", 20000)]),
    ("姓名 | 职务\n张三 | 经理\n李四 | 组员", []),
]
# segment, template by rule, role label, heading, match form
RULES: list[tuple[str, bool, str | None, bool, str]] = [
    ("根据《中华人民共和国招标投标法》编制", True, None, False, "根据<中华人民共和国招标投标法>编制"),
    ("本项目适用《中华人民共和国招标投标法》的水泵", False, None, False, "本项目适用<中华人民共和国招标投标法>的水泵"),
    ("为本项目提供整体设计、规范编制的单位", True, None, False, "为本项目提供整体设计,规范编制的单位"),
    ("第三章 项目管理", True, None, True, "第三章项目管理"),
    ("1.2 冷却塔", False, None, True, "1.2冷却塔"),
    ("（一）项目经理", False, "project_manager", False, "(一)项目经理"),
    ("Section 3 ＰＵＭＰ", False, None, True, "section3pump"),
    ("目 录", True, None, False, "目录"),
    ("法定代表人（签字）：", True, "legal_rep", False, "法定代表人(签字):"),
    ("技术负责人……12", False, "technical_lead", False, "技术负责人12"),
    ("XIV", True, None, False, "xiv"),
    ("轴流泵规格45毫米，数量12台", False, None, False, "轴流泵规格45毫米,数量12台"),
]
NAMES: list[tuple[str, bool]] = [
    ("覃芳", True), ("诸葛云", True), ("刘曾", True), ("肖某某", True), ("武松", True), ("阿不来提·买买提", True), ("John Smith", True),
    ("任中职务", False), ("项目团队", False), ("经营范围", False), ("王五传真", False), ("本人", False), ("教授", False), ("某某", False), ("任志强", True), ("管虎", True),
]
COMPANIES: list[tuple[str, str]] = [
    ("北京某某大学 （投标人名称", "北京某某大学"), ("___北京某某大学___（盖单位章）", "北京某某大学"), ("投标人：北京某某大学", "北京某某大学"), ("企业名称　某省未来网络创新研究院", "某省未来网络创新研究院"), ("北京某某航天技术有限公司", "北京某某航天技术有限公司"),
]
PHONES: list[tuple[str, str]] = [("_021-12345678、", "021-12345678"), ("010-12345678;", "010-12345678"), ("010 - 1234 5678", "010-12345678"), ("(010)1234-5678", "0101234-5678")]
# group, properties, text
BIDDERS: list[tuple[str, dict[str, str | None], str]] = [
    ("甲", {"creator": "张三", "last_modified_by": "李四", "application": "WPS Office", "template": "Normal.dotm", "KSOTemplateDocerSaveRecord": "h1-u7"}, "投标人名称：北京某某科技有限公司\n委托代理人：王五\n联系电话：13912345678\n项目团队\n赵六 项目经理\n"),
    ("乙", {"creator": "王五", "last_modified_by": "李四", "application": "WPS Office", "template": "Normal.dotm", "KSOTemplateDocerSaveRecord": "h1-u7"}, "投标人名称：上海某某管路有限公司\n委托代理人：孙七\n联系电话：139 1234 5678\n项目团队\n赵六 项目经理\n附：北京某某科技有限公司业绩\n"),
    ("丙", {"creator": "Microsoft Word", "last_modified_by": "Adobe Acrobat", "application": "Word", "template": "", "KSOTemplateDocerSaveRecord": None}, "投标人名称：广州某某机电有限公司\n委托代理人：王五\n项目团队\n赵六 施工员\n"),
]
BIDDER_FINDINGS: list[tuple[str, str, str, str, str, str]] = [
    ("contacts", "same_phone", "乙", "甲", "13912345678", "high"),
    ("metadata", "application", "乙", "甲", "WPS Office", "info"),
    ("metadata", "template", "乙", "甲", "Normal.dotm", "medium"),
    ("metadata", "last_modified_by", "乙", "甲", "李四", "high"),
    ("metadata", "KSOTemplateDocerSaveRecord", "乙", "甲", "h1-u7", "high"),
    ("mixing", "company_in_other_text", "乙", "甲", "北京某某科技有限公司", "high"),
    ("people", "authorized_rep_is_creator", "丙", "乙", "王五", "high"),
    ("people", "authorized_rep_is_creator", "甲", "乙", "王五", "high"),
    ("people", "same_authorized_rep", "丙", "甲", "王五", "high"),
    ("people", "same_last_modifier", "乙", "甲", "李四", "high"),
    ("people", "same_person_same_role", "乙", "甲", "赵六", "high"),
    ("people", "same_person_same_role", "丙", "甲", "王五", "high"),
    ("people", "same_person", "丙", "乙", "赵六", "medium"),
    ("people", "same_person", "丙", "甲", "赵六", "medium"),
]
# amount as written, its value
AMOUNTS: list[tuple[str, float | None]] = [
    ("￥12.5万元", 125000), ("１２３４５６", 123456), ("1 261 819.76", 1261819.76), ("1838529 5002800", 1838529), ("1O9,800", 109800), ("l2300", 12300), ("I00000", 100000), ("3500万", 35000000), ("1.2亿元", 120000000), ("12（万元）", 120000),
    ("叁万元整", 30000), ("壹佰贰拾叁万元整", 1230000), ("壹亿贰仟陆佰壹拾捌万壹仟玖佰柒拾陆元叁角", 126181976.3), ("贰佰叁拾肆万伍仟陆佰柒拾捌元玖角", 2345678.9), ("壹佰貳拾萬元整", 1200000), ("伍角陆分", 0.56), ("一万亿", 1000000000000),
    ("一二三", 6), ("拾贰", 12), ("无", None), ("/", None), ("", None),
]
# text, what becomes of it
DIGITS: list[tuple[str, str]] = [("139 1234 5678", "13912345678"), ("1O9 与 l2", "109 与 l2"), ("1391234\n5678", "13912345678"), ("3l5", "315"), ("甲 1 乙", "甲 1 乙")]
BROKEN_NAMES: list[tuple[str, str]] = [("本人张\n某某系的法人", "本人张某某系的法人"), ("张 某某", "张 某某"), ("本人 李林 \n三、授权委托书", "本人 李林 \n三、授权委托书"), ("负责人：张\n三丰", "负责人：张三丰")]
PADDED: list[tuple[str, str]] = [("投标人 ： 张三（ 盖单位章 ）", "投标人： 张三（盖单位章）"), ("电话 ：　010-12345678", "电话： 010-12345678")]
PROJECTS: list[tuple[str, list[str]]] = [("项目名称：某某水厂工程（盖章）", ["某某水厂工程"]), ("项目名称：\n另一个工程", ["另一个工程"]), ("项目名称 | 第三个工程 | 编号", ["第三个工程"]), ("无", [])]
# tender, bidder, total; and what must be found: kind, tender, value, number of bidders or totals
TOTALS: list[tuple[str | None, str, float | None]] = [
    ("t", "a", 1950000.0), ("t", "b", 2000000.0), ("t", "c", 2050000.0), ("t", "c", None), ("u", "a", 5000.0), ("u", "b", 5000.0), ("u", "c", 7000.0), ("v", "a", 1.0), ("v", "b", 2.0), ("v", "c", 4.0), (None, "x", 5000.0), ("w", "a", 10.0), ("w", "a", 10.0),
]
TOTALS_FOUND: list[tuple[str, str, float, int]] = [("ladder", "t", 50000.0, 3), ("equal", "u", 5000.0, 2)]
