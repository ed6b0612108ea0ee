import threading
import time

import pytest

from bidloom.operators.people import labelled_fields, table_people
from bidloom.streaming.progress import cancel, progress, tagged


def test_staff_tables(spark):
    t = "姓名 | 职务 | 电话 | 身份证\n张三 | 项目经理 | 13900000001/13900000002 | 32012319900101123x\n | 技术负责人 | 139 1234 5678 | \n合计 | | |\n正文\n名称 | 数量\n李四 | 3"
    rows = table_people(spark.createDataFrame([(1, t), (2, None), (3, "")], "name long, t string").withColumnRenamed("name", "doc"), "doc", "t").orderBy("row_no").collect()
    assert [(r.name, r.role_label, r.phones, r.id_number) for r in rows] == [
        ("张三", "project_manager", ["13900000001", "13900000002"], "32012319900101123X"),
        ("张三", "technical_lead", ["13912345678"], ""),
    ]


def test_labels(spark):
    t = "投标人：某某建设集团有限公司（盖章）\n法定代表人（签字）：张 三\n项目经理：\n李四\n联系人：项目部 电话：1\n授权代表：__王五__"
    got = {(r.field, r.value) for r in labelled_fields(spark.createDataFrame([(1, t), (2, None)], "k long, t string"), "k", "t").collect()}
    assert got == {("company", "某某建设集团有限公司"), ("legal_rep", "张三"), ("project_manager", "李四"), ("authorized_rep", "王五")}


def test_cancel_by_tag(spark):
    failed = []

    def run():
        with tagged(spark, "slow"):
            try:
                spark.range(0, 4, 1, 4).rdd.map(lambda x: time.sleep(60)).count()
            except Exception as e:
                failed.append(e)

    t = threading.Thread(target=run)
    t.start()
    for _ in range(100):
        time.sleep(0.1)
        if progress(spark):
            break
    cancel(spark, "slow")
    t.join(30)
    assert failed and not t.is_alive()
    assert spark.range(3).count() == 3


@pytest.mark.parametrize("text", ["", "投标人：", "姓名"])
def test_nothing_found(spark, text):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    assert labelled_fields(df, "k", "t").count() == 0 and table_people(df, "k", "t").count() == 0
