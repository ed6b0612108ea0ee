from bidloom.llm import scan_repair


def test_repair_targets_do_not_vanish_in_a_large_corpus(spark):
    filler = "普通段落没有英文。" * 1000
    texts = ["The flange gasket is tested."] * 20 + ["The f1ange gasket is tested."] + [filler] * 3000
    rows = spark.range(3021).toDF("k")
    df = spark.createDataFrame(list(enumerate(texts[:21])), "k long, t string").unionByName(rows.where("k >= 21").selectExpr("k", f"'{filler}' as t"))
    assert df.count() == len(texts)
    corpus = scan_repair.corpus_terms(df, "t")
    assert corpus.read_word("f1ange") == "flange"


def test_misreadings_late_in_a_long_word():
    word = "ceoceoceoceo-ceo-flange"
    corpus = scan_repair.Corpus({word: 50}, {}, 4.0)
    assert corpus.read_word("ceoceoceoceo-ceo-f1ange") == word
    assert corpus.read_word("ceoceoceoceo-ceo-fxange") == "ceoceoceoceo-ceo-fxange"
