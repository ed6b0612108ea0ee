"""The queries of the training-data problems over the tables of a folder. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import canonical_names, groups, leakage, lookalikes, packing, residue, scan_repair, shared_spans, spam
from bidloom.llm.sql import ORACLES
from bidloom.session import read, ship_package, spread

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return spread(read(spark, d, table).select(*columns))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    inner = read(spark, d, "pair_results").select(F.explode("matches").alias("m")).select("m.match_id", "m.text")
    return read(spark, d, "matches").select("match_id", "text").unionByName(inner)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text, or one of whose identity numbers, bears a trace of scanning."""
    texts = scan_repair.repaired_texts(_texts(spark, d, "summarize_file", "file_id", "text"), "file_id", "text").where("damaged")
    numbers = scan_repair.repaired_numbers(read(spark, d, "personnel"), "person_id", "id_numbers").where("damaged")
    found = texts.select(F.lit("summarize_file").alias("src"), F.col("file_id").alias("rec_id")).unionByName(numbers.select(F.lit("personnel").alias("src"), F.col("person_id").alias("rec_id")))
    return found.where("rec_id is not null").distinct()


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all files in continuous paragraphs."""
    return scan_repair.repaired_texts(_texts(spark, d, "summarize_file", "file_id", "text"), "file_id", "text").select("file_id", "repaired").distinct()


def p1_numbers(spark: SparkSession, d: str) -> DataFrame:
    """All identity numbers in whole."""
    return scan_repair.repaired_numbers(read(spark, d, "personnel"), "person_id", "id_numbers").select("person_id", "value", "repaired").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of segments with at least 50 successive characters in common."""
    segments = _segments(spark, d)
    passages, members = shared_spans.shared_passages(segments, "match_id", "text")
    long = segments.where(F.length("text") >= 50).select(F.col("match_id").alias("rep")).distinct()
    return shared_spans.sharing_pairs(passages, members, long).select(F.col("id1").alias("match_id1"), F.col("id2").alias("match_id2")).distinct()


def p2_shared(spark: SparkSession, d: str) -> DataFrame:
    """For each segment how many of its characters also stand in another segment."""
    segments = _segments(spark, d)
    passages, members = shared_spans.shared_passages(segments, "match_id", "text")
    return shared_spans.shared_amount(segments, "match_id", "text", passages, members).select(F.col("rec_id").alias("match_id"), "n_chars", "n_shared")


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of pairs of segment classes that are verbatim or alike: at least 50 aligned columns, 0.8 of them agreeing."""
    passages, _ = shared_spans.shared_passages(_segments(spark, d), "match_id", "text", alike=True)
    return passages.select("rep1", "rep2", "start1", "end1", "start2", "end2", F.round("identity", 4).alias("identity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments that are residue of a template or an error page, or whose risk level is."""
    scores = residue.residue_scores(_texts(spark, d, "matches", "match_id", "pair_id", "text", "risk_level"), "match_id", "text", "risk_level", "pair_id")
    return scores.where("probability >= 0.5").select("match_id").distinct()


def p3_validation(spark: SparkSession, d: str) -> DataFrame:
    """How the classifier of problem 3 does on hosts, and on families of phrases, that it was not trained on."""
    return residue.validation(_texts(spark, d, "matches", "match_id", "pair_id", "text", "risk_level"), "match_id", "text", "risk_level", "pair_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every linked file."""
    return groups.connected_groups(read(spark, d, "pair_results").where("total_matches >= 1"), "file1", "file2")


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The list entry that each freely typed cost name means, -1 where there is none."""
    return canonical_names.map_to_reference(read(spark, d, "costdetails"), "item_id", "pricename", read(spark, d, "price_ref"))


def p5_missing(spark: SparkSession, d: str) -> DataFrame:
    """The typed names that no entry names, with the number of cost lines."""
    typed = read(spark, d, "costdetails").select("item_id", "pricename").distinct()
    return p5_found(spark, d).where("ref_id = -1").join(typed, "item_id").groupBy("pricename").agg(F.count(F.lit(1)).alias("n_lines"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "summarize_file").select(F.lit("summarize_file").alias("src"), F.col("file_id").alias("id"), "text")
    totals = read(spark, d, "prices").select(F.lit("prices").alias("src"), F.col("price_id").alias("id"), F.col("totalprice").alias("text"))
    return spread(texts).unionByName(totals).where("id is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose fields differ in code points but look the same."""
    return lookalikes.equal_looking_pairs(lookalikes.uniform_text(_fields(spark, d), ["src", "id"], "text"), "src", "id", "text")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Records that look like another one with other characters, one row each with its class."""
    return lookalikes.look_classes(lookalikes.uniform_text(_fields(spark, d), ["src", "id"], "text"), "src", "id", "text")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every field that had another."""
    return lookalikes.uniform_text(_fields(spark, d), ["src", "id"], "text").where("not (text <=> uniform)").select("src", "id", "uniform").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or piece of one, for each capacity."""
    return packing.packed(packing.token_counts(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), read(spark, d, "container_spec"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 40 successive characters of an evaluation item."""
    return _leaks(spark, d).where("longest_run >= 40").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item or an edited copy of a part of one, by their alignment."""
    found = leakage.edited_leaks(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id", "longest_run", "score", F.round("share", 4).alias("share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of stuffed keywords, links, navigation or tags."""
    return spam.spam_scores(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text").where("flagged_share >= 0.5").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", *[F.round(c, 4).alias(c) for c in ("mean_pmi", "low_share", "repeated_share", "flagged_share")])


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    all_of = (
        p1_found, p1_texts, p1_numbers, p2_found, p2_shared, p2_passages, p3_found, p3_validation, p4_found, p4_sizes, p5_found, p5_missing, p6_found, p6_classes, p6_forms,
        p7_containers, p7_fill, p8_found, p8_leaks, p9_found, p9_scores,
    )
    return {q.__name__: _shipped(q) for q in all_of}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
