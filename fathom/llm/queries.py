"""Queries of the operators in this package, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, packing, personal, scan_repair, splitting, subjects
from fathom.tables import load, spread


def _rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose rows are worked on one by one at some cost."""
    return spread(load(spark, d, name))


def _splittable() -> dict:
    kind = F.col("chunk_type")
    return {"section_text": F.when(kind == "section_title", F.col("section_text")), "text": F.when(kind == "document", F.col("text"))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.find_defects(_rows(spark, d, "chunk_metadata")).distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repair_chunks(_rows(spark, d, "chunk_metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = _rows(spark, d, "chunk_metadata").where(F.col("chunk_type").isin("section_title", "document"))
    return splitting.unavoidable_cuts(splitting.split_texts(chunks, "chunk_id", _splittable(), with_text=False), "chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = _rows(spark, d, "chunk_metadata").where(F.col("chunk_type").isin("section_title", "document"))
    return splitting.split_texts(chunks, "chunk_id", _splittable(), keep=["section_heading"])


PERSONAL = ["participant_name", "information_need", "general_comment"]
#: The key of the pseudonyms is a parameter; this one is for tests and examples.
SECRET = b"for tests only"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_items(_rows(spark, d, "submissions"), "id", PERSONAL, SECRET).select("id", "field", "kind", "value").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.mask_fields(_rows(spark, d, "submissions"), "id", PERSONAL, SECRET)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(_rows(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows per outcome of decoding what was encoded: all should be 'same', or 'empty' for null and empty texts."""
    docs = _rows(spark, d, "documents").select("doc_id", "text")
    back = bpe.decode_documents(bpe.encode_documents(docs)).withColumnRenamed("text", "decoded")
    outcome = F.when(F.coalesce("text", F.lit("")) == "", "empty").when(F.col("text") == F.col("decoded"), "same").otherwise("different")
    return docs.join(back, "doc_id").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_rows(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(_rows(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _rows(spark, d, "documents")
    model = subjects.fit_model(docs, load(spark, d, "doc_labels"), load(spark, d, "subject_areas"))
    return subjects.assign_documents(docs, model).distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    docs, areas = _rows(spark, d, "documents"), load(spark, d, "subject_areas")
    model = subjects.fit_model(docs, load(spark, d, "doc_labels"), areas)
    return subjects.composition(subjects.assign_documents(docs, model), docs, areas)


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p4_found, p4_pieces, p5_found, p5_masked, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_composition)}
ORACLE = {"p6_round_trip": "select case when coalesce(text, '') = '' then 'empty' else 'same' end as outcome, count(*) as n from documents group by 1"}
