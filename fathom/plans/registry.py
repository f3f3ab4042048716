"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import packed_values, schema_drift
from fathom.plans import analytics_queries, engine_queries, evaluation_queries, search_queries, section_sql, text_queries
from fathom.tables import load, small_rows

FLAGSHIP = "bm25_batch"
#: The tables of established terms and of target fields are fixed; more rows than this are an error.
MOST_TERMS = MOST_FIELDS = 10_000
PACKED = ["tax_keyword", "valid_for_area", "subject_area"]


def terms_by_field(spark: SparkSession, d: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in small_rows(load(spark, d, "area_terms").select("field", "term").where("term is not null"), MOST_TERMS, "area_terms"):
        out.setdefault(r.field, []).append(r.term)
    return out


def target_fields(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    rows = small_rows(load(spark, d, "summary_fields").select("position", "field", "field_type"), MOST_FIELDS, "summary_fields")
    return [(r.field, r.field_type) for r in sorted(rows, key=lambda r: r.position)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    values = packed_values.split_packed(load(spark, d, "metadata"), terms_by_field(spark, d), "record_id", PACKED)
    return values.select("record_id", "field", "position", "value").distinct()


def p2_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.value_counts(packed_values.split_packed(load(spark, d, "metadata"), terms_by_field(spark, d), "record_id", PACKED))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift(load(spark, d, "evaluation_summary"), target_fields(spark, d))


#: Types of unknown columns that are promoted into the consistent table; other ones are promoted as strings.
APPROVED = [("average_ndcg@10", "double"), ("average_recall@10", "double"), ("wall_seconds", "double"), ("rrf_k", "int"), ("bm25_weight", "double"), ("seed", "int"), ("qrels_path", "string"), ("notes", "string")]
#: More different names of added columns than this are an error.
MOST_ADDED = 1000


def added_fields(spark: SparkSession, d: str, fields: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The listed columns, and those of all headers that are no field, in the order of their names."""
    heads = schema_drift.headers(load(spark, d, "evaluation_summary"), fields)
    pairs = heads.select(F.explode(F.arrays_zip("columns", "fields")).alias("c")).where(F.col("c.fields").isNull() & (F.col("c.columns") != ""))
    names = small_rows(pairs.select(F.col("c.columns").alias("name")).distinct(), MOST_ADDED, "the names of added columns")
    listed = {c for c, _ in APPROVED}
    return [*APPROVED, *((r.name, "string") for r in sorted(names, key=lambda r: r.name) if r.name not in listed)]


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    fields = target_fields(spark, d)
    return schema_drift.promote(schema_drift.ingest(load(spark, d, "evaluation_summary"), fields), fields, added_fields(spark, d, fields))


_AREAS = (text_queries, search_queries, evaluation_queries, analytics_queries, engine_queries)
QUERIES = {f.__name__: f for f in (p2_found, p2_value_counts, p3_found, p3_table)} | {k: f for m in _AREAS for k, f in m.QUERIES.items()}
#: Columns that are int in the result and bigint in the SQL as it stands.
_INTS = {
    "rank": "best_chunk_per_doc bm25_batch bm25_topk dedupe_docs fts_weighted_topk hybrid_topk live_rank_score rrf_chunks rrf_documents search_all_methods vector_batch vector_topk eval_buckets",
    "position": "extract_links ordered_methods", "n_methods": "pool_results", "result_index": "relevant_chunks", "leading_spaces": "text_lines", "value": "zero_filled_counts",
    "num_results": "submission_audit", "num_relevant": "submission_audit", "num_non_relevant": "submission_audit", "num_unrated": "submission_audit",
}


def _typed(name: str, sql: str) -> str:
    casts = [f"{c}::int as {c}" for c, names in _INTS.items() if name in names.split()]
    return f"select * replace ({', '.join(casts)}) from ({sql})" if casts else sql


ORACLE: dict[str, str] = {k: _typed(k, s) for m in (*_AREAS, section_sql) for k, s in m.ORACLE.items()}
