"""Judgement forms: their results as qrels, audits and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import fusion

_TEXTS = "document title source_path source_url url link href source chunk_id chunk_type section_heading section_text chunk_text preview_text text result_method demo_method".split()
RESULT = f"struct<{', '.join(f'{c}:string' for c in _TEXTS)}, metadata:map<string,string>, assessment:struct<rating:string, relevant_scope:string, relevant_section:string, comment:string>>"
PAYLOAD = f"struct<query:string, information_need:string, participant_name:string, general_comment:string, results:array<{RESULT}>>"
#: The metadata's keys that may hold a result's document, in order.
DOCUMENT_KEYS = [*fusion.TITLE_KEYS, "source_path", "source_url", "url"]


def parsed(submissions: DataFrame) -> DataFrame:
    """The forms whose payload is whole JSON, with it as the column ``p``; cut-off ones and null ones are dropped."""
    out = submissions.withColumn("p", F.from_json("payload_json", PAYLOAD)).where(F.get_json_object("payload_json", "$.query").isNotNull())
    return out.where(F.col("p").isNotNull())


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def result_doc(r: Column) -> Column:
    """The document of a result in normal form: the first that has one of its name and title, its metadata's keys, its path and address."""
    options = [r["document"], r["title"], *(r["metadata"][k] for k in DOCUMENT_KEYS), r["source_path"], r["source_url"], r["url"]]
    return t.plain_doc_id(t.first_value(*options))


def results(forms: DataFrame) -> DataFrame:
    """id, created_at, query_id, information_need, result_index (from 1), r: one row per result."""
    query = F.coalesce(t.first_value(F.col("p.query")), _text(F.col("query_text")))
    rows = forms.select("id", "created_at", query.alias("query_id"), _text(F.col("information_need")).alias("information_need"), F.posexplode("p.results").alias("n", "r"))
    return rows.withColumn("result_index", F.col("n") + 1).drop("n")


def to_qrels(forms: DataFrame, include_non_relevant: bool = False) -> DataFrame:
    """id, query_id, doc_id, relevance: 1 for results rated relevant; the others are 0 rows or left out. Repeats stay."""
    rated = F.coalesce(F.col("r.assessment.rating") == "relevant", F.lit(False))
    rows = results(forms).select("id", "query_id", result_doc(F.col("r")).alias("doc_id"), rated.cast("int").alias("relevance")).where((F.col("query_id") != "") & (F.col("doc_id") != ""))
    return rows if include_non_relevant else rows.where("relevance = 1")


def audit(forms: DataFrame) -> DataFrame:
    """A row per form: the number of results, relevant, not relevant and unrated ones, and whether it looks like a test."""
    rating = F.transform(F.coalesce("p.results", F.array().cast(f"array<{RESULT}>")), lambda r: F.coalesce(r.assessment.rating, F.lit("")))
    count = lambda v: F.size(F.filter("x", lambda e: e == v))
    query = F.coalesce(t.first_value(F.col("p.query")), _text(F.col("query_text")))
    out = forms.withColumn("x", rating).select(
        "id", query.alias("query_id"), F.size("x").alias("num_results"), count("relevant").alias("num_relevant"), count("not_relevant").alias("num_non_relevant"),
        (F.lower(_text(F.col("p.query"))) == "test").alias("q"), (F.lower(_text(F.col("information_need"))) == "test").alias("i"),
    )
    return out.select("id", "query_id", "num_results", "num_relevant", "num_non_relevant", (F.col("num_results") - F.col("num_relevant") - F.col("num_non_relevant")).alias("num_unrated"), (F.col("q") | F.col("i")).alias("looks_like_test"))


def excluding(forms: DataFrame, ids: DataFrame) -> DataFrame:
    """The forms whose id is not listed."""
    return forms.join(ids.select("id").distinct(), "id", "left_anti")


def relevant_chunks(forms: DataFrame) -> DataFrame:
    """A row per relevant result, with the form, the document, where its text was found and what was said of it; missing values are ''."""
    r, m, p = F.col("r"), F.col("r.metadata"), F.col("p")
    rows = forms.select("id", "created_at", "p", F.posexplode("p.results").alias("n", "r")).where(F.trim(F.col("r.assessment.rating")) == "relevant")
    one = lambda *options: F.coalesce(t.first_value(*options), F.lit(""))
    pooled = F.array_join(F.filter(F.transform(F.from_json(m["pooled_from"], "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), "|")
    return rows.select(
        "id", "created_at", one(p["participant_name"]).alias("participant_name"), one(p["information_need"]).alias("information_need"), one(p["query"]).alias("query"), one(p["general_comment"]).alias("general_comment"),
        (F.col("n") + 1).alias("result_index"), one(r["chunk_id"]).alias("chunk_id"), one(r["chunk_type"]).alias("chunk_type"), one(r["source_path"]).alias("source_path"),
        one(r["title"], *(m[k] for k in fusion.TITLE_KEYS)).alias("document_title"), one(*(r[k] for k in fusion.URL_KEYS), *(m[k] for k in fusion.URL_KEYS)).alias("document_url"),
        one(pooled, r["result_method"], r["demo_method"], m["demo_method"]).alias("pooled_from_methods"), one(r["section_heading"], m["section_heading"]).alias("section_heading"),
        one(r["section_text"], r["chunk_text"], r["preview_text"], r["text"], m["section_text"]).alias("chunk_text"),
        *(one(r["assessment"][c]).alias(a) for c, a in (("relevant_scope", "relevant_scope"), ("relevant_section", "relevant_section"), ("comment", "assessment_comment"))),
    )


def write_submissions(forms: DataFrame, folder: str) -> None:
    """Accepted forms appended to a table, one file of rows per write; ids come with the rows."""
    forms.write.mode("append").parquet(folder)


def accepted(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forms that name a participant, a need and a query, and those that don't, with the names of the blank fields."""
    fields = {"participant_name": F.col("participant_name"), "information_need": F.col("information_need"), "query": F.col("query_text")}
    checked = forms.withColumn("errors", fusion.submission_errors(fields))
    return checked.where("errors = ''").drop("errors"), checked.where("errors <> ''")
