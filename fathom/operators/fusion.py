"""Shaping and fusing ranked results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.functions import urls

RRF = 60
#: The order in which methods are pooled.
METHODS = ["bm25", "sqlite_fts", "dense", "dense_e5", "hybrid", "hybrid_e5"]


#: Where a result's title, address and user are looked for, in order.
TITLE_KEYS = ["title", "document_title", "doc_title", "name", "filename", "file_name"]
URL_KEYS = ["source_url", "url", "link", "href", "source"]
USER_KEYS = ["user_name", "participant_name", "user", "name"]


def result_url(metadata: Column) -> Column:
    """The first address of the metadata's keys that is not blank, '' if that is none of http."""
    url = t.first_value(*(metadata[k] for k in URL_KEYS))
    return F.when(url.rlike("(?i)^https?://"), url).otherwise("")


def result_title(metadata: Column, path: Column) -> Column:
    """The title of a hit: of the metadata's keys in order, else the name in its address, else the last part of its path."""
    last = F.filter(F.split(F.trim(path), "/"), lambda x: x != "")
    return t.first_value(*(metadata[k] for k in TITLE_KEYS), urls.name_in_address(result_url(metadata)), F.try_element_at(last, F.lit(-1)))


def score_text(score: Column) -> Column:
    """A number with at most twelve significant digits, without needless zeros; null gives ''."""
    s = F.format_string("%.12g", score.cast("double"))
    return F.when(score.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1"))


def user_name(payload: Column) -> Column:
    return F.coalesce(t.first_value(*(payload[k] for k in USER_KEYS)), F.lit(""))


def best_per_document(hits: DataFrame, doc: str, score: str = "score", order: str = "rank", group: list[str] | None = None, k: int | None = None) -> DataFrame:
    """The best hit of each document (ties: the first), renumbered by score; hits without a document are dropped.

    A null score is the lowest.
    """
    by = group or []
    s = F.desc_nulls_last(score)
    first = hits.where(t.first_value(F.col(doc)).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*by, doc).orderBy(s, order))).where("_n = 1").drop("_n")
    w = Window.partitionBy(*by).orderBy(s, order) if by else Window.orderBy(s, order)
    if k is not None and not by:
        first = first.orderBy(s, order).limit(k)
    out = first.withColumn("new_rank", F.row_number().over(w))
    return out.where(F.col("new_rank") <= k) if k is not None else out


def reciprocal_ranks(lists: DataFrame, key: list[str], weight: Column, k: int | None = None, group: list[str] | None = None, const: int = RRF) -> DataFrame:
    """group, key, score, rank: weighted reciprocal rank fusion of the lists in ``lists`` (list_no, rank and key).

    Empty keys are skipped, though their ranks stay used. Ties go by the first
    list and rank that has the key.
    """
    by = group or []
    known = lists
    for c in key:
        known = known.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    fused = known.groupBy(*by, *key).agg(F.round(F.sum(weight / (const + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "_first", *key) if by else Window.orderBy(F.desc("score"), "_first", *key)
    if k is not None and not by:
        fused = fused.orderBy(F.desc("score"), "_first", *key).limit(k)
    out = fused.withColumn("rank", F.row_number().over(w)).drop("_first")
    return out.where(F.col("rank") <= k) if k is not None else out


def dedupe_documents(hits: DataFrame, query_id: str, doc: str, k: int) -> DataFrame:
    """query_id, doc, score, rank: the highest score of each document, the best ``k``."""
    best = hits.where(F.coalesce(F.col(doc), F.lit("")) != "").groupBy(query_id, doc).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def pool(hits: DataFrame, query_id: str, doc: str, order: list[str] = METHODS) -> DataFrame:
    """query_id, doc, pooled_from, ranks, n_methods, first_title: hits of several methods, one row per document.

    Methods are listed in their fixed order; the title is that of the first method that has the document.
    """
    no = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    one = F.struct(no.alias("n"), F.col("method").alias("m"), F.col("rank").alias("r"))
    best = hits.where(F.col(doc).isNotNull()).groupBy(query_id, doc, "method").agg(F.min("rank").alias("rank"), F.min_by("title", "rank").alias("title"))
    out = best.groupBy(query_id, doc).agg(F.sort_array(F.collect_list(one)).alias("x"), F.min_by("title", F.struct(no, "rank")).alias("first_title"))
    return out.select(
        query_id, doc, F.array_join(F.transform("x", lambda e: e.m), "|").alias("pooled_from"), F.array_join(F.transform("x", lambda e: F.concat_ws(":", e.m, e.r)), "|").alias("ranks"), F.size("x").alias("n_methods"), "first_title"
    )


#: The factor of the hash of the seed text, and factor and addend of the congruence, all mod 2**32.
HASH_FACTOR, STEP_FACTOR, STEP_ADDEND = 31, 1664525, 1013904223


def shuffled(items: list, seed_text: str) -> list:
    """Items in an order that the text determines: a 31-fold hash of its UTF-16 units seeds a linear congruence, mod 2**32."""
    seed = 0
    units = seed_text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        seed = (seed * HASH_FACTOR + units[k] + 256 * units[k + 1]) % 2**32
    out = list(items)
    for last in range(len(out) - 1, 0, -1):
        seed = (STEP_FACTOR * seed + STEP_ADDEND) % 2**32
        other = seed % (last + 1)
        out[last], out[other] = out[other], out[last]
    return out


def seeded_shuffle(df: DataFrame, group: str, item: str, order: str, run_id: str) -> DataFrame:
    """group, item, position (int, from 1): each group's items shuffled by group and run. Groups are result lists and short."""
    lists = df.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(g, x, n) for g, items in zip(b[group], b["items"]) for n, x in enumerate(shuffled(list(items), f"{g}:{run_id}"), 1)], columns=[group, item, "position"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return lists.mapInPandas(run, f"{group} {types[group]}, {item} {types[item]}, position int")


def log_rows(results: DataFrame, keep: list[str], hits: str) -> DataFrame:
    """One row per hit with its rank and the number of hits; a search without hits keeps one row with nulls."""
    return results.select(*keep, F.size(hits).alias("result_count"), F.posexplode_outer(hits).alias("_pos", "hit")).withColumn("rank", F.col("_pos") + 1).drop("_pos")


def valid_rating(rating: Column) -> Column:
    """A whole number from 1 to 5."""
    return F.coalesce(rating.rlike(r"^\s*[1-5]\s*$"), F.lit(False))


def rating_errors(request: Column) -> Column:
    """What is wrong with a rating (search_id, user_score): '' if it is accepted."""
    return F.when(t.first_value(request["search_id"]).isNull(), "search_id is required").when(~valid_rating(request["user_score"]), "user_score must be 1 to 5").otherwise("")


def rated_document(request: Column) -> Column:
    """The document that a rating is of: as named, else its title, path or address."""
    return F.coalesce(t.first_value(*(request[k] for k in ("document", "title", "source_path", "url"))), F.lit(""))


def submission_errors(fields: dict[str, Column]) -> Column:
    """The names of the fields that are blank, joined by "|"."""
    return F.concat_ws("|", *(F.when(t.first_value(c).isNull(), name) for name, c in fields.items()))


def safe_int(c: Column, default: int) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(default))


def safe_bool(c: Column, default: bool) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("1", "true", "yes", "on", "y"), True).when(s.isin("0", "false", "no", "off", "n"), False).otherwise(default)
