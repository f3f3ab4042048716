"""The inverted index as tables, and the two rankings over it.

``postings`` is built once and written or persisted; queries join their few terms
to it, so only the query terms' postings are read. Scores are rounded before
ranking, as sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as t

K1, B = 1.5, 0.75
FIELD_K1, FIELD_B = 1.2, 0.75
#: Weights of the fields of the weighted index.
FIELD_WEIGHTS = {"title_text": 5.0, "body_text": 1.0, "metadata_text": 0.5}
SCORE_PLACES = 6


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf (long): how often each term occurs in each text. Counted before the shuffle."""
    words = df.select(F.col(key), F.explode(t.tokens(F.col(text))).alias("term"))
    return words.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def term_postings(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """term, key, tf, dl: the postings of some terms only, with the length of each text.

    Other terms are left out before anything is counted or shuffled.
    """
    # In steps: beside a generator an expression is worked out for every row that comes out of it.
    words = df.select(F.col(key), t.tokens(F.col(text)).alias("words")).select(key, "words", F.size("words").alias("dl"))
    # The outer form keeps the words from being found once more to see whether there are any.
    long = words.select(key, "dl", F.explode_outer("words").alias("term"))
    return long.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, dl (int): the number of terms of each text that has any."""
    return df.select(key, F.size(t.tokens(F.col(text))).alias("dl")).where(F.col("dl") > 0)


def term_stats(post: DataFrame) -> DataFrame:
    """term, df (long), cf (long): in how many texts a term is, and how often in all."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """n (long) and avgdl: one row."""
    return dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term, qtf (long), qpos (int): the distinct terms of each query, how often and where first."""
    words = queries.select(F.col(query_id), F.posexplode(t.tokens(F.col(text))).alias("pos", "term"))
    return words.groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"), F.min("pos").alias("qpos"))


#: A query set of at most so many terms is known to all tasks; a larger one is joined by term.
MOST_TERMS = 200_000


def held(terms: DataFrame, most: int = MOST_TERMS) -> tuple[DataFrame, bool]:
    """The terms as rows at hand and True if they are at most ``most``, else as they are and False."""
    rows = terms.limit(most + 1).collect()
    return (terms.sparkSession.createDataFrame(rows, terms.schema), True) if len(rows) <= most else (terms, False)


def _by_text(post: DataFrame, key: str) -> DataFrame:
    """The postings by the hash of their text. The number is given, as postings that look small are many more rows once they meet the queries."""
    return post.repartition(int(post.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(terms: DataFrame, post: DataFrame, stats: DataFrame, key: str, query_id: str, k: int, k1: float = K1, b: float = B, frequency: DataFrame | None = None, small: bool = False) -> DataFrame:
    """query_id, key, score, rank (int) of the best ``k`` texts of each query.

    ``post`` is that of ``term_postings``, for these terms or more, ``stats`` that of
    ``corpus_stats``, ``frequency`` (term, df) that of ``term_stats``, counted here if
    it isn't given. With ``small`` the terms are few (see ``held``) and sent to all
    tasks. A query's term counts as often as it occurs in the query. Ties go
    by the first query term found, then by key. A query without known terms, and any
    query with k of 0 or less, has no rows. Only postings of query terms are joined;
    texts are ranked within each query after partial ranking (WindowGroupLimit).
    """
    # The query terms are those of the queries at hand; the join picks its own strategy by their size.
    # All columns are read, so that this is the same exchange as that of the postings and is used twice.
    if frequency is None:
        frequency = post.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") > 0)).alias("df"))
    # The postings go to their texts before they meet the queries' terms, so that a text's scores are added up and
    # ranked where they are, and no row for each query and text is shuffled. Statistics are one row.
    asked = terms.join(frequency, "term")
    scored = _by_text(post, key).join(F.broadcast(asked) if small else asked, "term").crossJoin(F.broadcast(stats))
    tf = F.col("tf")
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    sums = scored.groupBy(query_id, key).agg(F.round(F.sum(part), SCORE_PLACES).alias("score"), F.min("qpos").alias("qpos"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "qpos", key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, key, "score", "rank")


def field_postings(df: DataFrame, key: str, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """field, term, key, tf, dl: postings of several fields, words of any script, diacritics kept, of some terms only if given."""
    lists = [t.unicode_tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    made = df.select(F.col(key), F.array(*[F.struct(F.lit(f).alias("field"), x.alias("words")) for f, x in zip(fields, lists)]).alias("xs"))
    counted = made.select(key, "xs", F.aggregate("xs", F.lit(0), lambda a, x: a + F.size(x["words"])).alias("dl"))
    words = counted.select(key, "dl", F.explode_outer("xs").alias("x"))
    long = words.select(key, "dl", F.col("x.field").alias("field"), F.explode_outer("x.words").alias("term")).where(F.col("term").isNotNull())
    if terms is not None:
        long = long.join(terms.select("term").distinct(), "term", "left_semi")
    return long.groupBy("field", "term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def field_lengths(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, dl: the number of words in all fields together, rows without any included."""
    return df.select(key, sum((F.size(t.unicode_tokens(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0)).alias("dl"))


def weighted_fields(terms: DataFrame, post: DataFrame, stats: DataFrame, key: str, query_id: str, k: int, weights: dict[str, float] | None = None, frequency: DataFrame | None = None, small: bool = False) -> DataFrame:
    """query_id, key, score, rank: one score over weighted fields.

    ``post`` is that of ``field_postings``, or has its fields already merged into ``f``.

    A term's frequency is the weighted sum over fields; its rarity counts rows that
    have it in any field and is at least 1e-6; how often the query has it does not
    matter. The score is positive, the best first; ties go by key.
    """
    merged = post
    if "f" not in post.columns:
        weight = F.create_map(*[F.lit(x) for f in (weights or FIELD_WEIGHTS).items() for x in f])
        merged = post.groupBy("term", key).agg(F.sum(weight[F.col("field")] * F.col("tf")).alias("f"), F.first("dl").alias("dl"))
    if frequency is None:
        frequency = merged.groupBy("term").agg(F.count_if((F.col("f") > 0) & (F.col("dl") > 0)).alias("df"))
    asked = terms.select(query_id, "term").distinct().join(frequency, "term")
    scored = _by_text(merged, key).join(F.broadcast(asked) if small else asked, "term").crossJoin(F.broadcast(stats))
    rare = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    f = F.col("f")
    part = rare * f * (FIELD_K1 + 1) / (f + FIELD_K1 * (1 - FIELD_B + FIELD_B * F.col("dl") / F.col("avgdl")))
    sums = scored.groupBy(query_id, key).agg(F.round(F.sum(part), SCORE_PLACES).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, key, "score", "rank")


def metadata_text(metadata: Column) -> Column:
    """The values of a metadata map in the order of their keys, without paths, texts, addresses and times, in one text."""
    skipped = ["section_path", "section_text", "source_url", "downloaded_at"]
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(skipped) & v.isNotNull() & (F.trim(v) != ""))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.trim(e["value"])), " ")
