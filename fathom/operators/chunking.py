"""Chunks for search: greedy words with overlap, and the chunk tables of the indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as t
from fathom.functions.numbering import dense_number

#: Named settings: size and overlap of chunks, whether titles are chunks, the prefix of passages.
PROFILES = {"bm25": (500, 50, True, ""), "swedish_bert": (250, 50, True, ""), "e5_large_instruct": (500, 25, True, "passage: ")}


def settings(profile: str = "bm25", size: int | None = None, overlap: int | None = None, titles: bool | None = None) -> tuple[int, int, bool, str]:
    """Size, overlap, titles and prefix of a profile; what is given goes before it. An unknown profile is an error."""
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile!r}; there are {', '.join(PROFILES)}")
    own = PROFILES[profile]
    return (own[0] if size is None else size, own[1] if overlap is None else overlap, own[2] if titles is None else titles, own[3])


def chunk_words(text: str | None, size: int, overlap: int) -> list[str]:
    """Words packed into chunks of at most ``size`` characters, each word counting one more for its space.

    A chunk begins with the last words of the one before until ``overlap`` is used
    up, the word that crosses it included. A long word is never split.
    """
    out: list[str] = []
    now: list[str] = []
    used = 0
    for w in (text or "").split():
        if now and used + len(w) + 1 > size:
            out.append(" ".join(now))
            kept: list[str] = []
            room = 0
            for x in reversed(now if overlap > 0 else []):
                if room >= overlap:
                    break
                kept.append(x)
                room += len(x) + 1
            now, used = kept[::-1], room
        now.append(w)
        used += len(w) + 1
    return [*out, " ".join(now)] if now else out


def chunk_column(text: Column, size: int, overlap: int) -> Column:
    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def run(x):
        return chunk_words(x, size, overlap)

    return run(text)


def chunk_text(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """key, chunk_index (int, from 0), chunk. Null and blank texts have none. Rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, index, chunks = [], [], []
            for k, s in enumerate(b.column(1).to_pylist()):
                for n, c in enumerate(chunk_words(s, size, overlap)):
                    take.append(k)
                    index.append(n)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(index, pa.int32()), pa.array(chunks, pa.string())], names=[key, "chunk_index", "chunk"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return df.select(key, text).mapInArrow(run, schema)


def chunk_counts(df: DataFrame, text: str, settings: list[tuple[int, int]]) -> DataFrame:
    """size, overlap, n (long): how many chunks each setting makes of all texts. Counted in each task; no chunk leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(settings)
        for b in batches:
            for x in b.column(0).to_pylist():
                for k, (size, overlap) in enumerate(settings):
                    n[k] += len(chunk_words(x, size, overlap))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in settings], pa.int64()), pa.array([o for _, o in settings], pa.int64()), pa.array(n, pa.int64())], names=["size", "overlap", "n"])

    return df.select(text).mapInArrow(run, "size long, overlap long, n long").groupBy("size", "overlap").agg(F.sum("n").alias("n"))


def corpus(docs: DataFrame, sections: DataFrame, key: str, size: int | None = 500, overlap: int = 50, titles: bool = True) -> DataFrame:
    """key, section_index, unit (0 title, 1 heading, 2 body), chunk_index, chunk_type, text, preview_text.

    ``docs`` has key and title, ``sections`` key, section_index, heading and text.
    A heading's text is title and heading, unless they are the same; the first
    chunk of a body begins with its heading. ``size`` None makes one chunk of each
    section. Blank bodies give a heading only.
    """
    named = docs.select(key, t.squeeze(F.col("title")).alias("title"))
    head = F.coalesce(t.first_value(F.col("heading")), F.col("title"), F.lit(""))
    full = sections.join(named, key, "left").withColumn("head", head)
    both = F.when((F.coalesce("title", F.lit("")) != "") & (F.col("title") != F.col("head")), F.concat_ws("\n\n", "title", "head")).otherwise(F.col("head"))
    cols = [key, "section_index", "unit", "chunk_index", "chunk_type", "text", "preview_text"]
    heads = full.where(F.col("head") != "").select(key, "section_index", F.lit(1).alias("unit"), F.lit(0).alias("chunk_index"), F.lit("section_title").alias("chunk_type"), both.alias("text"), F.col("head").alias("preview_text"))
    body = full.where(F.trim(F.col("text")) != "")
    if size is None:
        body = body.select(key, "section_index", "head", F.lit(0).alias("chunk_index"), F.col("text").alias("preview_text"))
    else:
        body = body.select(key, "section_index", "head", F.posexplode(chunk_column(F.col("text"), size, overlap)).alias("chunk_index", "preview_text"))
    opened = F.when((F.col("chunk_index") == 0) & (F.col("head") != ""), F.concat_ws("\n\n", "head", "preview_text")).otherwise(F.col("preview_text"))
    bodies = body.select(key, "section_index", F.lit(2).alias("unit"), "chunk_index", F.lit("section").alias("chunk_type"), opened.alias("text"), "preview_text")
    out = heads.select(cols).unionByName(bodies.select(cols))
    if titles:
        t0 = named.where(F.coalesce("title", F.lit("")) != "")
        out = out.unionByName(t0.select(key, F.lit(-1).alias("section_index"), F.lit(0).alias("unit"), F.lit(0).alias("chunk_index"), F.lit("title").alias("chunk_type"), F.col("title").alias("text"), F.col("title").alias("preview_text")))
    return out


def with_chunk_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The chunks that have a token, with a dense chunk_id (long, from 0) in the order given."""
    return dense_number(chunks.where(F.size(t.tokens(F.col("text"))) > 0), order, "chunk_id")


def dense_ids(chunks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The chunks that have a token, numbered within ``group`` (chunk_no, from 0)."""
    kept = chunks.where(F.size(t.tokens(F.col("text"))) > 0)
    return kept.withColumn("chunk_no", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
