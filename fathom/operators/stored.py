"""Indexes written once to the shared folder and read by every search after.

The folder is the one the cluster names in ``spark.checkpoint.dir``; where none is
named, as in tests, one of this machine is taken. An index lies under a signature of
its source's files and its settings: if either changes, another is built. It is
written beside its place and then moved there, so that it is there as a whole or not
at all, and two that build the same one don't disturb each other.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import index, vectors
from fathom.session import shared_folder

#: Terms lie in so many folders, each in at least so many files by the hash of the text, so that a common term is read by many tasks.
BUCKETS, LEAST_PARTS = 8, 8
VERSION = 3


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, beside: str, where: str) -> None:
    """Puts a folder in its place unless another is there, then it is dropped."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    (old, fs), (new, _) = _path(spark, beside), _path(spark, where)
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(old, new, none)
    except Py4JJavaError:
        if not fs.exists(new):
            raise
        fs.delete(old, True)


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return fs.exists(path)


def signature(spark: SparkSession, source: str, **settings) -> str:
    """A name for what is built from the files of ``source`` (a file or folder of files) by these settings."""
    path, fs = _path(spark, source)
    files = fs.listFiles(path, True)
    n, last, size = 0, 0, 0
    while files.hasNext():
        f = files.next()
        n, last, size = n + 1, max(last, f.getModificationTime()), size + f.getLen()
    told = json.dumps({"source": source, "files": [n, last, size], "version": VERSION, **settings}, sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
    """The table of that name in the shared folder, built and written if it isn't there."""
    where = f"{shared_folder(spark)}/fathom-index/{name}"
    path, fs = _path(spark, where)
    if not fs.exists(path):
        beside = f"{where}.{uuid.uuid4().hex}"
        writer = build().write.option("compression", "zstd")
        (writer.partitionBy(partition) if partition else writer).parquet(beside)
        _move(spark, beside, where)
    try:
        return spark.read.parquet(where)
    except AnalysisException:  # a table without rows that is laid down by a column has no file
        return spark.createDataFrame([], build().schema)


class WordIndex(NamedTuple):
    """postings (term, key, f, dl), terms (term, df) and stats (n, avgdl), as ``index.bm25`` and ``index.weighted_fields`` take them."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def asked(self, terms: DataFrame, small: bool = False) -> tuple[DataFrame, DataFrame]:
        """The postings of some terms, and in how many texts each is. Only the terms' parts of the index are read; few terms (``index.held``) are sent to all tasks."""
        hint = F.broadcast if small else lambda x: x
        some = terms.select("term").distinct()
        return self.postings.join(hint(some.withColumn("bucket", _bucket(F.col("term")))), ["bucket", "term"]), self.terms.join(hint(some), "term")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def word_index(spark: SparkSession, name: str, texts: Callable[[], DataFrame], key: str, fields: dict[str, float], tokens: Callable[[Column], Column], empty_too: bool = False) -> WordIndex:
    """The inverted index of some text fields, each term's frequency weighted by its field.

    Texts are read and taken apart once. Of each text one posting is marked, so that
    the number of texts and their lengths come from the postings alone; with
    ``empty_too`` a text without words counts as well. Postings are laid down by
    the hash of their term, and a term's by that of their text, so that a term that
    is in every text is no single task's work.
    """

    def build() -> DataFrame:
        df = texts()
        lists = [F.struct(F.lit(float(w)).alias("w"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f, w in fields.items()]
        made = df.select(F.col(key), F.array(*lists).alias("xs"))
        # The length, and the first field that has a word (from 1; 0 if none has).
        first = F.array_position(F.transform("xs", lambda x: F.size(x["words"]) > 0), True).cast("int")
        counted = made.select(key, "xs", F.aggregate("xs", F.lit(0), lambda a, x: a + F.size(x["words"])).alias("dl"), first.alias("first"))
        by_field = counted.select(key, "dl", "first", F.posexplode_outer("xs").alias("field", "x"))
        long = by_field.select(key, "dl", "first", "field", F.col("x.w").alias("w"), F.posexplode_outer("x.words").alias("pos", "term"))
        long = long.where(F.col("term").isNotNull() | ((F.col("first") == 0) & (F.col("field") == 0)))
        marked = F.col("term").isNull() | ((F.col("field") + 1 == F.col("first")) & (F.col("pos") == 0))
        post = long.groupBy("term", key).agg(F.sum("w").alias("f"), F.first("dl").alias("dl"), F.max(marked).alias("marked"))
        salt = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        placed = post.withColumn("bucket", F.coalesce(_bucket(F.col("term")), F.lit(0)))
        return placed.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(salt))).sortWithinPartitions("bucket", "term")

    post = kept(spark, f"{name}-postings", build, "bucket")
    terms = kept(spark, f"{name}-terms", lambda: post.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    one = post.where("marked" if empty_too else "marked and dl > 0")
    stats = kept(spark, f"{name}-stats", lambda: one.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).coalesce(1))
    return WordIndex(post.where("term is not null"), terms, stats)


def bm25_index(spark: SparkSession, source: str, key: str, text: str) -> WordIndex:
    """The index of one field of a stored table for ``index.bm25``."""
    name = signature(spark, source, kind="bm25", key=key, text=text)
    return word_index(spark, name, lambda: spark.read.parquet(source), key, {text: 1.0}, t.tokens)


def fields_index(spark: SparkSession, source: str, key: str, texts: Callable[[], DataFrame], weights: dict[str, float] | None = None) -> WordIndex:
    """The index of weighted fields for ``index.weighted_fields``; ``texts`` gives key and the fields, from ``source``."""
    weights = weights or index.FIELD_WEIGHTS
    name = signature(spark, source, kind="fields", key=key, weights=weights)
    return word_index(spark, name, texts, key, weights, t.unicode_tokens, empty_too=True)


def vector_index(spark: SparkSession, source: str, key: str, text: str, profile: str, chosen: str | None = None) -> DataFrame:
    """key, embedding of the texts of a stored table that have a word, by a named profile; ``chosen`` is a condition on its rows."""
    name = signature(spark, source, kind="vectors", key=key, text=text, profile=profile, chosen=chosen or "", dims=vectors.DIMS)

    def build() -> DataFrame:
        rows = spark.read.parquet(source).where(F.size(t.tokens(F.col(text))) > 0)
        return vectors.index_rows(rows.where(chosen) if chosen else rows, key, text, profile)

    return kept(spark, f"{name}-vectors", build)
