"""Result files of evaluation runs found in a folder, and reports of result tables."""

from __future__ import annotations

import html

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as t

#: Where result files lie under a folder of experiments, and what kind they are of.
PLACES = {"aggregate": "*/results/aggregate/*.csv", "runs": "*/results/runs/**"}
ROWS = 50


def discover(spark: SparkSession, folder: str, root: str | None = None, runs: bool = True) -> DataFrame:
    """file_id, source_file, source_kind, experiment, line_no, line: the lines of the result files of a folder.

    Aggregates of all experiments, with ``runs`` also their single runs, and the file
    ``root`` if it is given. A file is read as a whole, as its lines need their
    numbers; places without files are no error.
    """
    found = []
    for kind, place in [("root", None)] * bool(root) + [(k, p) for k, p in PLACES.items() if runs or k != "runs"]:
        where = spark._jvm.org.apache.hadoop.fs.Path(root if place is None else f"{folder}/{place}")
        hits = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        paths = [h.getPath().toString() for h in hits or []]
        if paths:
            texts = spark.read.text(paths, wholetext=True, pathGlobFilter="*.csv", recursiveFileLookup=True)
            found.append(texts.select(F.col("_metadata.file_path").alias("source_file"), F.lit(kind).alias("source_kind"), "value"))
    if not found:
        return spark.createDataFrame([], "file_id long, source_file string, source_kind string, experiment string, line_no int, line string")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    experiment = F.nullif(F.regexp_extract("source_file", r"([^/]+)/results/", 1), F.lit(""))
    lines = every.select("source_file", "source_kind", experiment.alias("experiment"), F.posexplode(F.split(F.regexp_replace("value", r"\r\n|\r", "\n"), "\n", -1)).alias("n", "line"))
    return lines.select(F.xxhash64("source_file").alias("file_id"), "source_file", "source_kind", "experiment", (F.col("n") + 1).alias("line_no"), "line")


def read_sheet(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """A sheet of queries from CSV, all text. What was read is kept as a snapshot, which is read where the sheet can't be."""
    read = lambda where: spark.read.csv(where, header=True, multiLine=True, escape='"')
    try:
        sheet = read(path)
        sheet.write.mode("overwrite").csv(snapshot, header=True, escape='"')
    except (AnalysisException, Py4JJavaError, SparkException):
        return read(snapshot)
    return sheet


def html_table(df: DataFrame, most: int = ROWS) -> str:
    """The first rows of a table in HTML, escaped; at most ``most`` come to the driver."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    rows = ["".join(cell("th", c) for c in df.columns), *("".join(cell("td", v) for v in r) for r in df.limit(most).collect())]
    return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"


def html_report(title: str, tables: dict[str, DataFrame], most: int = ROWS) -> str:
    """A page with a heading and table for each result."""
    parts = "".join(f"<h2>{html.escape(name)}</h2>{html_table(df, most)}" for name, df in tables.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>"


def with_experiment(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Result rows with kind and file; the experiment is that of their column, else of their path."""
    of = files.groupBy("file_id").agg(F.first("source_file").alias("source_file"), F.first("source_kind").alias("source_kind"), F.first("experiment").alias("_path"))
    return rows.join(of, "file_id").withColumn("experiment", t.first_value(F.col("experiment"), F.col("_path"))).drop("_path")
