"""Schemas that drift between files: rescue-column ingestion of raw delimited lines.

``ingest`` enforces a target schema on lines whose headers change from file to
file and within a file.  What has no place in it (unknown columns, values that
can't be cast) is kept as JSON in the column ``rescued``; ``promote`` turns
approved unknown columns and re-readable values into typed columns later, without
reading the files again.  ``drift`` reports every change of every header.

A file's lines are never gathered in one task: headers are found line by line,
only those (a few lines per file) are grouped, and they are joined back to the
lines of their file.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Other names under which a field is known to have been written.
ALIASES = {
    "average_rank": ["mean rank", "avg_rank", "mean_rank", "rank"],
    "average_score": ["mean_rr20", "rr@20", "avg_score", "mean_score", "score"],
    "evaluated_at_cet": ["ts_cet", "evaluated_at", "timestamp_cet", "evaluated"],
    "top_k": ["k", "topk"],
    "num_queries_total": ["n_queries", "num_queries", "queries_total"],
    "num_query_types": ["n_query_types", "query_types"],
    "qrels_source": ["qrels"],
    "data_source": ["source", "data", "datakälla"],
    "method": ["metod", "mthd", "search_method", "retrieval-method", "engine", "sökmetod"],
    "model_name": ["model", "modell"],
    "experiment": ["experiment_name", "försök", "exp", "run_label", "experimentnamn"],
    "config_slug": ["slug", "config", "konfiguration", "cfg_slug", "cfg"],
    "text_source": ["text", "textkälla"],
    "chunk_size": ["max_chars", "size"],
    "chunk_overlap": ["overlap", "överlapp"],
    "include_title_chunk": ["title_chunk", "with_title"],
    "index_dir": ["index_path", "index"],
}
DELIMITERS = ",;\t|"
TRUE, FALSE = {"true"}, {"false"}
WHOLE = re.compile(r"[+-]?\d+")
REAL = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:nan|inf(?:inity)?)", re.I)
STAMP = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?")
BLANKS = " \t\r\n\f\v\xa0﻿"
SPARK = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


#: Cells may be as long as texts are.
csv.field_size_limit(2**31 - 1)


def cells(line: str, delimiter: str) -> list[str]:
    """The cells of a line; a line end within it that isn't quoted counts as a blank."""
    line = line.strip("﻿\r\n")
    try:
        return next(csv.reader([line], delimiter=delimiter), [])
    except csv.Error:
        return next(csv.reader([re.sub(r"[\r\n\0]", " ", line)], delimiter=delimiter), [])


def bare(name: str) -> str:
    """A column name without the surrounding blanks, quotes and byte order mark, which are no change."""
    before = None
    while before != name:
        before, name = name, name.strip(BLANKS).strip("\"'")
    return name


def _key(name: str) -> str:
    return re.sub(r"[\W_]+", "", name).casefold()


class Names:
    """Which field a column name stands for: itself, a known other name, else an abbreviation of it."""

    def __init__(self, fields: list[str]):
        self.fields = fields
        self.seen: dict[str, bool] = {}
        self.known = {_key(f): f for f in fields}
        for f in fields:
            for a in ALIASES.get(f, []):
                self.known.setdefault(_key(a), f)

    def resolve(self, columns: list[str]) -> list[str | None]:
        """The field of each column or None; an exact name goes before another one of the same field."""
        out: list[str | None] = [c if c in self.fields else None for c in columns]
        taken = {f for f in out if f}
        for strict in (True, False):
            for i, c in enumerate(columns):
                if out[i] is None and c:
                    f = self.known.get(_key(c)) if strict else self._short(c)
                    if f and f not in taken:
                        out[i] = f
                        taken.add(f)
        # The same exact name twice: the first column is the field.
        seen: set[str] = set()
        for i, f in enumerate(out):
            if f in seen:
                out[i] = None
            elif f:
                seen.add(f)
        return out

    def knows(self, name: str) -> bool:
        """Whether a name is that of a field, or a known other one."""
        got = self.seen.get(name)
        if got is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            got = self.seen[name] = bool(name) and _key(name) in self.known
        return got

    def _short(self, name: str) -> str | None:
        """A field whose words the name's words shorten, one by one ("num_q_types", "evalAtCet")."""
        words = lambda x: [w.casefold() for w in re.findall(r"[^\W\d_]+?(?=[A-ZÅÄÖ]|[\W\d_]|$)|\d+", x)]

        def shortens(a: str, b: str) -> bool:
            it = iter(b)
            return len(a) >= 2 and a[0] == b[0] and all(c in it for c in a)

        mine, found = words(name), []
        for f in self.fields:
            theirs = words(f)
            if len(mine) == len(theirs) and all(map(shortens, mine, theirs)):
                found.append(f)
        return found[0] if len(found) == 1 else None


def is_header(line: str | None, names: Names, first: bool) -> tuple[str, list[str]] | None:
    """(delimiter, names) of a header line: most cells are names of fields and no cell is a number or time."""
    if line is None or not line.strip(BLANKS):
        return None
    best: tuple[int, int, str, list[str]] | None = None
    for d in DELIMITERS:
        if d in line or d == DELIMITERS[0]:
            got = [bare(c) for c in cells(line, d)]
            known = sum(names.knows(c) for c in got)
            if best is None or (known, len(got)) > best[:2]:
                best = (known, len(got), d, got)
    known, _, d, got = best
    if any(c[:1] in "0123456789+-." and (WHOLE.fullmatch(c) or REAL.fullmatch(c) or STAMP.fullmatch(c)) for c in got):
        return None
    if known >= max(2, len(got) // 3) or (first and known >= 1):
        return d, got
    return None


def form(value: str, field_type: str) -> bool:
    """Whether a trimmed value has the form of a type; any text has that of a string."""
    if field_type == "int":
        return WHOLE.fullmatch(value) is not None
    if field_type == "double":
        return REAL.fullmatch(value) is not None
    if field_type == "boolean":
        return value.lower() in TRUE | FALSE
    if field_type == "timestamp":
        return STAMP.fullmatch(value) is not None
    return True


def is_json(value: str) -> bool:
    """Whether a value is a JSON list, object or text; one nested deeper than Python reads is none."""
    if value[:1] not in '[{"':
        return False
    try:
        json.loads(value)
    except (ValueError, RecursionError):
        return False
    return True


HEADER = T.StructType(
    [T.StructField("line_no", T.IntegerType()), T.StructField("delimiter", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("fields", T.ArrayType(T.StringType()))]
)


def headers(lines: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """The header lines: file_id, line_no, delimiter, columns, fields (null where a column is no field)."""
    known = [f for f, _ in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(known)
        for b in batches:
            out = []
            for i, n, s in zip(b.file_id, b.line_no, b.line):
                if got := is_header(s if isinstance(s, str) else None, names, n == 1):
                    out.append((i, n, got[0], got[1], names.resolve(got[1])))
            yield pd.DataFrame(out, columns=["file_id", "line_no", "delimiter", "columns", "fields"])

    schema = T.StructType([lines.schema["file_id"], *HEADER.fields])
    return lines.select("file_id", F.col("line_no").cast("int").alias("line_no"), "line").mapInPandas(run, T.StructType([T.StructField("file_id", lines.schema["file_id"].dataType), *schema.fields[1:]]))


def lay_out(line: str | None, line_no: int, known: list[dict]) -> tuple[dict, list[str]] | None:
    """The header a row is laid out by, and its cells: the last header before it, or the most recent
    earlier one of its width if the number of cells differs."""
    if line is None or not line.strip(BLANKS):
        return None
    before = [h for h in known if h["line_no"] < line_no]
    if not before:
        return None
    last = None
    for h in reversed(before):
        got = cells(line, h["delimiter"])
        last = last or got
        if len(got) == len(h["columns"]):
            return h, got
    return before[-1], last


class Row(NamedTuple):
    """A data row under its header: the header, the values by column, and what lies beyond the header."""

    header: dict
    values: list[str]
    extra: list[str]


def _headed(lines: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """The lines with ``heads``, the header lines of their file: a file has a few, which are all that is gathered."""
    by_file = headers(lines, fields).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "delimiter", "columns", "fields"))).alias("heads"))
    return lines.select("file_id", F.col("line_no").cast("int").alias("line_no"), "line").join(by_file, "file_id")


def _read(b: pd.DataFrame, held: dict, strict: bool = False) -> Iterator[tuple[object, int, dict | Row]]:
    """file_id, line_no and the header or data row of the lines of a batch; other lines have none. ``held`` keeps the headers of the last file."""
    for i, n, s, heads in zip(b.file_id, b.line_no, b.line, b.heads):
        if held.get("file") != i:
            held["file"], held["heads"] = i, [{k: (list(v) if k in ("columns", "fields") else v) for k, v in dict(h).items()} for h in heads]
        known = held["heads"]
        own = next((h for h in known if h["line_no"] == n), None)
        if own:
            yield i, n, own
        elif got := lay_out(s if isinstance(s, str) else None, n, known):
            head, values = got
            width = len(head["columns"])
            if strict and len(values) != width:
                raise ValueError(f"file {i}, line {n}: {len(values)} cells under a header of {width}")
            yield i, n, Row(head, [v.strip(BLANKS) for v in values[:width]], values[width:])


def ingest(lines: DataFrame, fields: list[tuple[str, str]], strict: bool = False) -> DataFrame:
    """The data rows in the target schema: file_id, line_no, header_line, one typed column per field, ``rescued``.

    ``rescued`` is JSON: {"unknown": {column: value}, "uncast": {field: value},
    "extra": [cells beyond the header]}, null if nothing was rescued. Blank lines
    and header lines have no row; a row before any header has none either. Null
    lines count as blank. Values are trimmed. With ``strict`` a row whose width is
    that of no header before it is an error.
    """
    names = [f for f, _ in fields]
    kinds = dict(fields)
    raw = T.StructType(
        [T.StructField("file_id", lines.schema["file_id"].dataType), T.StructField("line_no", T.IntegerType()), T.StructField("header_line", T.IntegerType())]
        + [T.StructField(f, T.StringType()) for f in names]
        + [T.StructField("rescued", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            out = []
            for i, n, x in _read(b, held, strict):
                if isinstance(x, dict):
                    continue
                row, unknown, uncast = {}, {}, {}
                for c, f, v in zip(x.header["columns"], x.header["fields"], x.values):
                    if v:
                        (unknown if f is None else row if form(v, kinds[f]) else uncast)[c if f is None else f] = v
                kept = {k: y for k, y in (("unknown", unknown), ("uncast", uncast), ("extra", x.extra)) if y}
                out.append((i, n, x.header["line_no"], *(row.get(f) for f in names), json.dumps(kept, ensure_ascii=False) if kept else None))
            yield pd.DataFrame(out, columns=raw.names)

    typed = [typed_value(F.col(f"`{f}`"), kinds[f]).alias(f) for f in names]
    return _headed(lines, fields).mapInPandas(run, raw).select("file_id", "line_no", "header_line", *typed, "rescued")


def typed_value(c: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.try_to_timestamp(F.regexp_replace(c, ",", "."))
    return c if kind == "string" else c.try_cast(SPARK[kind])


def readable(c: Column, kind: str) -> Column:
    """A rescued value read leniently: decimal comma, a unit behind or a word before a number, percent, Swedish booleans."""
    number = F.regexp_replace(F.regexp_extract(c, r"([+-]?\d+(?:[.,]\d+)?)", 1), ",", ".")
    if kind == "double":
        return number.try_cast("double") / F.when(c.contains("%"), 100.0).otherwise(1.0)
    if kind == "int":
        return number.try_cast("double").cast("int")
    if kind == "boolean":
        low = F.lower(c)
        return F.when(low.isin("ja", "yes", "on", "1", "sant", "y", "j"), True).when(low.isin("nej", "no", "off", "0", "falskt", "n"), False)
    if kind == "timestamp":
        seconds = c.try_cast("double")
        return F.coalesce(
            F.when(seconds > 1e11, F.timestamp_millis(seconds.cast("long"))).when(seconds > 1e8, F.timestamp_seconds(seconds)),
            F.try_to_timestamp(c, F.lit("d/M/yyyy H:mm")), F.try_to_timestamp(c, F.lit("d.M.yyyy H:mm")), F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(c),
        )
    return c


def promote(rows: DataFrame, fields: list[tuple[str, str]], approved: list[tuple[str, str]]) -> DataFrame:
    """Replays ``rescued``: approved unknown columns become typed columns, uncast values that can be
    read leniently fill their fields; what stays behind stays in ``rescued``. A column whose name
    is taken, in whatever case, gets a number behind it."""
    inner = F.from_json("rescued", "unknown map<string,string>, uncast map<string,string>, extra array<string>")
    out = rows.withColumn("_r", inner)
    late = [F.coalesce(F.col(f"`{f}`"), readable(F.col("_r.uncast").getItem(f), k)).alias(f) for f, k in fields]
    taken = {x.casefold() for x in ("file_id", "line_no", "header_line", "rescued", *(f for f, _ in fields))}
    added = []
    for c, k in approved:
        free = next(x for x in (c, *(f"{c}_{n}" for n in range(2, len(taken) + 3))) if x.casefold() not in taken)
        taken.add(free.casefold())
        added.append(typed_value(F.col("_r.unknown").getItem(c), k).alias(free))
    names = [c for c, _ in approved]
    rest = F.struct(
        F.map_filter("_r.unknown", lambda k, _: ~k.isin(names)).alias("unknown") if names else F.col("_r.unknown").alias("unknown"),
        F.col("_r.uncast").alias("uncast"), F.col("_r.extra").alias("extra"),
    )
    return out.select("file_id", "line_no", "header_line", *late, *added, F.when(F.col("rescued").isNotNull(), F.to_json(rest)).alias("rescued"))


def drift(lines: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """file_id, line_no, change, field: each change of each header line with the rows laid out by it.

    Distinct rows.  A header with no rows, or a field with no value under it, is
    never ``retyped``.  A ``string`` field is, if all its values are whole
    numbers or all are JSON; another one, if no value has its form. Values are
    counted within each task; what is shuffled is a row for each header and field.
    """
    kinds = dict(fields)
    order = [f for f, _ in fields]
    schema = T.StructType(
        [T.StructField("file_id", lines.schema["file_id"].dataType), T.StructField("line_no", T.IntegerType()), T.StructField("change", T.StringType()), T.StructField("field", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("n", "bad", "whole", "json")]
    )

    def changes(head: dict) -> Iterator[tuple[str, str]]:
        for c, f in zip(head["columns"], head["fields"]):
            if f is None and c:
                yield "added", c
            elif f and f != c:
                yield "renamed", f
        yield from (("removed", f) for f in order if f not in head["fields"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        counts: dict[tuple, list[int]] = {}

        def told() -> pd.DataFrame:
            rows = [(i, n, "retyped", f, *c) for (i, n, f), c in counts.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=schema.names)

        for b in batches:
            out = []
            for i, n, x in _read(b, held):
                if isinstance(x, dict):
                    out += [(i, n, change, f, 0, 0, 0, 0) for change, f in changes(x)]
                    continue
                for f, v in zip(x.header["fields"], x.values):
                    if f and v:
                        c = counts.setdefault((i, x.header["line_no"], f), [0, 0, 0, 0])
                        c[0] += 1
                        c[1] += not form(v, kinds[f])
                        c[2] += WHOLE.fullmatch(v) is not None
                        c[3] += is_json(v)
            yield pd.DataFrame(out, columns=schema.names)
            if len(counts) > 100_000:
                yield told()
        yield told()

    kind = F.create_map(*[F.lit(x) for f in fields for x in f])[F.col("field")]
    added = _headed(lines, fields).mapInPandas(run, schema).groupBy("file_id", "line_no", "change", "field").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "whole", "json")))
    retyped = F.when(kind == "string", (F.col("whole") == F.col("n")) | (F.col("json") == F.col("n"))).otherwise(F.col("bad") == F.col("n"))
    return added.where((F.col("change") != "retyped") | retyped).select("file_id", "line_no", "change", "field")
