"""Several values packed in one field: one row per value, with position and error flags.

A parsing expression grammar is applied at each place of the string.  The
alternatives of ``value`` are ordered and the first that succeeds wins; one that
fails leaves the place where it was, so that a quote that is never closed falls
back to a bare value:

    field  <- blank? (list / sequence) blank? !.
    list   <- '[' (json-string (',' json-string)*)? ']'
    sequence <- value? (delimiter value?)*
    value  <- term &end / quoted &end / bracketed &end / bare
    quoted <- open (doubled / escape / !close .)* close
    bare   <- (term &end / escape / entity / !delimiter .)+
    delimiter <- ';#' / CR? LF / [,;|•·] / tab / blank '/' blank
    end    <- blank (delimiter / !.)

A term is an established value that may hold delimiters or quotes itself; letter
case and the kind and number of blanks within it do not matter, and the value
comes out as listed.

Time is linear in the string: places from which a quote was found not to close are
remembered and not read again (a packrat's memo), closing brackets are looked up,
and runs of blanks are read once. Brackets within more than ``DEEPEST`` others are
ordinary characters.
"""

from __future__ import annotations

import bisect
import functools
import html
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of quotes and brackets, delimiters, ways to say that nothing is given.
QUOTES = {'"': '"', "'": "'", "”": "”", "“": "”", "«": "»", "»": "»", "‘": "’", "’": "’", "„": "”"}
BRACKETS = {"[": "]", "{": "}"}
NOTHING = {"-", "–", "—", "--", "saknas", "ej angivet", "ej angiven", "ej angett", "ingen uppgift", "uppgift saknas", "n/a", "na", "n.a.", "null", "none", "ingen", "inget", "okänt", "okänd", "tom", "?", "."}
DELIMITER = re.compile(r"\s*(?:;#|\r?\n|\r|[,;|•·\t])|(?:\s+|\A)/(?=\s|\Z)")
ENTITY = re.compile(r"&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z]{2,8});")
BLANK = re.compile(r"\s+")
_PLAIN = r"""(?:"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|true|false|null)"""
#: A list as JSON writes it, of plain values.
LIST = re.compile(rf"\[\s*+(?:{_PLAIN}\s*+(?:,\s*+{_PLAIN}\s*+)*+)?\]", re.S)
#: How many brackets may hold one another.
DEEPEST = 30


def _squeeze(x: str) -> str:
    return BLANK.sub(" ", x).strip()


class PackedGrammar:
    """The grammar for one field's terms."""

    def __init__(self, terms: Iterable[str]):
        self.listed = {}
        for t in terms:
            self.listed.setdefault(_squeeze(t).casefold(), _squeeze(t))
        # The longest term first: "a, b" before "a".
        forms = sorted(self.listed, key=lambda x: (-len(x), x))
        written = {" ": r"\s+", "&": "(?:&amp;|&)", '"': r'(?:\\"|&quot;|")'}

        def pattern(form: str) -> str:
            return "".join(written.get(c) or ((r"\\?" if c in ",;|/" else "") + re.escape(c)) for c in form)

        self.term = re.compile("|".join(map(pattern, forms)), re.I) if forms else None

    def _term(self, s: str, i: int) -> tuple[str, int] | None:
        """An established term at i that ends where a value may end."""
        if self.term is None:
            return None
        m = self.term.match(s, i)
        if m and self._ends(s, m.end()):
            return self.value(m.group()), m.end()
        return None

    def _ends(self, s: str, i: int) -> bool:
        j = i
        while j < len(s) and s[j].isspace() and s[j] not in "\n\r\t":
            j += 1
        return j == len(s) or DELIMITER.match(s, i) is not None

    def _quoted(self, s: str, i: int, memo: dict) -> tuple[str, int] | None:
        close = QUOTES.get(s[i])
        if close is None:
            return None
        dead = memo.setdefault(close, set())
        out, j, seen = [], i + 1, []
        while j < len(s):
            if out:
                if j in dead:  # from here on no such quote closes
                    break
                seen.append(j)
            c = s[j]
            if c == "\\" and j + 1 < len(s):
                out.append(s[j + 1])
                j += 2
            elif c == close:
                if s[j + 1 : j + 2] == close and not (len(out) == 0 and self._ends(s, j + 1)):
                    out.append(close)
                    j += 2
                elif self._ends(s, j + 1):
                    return self.value("".join(out), False), j + 1
                else:
                    out.append(c)
                    j += 1
            else:
                out.append(c)
                j += 1
        dead.update(seen)
        return None

    def _bracketed(self, s: str, i: int, memo: dict, depth: int) -> tuple[list[str], int] | None:
        close = BRACKETS.get(s[i])
        if close is None or depth >= DEEPEST:
            return None
        if (m := LIST.match(s, i)) and self._ends(s, m.end()):
            try:
                found = json.loads(m.group(), parse_int=str, parse_float=str, parse_constant=str, strict=False)
                return [self.value(str(x), False) for x in found if x is not None], m.end()
            except ValueError:
                pass
        if ("ends", close) not in memo:
            memo["ends", close] = [m.start() for m in re.finditer(re.escape(close), s) if self._ends(s, m.end())]
        ends = memo["ends", close]
        k = bisect.bisect_left(ends, i)
        if k == len(ends):
            return None
        return [v for v, _ in self._sequence(s[i + 1 : ends[k]], depth + 1)], ends[k] + 1

    def _bare(self, s: str, i: int) -> tuple[str, int]:
        out, j = [], i
        while j < len(s):
            if s[j] == "\\" and j + 1 < len(s):
                out.append(s[j + 1])
                j += 2
            elif s[j] == "&" and (m := ENTITY.match(s, j)):
                out.append(html.unescape(m.group()))
                j = m.end()
            elif DELIMITER.match(s, j):
                break
            elif s[j].isspace():  # no delimiter begins within a run of blanks if none begins with it
                m = BLANK.match(s, j)
                out.append(m.group())
                j = m.end()
            else:
                out.append(s[j])
                j += 1
        return self.value("".join(out), False), j

    def value(self, x: str, escapes: bool = True) -> str:
        x = html.unescape(x)
        if escapes:
            x = re.sub(r"\\(.)", r"\1", x)
        x = _squeeze(x)
        return self.listed.get(x.casefold(), x)

    def _sequence(self, s: str, depth: int = 0) -> Iterator[tuple[str, str]]:
        i, memo = 0, {}
        while i < len(s):
            if m := DELIMITER.match(s, i):
                i = max(m.end(), i + 1)
                continue
            if s[i].isspace():
                i = BLANK.match(s, i).end()
                continue
            flag = ""
            if got := self._term(s, i):
                values, i = [got[0]], got[1]
            elif got := self._quoted(s, i, memo):
                values, i = [got[0]], got[1]
            elif got := self._bracketed(s, i, memo, depth):
                values, i = got
            else:
                start = i
                text, i = self._bare(s, i)
                if s[start] in QUOTES or s[start] in BRACKETS:
                    flag = "unclosed"
                    text = self.value(text.lstrip("".join(QUOTES) + "".join(BRACKETS)), False)
                elif text[-1:] in QUOTES.values() and text.casefold() not in self.listed:
                    flag = "unopened"
                    text = self.value(text.rstrip("".join(QUOTES.values())), False)
                values = [text]
            for v in values:
                yield v, flag

    def parse(self, s: str | None) -> list[tuple[int, str, str]]:
        """(position, value, error) from 1 over the values that are not empty."""
        if s is None or _squeeze(html.unescape(s)).casefold() in NOTHING or not s.strip():
            return []
        out, n = [], 0
        for v, flag in self._sequence(s):
            if v and v not in ('""', "''"):
                n += 1
                out.append((n, v, flag))
        if len(out) == 1 and out[0][1].casefold() in NOTHING:
            return []
        return out


def split_packed(df: DataFrame, terms: dict[str, list[str]], key: str, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per value of each of ``fields``: key, field, position (int), value, error.

    Null, blank and "nothing given" fields have no rows.  Repeated values and
    repeated records each keep their rows.  ``error`` is '' or says that a quote
    was 'unclosed' or 'unopened' (the value then starts or ends at the
    delimiter).  Rows are independent: no shuffle, any size of text.  Columns of
    ``df`` other than key and fields are not read.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("field", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = {f: functools.lru_cache(20_000)(PackedGrammar(terms.get(f, [])).parse) for f in fields}
        for b in batches:
            rows = [(k, f, n, v, e) for f in fields for k, s in zip(b[key], b[f]) for n, v, e in parse[f](s if isinstance(s, str) else None)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, *fields).mapInPandas(run, schema)


def value_counts(values: DataFrame) -> DataFrame:
    """How often each value occurs in each field, and in how many records it is first."""
    return values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("position") == 1, 1).otherwise(0)).alias("n_first"))
