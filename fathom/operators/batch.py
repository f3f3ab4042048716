"""Word rankings of many queries over several cuts of a corpus, in two passes over the texts.

The first counts terms, the second scores every text where it is read and hands on
each task's best of each query, so no posting is shuffled. The queries of a block are
known to all workers, some hundred bytes for each distinct text; of more queries than
a block holds there are several blocks, with two passes each.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import index

#: Postings held before they are scored.
HELD = 1_000_000
#: Queries of a block.
BLOCK = 100_000


class Formula(NamedTuple):
    """``index.bm25`` or ``index.weighted_fields``."""

    fields: dict[str, float]
    pattern: str
    k1: float
    b: float
    weighted: bool


BM25 = Formula({"text": 1.0}, "[0-9A-Za-zÅÄÖåäö]+", index.K1, index.B, False)
FIELDS = Formula(index.FIELD_WEIGHTS, r"(?:[^\W_]|[\ue000-\uf8ff])+", index.FIELD_K1, index.FIELD_B, True)
_WORDS = re.compile(BM25.pattern)


def _numbered(queries: DataFrame) -> tuple[list[tuple], dict[str, int], list[tuple]]:
    """(query_id, number) pairs, the terms' numbers, and per number the (term, how often) of the query in its order."""
    terms: dict[str, int] = {}
    lists: dict[tuple, int] = {}
    pairs = []
    for i, text in queries.select("query_id", "query").collect():
        n = Counter(w.lower() for w in _WORDS.findall(text or ""))
        if n:
            asked = tuple((terms.setdefault(w, len(terms)), c) for w, c in n.items())
            pairs.append((i, lists.setdefault(asked, len(lists))))
    return pairs, terms, list(lists)


def _reader(formula: Formula, terms: dict[str, int]):
    """A function of a text's fields: its known terms with their (weighted) frequency, and its length."""
    find, weights = re.compile(formula.pattern).findall, list(formula.fields.values())

    def read(fields: tuple) -> tuple[dict[int, float], int]:
        tf: dict[int, float] = {}
        dl = 0
        for x, weight in zip(fields, weights):
            words = find(x) if isinstance(x, str) else ()
            dl += len(words)
            for w in words:
                n = terms.get(w.lower())
                if n is not None:
                    tf[n] = tf.get(n, 0.0) + weight
        return tf, dl

    return read


class _Best:
    """The best k of each view and query of what a task has seen."""

    def __init__(self, lists: list[tuple], views: dict, formula: Formula, k: int):
        self.lists, self.views, self.formula, self.k = lists, views, formula, k
        self.rows: dict[tuple[int, int], list[tuple]] = {}

    def take(self, part: int, keys: list, docs: list, titles: list[bool], dl: list[int], post: dict[int, tuple[array, array]]) -> None:
        f, titled = self.formula, np.array(titles)
        length, s = np.array(dl, float), np.zeros(len(keys))
        for view, with_titles, n, avgdl, df in self.views[part]:
            norm = f.k1 * (1 - f.b + f.b * length / avgdl)
            parts = {}
            for term, (at, tf) in post.items():
                at, tf = np.frombuffer(at, np.int32), np.frombuffer(tf, float)
                if not with_titles:
                    at, tf = at[keep := ~titled[at]], tf[keep]
                if len(at):
                    odds = (n - df[term] + 0.5) / (df[term] + 0.5)
                    rare = max(math.log(odds), 1e-6) if f.weighted else math.log1p(odds)
                    parts[term] = at, rare * tf * (f.k1 + 1) / (tf + norm[at])
            for q, asked in enumerate(self.lists):
                got = [(pos, *parts[term], 1 if f.weighted else c) for pos, (term, c) in enumerate(asked) if term in parts]
                if got:
                    self._query(view, q, got, s, keys, docs)

    def _query(self, view: int, q: int, got: list[tuple], s: np.ndarray, keys: list, docs: list) -> None:
        for _, at, x, c in got:
            s[at] += c * x
        found = got[0][1] if len(got) == 1 else np.flatnonzero(s)
        score = np.round(s[found], index.SCORE_PLACES)
        s[found] = 0
        old = self.rows.get((view, q), [])
        least = -old[-1][0] if len(old) == self.k else -1.0
        if len(found) > self.k:
            least = max(least, np.partition(score, len(score) - self.k)[len(score) - self.k])
        keep = score >= least
        found, score = found[keep], score[keep]
        if not len(found):
            return
        first = np.zeros(len(found), int)
        if not self.formula.weighted:  # ties go by the first query term found
            for pos, at, _, _ in reversed(got):
                first[at[np.minimum(np.searchsorted(at, found), len(at) - 1)] == found] = pos
        new = [(-float(x), int(p), keys[i], docs[i]) for x, p, i in zip(score, first, found)]
        self.rows[view, q] = sorted(old + new, key=lambda r: r[:3])[: self.k]


def counts(units: DataFrame, terms: dict[str, int], formula: Formula) -> dict[tuple[int, bool], Counter]:
    """Per part and title or not: how many texts have each term, and "n" texts that count, "dl" words, "rows" in all."""
    shared = units.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, out = _reader(formula, shared.value), Counter()
        for b in batches:
            for part, title, *fields in zip(b.part, b.title, *(b[f] for f in formula.fields)):
                tf, dl = read(fields)
                out[part, title, -3] += 1
                if dl or formula.weighted:
                    out[part, title, -1] += 1
                    out[part, title, -2] += dl
                    out.update((part, title, n) for n in tf)
        yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["part", "title", "term", "n"])

    found: dict[tuple[int, bool], Counter] = {}
    names = {-1: "n", -2: "dl", -3: "rows"}
    made = units.select("part", "title", *formula.fields).mapInPandas(run, "part int, title boolean, term int, n long")
    for r in made.groupBy("part", "title", "term").agg(F.sum("n").alias("n")).collect():
        found.setdefault((r.part, r.title), Counter())[names.get(r.term, r.term)] = r.n
    return found


def lists(units: DataFrame, queries: DataFrame, k: int, views: list[tuple[int, int, bool]] | None = None, formula: Formula = BM25) -> tuple[DataFrame, dict[int, int]]:
    """``_lists`` of all queries, in blocks by the hash of their id."""
    blocks = -(-queries.count() // BLOCK)
    if blocks < 2:
        return _lists(units, queries, k, views, formula)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_lists(units, queries.where(block == n), k, views, formula) for n in range(blocks)]
    return reduce(DataFrame.unionByName, (p for p, _ in parts)), parts[0][1]


def _lists(units: DataFrame, queries: DataFrame, k: int, views: list[tuple[int, int, bool]] | None, formula: Formula) -> tuple[DataFrame, dict[int, int]]:
    """view, query_id, key, doc, score, rank: the ``k`` best texts of each query in each view; and how many texts a view has.

    ``units`` has part (int), key, doc, title (boolean, never null) and the formula's
    fields, ``queries`` query_id and query. A view is (number, part, whether titles
    are texts of it); without views there is one of part 0 with titles. Statistics
    are those of the view. Scores and ties are those of ``index``.
    """
    spark = units.sparkSession
    views = views or [(0, 0, True)]
    pairs, terms, asked = _numbered(queries)
    found = counts(units, terms, formula)
    by_part: dict[int, list] = {}
    size = {}
    for view, part, with_titles in views:
        c = sum((found.get((part, x), Counter()) for x in ((False, True) if with_titles else (False,))), Counter())
        size[view] = c["rows"]
        by_part.setdefault(part, []).append((view, with_titles, c["n"], c["dl"] / c["n"] if c["dl"] else 1.0, c))
    shared = spark.sparkContext.broadcast((terms, asked, by_part))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, asked, by_part = shared.value
        read, best = _reader(formula, terms), _Best(asked, by_part, formula, k)
        held: dict[int, tuple] = {}
        n = 0
        for b in batches:
            for part, key, doc, title, *fields in zip(b.part, b.key, b.doc, b.title, *(b[f] for f in formula.fields)):
                if part not in by_part:
                    continue
                tf, dl = read(fields)
                if not tf:
                    continue
                keys, docs, titles, dls, post = held.setdefault(part, ([], [], [], [], {}))
                for term, x in tf.items():
                    at, much = post.get(term) or post.setdefault(term, (array("i"), array("d")))
                    at.append(len(keys))
                    much.append(x)
                keys.append(key)
                docs.append(doc)
                titles.append(title)
                dls.append(dl)
                n += len(tf)
            if n > HELD:
                for part, x in held.items():
                    best.take(part, *x)
                held, n = {}, 0
        for part, x in held.items():
            best.take(part, *x)
        out = []
        for (view, q), rows in best.rows.items():
            out += [(view, q, key, doc, -score, first) for score, first, key, doc in rows]
            if len(out) > 100_000:
                yield pd.DataFrame(out, columns=["view", "_q", "key", "doc", "score", "_first"])
                out = []
        yield pd.DataFrame(out, columns=["view", "_q", "key", "doc", "score", "_first"])

    kind = units.schema["key"].dataType.simpleString()
    # Fewer tasks hand on fewer lists; neighbouring parts of a union stay together.
    few = units.coalesce(2 * spark.sparkContext.defaultParallelism)
    near = few.select("part", "key", "doc", "title", *formula.fields).mapInPandas(run, f"view int, _q int, key {kind}, doc string, score double, _first int")
    rank = F.row_number().over(Window.partitionBy("view", "_q").orderBy(F.desc("score"), "_first", "key"))
    top = near.withColumn("rank", rank).where(F.col("rank") <= k)
    who = spark.createDataFrame(pairs, f"query_id {queries.schema['query_id'].dataType.simpleString()}, _q int")
    return top.join(F.broadcast(who), "_q").select("view", "query_id", "key", "doc", "score", "rank"), size
