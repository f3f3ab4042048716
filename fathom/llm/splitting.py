"""Cutting oversized texts at natural boundaries, with overlap.

The separators form a hierarchy: section, paragraph, sentence, word, character. A
span that is too long is divided at the first level that divides it; parts that
are still too long are divided at the next. What comes out are atoms, which are
packed greedily into pieces of at most ``limit`` code points. A piece after the
first begins with at least ``overlap`` code points of the one before, where they
fit, from the beginning of a word if that fits too.

Lines end at LF, CR, CRLF or form feed; a paragraph is a run of lines with visible
characters, measured from its first to its last visible one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 500, 25
LEVELS = ("section", "paragraph", "sentence", "word", "character")
_BREAK = re.compile(r"\s*[\n\r\f]\s*")
_LINE_END = re.compile(r"\r\n|[\n\r\f]")
_SENTENCE = re.compile(r"[.!?…][\"'”»)\]]*(\s+)")
_WORD = re.compile(r"\s+")
#: After these a full stop ends no sentence.
SHORT = {"t.ex", "bl.a", "dvs", "osv", "kl", "ca", "nr", "s.k", "m.m", "m.fl", "resp", "tel", "avd", "max", "min", "dr", "e.g", "i.e", "etc", "vs", "no", "fig"}
_HEADING = re.compile(r"(?:\d+(?:\.\d+)*[.)]?\s+)?[^\W\d_].{0,98}")


class Piece(NamedTuple):
    start: int  # first code point of the piece, overlap included
    core: int  # first code point that is new: the cut
    end: int  # behind the last code point
    level: str  # what was cut at, '' for the first piece
    before: int  # length of the paragraph that ends before the cut, 0 if the cut is within one
    after: int  # length of the paragraph that begins at it
    joint: int  # from the first visible character of the one to the last of the other


def paragraphs(s: str) -> list[tuple[int, int]]:
    """(first visible, behind the last visible) of each paragraph."""
    lo, hi = len(s) - len(s.lstrip()), len(s.rstrip())
    if lo >= hi:
        return []
    out = []
    for m in _BREAK.finditer(s, lo, hi):
        if len(_LINE_END.findall(m.group())) > 1:
            out.append((lo, m.start()))
            lo = m.end()
    out.append((lo, hi))
    return out


def is_heading(s: str, span: tuple[int, int]) -> bool:
    """A paragraph of one short line without a full stop, as headings have it."""
    lo, hi = span
    if hi - lo > 100 or s[hi - 1] in ".;?!,:" or _LINE_END.search(s, lo, hi):
        return False
    m = _HEADING.fullmatch(s, lo, hi)
    return m is not None and (s[lo].isdigit() or s[lo].isupper())


def _at(s: str, lo: int, hi: int, level: str) -> list[tuple[int, int]]:
    """The parts of a span within one paragraph."""
    cuts = []
    if level == "sentence":
        for m in _SENTENCE.finditer(s, lo, hi):
            word = s[max(lo, m.start() - 8) : m.start()].split()[-1:] or [""]
            if s[m.start()] != "." or word[0].lstrip("(").casefold() not in SHORT:
                cuts.append((m.start(1), m.end()))
    else:
        cuts = [(m.start(), m.end()) for m in _WORD.finditer(s, lo, hi)]
    out = []
    for a, b in cuts:
        if lo < a and b < hi:
            out.append((lo, a))
            lo = b
    return [*out, (lo, hi)]


def _letters(s: str, lo: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
    """A word cut into parts of at most ``most``, before no combining mark if another place can be found."""
    while hi - lo > most:
        at = lo + most
        while at > lo + 1 and (unicodedata.combining(s[at]) or s[at] == "‍" or s[at - 1] == "‍"):
            at -= 1
        at = at if at > lo + 1 else lo + most
        yield lo, at
        lo = at
    yield lo, hi


def _atoms(s: str, lo: int, hi: int, level: int, most: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, level of the cut before it) of the parts of a paragraph or of a part of one."""
    if hi - lo <= most:
        yield lo, hi, LEVELS[level - 1]
        return
    name = LEVELS[level]
    parts = list(_letters(s, lo, hi, most)) if name == "character" else _at(s, lo, hi, name)
    for k, (a, b) in enumerate(parts):
        for j, (x, y, at) in enumerate(_atoms(s, a, b, level + 1, most) if name != "character" else [(a, b, name)]):
            yield x, y, (LEVELS[level - 1] if k == 0 else name) if j == 0 else at


def split(s: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """The pieces of a text in order; none for null and blank texts, one for a text within the limit.

    The new parts of the pieces together hold every visible character once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if not s or not s.strip():
        return []
    if len(s) <= limit:
        return [Piece(0, 0, len(s), "", 0, 0, 0)]
    most = limit - overlap
    blocks = paragraphs(s)
    heads = [is_heading(s, p) for p in blocks]
    atoms: list[tuple[int, int, str, int]] = []  # start, end, level, paragraph
    for n, (lo, hi) in enumerate(blocks):
        for k, (a, b, at) in enumerate(_atoms(s, lo, hi, 2, most)):
            atoms.append((a, b, ("section" if heads[n] else "paragraph") if k == 0 else at, n))

    # Greedy packing: groups of atoms, each from its first to its last visible character.
    groups, first = [], 0
    for i in range(1, len(atoms) + 1):
        room = limit if not groups else most
        if i == len(atoms) or atoms[i][1] - atoms[first][0] > room:
            last = i
            # A heading goes with what it heads, if both fit.
            while i < len(atoms) and last - 1 > first and heads[atoms[last - 1][3]] and atoms[i][3] != atoms[last - 1][3] and atoms[i][1] - atoms[last - 1][0] <= most:
                last -= 1
            groups.append((first, last))
            first = last
            if last < i and i < len(atoms) and atoms[i][1] - atoms[first][0] > most:
                groups.append((first, i))
                first = i
    out: list[Piece] = []
    for g, (a, b) in enumerate(groups):
        core, end, level, n = atoms[a][0], atoms[b - 1][1], atoms[a][2], atoms[a][3]
        following = atoms[b][0] if b < len(atoms) else len(s)
        if not out:
            start, level, before, after, joint = 0 if end <= limit else core, "", 0, 0, 0
        else:
            prior = out[-1]
            start = core
            if overlap:
                at = prior.end - overlap
                word = max(s.rfind(" ", prior.start, at + 1), s.rfind("\n", prior.start, at + 1)) + 1
                if prior.start < word <= at and end - word <= limit and at - word <= overlap:
                    start = word
                else:
                    start = min(core, max(at, prior.start, end - limit))
            begins = core == blocks[n][0]
            before = blocks[n - 1][1] - blocks[n - 1][0] if begins and n else 0
            after = blocks[n][1] - blocks[n][0] if begins else 0
            joint = blocks[n][1] - blocks[n - 1][0] if begins and n else 0
        # Blanks behind a piece belong to it as far as they fit, so that pieces join without a gap.
        out.append(Piece(start, core, min(following, start + limit), level, before, after, joint))
    return out


def split_texts(df: DataFrame, key: str, fields: dict[str, Column], keep: list[str] | None = None, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row per piece: key, field, kept columns, piece (int, from 0), start, cut_at, end, level,
    before, after, joint, and text unless ``with_text`` is false.

    ``fields`` maps a field's name to a column that is null where the row is not
    to be split. ``start`` and ``end`` are code points of the field's text,
    ``cut_at`` is where the part begins that no earlier piece has. Null and blank
    texts have no piece. Rows are independent; a very long text is walked through
    once and its pieces leave the worker in batches.
    """
    keep = keep or []
    kept = [T.StructField(c, df.schema[c].dataType) for c in keep]
    ints = ["piece", "start", "cut_at", "end", "before", "after", "joint"]
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("field", T.StringType()), *kept, *(T.StructField(c, T.IntegerType()) for c in ints), T.StructField("level", T.StringType())]
        + [T.StructField("text", T.StringType())] * with_text
    )
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            of: list[str] = []
            made: list[Piece] = []
            number: list[int] = []
            texts: list[str] = []

            def flush() -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                cols = [b.column(0).take(take), pa.array(of, pa.string()), *(b.column(1 + k).take(take) for k in range(len(keep)))]
                cols += [pa.array(x, pa.int32()) for x in (number, [p.start for p in made], [p.core for p in made], [p.end for p in made], [p.before for p in made], [p.after for p in made], [p.joint for p in made])]
                cols += [pa.array([p.level for p in made], pa.string())] + [pa.array(texts, pa.string())] * with_text
                for x in (rows, of, made, number, texts):
                    x.clear()
                return pa.RecordBatch.from_arrays(cols, names=schema.names)

            for k, name in enumerate(names):
                column = b.column(1 + len(keep) + k)
                for i in range(len(column)):
                    s = column[i].as_py()
                    if s is None:
                        continue
                    for n, p in enumerate(split(s, limit, overlap)):
                        rows.append(i)
                        of.append(name)
                        made.append(p)
                        number.append(n)
                        if with_text:
                            texts.append(s[p.start : p.end])
                    if len(rows) > 20_000:
                        yield flush()
            yield flush()

    some = F.coalesce(*(c.cast("string") for c in fields.values())).isNotNull()
    return df.where(some).select(F.col(key), *keep, *(c.alias(f"_text_{n}") for n, c in enumerate(fields.values()))).mapInArrow(run, schema)


def unavoidable_cuts(pieces: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, field, cut_at: the cuts between two paragraphs that fit a piece each but not one together."""
    most = limit - overlap
    return pieces.where((F.col("piece") > 0) & F.col("before").between(1, most) & F.col("after").between(1, most) & (F.col("joint") > limit)).select(key, "field", "cut_at")
