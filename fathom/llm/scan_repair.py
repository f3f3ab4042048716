"""Repair of text that comes from scanned pages.

Two passes over the chunks. The first counts words, pairs of neighbouring words and
whole lines of the corpus; what is frequent enough (a share of the corpus, so the
lexicon's size has a fixed bound) goes to every worker. In the second each text is
repaired by itself:

* lines that are page furniture are taken out: page numbers, and running headers,
  which repeat over the corpus and break into sentences or carry the document's title;
* words broken at a line end are joined, also over page furniture;
* misread words and numbers are repaired. A symmetric-delete index over the
  lexicon's frequent words gives the candidates within two edits; a weighted edit
  distance that knows which characters scanners take for which prices them; and the
  pairs with the words before and behind say whether one is taken, and which.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, pair or line is kept if it has this share of all words, words or lines: at most 500,000, 500,000 and 2,000 are.
WORD_SHARE, PAIR_SHARE, LINE_SHARE = 2e-6, 2e-6, 5e-4
#: A repair must be this many times as frequent as what was read.
TIMES = 15
#: Share of a line's occurrences that must break into a sentence to make it a running header.
BREAKS = 0.25
#: The index deletes up to so many characters from so long a beginning of each word.
EDITS, BEGINNING = 2, 7
#: The price of a character that is left out, put in or changed in a way that scanners don't.
ODD = 1.0
#: The dearest repair that is taken on its own, for words of so many characters the dearest of what scanners take for
#: each other, and the dearest in a context that is known, by the word's length.
PLAIN, DEAREST, SURE_LENGTH = 0.4, 0.6, 7
DEAREST_IN_CONTEXT = ((9, 2.0), (6, 1.0))
#: Longer words are names of files, chemicals and the like; longer lines are no running header, no page number.
LONGEST_WORD, LONGEST_HEADER, LONGEST_REPEATED, LONGEST_PAGE_NUMBER = 60, 130, 110, 24

# What a scanner reads (first) for what stands there (second), and what it costs.
CONFUSED = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("f", "r"), ("5", "s"), ("S", "s"), ("í", "i"), ("ì", "i"), ("!", "i"), ("|", "l"), ("1", "l"), ("I", "l"), ("l", "I"), ("|", "I"), ("1", "i"),
    ("!", "l"), ("q", "g"), ("9", "g"), ("0", "o"), ("0", "O"), ("6", "ö"), ("6", "b"), ("6", "ó"), ("ô", "ö"), ("o", "ö"), ("ó", "ö"), ("ò", "ö"), ("õ", "ö"), ("à", "ä"), ("a", "ä"), ("â", "ä"), ("ã", "ä"),
    ("á", "å"), ("a", "å"), ("â", "å"), ("à", "å"), ("y", "v"), ("v", "y"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("8", "B"), ("B", "8"), ("D", "O"), ("5", "S"), ("7", "T"), ("é", "e"), ("è", "e"), ("j", "i"), ("i", "j"), ("i", "l"), ("l", "i"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("lc", "k"), ("m", "in"), ("h", "li"), ("vv", "w"), ("ni", "m"), ("nn", "m"), ("li", "h"), ("in", "m"), ("ii", "n"), ("ti", "n"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("lo", "b"), ("cI", "d"), ("ll", "ü"),
]
COST = {p: 0.3 if len(p[0]) == len(p[1]) else 0.4 for p in CONFUSED}
DIGITS = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "T": "7", "B": "8", "g": "9", "q": "9"}
# Words that join a word with an omitted part to the next: "dag- eller nattpersonal".
JOINING = {"och", "eller", "samt", "respektive", "resp", "resp.", "and", "or", "till", "men", "/", "&"}
HYPHENS = "-‐‑\xad¬"
OPEN_OR_END = ".?!;:," + HYPHENS
# Longer ones before shorter ones.
_PAGE = re.compile(
    r"[\s\-–—·•|\[(*~.]*(?:(?:sid(?:a|an|or|nr)?|page|pg|pag|blad|s|p)\b\.?\s*(?:nr\.?\s*)?:?\s*)?"
    r"(?:(?P<n>\d{1,4})|(?P<roman>[ivxlc]{1,7}))"
    r"(?:\s*(?:av|of|/|\|)\s*(?P<of>\d{1,4})|\s*\(\s*(?:av\s*)?(?P<in>\d{1,4})\s*\))?[\s\-–—·•|\])*~.]*",
    re.I,
)
_SAYS_PAGE = re.compile(r"[\s\-–—·•|\[(*~]*(?:sid|page|pg|blad|s\.|p\.)|\d\s*(?:av|of|/)\s*\d|\(\d+\)|[\-–—]\s*\d+\s*[\-–—]|[\[(|·•~*]", re.I)
_WORDS = re.compile(r"[^\W_]+(?:[!|'’\-][^\W_]+)*")
_WORDS_NUM = re.compile(r"#|[^\W_]+(?:[!|'’\-][^\W_]+)*")
_NUMBER = re.compile(r"\b\d+\b")
_HYPHEN_END = re.compile(rf"[{HYPHENS}][ \t\xa0\r]*\n")
_BROKEN = re.compile(rf"[^\W_]+[{HYPHENS}][ \t\xa0\r]*\n\s*[^\W_]+")
_TOKEN = re.compile(r"[^\s.,;:?()\[\]\"”“»«…=+/*–—]+")
_LINES = re.compile(r"[^\n\f]*[\n\f]?")
_JUNK = re.compile(r"\S{41,}")


class Defect(NamedTuple):
    kind: str
    repaired: str


def squeeze(s: str) -> str:
    return " ".join(s.split())


_FOLD = str.maketrans({"c": "e", "f": "t", "r": "t", "5": "s", "í": "i", "!": "i", "|": "i", "1": "i", "l": "i", "j": "i", "q": "g", "9": "g", "0": "o", "6": "o", "ö": "o", "ô": "o", "ä": "a", "å": "a", "à": "a", "á": "a", "â": "a", "y": "v", "h": "b", "u": "n"})


def template(line: str) -> str:
    """A line without what differs from page to page and without what scanners confuse."""
    return _NUMBER.sub("#", squeeze(line).casefold()).translate(_FOLD)


def _ends_open(s: str) -> bool:
    """A long line whose sentence goes on."""
    return len(s) > 30 and (s[-1].isalnum() or s[-1] in "," + HYPHENS)


def _goes_on(s: str) -> bool:
    return len(s) > 15 and s[0].islower() and " " in s


def count_chunks(texts: Iterator[str | None]) -> Counter:
    """("w", word), ("p", pair), ("l", line), ("b", line that breaks into a sentence) of some texts, and the totals ("n", …)."""
    out: Counter = Counter()
    words: Counter = Counter()
    pairs: Counter = Counter()
    for s in texts:
        if not s:
            continue
        plain = (_BROKEN.sub(" ", s) if _HYPHEN_END.search(s) else s).casefold()
        words.update(_WORDS.findall(plain))
        w = _WORDS_NUM.findall(_NUMBER.sub("#", plain))
        pairs.update(zip(w, w[1:]))
        lines = [x.strip() for x in s.replace("\f", "\n").split("\n")]
        full = [x for x in lines if x]
        out["n", "line"] += max(0, len(full) - 2)
        for a, x, b in zip(full, full[1:], full[2:]):
            if len(x) < LONGEST_REPEATED and x[-1] not in OPEN_OR_END and not x[0].islower():
                t = template(x)
                out["l", t] += 1
                out["b", t] += _ends_open(a) or _goes_on(b)
    out["n", "word"] = sum(words.values())
    out.update({("w", k): n for k, n in words.items()})
    out.update({("p", f"{a} {b}"): n for (a, b), n in pairs.items()})
    return out


def corpus_counts(df: DataFrame, text: str) -> DataFrame:
    """kind, key, n: what ``count_chunks`` counts, over all rows. Counted in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(k, x, n) for (k, x), n in total.items()], columns=["kind", "key", "n"])
            total.clear()
            return rows

        for b in batches:
            total.update(count_chunks(b[text]))
            if len(total) > 600_000:
                yield out()
        yield out()

    return df.select(text).mapInPandas(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def deletions(word: str) -> set[str]:
    """The beginning of a word without up to ``EDITS`` of its characters: words within so many edits have one in common."""
    found = {word[:BEGINNING]}
    last = found
    for _ in range(EDITS):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return found


@lru_cache(200_000)
def _change(read: str, true: str) -> float:
    """The price of some characters for others; letter case doesn't matter where the pair is not told otherwise."""
    low = read.casefold()
    if low == true:
        return 0.0
    return min(COST.get((read, true), 9), COST.get((read, true.upper()), 9), COST.get((low, true), 9), ODD if len(read) == len(true) == 1 else 9)


def distance(token: str, word: str, limit: float) -> float:
    """The weighted edit distance of what was read to a word in small letters: pairs of ``CONFUSED`` at their price,
    any other change, omission or addition at ``ODD``. More than ``limit`` comes as 9."""
    m, n = len(token), len(word)
    before = [None] * m
    rows = [[j * ODD for j in range(n + 1)]]
    for i in range(1, m + 1):
        row = [i * ODD] + [9.0] * n
        for j in range(max(1, i - EDITS), min(n, i + EDITS) + 1):
            best = min(rows[i - 1][j - 1] + _change(token[i - 1], word[j - 1]), rows[i - 1][j] + ODD, row[j - 1] + ODD)
            for x, y in ((1, 2), (2, 1), (2, 2)):
                if i >= x and j >= y and rows[i - x][j - y] < best:
                    best = min(best, rows[i - x][j - y] + _change(token[i - x : i], word[j - y : j]))
            row[j] = best
        if min(row) > limit and (i == 1 or before[i - 2] is None or before[i - 2] > limit):
            return 9.0
        before[i - 1] = min(row)
        rows.append(row)
    return rows[m][n] if rows[m][n] <= limit + 1e-9 else 9.0


class Lexicon:
    """What the workers know of the corpus, and the symmetric-delete index over its frequent words."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], headers: set[str], total: int):
        self.words, self.pairs, self.headers, self.total = words, pairs, headers, total
        #: A word that isn't known occurs less often than this.
        self.least = max(1, math.ceil(total * WORD_SHARE))
        #: A misread word may come this often between the same neighbours, as sentences are repeated.
        self.repeated = 3 * max(2, math.ceil(total * PAIR_SHARE))
        self.index: dict[str, list[str]] = {}
        for w, n in words.items():
            if n >= self.need(None) and len(w) > 1 and not w[0].isdigit():
                for k in deletions(w):
                    self.index.setdefault(k, []).append(w)
        self.known: dict[str, tuple[tuple[float, str], ...]] = {}
        #: Forms so frequent that they stand as they are; codes that could be misread numbers aren't among them.
        often = max(TIMES * self.least * 3, TIMES * 3)
        self.common = {form for w, n in words.items() if n >= often and not (w[0].isdigit() and self.as_digits(w.upper())) for form in (w, w.capitalize(), w.upper())}

    @staticmethod
    def as_digits(token: str) -> str | None:
        new = "".join(DIGITS.get(c, c) for c in token)
        return new if new.isdigit() else None

    def need(self, word: str | None) -> int:
        """How often a repair of a word must occur in the corpus."""
        n = max(self.words.get(word, 0) if word else 0, self.least - 1 if self.least > 1 else 1)
        return 3 + TIMES * (n - 1) if n < 10 else TIMES * n

    def candidates(self, token: str) -> tuple[tuple[float, str], ...]:
        """(cost, repair) for a token that isn't frequent, cheapest first; letter case is kept."""
        got = self.known.get(token)
        if got is None:
            got = self._candidates(token)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = got
        return got

    def _candidates(self, token: str) -> tuple[tuple[float, str], ...]:
        low = token.casefold()
        if len(low) != len(token):
            token = low
        need, size = self.need(low), len(low)
        limit = next((x for n, x in DEAREST_IN_CONTEXT if size >= n), DEAREST)
        words = {w for k in deletions(low) for w in self.index.get(k, ()) if abs(len(w) - size) <= EDITS and w != low}
        found: dict[str, float] = {}
        for w in words:
            if self.words[w] < need:
                continue
            # What both begin and end with is no part of the difference.
            short, a, b = min(size, len(w)), 0, 0
            while a < short and low[a] == w[a]:
                a += 1
            while b < short - a and low[-1 - b] == w[-1 - b]:
                b += 1
            read, true = token[a : size - b], w[a : len(w) - b]
            if len(read) - len(true) > 4 or len(read) + len(true) > 24:
                continue
            # A word's first and last character stand: other endings are other forms of a word, not misread ones.
            cost = _change(read, true) if len(read) <= 2 and len(true) <= 2 and read and true else 9
            if cost >= ODD:
                inside = a > 0 and b > 0 and size >= DEAREST_IN_CONTEXT[-1][0]
                cost = distance(read, true, limit if inside else DEAREST)
            if cost <= limit:
                mine = "".join(c.upper() if self._upper(token, a + k) else c for k, c in enumerate(true))
                new = token[:a] + mine + token[size - b :]
                found[new] = min(cost, found.get(new, 9))
        return tuple(sorted((c, w) for w, c in found.items()))

    @staticmethod
    def _upper(token: str, at: int) -> bool:
        """Whether a character put in there is a capital."""
        rest = token[:at] + token[at + 1 :]
        if at == 0:
            return token[0].isupper() and rest.islower() or rest.isupper()
        return rest.isupper() and len(rest) > 1

    def pair(self, a: str, b: str) -> int:
        one = lambda x: "#" if x.isdigit() else x.casefold()
        return self.pairs.get(f"{one(a)} {one(b)}", 0)

    def context(self, before: str, token: str, after: str) -> int:
        return self.pair(before, token) + self.pair(token, after)

    def repair(self, token: str, before: str, after: str) -> str | None:
        """What a token should read, or None if it stands.

        A cheap repair is taken unless the token itself is better known between its
        neighbours; a dearer one only if it is known there and the token is not.
        Among several the neighbours choose, then the price.
        """
        got = self.candidates(token)
        if not got:
            return None
        own = self.context(before, token, after)
        cheap, dear = [], []
        for cost, new in got:
            known = self.context(before, new, after)
            if cost <= PLAIN or cost <= DEAREST and len(token) >= SURE_LENGTH:
                if known >= own or own < self.repeated:
                    cheap.append((known, -cost, self.words.get(new.casefold(), 0), new))
            elif known > TIMES * own:
                dear.append((-cost, known, self.words.get(new.casefold(), 0), new))
        best = cheap or dear
        return max(best)[-1] if best else None

    def number(self, token: str, before: str, after: str) -> str | None:
        """A number with letters read for digits, where numbers stand."""
        new = self.as_digits(token)
        if not new or token.isdigit() or not any(c.isdigit() for c in token) and len(token) > 1 and self.words.get(token.casefold(), 0) >= self.need(None):
            return None
        if new.startswith("0") and len(new) > 1:
            return None
        seen = self.pair(before, token) + self.pair(token, after)
        as_number = min(self.pair(before, "1"), 10**9) + self.pair("1", after)
        if not any(c.isdigit() for c in token) and (len(token) > 2 or not (self.pair(before, "1") > 50 * max(1, self.pair(before, token)) and self.pair("1", after) > 50 * max(1, self.pair(token, after)))):
            return None
        low = token.casefold()
        if self.words.get(low, 0) >= TIMES * 3 * self.least:  # a code that is itself frequent
            return new if self.pair("1", after) > 50 * max(1, self.pair(token, after)) and self.pair(before, token) == 0 and self.pair(before, "1") else None
        return new if as_number > TIMES * seen else None


def _similar(a: str, b: str) -> bool:
    """The same word but for what a scanner confuses."""
    if a == b:
        return True
    x, y = a.translate(_FOLD), b.translate(_FOLD)
    if x == y:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 2


@lru_cache(20_000)
def _title_words(title: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", title.casefold()))


def carries_title(line: str, title: str | None) -> bool:
    """Whether a line is little more than the document's title."""
    want = _title_words(title) if title else ()
    if not want:
        return False
    low = line.casefold()
    if not any(w in low for w in want if len(w) > 3 or len(want) < 3):
        return False
    have = re.findall(r"[^\W_]+(?:[!|][^\W_]+)*", low)
    if len(have) < len(want) or len(have) > len(want) + 7:
        return False
    hits, k = 0, 0
    for w in want:
        for j in range(k, min(len(have), k + 8)):
            if _similar(have[j], w):
                hits, k = hits + 1, j + 1
                break
    if len(want) < 3:
        return hits == len(want) and (len(have) <= len(want) + 6 if len(want) == 2 else len(have) == 1 or "  " in line or "|" in line)
    return hits >= len(want) - (len(want) > 3) and hits >= 2


def _page(line: str) -> bool:
    m = _PAGE.fullmatch(line)
    if not m:
        return False
    if m["roman"]:
        return re.search(r"sid|page|[\-–—|\[(]", line, re.I) is not None and re.fullmatch(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", m["roman"], re.I) is not None
    if (n := m["of"] or m["in"]) and int(n) < int(m["n"]):
        return False
    return not (line[-1:] == "." and not _SAYS_PAGE.match(line))


class Line(NamedTuple):
    start: int
    end: int
    text: str  # trimmed
    kind: str  # '', 'blank', 'heading', 'header', 'page_number'


def read_lines(s: str, title: str | None, heading: str | None, whole: bool, lex: Lexicon) -> list[Line]:
    """The lines of a text and what each is. A text may open with its heading, a whole document also with its title."""
    raw = [(m.start(), m.end(), m.group().strip()) for m in _LINES.finditer(s) if m.group()]
    full = [k for k, x in enumerate(raw) if x[2]]
    kinds = ["blank" if not x[2] else "" for x in raw]
    place = {k: n for n, k in enumerate(full)}
    opening = {squeeze(x).casefold() for x in (title if whole else None, heading) if x}
    for k in full:
        x = raw[k][2]
        if len(x) > LONGEST_HEADER:
            continue
        n = place[k]
        prior = raw[full[n - 1]][2] if n else ""
        later = raw[full[n + 1]][2] if n + 1 < len(full) else ""
        if n == 0 and squeeze(x).casefold() in opening and (k + 1 >= len(raw) or not raw[k + 1][2]):
            kinds[k] = "heading"
        elif len(x) <= LONGEST_PAGE_NUMBER and _page(x):
            kinds[k] = "page_number"
            if x.isdigit() and (n == 0 or n + 1 == len(full)) and len(full) > 1:
                # A bare number where the chunk was cut may be the end or the beginning of a line of text.
                if n == 0 and _goes_on(later) and lex.pair("1", (_TOKEN.findall(later) or [""])[0]) > 0:
                    kinds[k] = ""
                if n > 0 and n + 1 == len(full) and _ends_open(prior) and prior[-1] not in HYPHENS and lex.pair((_TOKEN.findall(prior) or [""])[-1], "1") > 0:
                    kinds[k] = ""
        elif x[-1] in HYPHENS and x[-2:-1].isalnum() or x[0].islower() or (x[-1] in ".?!;," and not (title and title.strip()[-1:] == x[-1])):
            continue
        elif carries_title(x, title) or template(x) in lex.headers:
            kinds[k] = "header"
    return [Line(a, b, t, kind) for (a, b, t), kind in zip(raw, kinds)]


def _word_at(text: str, last: bool) -> str:
    m = re.search(rf"[^\W_]+(?:[{HYPHENS}!|'’][^\W_]+)*[{HYPHENS}]?\Z" if last else r"\A[^\W_]+(?:[!|'’\-][^\W_]+)*", text)
    return m.group() if m else ""


def join_word(left: str, right: str, lex: Lexicon) -> str | None:
    """The whole word of two parts at a line end, None if the hyphen stands for an omitted part.

    ``left`` ends with its hyphen. A hyphen that belongs to the word stays; which
    it is the lexicon says.
    """
    stem = left[:-1]
    if not stem or not right or right.casefold() in JOINING:
        return None
    joined, kept = stem + right, stem + "-" + right
    if left[-1] in "\xad¬":
        return joined
    n, m = lex.words.get(joined.casefold(), 0), lex.words.get(kept.casefold(), 0)
    if m > n:
        return kept
    if n == 0 and m == 0:
        if right[0].isupper() and not stem.isupper() or stem.isupper() or stem[-1:].isdigit() or right[0].isdigit():
            return kept
        # A misread character in one of the parts.
        for w in (joined, kept):
            got = lex.candidates(w)
            if got and got[0][0] <= DEAREST:
                return got[0][1]
    return joined


def repair(s: str | None, title: str | None, heading: str | None, whole: bool, lex: Lexicon, rebuild: bool = False) -> tuple[list[Defect], str | None]:
    """The defects of a text and, if asked for, the text in continuous paragraphs.

    A text without defects and without hard line ends comes back as it is; so do
    tables and headings. Null stays null.
    """
    if not s or not s.strip():
        return [], s
    if not rebuild and "\n" not in s.strip() and "\f" not in s and all(w in lex.common or w.isdigit() for w in _TOKEN.findall(s)):
        return [], None
    lines = read_lines(s, title, heading, whole, lex)
    found = [Defect(x.kind, squeeze(x.text)) for x in lines if x.kind in ("header", "page_number")]
    body = [k for k, x in enumerate(lines) if x.kind == ""]
    skip_first: set[int] = set()  # lines whose first word belongs to the line before
    joined: dict[int, tuple[str, str, str]] = {}  # line -> (left part, right part, whole)
    for n, k in enumerate(body[:-1]):
        t = lines[k].text
        if t[-1] in HYPHENS and len(t) > 1 and (t[-2].isalnum()):
            nxt = body[n + 1]
            if any(lines[j].kind == "blank" for j in range(k + 1, nxt)) and not any(lines[j].kind in ("header", "page_number") for j in range(k + 1, nxt)):
                continue
            left, right = _word_at(t, True), _word_at(lines[nxt].text, False)
            whole = join_word(left, right, lex)
            if whole:
                found.append(Defect("hyphen", whole))
                joined[k] = (left, right, whole)
                skip_first.add(nxt)
    fixes: dict[int, list[tuple[int, int, str]]] = {}
    least, count, common = lex.need(None), lex.words.get, lex.common
    carried = ""
    for place, k in enumerate(body):
        t = lines[k].text
        junk = [m.span() for m in _JUNK.finditer(t)] if len(t) > 40 else []  # strings of code, not running text
        plain = _TOKEN.findall(t)
        if all(w in common or w.isdigit() for w in plain):
            carried = plain[-1] if plain else carried
            continue
        got = list(_TOKEN.finditer(t))
        lo = 1 if k in skip_first else 0
        hi = len(got) - 1 if k in joined else len(got)
        for i in range(lo, hi):
            w = got[i].group()
            if any(a <= got[i].start() < b for a, b in junk):
                continue
            if w in common or w.isdigit() or len(w) > LONGEST_WORD or w[-1] in HYPHENS or w[0] in HYPHENS and len(w) < 3:
                continue
            before = got[i - 1].group() if i else carried
            if i + 1 < len(got):
                after = got[i + 1].group()
                gap = t[got[i].end() : got[i + 1].start()]
            else:
                after, gap = "", ""
                if place + 1 < len(body):
                    m = _TOKEN.search(lines[body[place + 1]].text)
                    after = m.group() if m else ""
            core = w.rstrip("'’!")
            new = None
            if any(c.isdigit() for c in w) or w in DIGITS or len(w) <= 3 and all(c in DIGITS for c in w):
                if not (gap[:1] == ":" or (got[i].start() and t[got[i].start() - 1] in "-/+=") or got[i].end() < len(t) and t[got[i].end()] in "+="):
                    new = lex.number(w, before, after)
            if new is None:
                new = lex.repair(w, before, after)
                if new is None and core != w and len(core) > 1 and count(core.casefold(), 0) < least:
                    new = lex.repair(core, before, after)
                    w = core if new else w
            if new and new != w:
                # In a text with decimals the whole number counts: "l7,5".
                a, b = got[i].start(), got[i].start() + len(w)
                lead, tail = "", ""
                if new.isdigit():
                    m = re.match(r"[.,:]\d+", t[b:])
                    tail = m.group() if m else ""
                    m = re.search(r"\d+[.,:]\Z", t[:a])
                    lead = m.group() if m else ""
                found.append(Defect("misread", lead + new + tail))
                fixes.setdefault(k, []).append((a, b, new))
        if got:
            carried = got[-1].group()
    if not rebuild:
        return found, None
    return found, _rebuild(s, lines, joined, skip_first, fixes)


def _rebuild(s: str, lines: list[Line], joined: dict[int, tuple[str, str, str]], skip_first: set[int], fixes: dict[int, list[tuple[int, int, str]]]) -> str:
    body = [k for k, x in enumerate(lines) if x.kind == ""]
    wrapped = [k for n, k in enumerate(body[:-1]) if (_ends_open(lines[k].text) or k in joined) and (_goes_on(lines[body[n + 1]].text) or body[n + 1] in skip_first)]
    furniture = any(x.kind in ("header", "page_number") for x in lines)
    if not (furniture or joined or wrapped):
        if not fixes:
            return s
        out = []
        for k, x in enumerate(lines):
            raw = s[x.start : x.end]
            at = raw.find(x.text) if x.text else 0
            t = x.text
            for a, b, new in reversed(fixes.get(k, [])):
                t = t[:a] + new + t[b:]
            out.append(raw[:at] + t + raw[at + len(x.text) :])
        return "".join(out)
    paragraphs: list[str] = []
    now, open_, gap = "", False, True
    rest = ""
    for k, x in enumerate(lines):
        if x.kind in ("header", "page_number"):
            continue
        if x.kind == "blank":
            # A blank line beside page furniture within a sentence is part of the page break.
            gap = True
            continue
        t = x.text
        for a, b, new in reversed(fixes.get(k, [])):
            t = t[:a] + new + t[b:]
        if k in skip_first and rest:
            m = re.match(r"[^\W_]+(?:[!|'’\-][^\W_]+)*", t)
            t = rest + (t[m.end() :] if m else t)
        rest = ""
        if k in joined:
            left, _, whole = joined[k]
            t = t[: len(t) - len(left)]
            rest = whole
        continues = bool(now) and x.kind != "heading" and (k in skip_first or not gap or (open_ and x.text[:1].islower()))
        if continues and not gap and not (open_ or k in skip_first or len(now.split("\n")[-1]) > 45):
            now = f"{now}\n{t.strip()}"  # a short line stands by itself: a list or a table
        elif continues:
            now = f"{now} {t.strip()}".strip()
        else:
            if now:
                paragraphs.append(now)
            now = t.strip()
        if rest:
            now = now.rstrip()
        open_, gap = _ends_open(x.text) or k in joined, x.kind == "heading"
    if rest:
        now = f"{now} {rest}".strip()
    if now:
        paragraphs.append(now)
    return "\n\n".join(re.sub(r" {2,}", " ", p) for p in paragraphs)


def build_lexicon(df: DataFrame, text: str) -> Lexicon:
    """Counts all distinct texts and collects what has its share of them; the shares bound what comes to the driver.

    Copies of a text say nothing new: with them a misread form could be as frequent as a word.
    """
    counts = corpus_counts(df.select(text).distinct(), text).persist()
    try:
        totals = {r.key: r.n for r in counts.where("kind = 'n'").collect()}
        words, lines = totals.get("word", 0), totals.get("line", 0)
        least = {"w": max(1, math.ceil(words * WORD_SHARE)), "p": max(2, math.ceil(words * PAIR_SHARE)), "l": max(5, math.ceil(lines * LINE_SHARE))}
        keep = " or ".join(f"(kind = '{k}' and n >= {n})" for k, n in least.items())
        got = counts.where(f"{keep} or (kind = 'b' and n >= {least['l'] * BREAKS})").toPandas()
    finally:
        counts.unpersist()
    part = {k: dict(zip(g.key, g.n.astype(int))) for k, g in got.groupby("kind")}
    breaks = part.get("b", {})
    headers = {t for t, n in part.get("l", {}).items() if breaks.get(t, 0) >= BREAKS * n and re.search(r"[^\W\d_]{3}", t)}
    return Lexicon(part.get("w", {}), part.get("p", {}), headers, words)


_LEXICONS: dict[str, Lexicon] = {}


def _shared(df: DataFrame, text: str):
    """The lexicon's tables as a broadcast; a worker builds the index once."""
    lex = build_lexicon(df, text)
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, lex.words, lex.pairs, lex.headers, lex.total))


def _get(shared) -> Lexicon:
    key, *tables = shared.value
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(*tables)
    return _LEXICONS[key]


@lru_cache(20_000)
def _title(metadata: str | None) -> str | None:
    try:
        got = json.loads(metadata or "{}")
    except ValueError:
        return None
    t = got.get("title") if isinstance(got, dict) else None
    return t if isinstance(t, str) and t.strip() else None


#: Chunks that hold running text; titles and headings by themselves are no running text.
RUNNING = ("section", "document")


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def find_defects(chunks: DataFrame, fields: tuple[str, ...] = ("text", "preview_text")) -> DataFrame:
    """chunk_id, field, kind, repaired: one row per defect (a defect that occurs twice in a text has two rows).

    Null and blank texts have none. Titles come from ``metadata_json``; where it is
    null or no JSON, headers are known by repetition alone.
    """
    running = chunks.where(F.col("chunk_type").isin(*RUNNING))
    shared = _shared(running, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _get(shared)
        for b in batches:
            rows = []
            for i, kind, meta, head, *texts in zip(b.chunk_id, b.chunk_type, b.metadata_json, b.section_heading, *(b[f] for f in fields)):
                title = _title(_text(meta))
                for f, s in zip(fields, texts):
                    for d in repair(_text(s), title, _text(head), kind == "document", lex)[0]:
                        rows.append((i, f, d.kind, d.repaired))
            yield pd.DataFrame(rows, columns=["chunk_id", "field", "kind", "repaired"])

    schema = T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), *(T.StructField(c, T.StringType()) for c in ("field", "kind", "repaired"))])
    return running.select("chunk_id", "chunk_type", "metadata_json", "section_heading", *fields).mapInPandas(run, schema)


def repair_chunks(chunks: DataFrame, fields: tuple[str, ...] = ("text", "preview_text")) -> DataFrame:
    """chunk_id and the fields, repaired; rows that hold no running text come back as they are."""
    shared = _shared(chunks.where(F.col("chunk_type").isin(*RUNNING)), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _get(shared)
        for b in batches:
            out = {f: [] for f in fields}
            for kind, meta, head, *texts in zip(b.chunk_type, b.metadata_json, b.section_heading, *(b[f] for f in fields)):
                for f, s in zip(fields, texts):
                    s = _text(s)
                    out[f].append(repair(s, _title(_text(meta)), _text(head), kind == "document", lex, True)[1] if kind in RUNNING else s)
            yield pd.DataFrame({"chunk_id": b.chunk_id, **out})

    schema = T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), *(T.StructField(f, T.StringType()) for f in fields)])
    return chunks.select("chunk_id", "chunk_type", "metadata_json", "section_heading", *fields).mapInPandas(run, schema)
