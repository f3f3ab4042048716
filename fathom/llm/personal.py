"""Personal information in free text: found, typed, and replaced by linked pseudonyms.

Items are found kind by kind, the strictest first; what one kind has taken no
later kind may overlap. Numbers are validated (check digit and date, number of
digits), so that article numbers, versions and codes are left alone.

Names need no list of family names: a word with a capital that follows a given name,
a title or a word that announces a person belongs to the name unless it is a common
word. Which words are common, and which are family names also where they stand alone
or before the given name, the corpus says (``learn``): how often a word is written
small in running text, and how often it follows a given name, an initial or a title.

``mask`` puts a typed placeholder in place of each item, and ``find_items`` gives the
same items with their placeholders. Within it, numbers and
dates stay numbers and dates: they are permuted with a keyed Feistel network
inside their own format (a valid identity number becomes another valid one), so
equal values are equal in every document, however they were written, and nothing
can be turned back without the key. Other kinds get a keyed code.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Given names, endings of family names, words that announce a person,
# words that are no names, and endings of street names.
GIVEN = set(
    """anna eva maria karin kristina lena sara kerstin ingrid emma malin jenny hanna linda susanne elin monica johanna
    marie ulla birgitta gunilla annika helena ida camilla katarina lisa julia sofia inger margareta anneli siv maj
    britt linnéa linnea ebba milla tove ylva aurora yusra zahra samira ingegerd alva agnes alice astrid elsa ellen
    fatima greta gunnel irene josefin klara lovisa maja matilda moa nora olivia pia rebecka saga signe stina tuva vera
    wilma åsa lars mikael anders johan erik per karl peter jan thomas daniel fredrik andreas hans bo mats marcus mattias
    magnus bengt jonas niklas martin björn bjorn leif ulf sven alexander nils oskar oscar viktor victor emil simon david
    filip robert stefan joakim göran håkan kjell rolf torbjörn sixten hjalmar eskil vidar darian åke pär olof gustav axel
    albin anton arvid august elias elis gösta hugo ivar jakob kalle kent knut lennart liam linus ludvig melker noah ola
    olle otto ragnar rasmus roger samuel sebastian tage tobias tomas tor urban valter vilgot yngve zlatan ahmed ali hassan
    mohammed omar amir leila amina john mary james emily sarah michael""".split()
)
ENDINGS = "sson sdotter ström qvist kvist lund berg gren dahl mark löf löv stedt hagen holm blad borg felt feldt crantz hielm".split()
# Only these can be told from common words when the name is not written with a capital or stands alone.
RARE_ENDINGS = tuple("sson sdotter qvist".split())
# Common words with such an ending.
NO_FAMILY = {"brorsdotter", "sonsdotter", "dotterdotter"}
ANNOUNCE = (
    "fråga fragade frågade syster broder dr doktor doc heter hälsningar hälsning mvh vänligen kram med av by from till hos "
    "ask nurse doctor mr mrs ms sister called name is av: från hej hi dear undertecknad kontakta ring prof överläkare läkare sjuksköterska kollegan kollega"
).split()
_ANNOUNCED = frozenset(ANNOUNCE)
NOT_NAMES = set(
    """anonym anonymous läkare sjuksköterska undersköterska student test testperson admin enhet avdelning avd mottagning sektion
    okänd ingen saknas n/a na null none chef enhetschef vårdadministratör användare gäst demo support personal jour""".split()
)
# Words that a person's name follows, be it one that nobody knows: alone, or only two names together.
INTRODUCE = set("dr doktor doctor prof syster heter undertecknad mvh hälsningar mr mrs ms".split())
ADDRESS = set("kontakta ring fråga frågade fragade ask called kollegan kollega sister nurse".split())
# Words behind a name that make it that of a disease, scale, place or unit, and words of the names of units.
NO_PERSON = set("sjukdom syndrom syndromet skala skalan scale index score test testet metod klassifikation disease syndrome kommun sjukhus sjukhuset mottagning mottagningen avdelning avdelningen kliniken".split())
UNITS = set("region regionen sjukhus sjukhuset klinik kliniken mottagning mottagningen enheten avdelningen centrum universitetssjukhuset universitet kommun akuten akutmottagningen vårdcentralen vårdcentral primärvården".split())
STREETS = "gatan vägen stigen gränd backen torget allén gata väg stig torg plan esplanaden kajen liden slingan brinken gången".split()

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_EMAIL = re.compile(
    rf"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*"
    r"(?:\s?@\s?|\s?＠\s?|\s?[(\[{]\s?(?:at|a|snabel-?a)\s?[)\]}]\s?|\s(?:snabel-?a|at)\s(?=[\w-]+\s(?:punkt|dot|prick)\s))"
    r"[\w-]+(?:(?:\.|\s?[(\[{]\s?(?:punkt|dot|prick|\.)\s?[)\]}]\s?|\s(?:punkt|dot|prick)\s)[\w-]+)+",
    re.I,
)
_ID = re.compile(r"(?<![\w+.,/-])(?<!\d[ \xa0])(?:(18|19|20)\s?)?(\d{2})(\d{2})(\d{2})\s?([-–‐‑+−]?)\s?(\d{3})(\d)(?![\w/-]|[.,]\d|\s\d{2,})")
_PHONE = re.compile(r"(?<![\w.,/+-])(?<!\w[-–])(?:(?:\+|00)\s?\d{2}[\s\-–/]*(?:\(0\)[\s\-–/]*)?[1-9]\d{0,2}|\(0\d{1,3}\)|0[1-9]\d{0,2})(?:[\s\-–/]*\d){5,9}(?![\w/]|[-–.,]\d)")
_STREET = re.compile(
    rf"(?<![\w-])(?:(?:[SNÖV](?:östra|orra|ödra|ästra)|Stora|Lilla|Gamla|Nya)\s)?(?:[{_L}-]+?(?:{'|'.join(STREETS)})|[A-ZÅÄÖ][{_L}-]+s\s(?:{'|'.join(STREETS)}))"
    rf"\s\d{{1,3}}(?:\s?[A-Ha-h](?![\w]))?(?:,?\s(?:lgh|lägenhet|apt)\.?\s?\d{{1,4}})?(?:,?\s(?:SE?-)?\d{{3}}\s?\d{{2}}(?:\s[{_L}-]+)?)?(?![\d{_L}])",
    re.I,
)
# Cheap tests that most texts fail.
_MAYBE_EMAIL = re.compile(r"[@＠]|[(\[{]\s?(?:at|a|snabel)|\s(?:punkt|dot|prick)\s", re.I)
_MAYBE_NUMBER = re.compile(r"\d(?:[^\w\n]{0,4}\d){7}")
_MAYBE_STREET = re.compile(rf"(?:{'|'.join(STREETS)})\s\d", re.I)
_DATE_LIKE = re.compile(r"\d{6}\s?[-–+ ]\s?\d{4}")
_WORD = re.compile(rf"(?<![\w@])[{_L}]+(?:-[{_L}]+)*\.?")
_INITIAL = re.compile(r"[A-ZÅÄÖa-zåäö](?:-[A-ZÅÄÖ])?\.")
_GAP = re.compile(r"[ \t\xa0]{1,2}")
_BESIDE = re.compile(r",?[ \t\xa0]{1,2}")


#: What ``learn`` keeps of the words: at most as many as this share of all words allows, 200,000.
WORD_SHARE = 5e-6
#: A word is common if it is written small at least so often, and more often than it follows a given name or title, or if
#: it stands in running text so often and follows them in less than this share of its places.
SMALL, STANDS, ELSEWHERE = 3, 10, 0.05
#: It is a family name if it follows them at least so often, in at least this share of its places, and is hardly ever written small.
FOLLOWS, BEHIND, HARDLY = 2, 0.3, 0.05
#: Two-digit years after this one are of the century before.
LATEST_YEAR = 2029


class Known(NamedTuple):
    """What the corpus says of words, in small letters."""

    family: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()


class Item(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _identity(m: re.Match) -> str | None:
    """Twelve digits of a valid personal or coordination number (60 added to the day).

    Ten digits without a sign that begin with 0 are a phone number.
    """
    century, yy, mm, dd, sign, serial, check = m.groups()
    if m.group().isdigit() and not century and yy[0] == "0":
        return None
    day = int(dd) - 60 * (int(dd) > 60)
    if not luhn(yy + mm + dd + serial + check):
        return None
    year = int((century or "19") + yy)
    if not century:
        year = LATEST_YEAR - (LATEST_YEAR - int(yy)) % 100
        year -= 100 * (sign == "+")
    try:
        datetime.date(year, int(mm), day)
    except ValueError:
        return None
    return f"{year:04d}{mm}{dd}{serial}{check}"


def _national(value: str) -> str:
    """Digits of a phone number as dialled within the country, or with its code if that is another."""
    plus = value.lstrip("( ").startswith(("+", "00"))
    digits = re.sub(r"\D", "", re.sub(r"\(0\)", "", value) if plus else value)
    if plus:
        digits = digits.removeprefix("00")
        return "0" + digits[2:].lstrip("0") if digits.startswith("46") else "+" + digits
    return digits


def _phone(m: re.Match) -> bool:
    n = _national(m.group())
    # An identity number with a wrong check digit is no phone number.
    if "\n" in m.group() or re.search(r"\s{2,}", m.group()) or _DATE_LIKE.fullmatch(m.group()):
        return False
    return 8 <= len(n) <= 11 and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", m.group())


@functools.lru_cache(50_000)
def _bare(w: str) -> str:
    return unicodedata.normalize("NFC", w).rstrip(".").casefold()


@functools.lru_cache(50_000)
def _is_given(w: str) -> bool:
    return all(p in GIVEN for p in _bare(w).split("-")) and not w.endswith(".")


@functools.lru_cache(50_000)
def _has_ending(w: str, rare: bool = False) -> bool:
    ends = RARE_ENDINGS if rare else tuple(ENDINGS)
    parts = _bare(w).split("-")
    return bool(ends) and all(len(p) > 4 and p.endswith(ends) and p not in NO_FAMILY for p in parts)


class Traits(NamedTuple):
    """What can be said of a word by itself."""

    bare: str
    parts: tuple[str, ...]
    given: bool  # a given name, also with a full stop behind
    ending: bool
    rare: bool
    initial: bool


@functools.lru_cache(100_000)
def _traits(w: str) -> Traits:
    bare = _bare(w)
    return Traits(bare, tuple(bare.split("-")), _is_given(w.rstrip(".")), _has_ending(w), _has_ending(w, True), _INITIAL.fullmatch(w) is not None)


def _capital(w: str) -> bool:
    return w[:1].isupper()


@functools.lru_cache(50_000)
def _may_be_name(w: str, like: str = "Aa") -> bool:
    """A word, written like another (small, all in capitals, else with a capital and small letters), that is no word of a unit, role or greeting."""
    bare = _bare(w)
    alike = w.islower() if like.islower() else w.isupper() if like.isupper() and len(like) > 1 else w[:1].isupper() and (w[1:].islower() or "-" in w)
    return alike and len(bare) > 2 and not w.endswith(".") and bare not in NOT_NAMES and bare not in _ANNOUNCED and bare not in UNITS and not bare.endswith(tuple(STREETS))


def _names(s: str, whole_field: bool, known: Known = Known()) -> Iterator[tuple[int, int]]:
    """Spans of persons' names: given name and family name in either order, with initials, or either alone where it names a person."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(s)]
    text = [s[a:b] for a, b in words]
    traits = [_traits(w) for w in text]
    n, i = len(words), 0
    learnt = known.family

    def family(w: str, rare: bool = False) -> bool:
        x = _traits(w)
        return (x.rare if rare else x.ending) or (len(w) > 2 and learnt.issuperset(x.parts))

    announced = INTRODUCE | ADDRESS
    if not any(x.given or x.ending or x.initial or x.bare in announced or x.parts[0] in learnt for x in traits):
        return

    def near(k: int, comma: bool = False) -> bool:
        """Whether nothing but a blank (or a comma and a blank) lies between words k and k + 1."""
        if k + 1 >= n:
            return False
        gap = s[words[k][1] : words[k + 1][0]]
        return (re.fullmatch(r",[ \xa0]{1,2}", gap) if comma else _GAP.fullmatch(gap)) is not None

    def initial(k: int) -> bool:
        return k < n and traits[k].initial

    def end_of(k: int) -> int:
        return words[k][1] - text[k].endswith(".") * (not initial(k))

    def unheard(k: int, like: str = "Aa") -> bool:
        """A word that nothing speaks against being a name: no common one, and what follows makes it no disease, scale or unit."""
        w = text[k].rstrip(".") if not initial(k) else text[k]
        return _may_be_name(w, like) and _bare(w) not in known.common and not (near(k) and not text[k].endswith(".") and _bare(text[k + 1]) in NO_PERSON)

    def behind(k: int) -> bool:
        """Whether a word announces that a person follows."""
        return k > 0 and traits[k - 1].bare in _ANNOUNCED and re.fullmatch(r"[:,.]?[ \xa0]{1,2}", s[words[k - 1][1] : words[k][0]]) is not None

    def run_of(k: int) -> int:
        """The last of up to three unheard words, with initials between, from k on; k - 1 if there is none."""
        last, count = k - 1, 0
        while k < n and count < 3 and (unheard(k) or _is_given(text[k].rstrip(".")) and _capital(text[k]) or initial(k) and count):
            count += not initial(k)
            last = last if initial(k) else k
            if text[k].endswith(".") and not initial(k) or not near(k):
                break
            k += 1
        return last

    while i < n:
        w, x = text[i], traits[i]
        if not (x.given or x.initial or x.ending or w[:1].isupper() or x.parts[0] in learnt):
            i += 1  # a small word that nobody knows as a name
            continue
        # Given name, initials, family name.
        if _is_given(w):
            j = i
            while near(j) and (initial(j + 1) or (_is_given(text[j + 1]) and j - i < 2 and _capital(text[j + 1]) == _capital(w))):
                j += 1
            follows = near(j) and (not text[j].endswith(".") or initial(j))
            if follows and family(text[j + 1]) and (family(text[j + 1], True) or _capital(text[j + 1]) or j > i and initial(j)):
                yield words[i][0], end_of(j + 1)
                i = j + 2
                continue
            if follows and (_capital(w) or whole_field) and unheard(j + 1, w):
                yield words[i][0], end_of(j + 1)
                i = j + 2
                continue
        # Initials, family name.
        if initial(i):
            j = i
            while near(j) and initial(j + 1):
                j += 1
            if near(j) and (family(text[j + 1]) or w[0].isupper() and unheard(j + 1) and (i == 0 if whole_field else behind(i))):
                yield words[i][0], end_of(j + 1)
                i = j + 2
                continue
        # Family name, comma, given name or initial.
        if not w.endswith(".") and (family(w) or _capital(w) and near(i, comma=True) and unheard(i) and (whole_field or behind(i) and _capital(text[i + 1]))):
            if near(i, comma=True) and (_is_given(text[i + 1].rstrip(".")) or initial(i + 1)):
                j = i + 1
                while near(j) and initial(j + 1):
                    j += 1
                yield words[i][0], end_of(j)
                i = j + 1
                continue
            if near(i) and _is_given(text[i + 1].rstrip(".")) and _capital(text[i + 1]) == _capital(w) and family(w, True):
                yield words[i][0], end_of(i + 1)
                i += 2
                continue
        # Names that nobody knows, behind a title or a word that introduces or addresses a person.
        if behind(i) and (told := _bare(text[i - 1])) in announced and unheard(i):
            j = run_of(i)
            if j > i or told in INTRODUCE:
                yield words[i][0], end_of(j)
                i = j + 1
                continue
        if family(w, True) or (family(w) and _capital(w) and i and _bare(text[i - 1]) in ("dr", "doktor", "syster", "nurse", "prof")):
            yield words[i][0], end_of(i)
        elif _is_given(w.rstrip(".")) and _alone(s, words, text, i, whole_field):
            yield words[i][0], end_of(i)
        i += 1


def _alone(s: str, words: list[tuple[int, int]], text: list[str], i: int, whole_field: bool) -> bool:
    """Whether a given name by itself names a person here."""
    a, b = words[i]
    if whole_field:
        return i == 0 or not text[0][:1].islower() or _bare(text[0]) in ANNOUNCE
    if not _capital(s[a:b]):
        return False
    if s[:a].endswith("/") and not s[:a][:-1][-1:].isalnum():
        return True
    if i and _bare(text[i - 1]) in ANNOUNCE and re.fullmatch(r"[:,]?[ \xa0]{1,2}", s[words[i - 1][1] : a]):
        return True
    after = s[b : b + 40]
    return re.match(r"\s(?:hjälpte|bad|hittade|sa |sade|säger|på avdelning|på mottagning|ringde|skrev|vill|tyckte|tycker|visade|helped|asked|said|told|wants)", after) is not None


def find(s: str | None, field: str = "", known: Known = Known()) -> list[Item]:
    """Items in order of their place, none overlapping another; none for null and blank texts.

    In the field ``participant_name`` a given name alone is a name. ``known`` is what ``learn`` has of the corpus.
    """
    if not s or not s.strip():
        return []
    found: list[Item] = []

    def take(a: int, b: int, kind: str) -> None:
        if all(b <= x.start or a >= x.end for x in found):
            found.append(Item(a, b, kind, s[a:b]))

    if _MAYBE_EMAIL.search(s):
        for m in _EMAIL.finditer(s):
            take(m.start(), m.end(), "email")
    if _MAYBE_NUMBER.search(s):
        for m in _ID.finditer(s):
            if _identity(m):
                take(m.start(), m.end(), "identity_number")
    if _MAYBE_STREET.search(s):
        for m in _STREET.finditer(s):
            take(m.start(), m.end(), "street_address")
    if _MAYBE_NUMBER.search(s):
        for m in _PHONE.finditer(s):
            if _phone(m):
                take(m.start(), m.end(), "phone")
    # Names are looked for in what is left.
    rest = list(s)
    for x in found:
        rest[x.start : x.end] = "\x00" * (x.end - x.start)
    for a, b in _names("".join(rest), field == "participant_name", known):
        take(a, b, "name")
    return sorted(found)


class Feistel:
    """A keyed permutation of the numbers below n: a balanced network over the next square, walked until back below n."""

    def __init__(self, key: bytes, n: int, tweak: str):
        self.n, self.key, self.tweak = n, key, tweak.encode()
        self.half = 1
        while self.half * self.half < n:
            self.half += 1

    def _round(self, r: int, x: int) -> int:
        return int.from_bytes(hmac.new(self.key, b"%b|%d|%d" % (self.tweak, r, x), hashlib.sha256).digest()[:8], "big") % self.half

    def _walk(self, x: int, rounds: range, sign: int) -> int:
        a, b = divmod(x, self.half)
        for r in rounds:
            if sign > 0:
                a, b = b, (a + self._round(r, b)) % self.half
            else:
                a, b = (b - self._round(r, a)) % self.half, a
        return a * self.half + b

    def __call__(self, x: int) -> int:
        while True:
            x = self._walk(x, range(10), 1)
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            x = self._walk(x, range(9, -1, -1), -1)
            if x < self.n:
                return x


_DAY0 = datetime.date(1800, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _DAY0).days


def _pseudo_identity(key: bytes, twelve: str) -> str:
    """Another valid identity number: date and serial are permuted, kind and check digit follow."""
    dd = int(twelve[6:8])
    coordination = dd > 60
    day = datetime.date(int(twelve[:4]), int(twelve[4:6]), dd - 60 * coordination)
    x = Feistel(key, _DAYS * 1000, "id")((day - _DAY0).days * 1000 + int(twelve[8:11]))
    new = _DAY0 + datetime.timedelta(days=x // 1000)
    body = f"{new.year:04d}{new.month:02d}{new.day + 60 * coordination:02d}{x % 1000:03d}"
    check = next(c for c in "0123456789" if luhn(body[2:] + c))
    return f"{body[:8]}-{body[8:]}{check}"


def _pseudo_phone(key: bytes, national: str) -> str:
    """Another number of as many digits with the same first two."""
    head, tail = national[:2], national[2:]
    return head + str(Feistel(key, 10 ** len(tail), f"phone{len(tail)}")(int(tail))).zfill(len(tail))


def _code(key: bytes, kind: str, value: str) -> str:
    return hmac.new(key, f"{kind}|{value}".encode(), hashlib.sha256).hexdigest()[:8]


def pseudonym(item: Item, key: bytes) -> str:
    v = unicodedata.normalize("NFKC", item.value)
    if item.kind == "identity_number":
        return _pseudo_identity(key, _identity(_ID.search(item.value)))
    if item.kind == "phone":
        n = _national(v)
        return ("+" + _pseudo_phone(key, n[1:])) if n.startswith("+") else _pseudo_phone(key, n)
    if item.kind == "email":
        v = re.sub(r"\s?[(\[{]\s?(?:punkt|dot|prick|\.)\s?[)\]}]\s?|\s(?:punkt|dot|prick)\s", ".", v.casefold())
        v = re.sub(r"\s?[(\[{]\s?(?:at|a|snabel-?a)\s?[)\]}]\s?|\s(?:snabel-?a|at)\s", "@", v)
        return _code(key, "email", re.sub(r"\s", "", v))
    if item.kind == "name":
        return _code(key, "name", " ".join(sorted(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", v.casefold()))))
    return _code(key, item.kind, re.sub(r"[\s,]+", " ", v.casefold()))


@functools.lru_cache(100_000)
def _placeholder(kind: str, value: str, key: bytes) -> str:
    return f"[{kind}:{pseudonym(Item(0, len(value), kind, value), key)}]"


def linked(s: str | None, field: str, key: bytes, known: Known = Known()) -> list[tuple[Item, str]]:
    """The items of a text, each with its placeholder [kind:pseudonym]."""
    return [(x, _placeholder(x.kind, x.value, key)) for x in find(s, field, known)]


def mask(s: str | None, field: str, key: bytes, known: Known = Known()) -> str | None:
    """The text with a placeholder for each item; null stays null."""
    if not s:
        return s
    out, at = [], 0
    for x, placeholder in linked(s, field, key, known):
        out += [s[at : x.start], placeholder]
        at = x.end
    return "".join([*out, s[at:]])


@functools.lru_cache(100_000)
def _no_family(bare: str) -> bool:
    return len(bare) < 3 or bare in NOT_NAMES or bare in _ANNOUNCED or bare in UNITS


def count_words(texts: Iterator[tuple[str, str]]) -> Counter:
    """Of the words of some texts (field, text): how often each stands in running text ("n"), there in small letters and
    beside no given name ("s"), and behind a given name or an initial written alike, or behind a title ("f"). Parts of double names count by themselves."""
    stands: Counter = Counter()
    small: Counter = Counter()
    follows: Counter = Counter()
    for field, s in texts:
        own = field == "participant_name"
        if _MAYBE_EMAIL.search(s):
            s = _EMAIL.sub(" ; ", s)
        found = list(_WORD.finditer(s))
        traits = [_traits(m.group()) for m in found]
        if not own:
            stands.update(x for t in traits for x in t.parts)
            small.update(x for m, t in zip(found, traits) if m.group()[:1].islower() for x in t.parts)
        # Only what stands beside a given name, or behind an initial or a title, is looked at more closely.
        near = {j for k, t in enumerate(traits) for j in ((k - 1, k + 1) if t.given else (k + 1,) if t.initial or t.bare in INTRODUCE else ()) if 0 <= j < len(found)}
        for k in near:
            w, t = found[k].group(), traits[k]
            beside = lambda j: _BESIDE.fullmatch(s, found[j].end(), found[j + 1].start()) is not None
            before, b = (found[k - 1].group(), traits[k - 1]) if k and beside(k - 1) else ("", None)
            alike = bool(before) and (_capital(before) == _capital(w) or own)
            behind = alike and (b.given and not before.endswith(".") or b.initial and before[0].isupper()) or bool(before) and _capital(w) and b.bare in INTRODUCE
            named = behind or alike and b.given or k + 1 < len(found) and traits[k + 1].given and beside(k)
            for bare in t.parts:
                if named and not own and w[:1].islower():
                    small[bare] -= 1
                if behind and (own or _capital(w)) and not t.given and not _no_family(bare):
                    follows[bare] += 1
    out: Counter = Counter()
    for kind, counts in (("n", stands), ("s", small), ("f", follows)):
        out.update({(kind, w): c for w, c in counts.items() if c})
    return out


def learn(df: DataFrame, fields: list[str]) -> Known:
    """The common words and the family names of a corpus. Counted within each task; what comes to the driver is bounded by its share of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def told() -> pd.DataFrame:
            rows = [(k, w, n) for (k, w), n in total.items() if n]
            total.clear()
            return pd.DataFrame(rows, columns=["kind", "word", "n"])

        for b in batches:
            now = count_words((f, s) for f in fields for s in b[f] if isinstance(s, str))
            now["t", ""] = sum(n for (k, _), n in now.items() if k == "n")
            total.update(now)
            if len(total) > 500_000:
                yield told()
        yield told()

    made = df.select(*fields).mapInPandas(run, "kind string, word string, n long")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    counts = made.groupBy("word").agg(of("n"), of("s"), of("f"), of("t")).persist()
    try:
        total = counts.where("word = ''").agg(F.sum("t")).first()[0] or 0
        least = max(1, total * WORD_SHARE)
        n, s, f = F.col("n"), F.col("s"), F.col("f")
        common = ((s >= max(least, SMALL)) & (s > f)) | ((n >= max(least, STANDS)) & (f < ELSEWHERE * n))
        family = (f >= max(least, FOLLOWS)) & (f >= BEHIND * n) & (s <= HARDLY * (n + f))
        rows = counts.where((F.col("word") != "") & (common | family)).select("word", common.alias("common")).collect()
    finally:
        counts.unpersist()
    return Known(frozenset(r.word for r in rows if not r.common), frozenset(r.word for r in rows if r.common))


def find_items(df: DataFrame, key: str, fields: list[str], secret: bytes, known: Known | None = None) -> DataFrame:
    """key, field, start, kind, value, placeholder: one row per item, as ``mask_fields`` replaces it. Null and blank
    fields have none; a value that occurs twice has two rows. Whole texts are read, nothing is shuffled but counts of words."""
    names = ["field", "start", "kind", "value", "placeholder"]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.IntegerType() if c == "start" else T.StringType()) for c in names)])
    shared = df.sparkSession.sparkContext.broadcast(known or learn(df, fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, f, x.start, x.kind, x.value, to) for f in fields for k, s in zip(b[key], b[f]) if isinstance(s, str) for x, to in linked(s, f, secret, shared.value)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, *fields).mapInPandas(run, schema)


def mask_fields(df: DataFrame, key: str, fields: list[str], secret: bytes, known: Known | None = None) -> DataFrame:
    """key and the fields with placeholders; one row per row."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(f, T.StringType()) for f in fields)])
    shared = df.sparkSession.sparkContext.broadcast(known or learn(df, fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{f: [mask(s if isinstance(s, str) else None, f, secret, shared.value) for s in b[f]] for f in fields})

    return df.select(key, *fields).mapInPandas(run, schema)
