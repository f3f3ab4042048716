"""Subject areas of documents by latent semantic analysis and seeded centroids.

The model is fitted on a bounded sample of documents that were labelled by hand
(``most`` of them, chosen by a hash of their id). Their sentences are embedded by
term weighting and truncated singular value decomposition: a term's weight is its
inverse document frequency over all documents times what it says of the subject.
The sentences of documents with one label are the seeds of the centroids; then
sentences are assigned to the nearest centroid among their document's labels, and
term weights, decomposition and centroids are made anew from the assignments, until
they settle. Wrong labels lose their hold, as the sentences that don't fit them are
nearer to another centroid and count no longer.

Every document is then assigned, sentence by sentence: a sentence deals with the
subject whose centroid is nearest, if it holds terms that say anything of a
subject. A sentence whose terms belong to two subjects alike follows the rest of
its document.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.tables import small_rows

#: At most so many labelled documents are used for fitting.
MOST_LABELLED = 4_000
DIMENSIONS = 20
ROUNDS = 5
#: What is taken off a term's information: so many times what chance gives, and this. Information is 1 for a term
#: that tells one of equally frequent subjects from the others.
CHANCE, LEAST_INFORMATION = 0.7, 0.1
#: Least weight of a sentence's terms, least cosine to its centroid, and how near another centroid must be to leave it open.
LEAST_WEIGHT, LEAST_COSINE, NEAR = 0.16, 0.3, 0.12
#: A document with more sentences than this needs two for a subject.
SHORT = 3

# Two-byte characters read as cp1252, and what is put into texts in passing.
_MOJIBAKE = re.compile(r"[ÂÃÅâ][\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{1,2}")
_JUNK = re.compile(
    r" ?<b>[^<]{0,12}</b> ?(?:&nbsp;)?| ?</?(?:s|p|b|i|u|em|strong|span|div|br|li|ul|ol|td|tr|th|table|h[1-6])\b[^>]{0,200}>(?:</?s>)? ?| ?<\|[^|>]{1,40}\|> ?"
    r"| ?(?:\[/?INST\]|<<?/?SYS>?>|\[(?:PAD|UNK|CLS|SEP|MASK|BOS|EOS)\]) ?"
    r"| ?[​-‏⁠﻿­]+ ?| ?(?:[☀-➿️‍🀀-🯿]+ ?)+|(?<=\w)\t{2,}(?=\w)"
)
# Other scripts: some words of one within a text are put in by mistake, unless they are this share of its letters, and so many.
_OTHER = re.compile(r"[Ͱ-῿぀-鿿가-힯]")
_OTHER_WORDS = re.compile(r" ?(?:[Ͱ-῿぀-鿿가-힯]+(?: (?=[Ͱ-῿぀-鿿가-힯]))?)+ ?")
OTHER_SHARE, OTHER_LEAST = 0.2, 20
_ENGLISH = set("the and is are of to be in on for by with this that when must have has it then first not do if does after before".split())
_SWEDISH = set("och att är som för av på om den det i till med en ett ska inte har när vid från eller sedan först efter före får hur".split())
# Most texts have none of these and need no cleaning.
_MAYBE_JUNK = re.compile(r"[<\[\t​-‏⁠﻿­☀-➿️\U0001f000-\U0001fbffͰ-῿぀-鿿가-힯]")
_END = re.compile(r"[.!?…][\"'”»)\]]*(?=\s|$)|[。！？]")
_LINE = re.compile(r"[\n\r\f]+")
_TERM = re.compile(r"[^\W\d_]{2,}")
_GOES_ON = re.compile(r"\s*(?:därför att|otherwise|annars|because)\b")
_PARAGRAPH = re.compile(r"</?p>", re.I)


def plain(s: str) -> str:
    """A text without mark-up, wrongly decoded characters, inserted symbols and some words of another script, composed and in small letters.

    A text that is written in another script stays."""
    if "Ã" in s or "â€" in s or "Â" in s:
        s = _MOJIBAKE.sub(_decode, s)
    if "<" in s:
        s = _PARAGRAPH.sub("\n", s)
    if _MAYBE_JUNK.search(s):
        s = _JUNK.sub("", s)
        if 0 < (n := len(_OTHER.findall(s))) < max(OTHER_LEAST, OTHER_SHARE * sum(map(str.isalpha, s))):
            s = _OTHER_WORDS.sub("", s)
    if "&" in s:
        s = html.unescape(s)
    return unicodedata.normalize("NFC", s).casefold()


def _decode(m: re.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        try:
            return bytes(ord(c) if ord(c) < 256 else c.encode("cp1252")[0] for c in m.group()).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError, ValueError):
            return m.group()


def sentences(s: str | None) -> list[str]:
    """The sentences of a text, cleaned and in small letters; headings and lists of contents are none.

    A question and the reason given for it are one sentence. A text without any
    full stop is one sentence.
    """
    if not s or not s.strip():
        return []
    out: list[str] = []
    whole = plain(s)
    for line in _LINE.split(whole):
        at = 0
        for m in _END.finditer(line):
            part = line[at : m.end()]
            at = m.end()
            if len(part) > 8 and (" " in part.strip() or _OTHER.search(part)):
                if out and _GOES_ON.match(part) and out[-1][-1:] == "?":
                    out[-1] += part
                else:
                    out.append(part)
    if not out and (len(whole.split()) > 2 or len(_OTHER.findall(whole)) > 8):
        out = [" ".join(whole.split())]
    return out


class Space(NamedTuple):
    """Terms of one language and the centroids among them."""

    vocabulary: dict[str, int]
    vectors: np.ndarray  # term -> weighted embedding
    weights: np.ndarray  # term -> what it says of a subject
    centroids: np.ndarray


class Model(NamedTuple):
    spaces: dict[str, Space]
    subjects: list[int]


def language(words: list[str]) -> str:
    """Whether a sentence's words are English or, as most are, Swedish, by the commonest among them."""
    if _ENGLISH.isdisjoint(words):
        return "sv"
    if _SWEDISH.isdisjoint(words):
        return "en"
    return "en" if sum(w in _ENGLISH for w in words) > sum(w in _SWEDISH for w in words) else "sv"


def _words(texts: list[str | None]) -> list[list[tuple[str, list[str]]]]:
    """The language and the words of each sentence of each text."""
    find = _TERM.findall
    return [[(language(w), w) for w in map(find, sentences(x))] for x in texts]


def _sums(vectors: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each run of terms; an empty run gives zeros."""
    out = np.zeros((len(ends) - 1, *vectors.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(vectors[flat], ends[:-1][full], axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 1e-12, n, 1)


def _codes(texts: list[list[tuple[str, list[str]]]], vocabulary: dict[str, int], tongue: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers of all sentences of a language in one row, where each sentence ends, and the document of each."""
    known = vocabulary.keys()
    get = vocabulary.__getitem__
    flat: list[int] = []
    ends, of = [0], []
    for k, sents in enumerate(texts):
        for spoken, words in sents:
            if spoken == tongue:
                if not known.isdisjoint(words):
                    flat.extend([get(w) for w in words if w in vocabulary])
                ends.append(len(flat))
                of.append(k)
    return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(of, dtype=np.int64)


def _leading(gram: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a Gram matrix and their vectors, by subspace iteration."""
    n = len(gram)
    if n <= most:
        values, vectors = np.linalg.eigh(gram) if n else (np.zeros(0), np.zeros((0, 0)))
        return values[::-1], vectors[:, ::-1]
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((n, min(n, most + 8))))[0]
    for _ in range(12):
        q = np.linalg.qr(gram @ q)[0]
    values, small = np.linalg.eigh(q.T @ gram @ q)
    return values[::-1][:most], (q @ small)[:, ::-1][:, :most]


def _products(group: np.ndarray, other: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
    """The inner products of the ``other`` axis of a sparse matrix, added up group by group."""
    order = np.argsort(group, kind="stable")
    group, other, entry = group[order], other[order], entry[order]
    gram = np.zeros((n, n))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=int)
    for a, b in zip(starts, np.r_[starts[1:], len(group)]):
        gram[np.ix_(other[a:b], other[a:b])] += np.outer(entry[a:b], entry[a:b])
    return gram


def decompose(rows: np.ndarray, cols: np.ndarray, entry: np.ndarray, n_rows: int, n_cols: int, most: int) -> np.ndarray:
    """The leading right singular vectors of a sparse matrix of documents by terms.

    By way of the inner products of its shorter side: documents are at most as many
    as the fitting sample, so no more than its square is held, however many terms
    there are.
    """
    if n_cols <= n_rows:
        return _leading(_products(rows, cols, entry, n_cols), most)[1]
    values, left = _leading(_products(cols, rows, entry, n_rows), most)
    kept = values > 1e-12 * max(1.0, values[0] if len(values) else 0.0)
    left = left[:, kept]
    out = np.zeros((n_cols, left.shape[1]))
    for k in range(left.shape[1]):
        out[:, k] = np.bincount(cols, weights=entry * left[rows, k], minlength=n_cols)
    return out / np.linalg.norm(out, axis=0)


def _information(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """How far the subjects of a term are from those of all terms: the Kullback-Leibler divergence less
    what chance gives with so few occurrences, 0 for common terms."""
    n = counts.sum(1)
    p = counts / np.maximum(n, 1e-9)[:, None]
    divergence = np.where(p > 0, p * np.log(np.maximum(p, 1e-12) / prior), 0).sum(1)
    chance = (len(prior) - 1) / (2 * np.maximum(n, 1e-9))
    return np.where(n > 0, np.maximum(0, (divergence - CHANCE * chance) / np.log(max(2, len(prior))) - LEAST_INFORMATION), 0)


def fit(texts: list[str], labels: list[set[int]], subjects: list[int], idf: dict[str, float] | None = None, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> Model:
    """A model from labelled texts; a text with no label is one about none of the subjects."""
    cut = _words(texts)
    return Model({t: _fit(cut, labels, subjects, idf, dimensions, rounds, t) for t in ("sv", "en")}, subjects)


def _fit(sents: list[list[tuple[str, list[str]]]], labels: list[set[int]], subjects: list[int], idf: dict[str, float] | None, dimensions: int, rounds: int, tongue: str) -> Space:
    at = {s: k for k, s in enumerate(subjects)}
    df = Counter(w for x in sents for w in {w for spoken, words in x if spoken == tongue for w in words})
    words = sorted(w for w, n in df.items() if n > 1)
    vocabulary = {w: k for k, w in enumerate(words)}
    inverse = np.array([(idf or {}).get(w, np.log((1 + len(sents)) / (1 + df[w]))) for w in words]) if words else np.zeros(0)
    flat, ends, of = _codes(sents, vocabulary, tongue)
    s = len(subjects)
    allowed = np.zeros((len(sents), s))
    for k, ls in enumerate(labels):
        for x in ls:
            if x in at:
                allowed[k, at[x]] = 1
    share = allowed / np.maximum(1, allowed.sum(1, keepdims=True))
    where = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    # Terms by document at first: a document counts once for a term, shared among its labels.
    pairs = np.unique(np.stack([of[where], flat]), axis=1) if len(flat) else np.zeros((2, 0), dtype=np.int64)
    counts = np.zeros((len(words), s))
    np.add.at(counts, pairs[1], share[pairs[0]])
    spoken = np.bincount(of, minlength=len(sents)) > 0
    prior = share[spoken].sum(0) + 1.0
    prior /= prior.sum()
    single = allowed.sum(1) == 1
    weight = np.zeros(len(ends) - 1)
    assigned = np.full(len(ends) - 1, -1)
    for turn in range(rounds):
        info = _information(counts, prior)
        kept = np.flatnonzero(info > 0)
        # The weighted documents by terms, and the truncated decomposition.
        value = info * inverse
        number = np.full(len(words), -1)
        number[kept] = np.arange(len(kept))
        used = number[flat] >= 0
        cells, times = np.unique(of[where[used]] * len(kept) + number[flat[used]], return_counts=True) if len(kept) else (np.zeros(0, dtype=int), np.zeros(0))
        rows, cols = np.divmod(cells, max(1, len(kept)))
        entry = (1 + np.log(np.maximum(1, times))) * value[kept[cols]]
        length = np.sqrt(np.bincount(rows, weights=entry * entry, minlength=len(sents))) if len(rows) else np.zeros(len(sents))
        base = decompose(rows, cols, entry / length[rows], len(sents), len(kept), dimensions)
        vectors = np.zeros((len(words), base.shape[1]))
        vectors[kept] = base * value[kept, None]
        points = _unit(_sums(vectors, flat, ends))
        weight = _sums(info[:, None], flat, ends)[:, 0]
        if turn == 0:
            assigned = np.where(single[of] & (weight > 0), allowed[of].argmax(1), -1)
        centroids = _unit(np.stack([points[assigned == k].sum(0) for k in range(s)])) if len(of) else np.zeros((s, base.shape[1]))
        cosine = points @ centroids.T
        best = cosine.argmax(1)
        fits = (weight >= LEAST_WEIGHT) & (cosine.max(1) >= LEAST_COSINE) & (allowed[of, best] > 0)
        assigned = np.where(fits, best, -1)
        # From now on sentences count for terms.
        counts = np.zeros((len(words), s))
        known = assigned[where] >= 0
        np.add.at(counts, (flat[known], assigned[where][known]), 1)
        prior = np.bincount(assigned[assigned >= 0], minlength=s) + 1.0
        prior /= prior.sum()
    centroids = _unit(np.stack([points[assigned == k].sum(0) for k in range(s)])) if len(of) else np.zeros((s, 0))
    keep = np.flatnonzero(info > 0)
    return Space({words[k]: n for n, k in enumerate(keep)}, vectors[keep].astype(np.float32), info[keep].astype(np.float32), centroids.astype(np.float32))


def assign(texts: list[str | None], model: Model) -> list[list[int]]:
    """The subjects of each text, ascending; none for null, blank and empty texts."""
    sents = _words(texts)
    votes = np.zeros((len(texts), len(model.subjects)))
    later = []
    for tongue, space in model.spaces.items():
        flat, ends, of = _codes(sents, space.vocabulary, tongue)
        if not len(of) or not len(space.vocabulary):
            continue
        weight = _sums(space.weights[:, None], flat, ends)[:, 0]
        some = np.flatnonzero(weight >= LEAST_WEIGHT)
        cosine = _unit(_sums(space.vectors, flat, ends)[some]) @ space.centroids.T
        of, rows = of[some], np.arange(len(some))
        best = cosine.argmax(1)
        top = cosine[rows, best]
        near = (cosine > top[:, None] - NEAR).sum(1) > 1
        holds = top >= LEAST_COSINE
        np.add.at(votes, (of[holds & ~near], best[holds & ~near]), 1)
        later.append((of[holds & near], cosine[holds & near]))
    # A sentence between two subjects goes with the one that its document is about, and makes no passing remark a subject.
    clear = votes.copy()
    for of, cosine in later:
        for k, c in zip(of, cosine):
            main = [j for j in np.flatnonzero(clear[k] >= 2) if c[j] >= LEAST_COSINE / 3]
            if main:
                votes[k, max(main, key=lambda j: c[j])] += 1
            elif clear[k].max() < 2:
                votes[k, max(np.flatnonzero(c > c.max() - NEAR), key=lambda j: (clear[k, j], c[j]))] += 1
    return [[model.subjects[j] for j in np.flatnonzero(v >= (1 if len(x) <= SHORT else 2))] for v, x in zip(votes, sents)]


def document_frequencies(docs: DataFrame, text: str, words: set[str]) -> dict[str, int]:
    """In how many documents each of some words occurs, over all documents. The words are few: those of the fitting sample."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total, n = shared.value, Counter(), 0
        for b in batches:
            for s in b[text]:
                n += 1
                if isinstance(s, str):
                    total.update(known.intersection(_TERM.findall(plain(s))))
        yield pd.DataFrame({"word": ["", *total], "n": [n, *total.values()]})

    rows = docs.select(text).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


def fit_model(docs: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on at most ``most`` labelled documents, chosen by a hash of their id, with statistics over all documents.

    Labels of documents that are missing, null or blank are left out; repeated
    labels count once.
    """
    subjects = sorted(r.subject_id for r in small_rows(areas.select("subject_id").where("subject_id is not null").distinct(), 1000, "subject_areas"))
    by_doc = labels.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_id")).alias("subjects"))
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # The chosen ids are at most `most` rows.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").orderBy("doc_id").toPandas()
    texts, sets = list(got.text), [set(map(int, x)) for x in got.subjects]
    words = set()
    for x in texts:
        words.update(_TERM.findall(" ".join(sentences(x))))
    df = document_frequencies(docs, "text", words)
    n = df.get("", 0)
    idf = {w: float(np.log((1 + n) / (1 + df.get(w, 0)))) for w in words}
    return fit(texts, sets, subjects, idf)


def assign_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject_id: a row per row of ``docs`` and subject that its text is about."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("subject_id", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = assign([x if isinstance(x, str) else None for x in b.text], shared.value)
            yield pd.DataFrame([(i, s) for i, x in zip(b.doc_id, found) for s in x], columns=["doc_id", "subject_id"])

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def composition(assigned: DataFrame, docs: DataFrame, areas: DataFrame) -> DataFrame:
    """subject_id, code, n_docs, share of all documents; every area has a row."""
    counts = assigned.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_docs"))
    total = docs.agg(F.count(F.lit(1)).alias("_all"))
    return (
        areas.select("subject_id", "code").join(counts, "subject_id", "left").crossJoin(F.broadcast(total))
        .select("subject_id", "code", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.round(F.coalesce("n_docs", F.lit(0)) / F.col("_all"), 6).alias("share"))
    )
