"""Byte-level BPE by backtracking: exact merges in linear time.

The vocabulary's tokens are put in an Aho-Corasick automaton. At each place of a
word the longest token that starts there is tried first; it is kept only if it
and the token before it may stand side by side, that is, if merging by rank would
leave the border between them alone. If not, the next shorter token is tried, and
if none is left the token before is given up (backtracking). A place once found
to lead nowhere is not tried again, so the time is linear in the word.

Two tokens may stand side by side if, undoing their merges from the outside in,
no merge across the border has a lower rank than the merges that built them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the rule above has it. No word goes on from another character into white space, so a text may be
#: cut before each run of it, and the pieces ("  word,") be encoded one by one.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Distinct pieces kept per worker; the memory for them is bounded and forgetting them costs time only.
KEPT_PIECES = 400_000
#: Longer pieces aren't kept.
KEPT_LENGTH = 48


def _byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Kept(dict):
    """The ids of pieces as bytes of 32-bit integers, worked out when first asked for."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, piece: str) -> bytes:
        got = self.work(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = got
        return got


class Backtracking:
    """Encoder and decoder of one vocabulary, the content of its file."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A token's bytes are written as the characters U+0000 to U+00FF here.
        spelled = {i: "".join(chr(letters[c]) for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        made = set()
        for r, (a, b) in enumerate(pairs):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merged[x, y] = z
            if z not in made:
                made.add(z)
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.tokens = {s: i for i, s in spelled.items() if i in made or len(s) == 1}
        self.length = [0] * size
        for s, i in self.tokens.items():
            self.length[i] = len(s)
        # The next shorter token that is a prefix of a token.
        self.shorter = [-1] * size
        for s, i in self.tokens.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := self.tokens.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton()
        for s, i in self.tokens.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        # Decoding: the bytes of all tokens in one piece, and where each begins.
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        self.offsets[1:] = np.cumsum([len(spelled.get(i, "")) for i in range(size)])
        self.pool = "".join(spelled.get(i, "") for i in range(size)).encode("latin-1")
        self.words = regex.compile(WORDS)
        self.kept = _Kept(self._piece)
        self._beside = lru_cache(1 << 20)(self._may_stand)

    def _may_stand(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the border between tokens a and b."""
        limit = 1 << 60
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        while True:
            z = merged.get((a, b))
            if z is not None and rank[z] < limit:
                return False
            # Undo the later of the two merges; on the left side what touches the border is the right part.
            if rank[a] > rank[b]:
                limit = rank[a]
                a = right[a]
                if rank[a] < 0 and rank[b] < 0:
                    z = merged.get((a, b))
                    return z is None or rank[z] >= limit
            elif rank[b] >= 0:
                limit = rank[b] + 1
                b = left[b]
                if rank[a] < 0 and rank[b] < 0:
                    z = merged.get((a, b))
                    return z is None or rank[z] >= limit
            else:
                return True

    def word(self, w: str) -> tuple[int, ...]:
        """The ids of one word."""
        s = w.encode("utf-8").decode("latin-1")
        if (i := self.tokens.get(s)) is not None:
            return (i,)
        n = len(s)
        longest = [-1] * n
        size = [0] * n
        for end, (k, i) in self.automaton.iter(s):
            if k > size[end - k + 1]:
                size[end - k + 1], longest[end - k + 1] = k, i
        length, shorter, beside = self.length, self.shorter, self._beside
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (last < 0 or beside(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def _piece(self, piece: str) -> bytes:
        out = array("i")
        for w in self.words.findall(piece):
            out.extend(self.word(w))
        return out.tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers; none for null and empty texts.

        Strings that look like special tokens are ordinary text.
        """
        if not text:
            return b""
        kept = self.kept
        return b"".join([kept[p] for p in PIECES.findall(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4

    def decode(self, ids: Iterable[int]) -> str:
        o, pool = self.offsets, self.pool
        return b"".join(pool[o[i] : o[i + 1]] for i in ids).decode("utf-8", errors="replace")


def _content(path: str) -> bytes:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> Backtracking:
    """The encoder on the driver."""
    return Backtracking(_content(path))


_ENCODERS: dict[str, Backtracking] = {}


def shipped(df: DataFrame, path: str):
    """The vocabulary as a broadcast: a file of some megabytes that only the driver has to have."""
    content = _content(path)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), content))


def encoder_of(shared) -> Backtracking:
    """The encoder of a worker, built when first needed."""
    key, content = shared.value
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Backtracking(content)
    return _ENCODERS[key]


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, ids (array of int): one row per row of ``df``, without special tokens.

    A null or empty text gives an empty list; blank text is encoded as it stands.
    Repeated rows stay. Rows are independent: one scan of two columns, no shuffle.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shared = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for b in batches:
            # A batch may hold long texts; ids go out in parts of bounded size.
            keys, texts = b.column(0), b.column(1)
            start, parts, ends = 0, [], [0]
            for k in range(len(texts)):
                parts.append(enc.encode_bytes(texts[k].as_py()))
                ends.append(ends[-1] + len(parts[-1]) // 4)
                if ends[-1] > 4_000_000 or k == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), ids], names=[key, "ids"])
                    start, parts, ends = k + 1, [], [0]

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """key, text: the texts that the ids stand for. A null list gives null, an empty one ''."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])
    shared = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, n_tokens (int)."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.IntegerType())])
    shared = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for b in batches:
            counts = pa.array([enc.count(x.as_py()) for x in b.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), counts], names=[key, "n_tokens"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
