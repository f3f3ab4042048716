"""Vectors: normalisation, pooling, embedding, and exact inner-product search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as t

#: Bytes of a block of vectors, numbers of a part of the product of two blocks, and rows that a task holds of its best.
BLOCK_BYTES, PRODUCT, HELD = 2 << 20, 4 << 20, 2_000_000
SCORE_PLACES = 5
DIMS = 64


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero. The length is worked out once, not for each number."""
    length = F.array(F.greatest(norm(v), F.lit(1e-12)))
    return F.get(F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key, dim, value: the mean over a text's token vectors where the mask is 1, 0 where it is nowhere."""
    parts = tokens.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy(key, "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("value"))


def with_prefix(text: Column, prefix: str) -> Column:
    """A text with its prefix ("query: " or "passage: ") unless it has it already, trimmed."""
    s = F.trim(text)
    return F.when(F.lower(s).startswith(prefix.strip().lower()), s).otherwise(F.concat(F.lit(prefix), s))


def needs_prefix(model: str) -> bool:
    return "e5" in model.lower()


_WORD = re.compile(t.TOKEN)


@lru_cache(200_000)
def _place(term: str, dims: int) -> tuple[int, int]:
    """The number and sign that stand for a term: the first eight digits of its MD5, and whether the ninth is 8 or more."""
    h = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
    return int(h[:8], 16) % dims, 1 if h[8] >= "8" else -1


def hash_embedding(text: str | None, dims: int = DIMS) -> list[float]:
    """A unit vector of signed term counts; null and empty texts give zeros. Stands in for a learned encoder."""
    v = np.zeros(dims)
    for w in _WORD.findall(text or ""):
        k, sign = _place(w.lower(), dims)
        v[k] += sign
    n = np.sqrt((v * v).sum())
    return (v / n if n > 0 else v).astype(np.float32).tolist()


def embed(df: DataFrame, key: str, text: str, dims: int = DIMS, encoder=hash_embedding) -> DataFrame:
    """key, embedding (array of float). ``encoder`` is any function of a text and a number of dimensions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [encoder(x if isinstance(x, str) else None, dims) for x in b[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score, rank of the ``k`` vectors nearest to one query by inner product of unit vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(inner(unit(F.col(vector)), unit(q)), SCORE_PLACES).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def _blocks(df: DataFrame, key: str, vector: str, side: str) -> DataFrame:
    """Unit vectors of one length packed in rows of bounded size: a number for the block, its keys, and the numbers as bytes. Null vectors are left out, null numbers count as 0."""
    names = [f"{side}{c}" for c in ("block", "keys", "dims", "numbers")]
    schema = T.StructType([T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(df.schema[key].dataType)), T.StructField(names[2], T.IntegerType()), T.StructField(names[3], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            keys, rows = b.column(0), b.column(1)
            lengths = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths[lengths > 0]):
                some = np.flatnonzero(lengths == dims)
                step = max(1, BLOCK_BYTES // (8 * int(dims)))
                for lo in range(0, len(some), step):
                    at = pa.array(some[lo : lo + step])
                    x = np.nan_to_num(pc.list_flatten(rows.take(at)).to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
                    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                    own = keys.take(at)
                    held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), held, pa.array([dims], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=names)
                    block += 1

    return df.select(F.col(key), F.col(vector)).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


class _Nearest:
    """The best k of each query of a block, of the vectors that a task has seen."""

    def __init__(self, names, queries: np.ndarray, k: int):
        self.names, self.queries, self.k = names, queries, k
        self.least = np.full(len(queries), -np.inf)
        self.best = None

    def take(self, keys, vectors: np.ndarray) -> None:
        k = self.k
        for lo in range(0, len(self.queries), max(1, PRODUCT // len(vectors))):
            hi = min(len(self.queries), lo + max(1, PRODUCT // len(vectors)))
            s = np.round(self.queries[lo:hi] @ vectors.T, SCORE_PLACES) + 0.0
            least = self.least[lo:hi]
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            q, at = np.nonzero(s >= least[:, None])
            found = pa.table({"q": pa.array(q + lo, pa.int32()), "score": pa.array(s[q, at]), "key": keys.take(pa.array(at))})
            every = found if self.best is None else pa.concat_tables([self.best, found])
            every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")]))
            q = every.column("q").to_numpy()
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=int)
            place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            self.best = every.filter(pa.array(place < k))
            last = place == k - 1
            self.least[q[last]] = every.column("score").to_numpy()[last]

    def rows(self) -> pa.Table:
        return self.best.set_column(0, "q", self.names.take(self.best.column("q")))


def search(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: the ``k`` nearest vectors of every query, exactly.

    Both sides are packed into blocks of bounded size where they are read, so no
    vector is shuffled or gathered. Every block of the stated queries meets every
    block of vectors as one matrix product; a task keeps the best k of each query
    of all it sees and hands on only those. The engine broadcasts the blocks of a
    side whose size is below its threshold; else each part of the one is read
    against each part of the other. Vectors of another length than the query's,
    and null ones, are left out; a zero vector scores 0; ``k`` of 0 or less gives none.
    """
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    pairs = _blocks(vectors, key, vector, "v_").crossJoin(_blocks(queries, query_id, vector, "q_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest: dict[int, _Nearest] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for x in nearest.values():
                rows = x.rows()
                yield from pa.table([rows.column("q").combine_chunks(), rows.column("key").combine_chunks(), rows.column("score").combine_chunks()], names=schema.names).to_batches()
            nearest.clear()

        read = lambda b, side, n: (b.column(f"{side}keys")[n].values, np.frombuffer(b.column(f"{side}numbers")[n].as_buffer(), np.float64).reshape(-1, b.column(f"{side}dims")[n].as_py()))
        for b in batches:
            for n in range(b.num_rows):
                if b.column("v_dims")[n] != b.column("q_dims")[n]:
                    continue
                block = b.column("q_block")[n].as_py()
                if block not in nearest:
                    if sum(len(x.queries) for x in nearest.values()) * k > HELD:
                        yield from told()
                    nearest[block] = _Nearest(*read(b, "q_", n), k)
                nearest[block].take(*read(b, "v_", n))
        yield from told()

    if k < 1:
        return queries.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), key))
    return pairs.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k)


def index_rows(chunks: DataFrame, key: str, text: str, profile: str = "e5_large_instruct", dims: int = DIMS) -> DataFrame:
    """key and embedding of a chunk table by a named profile: the passage prefix where the model wants it."""
    body = with_prefix(F.col(text), "passage: ") if needs_prefix(profile) else t.squeeze(F.col(text))
    return embed(chunks.select(key, body.alias("_text")), key, "_text", dims)
