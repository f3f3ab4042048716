"""Filling containers of fixed capacity by sum-of-squares online packing.

``levels[h]`` is the number of open containers filled to h. An item of size s goes
into the open container, or a new one, that makes the sum of the squares of
``levels`` least; that keeps containers of every level about, so that a later item
finds one that it fills up. Placing an item is one pass over the level array.

Every task packs its own items and carries its level array and the numbers of its
open containers. It looks ahead a stated number of items and takes the larger ones
of those first; with a look-ahead of 1 it takes them as they come. Containers that
are still open when a task ends are emptied: what they hold goes into a second
packing, over groups of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.bpe import VOCABULARY, encoder_of, shipped
from fathom.session import checkpointed

CAPACITY = 2048
#: Items that a task looks ahead, and tasks whose open containers are packed together.
LOOKAHEAD, TASKS = 10_000, 64


class SumOfSquares:
    """Containers of one stream of items."""

    def __init__(self, capacity: int, first: int = 0):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.next = first

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill level before) for an item of 1 to capacity."""
        c, n = self.capacity, self.levels
        if size == c:
            return self._new(), 0
        # Twice the change of the sum of squares, for the levels 1 to c - size that have a container.
        cost = 2 * (n[1 + size : c + 1] - n[1 : c - size + 1] + 1)
        cost[-1] = 1 - 2 * n[c - size]
        cost[n[1 : c - size + 1] == 0] = 1 << 40
        h = c - size - int(np.argmin(cost[::-1]))  # the fullest of equals
        if cost[h - 1] > 2 * n[size] + 1:
            box, h = self._new(), 0
        else:
            box = self.open[h].pop()
            n[h] -= 1
        if h + size < c:
            n[h + size] += 1
            self.open[h + size].append(box)
        return box, h


def pieces(size: int, capacity: int) -> list[int]:
    """An item that exceeds the capacity is cut into full containers and one rest; any other stays whole."""
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * (rest > 0)


class _Ahead:
    """Places items of one stream, the larger of each so many first."""

    def __init__(self, boxes: SumOfSquares, ahead: int):
        self.boxes, self.ahead = boxes, max(1, ahead)
        self.held: list[tuple] = []

    def put(self, items: list[tuple]) -> Iterator[list[tuple]]:
        """Items are tuples that begin with a size and end in what tells them apart; they come back with container and level before."""
        for lo in range(0, len(items), self.ahead):
            self.held += items[lo : lo + self.ahead]
            while len(self.held) >= self.ahead:
                now, self.held = self.held[: self.ahead], self.held[self.ahead :]
                yield self._place(now)

    def rest(self) -> list[tuple]:
        now, self.held = self.held, []
        return self._place(now)

    def _place(self, items: list[tuple]) -> list[tuple]:
        order = sorted(range(len(items)), key=lambda k: (-items[k][0], k))
        return [(*items[k], *self.boxes.place(items[k][0])) for k in order]


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY, lookahead: int = LOOKAHEAD, tasks: int = TASKS) -> DataFrame:
    """key, piece (int, from 0), container (long), token_start, n_tokens, at (int: fill level before the piece).

    Sizes are tokens of the vocabulary at ``path``. Null and empty texts are left
    out. Repeated rows are items of their own. ``token_start`` is the first token
    of the piece within its document. The first packing is kept by a checkpoint, as
    its open containers and its pieces are read apart; only numbers are shuffled.
    """
    if capacity < 1 or lookahead < 1 or tasks < 1:
        raise ValueError("capacity, lookahead and tasks must be at least 1")
    names = [key, "piece", "container", "token_start", "n_tokens", "at"]
    schema = T.StructType([T.StructField(c, df.schema[key].dataType if c == key else T.LongType() if c == "container" else T.IntegerType()) for c in names])
    shared = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        boxes = SumOfSquares(capacity, TaskContext.get().partitionId() << 40)
        ahead = _Ahead(boxes, lookahead)
        kind = pa.null()

        def told(rows: list[tuple]) -> pa.RecordBatch:
            size, start, piece, k, box, at = map(list, zip(*rows)) if rows else ([],) * 6
            return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(piece, pa.int32()), pa.array(box, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(at, pa.int32())], names=names)

        for b in batches:
            kind = b.column(0).type
            sizes = [enc.count(x.as_py()) for x in b.column(1)]
            keys = b.column(0).to_pylist()
            for placed in ahead.put([(s, capacity * p, p, k) for k, n in zip(keys, sizes) for p, s in enumerate(pieces(n, capacity))]):
                yield told(placed)
        if kind != pa.null():
            yield told(ahead.rest())
            # What is open at the end: a container and no piece.
            left = [box for h in range(1, capacity) for box in boxes.open[h]]
            none = pa.nulls(len(left), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left), kind), none, pa.array(left, pa.int64()), none, none, none], names=names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = _Ahead(SumOfSquares(capacity, (1 << 62) + (TaskContext.get().partitionId() << 40)), lookahead)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int32()))], names=["container", "at", "moved", "below"])

        for b in batches:
            for placed in ahead.put(list(zip(*(b.column(c).to_pylist() for c in ("n_tokens", "container", "at"))))):
                yield told(placed)
        yield told(ahead.rest())

    first = checkpointed(df.select(F.col(key), F.col(text)).where(F.length(text) > 0).mapInArrow(run, schema))
    groups = max(1, -(-first._jdf.rdd().getNumPartitions() // tasks))
    found = first.where("n_tokens is not null")
    loose = found.select("container", "at", "n_tokens").join(first.where("n_tokens is null").select("container"), "container", "left_semi")
    # A piece is told apart by its container and place. In one order, so that a lost task finds the same places again.
    ordered = loose.repartition(groups, "container").sortWithinPartitions("container", "at")
    moved = ordered.mapInArrow(again, "container long, at int, moved long, below int")
    out = found.join(moved, ["container", "at"], "left")
    return out.select(key, "piece", F.coalesce("moved", "container").alias("container"), "token_start", "n_tokens", F.coalesce("below", "at").alias("at"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, pieces, tokens and the share of space that is used (0 to 1; null if there is no container)."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("used_share")
    )
