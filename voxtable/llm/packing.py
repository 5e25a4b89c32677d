"""Packing documents into sequences by patterns and non-negative least squares (operator 4).

The histogram of piece lengths, at most ``capacity`` numbers whatever the corpus, is all that reaches the driver.
There, patterns of two to four lengths that fill a sequence exactly are enumerated, repeat counts are fitted to
the histogram by non-negative least squares (accelerated projected gradient over the sparse patterns) and rounded as far as
pieces last; the residual is packed by best fit, longest first, on counts. The resulting plan speaks of
ranges: the pieces of one length with ranks r to r + m lie at one offset of sequences s to s + m. In Spark each
piece gets its rank among those of its length (a count per task, then a running sum over tasks) and looks up its place.

Edge cases. Null text counts as empty; every document has at least its separator. Documents over the capacity are
cut, the first piece takes the remainder. Rows may repeat and doc_id may be null: each row is placed.
Empty tables give no rows. Other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PIECES, Codec, batches
from .common import spool, table, text_or_empty

CAPACITY, SEPARATOR, ROUNDS = 2048, 0, 400


def piece_lengths(total: int, capacity: int) -> list[int]:
    """A document of ``total`` ids in pieces; only the first may be short."""
    if total <= capacity:
        return [total]
    rest = total % capacity
    return [rest] * bool(rest) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth[, ids]) of each piece; nth counts the pieces of a
    length within the task ``part``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, part = Codec.of(path), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        end = np.array([separator], "<u4")
        names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
        for frame in frames:
            out, keys = [], iter(frame["id"])
            for batch in batches(frame["text"], PIECES):
                for encoded, key in zip(codec.encode_all(batch), keys):
                    ids, start = np.concatenate((encoded, end)), 0
                    for k, length in enumerate(piece_lengths(len(ids), capacity)):
                        own = ids[start : start + length]
                        row = (key, k, start, length, zlib.crc32(own.tobytes()), part, met[length])
                        out.append(row + (own.astype("int32"),) if with_ids else row)
                        met[length] += 1
                        start += length
            yield pd.DataFrame(out, columns=names)

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"))
    kind = "id string, piece int, start long, length int, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return rows.mapInPandas(run, kind)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of four lengths, descending and filled up with 0, that sum to ``capacity``; ``present`` tells by length
    which occur. For each longest length the rest goes to one piece, or is split at a few ratios."""
    longest = np.flatnonzero(present)
    longest = longest[(longest < capacity) & (longest * 4 >= capacity)]
    rest = capacity - longest
    none = np.zeros_like(rest)
    made = [np.stack((longest, rest, none, none), axis=1)]
    for share in (1 / 2, 3 / 5, 2 / 3, 3 / 4, 5 / 6, 9 / 10):
        second = np.floor(rest * share).astype(int)
        made.append(np.stack((longest, second, rest - second, none), axis=1))
    for a, b in ((1 / 3, 1 / 3), (1 / 2, 1 / 4), (3 / 5, 1 / 4)):
        second, third = np.floor(rest * a).astype(int), np.floor(rest * b).astype(int)
        made.append(np.stack((longest, second, third, rest - second - third), axis=1))
    made = -np.sort(-np.concatenate(made), axis=1)
    made = np.unique(made, axis=0)
    return made[(made.sum(axis=1) == capacity) & (present[made] | (made == 0)).all(axis=1) & (made[:, 1] > 0)]


def least_squares(columns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that minimises ||A x - counts||, A[l, j] = how often pattern j has length l > 0.
    Accelerated projected gradient with restarts; A has at most four entries a column."""
    size, (n, width) = len(counts), columns.shape

    def times(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, k], weights=x, minlength=size) for k in range(width))
        out[0] = 0
        return out

    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue of A'A, for the step
        r = times(v)
        v = r[columns].sum(axis=1)
        norm = np.linalg.norm(v)
        v = v / max(norm, 1e-12)
    step = 1 / max(norm * 1.05, 1e-9)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        error = times(y) - counts
        error[0] = 0
        slope = error[columns].sum(axis=1)
        new = np.maximum(0, y - step * slope)
        if slope @ (new - x) > 0:
            t = 1.0
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / faster * (new - x)
        x, t = new, faster
    return x


class Plan:
    """Ranges (length, first rank, how many, first sequence, offset) that place every piece."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def open(self, many: int) -> int:
        first, self.sequences = self.sequences, self.sequences + many
        return first

    def place(self, length: int, many: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), many, sequence, offset))
        self.used[length] += many
        self.left[length] -= many


def by_patterns(plan: Plan, capacity: int) -> None:
    """Use up what the fitted patterns cover."""
    columns = patterns(plan.left > 0, capacity)
    if not len(columns):
        return
    fitted = least_squares(columns, plan.left.astype(float))
    for j in np.argsort(-fitted, kind="stable"):
        lengths = [int(x) for x in columns[j] if x]
        many = int(round(fitted[j]))
        if not many:
            break
        need = {x: lengths.count(x) for x in lengths}
        many = min([many, *(int(plan.left[x]) // k for x, k in need.items())])
        if many > 0:
            first, offset = plan.open(many), 0
            for x in lengths:
                plan.place(x, many, first, offset)
                offset += x


def by_best_fit(plan: Plan, capacity: int) -> None:
    """Longest first, each into the fullest open sequences that take it; equal sequences are one range."""
    spaces: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space: (first sequence, many)
    for length in range(capacity, 0, -1):
        space = length
        while plan.left[length]:
            while space <= capacity and not spaces[space]:
                space += 1
            if space > capacity:
                fresh = capacity // length  # copies of its own that a new sequence takes
                many = -(-int(plan.left[length]) // fresh)
                spaces[capacity].append((plan.open(many), many))
                space = capacity
            first, there = spaces[space].pop()
            many = min(there, int(plan.left[length]))
            if many < there:
                spaces[space].append((first + many, there - many))
            plan.place(length, many, first, capacity - space)
            spaces[space - length].append((first, many))
            if space - length >= length:
                space -= length


def plan_for(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """counts[l]: pieces of length l. Every piece is placed, no sequence has a gap or over ``capacity``."""
    plan = Plan(counts)
    by_patterns(plan, capacity)
    by_best_fit(plan, capacity)
    return plan


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = spool(pieces(docs, path, capacity, separator, with_ids))
    per_task = spool(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    rows = np.array(sorted(plan_for(counts, capacity).rows), np.int64).reshape(-1, 5)
    stride = int(counts.max()) + 1  # (length, rank) as one number
    starts, sequences, offsets = rows[:, 0] * stride + rows[:, 1], rows[:, 3] - rows[:, 1], rows[:, 4]

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy(np.int64) * stride + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy(), "offset": offsets[at]})

    place.__annotations__ = {"length": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the counts of all tasks grow with the input: a shuffle, never a broadcast
    placed = cut.join(base.hint("merge"), ["part", "length"]).withColumn(
        "place", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("base") + F.col("nth"))
    )
    return placed.select(
        F.col("id").cast(kind).alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"),
        "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * with_ids,
    )


def assemble(packed: DataFrame) -> DataFrame:
    """pack(with_ids=True) -> sequence_id, doc_ids, ids: the token ids of each sequence, which the capacity bounds."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("all")).select(
        "sequence_id", F.col("all.doc_id").alias("doc_ids"), F.flatten("all.ids").alias("ids")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_packing": op4_packing}
