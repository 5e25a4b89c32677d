"""Near-duplicate search over distinct texts: band buckets, candidate components, block-wise checks.

The flow keeps every group divisible. Texts that are equal enter once. Each bucket of equal band
keys becomes a star around its least key, the stars' components hold every pair that shares a
bucket, and a component of n texts is cut into ceil(n / block) hashed blocks; one task at a time
sees two blocks. Pairs are counted where they are found and only a spanning forest of them
leaves a task, so a large group costs rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, shuffle_parts, spool
from .components import components
from .shingles import band_keys, minhash, shingles


def text_key(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text: equal texts, equal keys."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def least_matches(threshold: float, tolerance: float, lanes: int, step: int) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on) after each ``step`` MinHash values.

    With a uniform prior the resemblance J after m matches of n has the posterior
    Beta(m + 1, n - m + 1), and P(J >= t) = P(Binomial(n + 1, t) <= m). A pair is dropped as soon
    as that falls below ``tolerance``.
    """
    table = []
    for n in range(step, lanes + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table.append((n, m))
    return table


def candidate_components(items: DataFrame) -> DataFrame:
    """items (key, bands) -> (node, component) of the graph that joins each bucket's members to its
    least key. Keys alone in all their buckets do not appear.

    A key's edges, one a band at most, are thinned before the rounds: it keeps the edge to the least of
    its buckets' first keys, and the other first keys are joined to that one. As a group's members share their first
    keys, the edges that remain follow the members and not the bands.
    """
    banded = items.select("key", F.explode("bands").alias("band"))
    shared = spool(banded.groupBy("band").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    stars = banded.join(shared, "band").where("key <> first")
    firsts = stars.groupBy("key").agg(F.min("first").alias("least"), F.collect_set("first").alias("firsts"))
    # one group by key serves both kinds of edge
    ends = F.filter("firsts", lambda x: x != F.col("least"))
    edges = spool(firsts.select("least", F.explode(F.concat(F.array("key"), ends)).alias("src")).distinct())
    found = components(edges, "src", "least")
    release(shared, edges)
    return found


def into_blocks(members: DataFrame, block: int, sizes: DataFrame) -> DataFrame:
    """members (node, component, ...) and sizes (component, n) -> each member once for every pair of
    blocks that its block is in."""
    dealt = (
        members.join(sizes, "component")
        .withColumn("n_blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), "n_blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    )
    return dealt.select(
        "node", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        *[c for c in members.columns if c not in ("node", "component")],
    )


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted distinct arrays, neither empty."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


class PairChecker:
    """Finds the pairs at or over ``threshold`` between two blocks of texts."""

    def __init__(self, threshold: float, size: int, bands: int, rows: int, tolerance: float, step: int):
        self.threshold, self.size, self.bands, self.rows, self.step = threshold, size, bands, rows, step
        self.lanes = bands * rows
        self.go_on = least_matches(threshold, tolerance, self.lanes, step)

    def pairs(self, texts: list[str], side: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Index pairs; ``side`` parts the two blocks, None means that there is one."""
        sets = [shingles(t, self.size) for t in texts]
        full = [i for i, x in enumerate(sets) if len(x)]
        if len(full) < 2:
            return
        sizes = np.array([len(sets[i]) for i in full])
        signs = np.stack([minhash(sets[i], self.lanes) for i in full])
        keys = band_keys(signs, self.bands, self.rows)
        part = None if side is None else side[full]
        for i in range(len(full)):
            if part is None:
                near = np.arange(i + 1, len(full))
            elif part[i] == 0:
                near = np.flatnonzero(part == 1)
            else:
                continue
            near = near[(keys[near] == keys[i]).any(axis=1)]
            matches = np.zeros(len(near), np.int64)
            for seen, least in self.go_on:
                matches += (signs[near, seen - self.step : seen] == signs[i, seen - self.step : seen]).sum(axis=1)
                stay = matches >= least
                near, matches = near[stay], matches[stay]
            ratio = np.minimum(sizes[near], sizes[i]) / np.maximum(sizes[near], sizes[i])
            for j in near[ratio >= self.threshold]:
                if resemblance(sets[full[i]], sets[full[j]]) >= self.threshold:
                    yield full[i], full[int(j)]


def forest_and_counts(keys: list, pairs: Iterator[tuple[int, int]]) -> list[tuple]:
    """(key, a linked key that leads to the root, number of links) of each key that has links."""
    root, links = list(range(len(keys))), [0] * len(keys)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return [(keys[i], keys[top(i)], n) for i, n in enumerate(links) if n]


def verified_links(dealt: DataFrame, checker: PairChecker) -> DataFrame:
    """dealt: into_blocks() with a column ``text`` -> (key, peer, links): the links of each text
    within one pair of blocks, and a peer that it is connected to."""
    keys = ["component", "low", "high"]

    def check(rows: list[tuple]) -> list[tuple]:
        own = {}
        for node, side, text in rows:
            own.setdefault(node, (side, text))
        nodes = sorted(own)
        if len(nodes) < 2:
            return []
        sides = np.array([own[n][0] for n in nodes])
        return forest_and_counts(nodes, checker.pairs([own[n][1] for n in nodes], sides if sides.any() else None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []

        def flush() -> pd.DataFrame | None:
            found = check(rows)
            return pd.DataFrame(found, columns=["key", "peer", "links"]) if found else None

        for frame in frames:
            cols = [frame[c] for c in ("component", "low", "high", "own", "node", "text")]
            for component, low, high, own, node, text in zip(*cols, strict=True):
                component, node = bytes(component), bytes(node)
                if (component, low, high) != at:
                    if (out := flush()) is not None:
                        yield out
                    at, rows = (component, low, high), []
                # the blocks of a pair are told apart by 0 and 1; a block with itself is all 0
                rows.append((node, int(own != low), text))
        if (out := flush()) is not None:
            yield out

    placed = dealt.repartition(shuffle_parts(dealt.sparkSession), *keys).sortWithinPartitions(*keys)
    return placed.select(*keys, "own", "node", "text").mapInPandas(run, "key binary, peer binary, links long")
