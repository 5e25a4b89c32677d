"""Substring dedup by paragraph MinHash banding and repeated passages (operator 9).

A paragraph is a line (``\\n``-split) of at least MIN_WORDS words, 50 by default: passages, not slogans
or licence lines. Bands are tuned for a recall over 0.999 at the threshold; paragraphs that collide in a
band are joined and verified by the exact Jaccard index of their five-word shingles, or by edit distance
(``measure="edit"``: 1 - distance / longer length); clusters are connected components of
verified pairs. Of each cluster the first occurrence stays, by (doc_id, line); all others are marked.

Passages. Lines of any length are also searched as one run of words a document: every run of MIN_WORDS words
or more that stands word for word at two places is found, across lines and within them. Windows chosen by content
(shingles.anchors) tell which stretches can hold such a run; there every window of MIN_WORDS words is compared by
hash. The first place of each window stays, the rest are marked; windows that meet make one row, with the
line in which it starts. Lines that go as a whole part the text; what a passage has beside such a line makes a row if it
is MIN_WORDS words or more itself.
A row of passages bears the cluster of its first window; rows that stay and rows that go may overlap.

Edge cases. Null text counts as empty. A null doc_id orders before all others. Rows with the same doc_id
and text count as one row. Empty tables give no rows; texts of one long line are one paragraph. Other
columns pass through remove() untouched, n_chars (where there is one) is counted anew for cut texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import release, spool, table, text_or_empty
from .components import components
from .neardup import PairChecker, candidate_components, into_blocks, text_key, verified_links
from .shingles import Words, anchors, band_keys, minhash_runs, portions, rolling_hashes, tune_bands, window_hashes, word_hashes, word_spans

SIZE, THRESHOLD, MISS, LANES, TOLERANCE, BLOCK, MIN_WORDS = 5, 0.8, 1e-3, 20, 1e-6, 256, 50
#: Windows of passages that leave a Python worker at once; a longer text's leave alone.
PORTION = 1 << 17


PARAGRAPH = "line int, start long, end long, n_words int, key binary, bands array<bigint>"
ANCHOR = "pos int, line int, h long"


def _lists(owner: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each of ``n`` rows; ``owner`` ascends and tells whose each struct is."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _surveyed(texts: list[bytes], size: int, least: int, bands: int, rows: int) -> list[pa.Array]:
    """Words, code points, paragraphs and anchors of each text."""
    many, n = Words(texts), len(texts)
    raw = np.frombuffer(many.data, np.uint8)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    tails = many.offsets + np.array([len(t) for t in texts], np.int64)
    start, end, owner = many.lines()
    first = np.append(np.searchsorted(many.start, start), len(many.start))
    count = np.diff(first)
    chosen = np.flatnonzero(count >= least)
    numbers = np.arange(len(start)) - np.searchsorted(owner, np.arange(n))[owner]
    if len(chosen):
        runs = window_hashes(many.hashes, size)
        keys = minhash_runs(runs, first[chosen], first[chosen] + count[chosen] - min(size, least) + 1, bands * rows)
        bound = band_keys(keys, bands, rows).view("int64").ravel()
    else:
        bound = np.empty(0, np.int64)
    base = points[many.offsets[owner[chosen]]]
    found = {
        "line": pa.array(numbers[chosen].astype(np.int32)),
        "start": pa.array(points[start[chosen]] - base),
        "end": pa.array(points[end[chosen]] - base),
        "n_words": pa.array(count[chosen].astype(np.int32)),
        "key": pa.array([blake2b(many.data[a:b], digest_size=16).digest() for a, b in zip(start[chosen], end[chosen], strict=True)], pa.binary()),
        "bands": pa.ListArray.from_arrays(pa.array((np.arange(len(chosen) + 1) * bands).astype(np.int32)), pa.array(bound)),
    }
    at, marks = anchors(many.hashes, least, many.within(least))
    holder = np.searchsorted(many.first[1:], at, "right")
    line = np.searchsorted(start, many.start[at], "right") - 1
    noted = {
        "pos": pa.array((at - many.first[holder]).astype(np.int32)),
        "line": pa.array(numbers[line].astype(np.int32)),
        "h": pa.array(marks.view("int64")),
    }
    return [
        pa.array(np.diff(many.first)), pa.array(points[tails] - points[many.offsets]),
        _lists(owner[chosen], n, found), _lists(holder, n, noted),
    ]


def survey(docs: DataFrame, size: int, least: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_words, n_points, paragraphs (lines of ``least`` words and more) and anchors of each row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for low, high in portions(texts):
                part = batch.slice(low, high - low)
                made = _surveyed(texts[low:high], size, least, bands, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *made], [*names])

    names = ("doc_id", "text_key", "n_words", "n_points", "paragraphs", "anchors")
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key binary, n_words long, n_points long, paragraphs array<struct<{_typed(PARAGRAPH)}>>, anchors array<struct<{_typed(ANCHOR)}>>"
    )


def _typed(columns: str) -> str:
    return ", ".join(c.strip().replace(" ", ":", 1) for c in columns.split(","))


def _edit_likeness(a: str, b: str, least: float) -> float:
    """1 - Levenshtein distance / longer length; 0 once it must be under ``least``."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    if min(len(a), len(b)) < least * longest:
        return 0.0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - steps) + steps
    return 1 - int(row[-1]) / longest


class EditChecker(PairChecker):
    """Verifies candidates by edit distance instead; the shingle pairs are candidates only."""

    def __init__(self, likeness: float, threshold: float, *rest):
        super().__init__(threshold, *rest)
        self.likeness = likeness

    def pairs(self, texts, side):
        for i, j in super().pairs(texts, side):
            if _edit_likeness(texts[i], texts[j], self.likeness) >= self.likeness:
                yield i, j


def _place_key(key: Column) -> Column:
    """The leading 60 bits of a text's key, in the same order."""
    return F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("long")


def _windows_of(text: str, size: int, hits: list[int], gone: list[int], near: list[int]) -> list[np.ndarray] | None:
    """Position, hash, code points from and to, line, and whether it only serves as a source, of each window of ``size``
    words near ``hits`` that has no word of the lines ``gone``, or lies in one of ``near``."""
    data = text.encode("utf-8", "surrogatepass")
    starts, ends = word_spans(data)
    n = len(starts)
    if n < size:
        return None
    raw = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, starts)
    count = lambda on: np.concatenate(([0], np.cumsum(on)))
    hit = np.zeros(n, bool)
    hit[np.asarray(hits)] = True
    hit, cut = count(hit), count(np.isin(line, gone))
    at = np.arange(n - size + 1)
    source = (line[at] == line[at + size - 1]) & np.isin(line[at], near)
    at = at[(hit[at + size - (size + 1) // 2 + 1] > hit[at]) & ((cut[at + size] == cut[at]) | source)]
    points = np.cumsum((raw & 0xC0) != 0x80) - 1
    found = rolling_hashes(word_hashes(data, (starts, ends)), size)[at].view("int64")
    return [at, found, points[starts[at]], points[ends[at + size - 1] - 1] + 1, line[at], source[at]]


def _as_frame(ids: list[str], doc_keys: list[int], parts: list[list[np.ndarray]]) -> pd.DataFrame:
    """The windows of several texts as one frame."""
    times = [len(x[0]) for x in parts]
    values = dict(zip(("pos", "h", "start", "end", "line", "source"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
    return pd.DataFrame({"id": np.repeat(np.array(ids, object), times), "doc_key": np.repeat(doc_keys, times), **values})


def _number() -> Column:
    """A number of a row's doc_id and text."""
    return F.xxhash64("doc_id", "doc_key")


def _repeated(rows: DataFrame, hashes: str = "h") -> DataFrame:
    """The rows whose hash occurs in more than one. Counted in part before the shuffle; a hot hash's rows are joined to one
    row of a table, a join that adaptive execution can split."""
    common = spool(rows.groupBy(hashes).agg(F.count("*").alias("n")).where("n > 1").select(hashes))
    return rows.join(common.hint("merge"), hashes)


def copies_of(seen: DataFrame, least: int) -> DataFrame:
    """(doc_id, doc_key, text_key, first_id, n_words, n_points) of each row with ``least`` words or more whose text another doc_id has, too."""
    rows = seen.where(F.col("n_words") >= least).select("doc_id", "doc_key", "text_key", "n_words", "n_points").distinct()
    # a struct, as a null doc_id comes first
    many = spool(rows.groupBy("text_key").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(many.hint("merge"), "text_key").select(*rows.columns, F.col("first.doc_id").alias("first_id"))


def passages(held: DataFrame, anchored: DataFrame, lines: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """All runs of ``size`` words and more that stand at two places outside the lines that go.

    held (doc, doc_id, doc_key, text): the texts with an anchor that another place has, anchored (doc, pos, line, h): these
    anchors; lines (doc, line, near: unlike the line that stays): those that go.
    -> doc_id, doc_key, line, start, end, n_words, cluster_id, removed."""
    kind = held.schema["doc_id"].dataType.simpleString()
    barred = lines.where("not near").select("doc", "line").distinct()
    # a second count without the lines that go: most of what is shared is shared with these
    left = _repeated(spool(anchored.join(barred.hint("merge"), ["doc", "line"], "left_anti")))
    hits = left.groupBy("doc").agg(F.collect_set("pos").alias("hits"))
    cuts = lines.groupBy("doc").agg(F.collect_set("line").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("near"))
    noted = spool(hits.join(cuts, "doc", "left"))

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, doc_keys, parts, many = [], [], [], 0
            for i, key, text, at, gone, near in zip(*(frame[c] for c in ("id", "doc_key", "text", "hits", "gone", "near")), strict=True):
                made = _windows_of(text, size, at, [] if gone is None else gone, [] if near is None else near)
                if made is None:
                    continue
                # memory follows PORTION and the longest text, not the number of texts in a frame
                if parts and many + len(made[0]) > PORTION:
                    yield _as_frame(ids, doc_keys, parts)
                    ids, doc_keys, parts, many = [], [], [], 0
                ids.append(i)
                doc_keys.append(key)
                parts.append(made)
                many += len(made[0])
            if parts:
                yield _as_frame(ids, doc_keys, parts)

    texts = held.select(F.col("doc_id").cast("string").alias("id"), "doc_key", "doc", "text").join(noted.hint("merge"), "doc")
    made = texts.mapInPandas(windows, "id string, doc_key long, pos int, h long, start int, end int, line int, source boolean")
    place = F.struct("doc_id", "doc_key", "pos")
    rows = spool(made.withColumn("doc_id", F.col("id").cast(kind)).drop("id"))
    upon = lambda p: F.col("first.doc_id").eqNullSafe(p["doc_id"]) & (F.col("first.doc_key") == p["doc_key"]) & (p["pos"] < F.col("first.pos") + size)
    # a window that overlaps its own first place is no second one
    alike = spool(
        rows.groupBy("h").agg(F.min(place).alias("first"), F.max(F.when(~F.col("source"), place)).alias("last"))
        .where(F.col("last").isNotNull() & ~upon(F.col("last"))).drop("last")
    )
    found = spool(rows.join(alike.hint("merge"), "h").withColumn("removed", ~upon(place)).drop("h"))
    release(rows, noted, alike)
    order = Window.partitionBy("doc_id", "doc_key", "removed").orderBy("pos")

    def islands(df: DataFrame) -> DataFrame:
        begins = F.coalesce(F.col("pos") > F.lag("pos").over(order) + size, F.lit(True)).cast("int")
        return df.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order)).groupBy("doc_id", "doc_key", "removed", "island")

    origins = spool(
        islands(found.where("not removed"))
        .agg(F.min("pos").alias("least"), F.max("pos").alias("most"))
        .select(
            F.col("doc_id").alias("o_id"), F.col("doc_key").alias("o_key"), "least", "most",
            F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), "doc_key", "least")).alias("cluster_id"),
        )
    )
    spans = spool(
        islands(found.where("not source")).agg(
            F.min("line").alias("line"), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
            (F.max("pos") + size - F.min("pos")).alias("n_words"), F.min(F.struct("pos", "first"))["first"].alias("first"),
        )
    )
    release(found)
    inside = (F.col("first.doc_key") == F.col("o_key")) & F.col("first.doc_id").eqNullSafe(F.col("o_id")) & F.col("first.pos").between(F.col("least"), F.col("most"))
    return spans.join(origins, inside).select("doc_id", "doc_key", "line", "start", "end", "n_words", "cluster_id", "removed")


def repeats(
    docs: DataFrame,
    size: int = SIZE,
    threshold: float = THRESHOLD,
    miss: float = MISS,
    tolerance: float = TOLERANCE,
    least: int = MIN_WORDS,
    block: int = BLOCK,
    measure: str = "jaccard",
    likeness: float = 0.8,
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, doc_key, line, start, end, n_words, cluster_id, removed: a row
    for each occurrence of a paragraph, passage or whole text whose cluster has more than one; start and end are code
    points of the text, end exclusive; cluster_id is the hex key of the cluster's least paragraph or of the text, or names
    the first place of a passage; doc_key is the leading part of the text's key."""
    if measure not in ("jaccard", "edit"):
        raise ValueError("measure is jaccard or edit")
    bands, rows = tune_bands(threshold, miss, LANES)
    seen = spool(survey(docs, size, least, bands, rows).withColumn("doc_key", _place_key(F.col("text_key"))).withColumn("doc", _number()))
    copies = spool(copies_of(seen, least))
    again = copies.where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(_number().alias("doc"))
    found = seen.select("doc_id", "doc_key", "doc", F.explode("paragraphs").alias("p")).select("doc_id", "doc_key", "doc", "p.*")
    place = F.struct("doc_id", "doc_key", "line")
    classes = spool(
        found.groupBy("key").agg(F.min(place).alias("at"), F.max(place).alias("last"), F.min(F.struct("doc_id", "doc_key", "line", "doc"))["doc"].alias("doc"), F.first("bands").alias("bands"))
    )
    near = candidate_components(classes.select("key", "bands"))
    wanted = spool(near.join(classes.select(F.col("key").alias("node"), F.col("at.line").alias("line"), "doc"), "node"))
    by_doc = spool(wanted.groupBy("doc").agg(F.collect_list(F.struct("node", "component", "line")).alias("lines")))
    anchored = spool(_repeated(seen.select("doc", F.explode("anchors").alias("a")).select("doc", "a.*")).join(again.hint("merge"), "doc", "left_anti"))
    # the texts that are looked at again move once; always by a shuffle, so that the plan is the same at every size
    needed = by_doc.select("doc").union(anchored.select("doc")).distinct()
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("doc_key", _place_key(text_key(F.col("text")))).withColumn("doc", _number())
    held = spool(texts.join(needed.hint("merge"), "doc"))
    split = held.join(by_doc.hint("merge"), "doc").withColumn("all", F.split("text", "\n", -1))
    members = split.select(F.explode("lines").alias("p"), "all").select(
        "p.node", "p.component", F.element_at("all", F.col("p.line") + 1).alias("text")
    )
    sizes = spool(wanted.groupBy("component").agg(F.count("*").alias("n")))
    basis = (threshold, size, bands, rows, tolerance, rows)
    checker = PairChecker(*basis) if measure == "jaccard" else EditChecker(likeness, *basis)
    links = spool(verified_links(into_blocks(members, block, sizes), checker))
    release(by_doc, wanted, sizes)
    groups = components(links, "key", "peer").withColumnRenamed("node", "key")
    named = spool(
        classes.select("key", "at", "last")
        .join(groups, "key", "left")
        .select("key", "at", F.coalesce("component", "key").alias("cluster"), (F.col("at") != F.col("last")).alias("many"))
    )
    heads = spool(
        named.groupBy("cluster").agg(F.min("at").alias("kept"), F.count("*").alias("n"), F.max("many").alias("many"))
        .where("n > 1 or many").select("cluster", "kept")
    )
    marked = spool(named.select("key", "cluster", "at").join(heads, "cluster"))
    lines = spool(
        found.drop("bands").join(marked, "key").join(again.hint("merge"), "doc", "left_anti").select(
            "doc_id", "doc_key", "doc", "line", "start", "end", "n_words",
            F.lower(F.hex("cluster")).alias("cluster_id"), (~place.eqNullSafe(F.col("kept"))).alias("removed"),
            (F.col("at") != F.col("kept")).alias("near"),
        )
    )
    release(seen, classes, links, named, heads, marked)
    spans = passages(held, anchored, lines.where("removed").select("doc", "line", "near"), least)
    whole = copies.select(
        "doc_id", "doc_key", F.lit(0).alias("line"), F.lit(0).cast("long").alias("start"), F.col("n_points").alias("end"),
        F.col("n_words").cast("int").alias("n_words"), F.lower(F.hex("text_key")).alias("cluster_id"), (~F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("removed"),
    )
    return lines.drop("near", "doc").unionByName(spans).unionByName(whole)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans of code points; lines of which nothing is left go with their breaks."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        while k < len(merged) and merged[k][1] < at:
            k += 1
        pieces, begin, j, cut = [], at, k, False
        while j < len(merged) and merged[j][0] <= end:
            low, high = max(merged[j][0], at), min(merged[j][1], end)
            if low < high or (merged[j][0] < at and merged[j][1] > end):
                pieces.append(text[begin:low])
                begin, cut = high, True
            j += 1
        if not cut:
            out.append(line)
        else:
            left = [p for p in (*(x.strip(" \t\r\v\f") for x in (*pieces, text[begin:end])),) if p]
            if left:
                out.append(" ".join(left))
        at = end + 1
    return "\n".join(out)


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)


# else Spark copies the call into the filter on its result, and each task cuts twice, in two Python workers at once
_cut = _cut.asNondeterministic()


def remove(docs: DataFrame, **options) -> DataFrame:
    """docs with the removed paragraphs and passages cut out of their texts. A document left without a word goes."""
    gone = spool(
        repeats(docs, **options).where("removed")
        .groupBy(F.col("doc_id").alias("cut_id"), F.col("doc_key").alias("cut_key"))
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )
    # the rows as structs, whatever their columns are called
    hashed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _place_key(text_key(text_or_empty())).alias("text_key"))
    met = (F.col("text_key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    joined = hashed.join(gone.hint("merge"), met, "left")
    whole = F.col("spans").isNull()
    left = joined.withColumn("left", _cut(F.when(~whole, F.col("row.text")), F.col("spans")))
    cut = left.withColumn("cut", F.when(whole, F.col("row.text")).otherwise(F.col("left")))
    out = cut.where(whole | F.col("cut").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("cut").cast(kind))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_paragraph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a paragraph that repeats, exactly or nearly, with its cluster and verdict."""
    return repeats(table(spark, sf_dir, "documents")).drop("doc_key")


def remove_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove(docs)


QUERIES = {"op9_paragraph_repeats": op9_paragraph_repeats}
