"""Similarity of vectors: centroids, assignment, pairs within bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise

SESSION = "session"


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """(label, c): the mean vector of each label, normalised; element sums meet, not vectors."""
    each = vectors.select(label, F.posexplode("v").alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("m"))
    listed = each.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("e"))
    return listed.select(label, l2_normalise(F.col("e.m")).alias("c"))


def _best(table):
    scores = F.transform(table, lambda r: F.struct(dot(F.col("v"), r["c"]).alias("s"), (-r["l"]).alias("back")))
    return F.array_max(scores)


def assigned(vectors: DataFrame, centres: DataFrame, label: str, few: int = 256) -> DataFrame:
    """Vectors with the most similar centre, the lowest label of equal ones. Up to ``few`` centres, at most few + 1 of which are
    collected, are held against each vector as a literal. More of them are dealt by hash to blocks of about ``few``, a row each: a vector
    meets every block, and the best of its blocks' best stays. Both ways give the same rows."""
    rows = centres.select(label, "c").limit(few + 1).collect()
    if len(rows) <= few:
        best = _best(F.array(*[F.struct(F.lit(r[0]).alias("l"), F.array(*map(F.lit, r[1])).alias("c")) for r in sorted(rows)]))
        return vectors.withColumn("_b", best).withColumns({"assigned": -F.col("_b.back"), "score": F.col("_b.s")}).drop("_b")
    n = -(-centres.count() // few)
    blocks = centres.groupBy(F.pmod(F.xxhash64(label), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct(F.col(label).alias("l"), "c")).alias("_t"))
    dealt = vectors.select(F.struct("*").alias("_row"), "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_block"))
    each = dealt.join(blocks, "_block").select("_row", _best(F.col("_t")).alias("_b"))
    # equal rows meet each block as often as they repeat
    best = each.groupBy("_row").agg(F.max("_b").alias("_b"), (F.count(F.lit(1)) / F.lit(blocks.count())).cast("int").alias("_times"))
    return best.select("_row.*", (-F.col("_b.back")).alias("assigned"), F.col("_b.s").alias("score"), F.explode(F.sequence(F.lit(1), "_times"))).drop("col")


def block_pairs(vectors: DataFrame, block: int = 512) -> DataFrame:
    """Each vector once for every pair of blocks of its session that it belongs to, so that no task sees more than two
    blocks, however large a session is."""
    own = F.floor(F.col("idx") / block)
    n = vectors.groupBy(SESSION).agg(F.max(own).alias("_last"))
    dealt = vectors.withColumn("_own", own).join(n, SESSION).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    return dealt.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).drop("_last", "_other")


SCHEMA = "session long, i long, j long, s double"


def _matrix(left, right):
    import numpy as np

    a, b = (np.stack(x["v"].to_numpy()).astype(float) for x in (left, right))
    return np.clip(a @ b.T, -1.0, 1.0)


def pairwise(vectors: DataFrame, block: int = 512) -> DataFrame:
    """(session, i, j, s) with i < j: cosine of all pairs within sessions, block by block."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        lo, hi = pdf[pdf["_own"] == key[1]].sort_values("idx"), pdf[pdf["_own"] == key[2]].sort_values("idx")
        if not len(lo) or not len(hi):
            return pd.DataFrame({"session": [], "i": [], "j": [], "s": []})
        s = _matrix(lo, hi)
        i, j = np.meshgrid(lo["idx"], hi["idx"], indexing="ij")
        keep = i < j
        return pd.DataFrame({"session": key[0], "i": i[keep], "j": j[keep], "s": s[keep]})

    return block_pairs(vectors.select(SESSION, "idx", "v"), block).groupBy(SESSION, "_lo", "_hi").applyInPandas(run, SCHEMA)


def similarity_summary(vectors: DataFrame, low: float = 0.4, block: int = 512) -> DataFrame:
    """Per session mean and deviation of the similarities of different rows, mean and median of the gap between each
    row's two best, and the number of rows whose best is under ``low``. Blocks report sums and two bests a row,
    never the pairs."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        lo, hi = pdf[pdf["_own"] == key[1]].sort_values("idx"), pdf[pdf["_own"] == key[2]].sort_values("idx")
        if not len(lo) or not len(hi):
            return pd.DataFrame({c: [] for c in names})
        s = _matrix(lo, hi)
        if key[1] == key[2]:
            np.fill_diagonal(s, np.nan)
            sides = [(lo, s)]
        else:
            sides = [(lo, s), (hi, s.T)]
        out = []
        for rows, m in sides:
            full = np.where(np.isnan(m), -np.inf, m)
            top = np.sort(full, axis=1)[:, ::-1][:, :2]
            second = top[:, 1] if top.shape[1] > 1 else np.full(len(rows), -np.inf)
            count = (~np.isnan(m)).sum(axis=1)
            out.append(pd.DataFrame({"session": key[0], "i": rows["idx"].to_numpy(), "total": np.nansum(m, axis=1), "squares": np.nansum(m * m, axis=1), "n": count, "a": top[:, 0], "b": second}))
        return pd.concat(out)

    names = ["session", "i", "total", "squares", "n", "a", "b"]
    parts = block_pairs(vectors.select(SESSION, "idx", "v"), block).groupBy(SESSION, "_lo", "_hi").applyInPandas(
        run, "session long, i long, total double, squares double, n long, a double, b double"
    )
    rows = parts.groupBy(SESSION, "i").agg(
        F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum("n").alias("n"),
        F.slice(F.sort_array(F.concat(F.collect_list("a"), F.collect_list("b")), asc=False), 1, 2).alias("best"),
    ).where("n > 0")
    top, second = F.col("best")[0], F.get("best", F.lit(1))
    gap = F.when(second == float("-inf"), 0.0).otherwise(top - second)
    out = rows.withColumn("gap", gap).groupBy(SESSION).agg(
        (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("squares") / F.sum("n")).alias("_q"), F.avg("gap").alias("gap_mean"),
        F.percentile("gap", F.lit(0.5)).alias("gap_median"), F.sum((top < low).cast("long")).alias("isolated"),
    )
    return out.withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("mean") * F.col("mean")))).drop("_q")
