"""Quality rules by weak supervision (operator 10), built-in functions only.

Ten rules vote +1 (good), -1 (bad) or abstain (0) on every document. Expectation-maximisation over the
counts of vote patterns (at most 3^10 of them, whatever the corpus) estimates each rule's accuracy on good and
on bad documents and the share of good ones; the posterior probability of being good replaces "all rules must pass". The
fit runs inside Spark as one fold over a single row; 21 numbers reach the driver.

Words are ``[^\\x20\\x09-\\x0D]+``. Windows of three words are compared by 64-bit hash within a text.
Per text everything takes time n log n and stays in its row: nothing is exploded.

Edge cases. Null text has no words. Empty, blank and short texts fail the base. Ties of words, lines and rows
need no order. An empty table fits the prior only and gives no rows. Other columns and
their names do not matter; keep() returns the columns that it got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table, text_or_empty

MIN_WORDS, MAX_REPEAT, THRESHOLD, ROUNDS = 50, 0.5, 0.5, 40
SPACE = "[\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(v) with v bound to ``value``, which is worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are none of ``characters``."""
    return F.length(F.translate(text, characters, ""))


def repeat_words(words: Column, size: int = 3) -> Column:
    """How many words lie in a window of ``size`` words that the text holds twice or more.

    Windows are sorted by hash; those equal to a neighbour repeat. The union of their spans, by start,
    grows by the distance to the start before, ``size`` at most.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, k: F.when(k == 0, F.lit(size)).otherwise(F.least(F.lit(size), s - F.get(starts, k - 1)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def repeated(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.get(ordered, k - 1)["h"]
            after = F.get(ordered, k + 1)["h"]
            return F.when((x["h"] == before) | (x["h"] == after), x["i"])

        return F.array_sort(F.filter(F.transform(ordered, twin), lambda i: i.isNotNull()))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = let(F.sort_array(placed), lambda o: let(repeated(o), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    return F.when(F.size(words) >= size, let(words, lambda w: let(windows(w), counted))).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """The rows of docs, each a struct ``row``, with the counts that the rules look at."""
    text = F.col("text")
    base = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty().alias("text"))
    split = base.withColumn("words", words_of(text)).withColumn(
        "lines", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    )
    size = F.length(text)
    return split.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        without(text, BLANKS).cast("long").alias("word_chars"),
        (size - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        (size - without(text, "|")).cast("long").alias("n_bars"),
        (size - without(text, "!")).cast("long").alias("n_bangs"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}][^\\x20\\x09-\\x0D]*")).cast("long").alias("n_symbol_words"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike('[.!?…:;"”»)]$'))).cast("long").alias("n_ended"),
    )


def votes() -> list[Column]:
    """+1, -1 or 0 of each rule; the bounds lie on either side of what prose shows."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def low(share: Column, good: float, bad: float, unless: Column | None = None) -> Column:
        vote = F.when(share <= good, 1).when(share > bad, -1).otherwise(0)
        return vote if unless is None else F.when(unless, 0).otherwise(vote)

    mean = chars / words
    return [
        low(F.col("n_symbols") / chars, 0.01, 0.04),
        low(F.col("n_dup_lines") / lines, 0.05, 0.3, lines < 4),
        low(F.col("n_repeat_words") / words, 0.1, 0.3),
        F.when(mean.between(3, 9), 1).when(~mean.between(2, 13), -1).otherwise(0),
        low(F.col("n_upper") / chars, 0.15, 0.4),
        low((F.col("n_bars") + F.col("n_bangs")) / words, 0.05, 0.2),
        low(1 - F.col("n_distinct_words") / words, 0.65, 0.85, words < 50),
        low(1 - F.col("n_ended") / lines, 0.5, 0.9, lines < 3),
        low(1 - F.col("n_letters") / chars, 0.12, 0.25),
        low(F.col("n_symbol_words") / words, 0.1, 0.3),
    ]


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def posterior(vote: Column, right: Column, caught: Column, prior: Column) -> Column:
    """Probability of good. right[k]: how often rule k says good of good documents, caught[k]: bad of bad
    ones, of those it speaks about. Rules are independent given the class; abstentions tell nothing."""

    def told(v: Column, pair: Column) -> Column:
        a, b = pair["right"], pair["caught"]
        return F.when(v > 0, F.ln(a / (1 - b))).when(v < 0, F.ln((1 - a) / b)).otherwise(0.0)

    pairs = F.arrays_zip(right.alias("right"), caught.alias("caught"))
    weight = F.aggregate(F.zip_with(vote, pairs, told), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-(logit(prior) + weight)))


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> tuple[list[float], list[float], float]:
    """patterns (vote array<double>, n double), at most 3^10 rows -> (right, caught, prior).

    Each kind of bad text trips a rule or two, so rules start as rarely wrong about good documents
    (0.99) and as seldom catching bad ones (0.15), which also tells the classes apart. Bounds only keep
    logarithms finite and one rule from deciding alone for good: right in 0.5..0.999, caught in 0.01..0.99,
    the prior in 0.01..0.99.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("vote", "n"))).alias("rows"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    clamp = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    zipped = lambda f, p: total(F.zip_with("rows", p, f))

    def step(state: Column, _: Column) -> Column:
        good = F.transform("rows", lambda r: posterior(r["vote"], state["right"], state["caught"], state["prior"]))

        def updated(p: Column) -> Column:
            def right(k: Column) -> Column:
                yes = zipped(lambda r, g: F.when(r["vote"][k] > 0, r["n"] * g).otherwise(0.0), p)
                spoke = zipped(lambda r, g: F.when(r["vote"][k] != 0, r["n"] * g).otherwise(0.0), p)
                return clamp((yes + 0.99) / (spoke + 1), 0.5, 0.999)

            def caught(k: Column) -> Column:
                no = zipped(lambda r, g: F.when(r["vote"][k] < 0, r["n"] * (1 - g)).otherwise(0.0), p)
                spoke = zipped(lambda r, g: F.when(r["vote"][k] != 0, r["n"] * (1 - g)).otherwise(0.0), p)
                return clamp((no + 0.15) / (spoke + 1), 0.01, 0.99)

            prior = (zipped(lambda r, g: r["n"] * g, p) + 0.8) / (total(F.transform("rows", lambda r: r["n"])) + 1)
            rules = F.sequence(F.lit(0), F.lit(n_rules - 1))
            return F.struct(
                F.transform(rules, right).alias("right"),
                F.transform(rules, caught).alias("caught"),
                clamp(prior, 0.01, 0.99).alias("prior"),
            )

        return let(good, updated)

    start = F.struct(
        F.array(*[F.lit(0.99)] * n_rules).alias("right"),
        F.array(*[F.lit(0.15)] * n_rules).alias("caught"),
        F.lit(0.8).alias("prior"),
    )
    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).select("m.*").first()
    return list(found["right"]), list(found["caught"]), found["prior"]


def voted(docs: DataFrame) -> DataFrame:
    return measures(docs).withColumn("vote", F.array(*[v.cast("double") for v in votes()]))


def verdicts(seen: DataFrame, model: tuple, min_words: int, max_repeat: float, threshold: float) -> DataFrame:
    """voted() with base_failed, p_good and kept."""
    right, caught, prior = model
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    p = posterior(F.col("vote"), F.array(*map(F.lit, right)), F.array(*map(F.lit, caught)), F.lit(prior))
    return (
        seen.withColumn("base_failed", failed)
        .withColumn("p_good", F.round(p, 9))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


def counted(seen: DataFrame) -> DataFrame:
    return seen.groupBy("vote").agg(F.count("*").cast("double").alias("n"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the counts, vote, base_failed, p_good, kept; a row for each row."""
    seen = spool(voted(docs.select("doc_id", "text")).withColumn("row", F.col("row.doc_id")).withColumnRenamed("row", "doc_id"))
    return verdicts(seen, fit(counted(seen), len(votes())), min_words, max_repeat, threshold)


def keep(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: float = MAX_REPEAT, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept. Texts are measured once; the rows wait beside their votes in the shared folder for the fit."""
    seen = spool(voted(docs).select("row", "n_words", "n_repeat_words", "vote"))
    judged = verdicts(seen, fit(counted(seen), len(votes())), min_words, max_repeat, threshold)
    return judged.where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"
    )


def keep_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs)


QUERIES = {"op10_quality_rules": op10_quality_rules}
