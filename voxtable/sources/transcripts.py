"""Readers of transcript, subtitle, segment and event files. Files are whole rows of Spark's text reader; lines are
numbered within their file, so a file may lie in any number of splits of the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import seconds_of

# The lines of the formats; blanks may lead.
HEADER = r"^\s*\[(\d+):(\d+):(\d+)(?:\.(\d+))?\]\s+([A-Z0-9_]+):"
TOKENS = r"^\s*\[(\d+:\d+:\d+(?:[.,]\d+)?)\]\s+(SPEAKER_\d+):\s*(\S.*)$"
TIMES = r"^(\d+:\d+:\d+[.,]\d+)\s*-->\s*(\d+:\d+:\d+[.,]\d+)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of all text files under a path."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("n", "line"))


def _blocks(df: DataFrame, header) -> DataFrame:
    """Lines with ``block``, the header line that they follow, and ``blanks``, how many blank lines lie between."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_h", header).withColumn("block", F.sum(F.col("_h").cast("int")).over(w)).where("block > 0")
    inner = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("blanks", F.sum((F.trim("line") == "").cast("int")).over(inner))


def _joined(df: DataFrame, separator: str = " "):
    return F.array_join(F.transform(F.sort_array(F.collect_list(df)), lambda x: x["line"]), separator)


def transcript(df: DataFrame) -> DataFrame:
    """Lines -> (file, seg_idx, start, speaker, text), ordered by start: a header line opens a segment, the lines up to
    the next header or the first blank line are its text. A fraction counts thousandths, however many digits it has."""
    part = lambda i: F.regexp_extract("line", HEADER, i)
    blocks = _blocks(df, F.col("line").rlike(HEADER))
    start = part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int") + F.coalesce(F.nullif(part(4), F.lit("")).cast("double") / 1000, F.lit(0.0))
    heads = blocks.where("_h").select("file", "block", start.cast("double").alias("start"), part(5).alias("speaker"))
    body = F.when(~F.col("_h") & (F.col("blanks") == 0), F.struct("n", F.trim("line").alias("line")))
    texts = blocks.groupBy("file", "block").agg(_joined(body).alias("text"))
    order = Window.partitionBy("file").orderBy("start", "block")
    return heads.join(texts, ["file", "block"]).select("file", (F.row_number().over(order) - 1).alias("seg_idx"), "start", "speaker", "text")


def tokens(df: DataFrame) -> DataFrame:
    """Lines ``[time] SPEAKER_nn: words`` -> (file, pos, word, speaker)."""
    hit = df.where(F.col("line").rlike(TOKENS))
    each = hit.select("file", "n", F.regexp_extract("line", TOKENS, 2).alias("speaker"), F.posexplode(F.split(F.trim(F.regexp_extract("line", TOKENS, 3)), r"\s+")).alias("k", "word"))
    return each.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("n", "k")) - 1).alias("pos"), "word", "speaker")


def header_times(df: DataFrame, duration: float) -> DataFrame:
    """Header lines only -> (file, start, end, speaker): a segment ends at the next start, the last at ``duration``;
    those without length go."""
    part = lambda i: F.regexp_extract("line", HEADER, i)
    start = (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).cast("double")
    heads = df.where(F.col("line").rlike(HEADER)).select("file", "n", start.alias("start"), part(5).alias("speaker"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy("file").orderBy("n")), F.lit(duration))
    return heads.withColumn("end", end).where("end > start").select("file", "start", "end", "speaker")


def subtitles(df: DataFrame) -> DataFrame:
    """SRT lines -> (file, n, start, end, text); the number line may be missing, decimals follow a comma or dot."""
    blocks = _blocks(df, F.col("line").rlike(TIMES))
    side = lambda i: seconds_of(F.regexp_extract("line", TIMES, i))
    heads = blocks.where("_h").select("file", "block", side(1).alias("start"), side(2).alias("end"))
    body = F.when(~F.col("_h") & (F.col("blanks") == 0), F.struct("n", F.trim("line").alias("line")))
    texts = blocks.groupBy("file", "block").agg(_joined(body, "\n").alias("text"))
    return heads.join(texts, ["file", "block"]).select("file", (F.col("block") - 1).alias("n"), "start", "end", "text")


def report_intervals(df: DataFrame, section: str) -> DataFrame:
    """Rows ``index start end duration`` below a section's header line, which begins with ``===`` -> (session, t0, t1),
    touching ones merged; the file is the session. Other lines of a section, such as its counts, are passed over."""
    from ..operators.sequences import merged

    blocks = _blocks(df, F.col("line").rlike(r"^\s*==="))
    heads = blocks.where("_h").select("file", "block", F.contains("line", F.lit(section)).alias("own")).where("own")
    row = r"^\s*\d+\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+\d+(?:\.\d+)?\s*$"
    hit = blocks.where(F.col("line").rlike(row)).join(heads, ["file", "block"], "left_semi")
    part = lambda i: F.regexp_extract("line", row, i).cast("double")
    return merged(hit.select(F.col("file").alias("session"), part(1).alias("t0"), part(2).alias("t1")))


TERMS = "vad spk word sw_pen sw_pen_base sw_pen_factor sw_hysteresis_scale sw_ten_scale sw_spk_margin_scale cp_scale uncertain_scale lex_scale post_to_scale_path spk_margin".split()
DOUBLES = "t vad p_top1 p_top2 p_top3 p_margin p_entropy p_entropy_norm beta spk_margin lex_scale cp cp_scale cp_floor uncertain_scale post_to_scale_argmax post_to_scale_path post_to_scale_conf dp_cost_total".split()
INTS = "i path_spk p_top1_spk p_top2_spk p_top3_spk p_argmax emit_argmax dp_terms_version path_spk_original".split()


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


COST_TERMS = T.StructType([*_fields(TERMS, T.DoubleType()), T.StructField("runlen", T.IntegerType())])
FRAME = T.StructType([*_fields(DOUBLES, T.DoubleType()), *_fields(INTS, T.IntegerType()), T.StructField("uncertain_hit", T.BooleanType()), T.StructField("dp_cost_terms", COST_TERMS)])
WORD = T.StructType([*_fields(["start", "end"], T.DoubleType()), T.StructField("text", T.StringType())])
EVENT = T.StructType([
    *_fields(["v", "frame", "window_frames", "lo", "hi", "num_speakers", "path_old", "path_new", "dp_terms_version", "max_words", "path_old_original", "path_new_original"], T.IntegerType()),
    *_fields(["time", "window_sec", "dp_cost_total", "word_window_sec"], T.DoubleType()),
    *_fields(["event_type", "frame_emission_mode", "words_text"], T.StringType()),
    T.StructField("dp_cost_terms", COST_TERMS), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("words_meta", T.ArrayType(WORD)), T.StructField("frames", T.ArrayType(FRAME)),
])


def events(spark: SparkSession, path: str) -> DataFrame:
    """Boundary events, one JSON object a line. Blank lines and values that are no object are passed over; a line that is
    no JSON stops the read."""
    value = F.try_parse_json("value")
    wanted = value.isNull() | F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    rows = spark.read.text(path).where((F.trim("value") != "") & wanted)
    return rows.select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("event")).select("event.*")


def event_rows(df: DataFrame) -> DataFrame:
    """Events with the frame that they are about (by index ``i``), flattened for statistics."""
    own = F.get(F.filter("frames", lambda f: f["i"] == F.col("frame")), F.lit(0))
    return df.withColumn("own", own).select(
        "event_type", "frame", "time", "path_old", "path_new", "words_text", F.col("own").isNotNull().alias("found"),
        F.col("own.cp").alias("cp"), F.col("own.p_margin").alias("margin"), F.col("own.p_entropy_norm").alias("entropy"), F.col("own.uncertain_hit").alias("uncertain"),
        *[F.coalesce(F.col(f"own.dp_cost_terms.{t}"), F.col(f"dp_cost_terms.{t}")).alias(f"term_{t}") for t in TERMS],
    )


SEGMENT_KEYS = T.ArrayType(T.StructType(_fields(["start_sec", "end_sec", "start_sample", "end_sample", "start", "end"], T.DoubleType())))


def segment_lists(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """JSON lists of segments in seconds, samples or plain start and end -> (file, seg_idx, a, b) in samples; those without
    any of the three stop the read, those without length go."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    each = whole.select("file", F.posexplode(F.from_json("value", SEGMENT_KEYS)).alias("seg_idx", "s"))
    pick = lambda k: F.coalesce(F.round(F.col(f"s.{k}_sec") * rate), F.col(f"s.{k}_sample"), F.round(F.col(f"s.{k}") * rate)).cast("bigint")
    both = each.select("file", "seg_idx", pick("start").alias("a"), pick("end").alias("b"))
    known = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a segment has no start and end"))).otherwise(F.col("b") > F.col("a"))
    return both.where(known)


TRACK = T.StructType([*_fields(["frame_dt", "duration"], T.DoubleType()), T.StructField("times", T.ArrayType(T.DoubleType())), T.StructField("probs", T.ArrayType(T.DoubleType()))])
COMPARISON = T.StructType([T.StructField("input_file", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("silero", TRACK), T.StructField("ten", TRACK)])


def comparisons(spark: SparkSession, path: str) -> DataFrame:
    """Two activity tracks a file -> (file, track, idx, t, p)."""
    df = spark.read.schema(COMPARISON).json(path, multiLine=True).withColumn("file", F.input_file_name())
    tracks = F.array(*[F.struct(F.lit(n).alias("track"), F.arrays_zip(F.col(f"{n}.times").alias("t"), F.col(f"{n}.probs").alias("p")).alias("rows")) for n in ("silero", "ten")])
    each = df.select("file", F.explode(tracks).alias("x")).select("file", "x.track", F.posexplode("x.rows").alias("idx", "r"))
    return each.select("file", "track", "idx", "r.t", "r.p")


def run_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Results of a run -> (file, seg_idx, start, end, speaker, text)."""
    segment = T.StructType([*_fields(["start", "end"], T.DoubleType()), *_fields(["speaker", "text"], T.StringType())])
    df = spark.read.schema(T.StructType([T.StructField("segments", T.ArrayType(segment))])).json(path, multiLine=True)
    return df.withColumn("file", F.input_file_name()).select("file", F.posexplode("segments").alias("seg_idx", "s")).select("file", "seg_idx", "s.*")
