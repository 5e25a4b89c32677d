"""Text and time formats of transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the CJK characters between which spaces go, and sentence-final marks.
CJK = "\\u3000-\\u303F\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"
FINAL_MARKS = "?？。.！!"
# Marks that neither lead nor repeat, and full stops that yield to a question mark.
MARKS = "。．.?？!！、，"
STOPS = "。．."
WHITE = "[\\p{IsWhite_Space}\\x1C-\\x1F]"


def drop_cjk_spaces(text: Column) -> Column:
    """Without spaces that have a CJK character as nearest other character on either side."""
    return F.regexp_replace(text, f"(?<=[{CJK}]) +(?=[{CJK}])", "")


def clean_punctuation(text: Column) -> Column:
    """No leading marks, no mark repeated (white space between does not matter), one kind of question mark, no full
    stop beside it. Leading white space goes only with marks after it."""
    for pattern, new in (
        (f"^{WHITE}*[{MARKS}]+", ""),
        (f"([{MARKS}])(?:{WHITE}*\\1)+", "$1"),
        ("[?？]+", "？"),
        (f"？{WHITE}*[{STOPS}]", "？"),
        (f"[{STOPS}]{WHITE}*？", "？"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def timecode(seconds: Column, millis: bool = True) -> Column:
    """HH:MM:SS,mmm, or HH:MM:SS; negative times are 0, hours may pass 24, rest is cut off."""
    micros = F.greatest(F.round(seconds * 1_000_000).cast("bigint"), F.lit(0).cast("bigint"))
    whole = F.expr("0") + F.floor(micros / 1_000_000)
    part = F.floor((micros % 1_000_000) / 1000)
    args = [F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60]
    if millis:
        return F.format_string("%02d:%02d:%02d,%03d", *args, part)
    return F.format_string("%02d:%02d:%02d", *args)


def seconds_of(code: Column) -> Column:
    """Seconds of HH:MM:SS with an optional fraction after ``.`` or ``,`` in thousandths."""
    pattern = r"^\s*(\d+):(\d+):(\d+)(?:[.,](\d+))?"
    part = lambda i: F.nullif(F.regexp_extract(code, pattern, i), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + F.coalesce(part(4) / 1000, F.lit(0.0))


def is_final(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).rlike(f"[{FINAL_MARKS}]$"), F.lit(False))


def is_hiragana(text: Column) -> Column:
    return text.rlike("^[\\u3040-\\u309F]+$")


def file_name(text: Column, default: str = "run") -> Column:
    """Only word characters, dots and dashes; no dots or underscores at the ends."""
    clean = F.regexp_replace(text, "[^\\w.\\-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^[._]+|[._]+$", ""), F.lit("")), F.lit(default))


def speaker_label(index: Column) -> Column:
    return F.format_string("SPEAKER_%02d", index)


def speaker_index(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"^SPEAKER_(\d+)$", 1), F.lit("")).cast("int")


def shown(value: Column, digits: int = 6) -> Column:
    """NA for null, else a fixed number of decimals."""
    return F.when(value.isNull(), "NA").otherwise(F.format_string(f"%.{digits}f", value))


# Endings after which a full stop is right.
SENTENCE_ENDINGS = (
    "です", "ます", "でした", "ました", "だ", "だった", "である", "ません", "でしょう",
    "ですよね", "ですね", "ですよ", "だよ", "だね", "ですが", "だけど", "けれど", "かもしれません",
)


def broken_sentence(left: Column, right: Column) -> Column:
    """Whether a full stop at the end of ``left`` may split a word that ``right`` goes on with: hiragana on either side and no
    usual ending. The decision itself needs a morphological dictionary."""
    base = F.rtrim(F.regexp_replace(F.trim(left), "。$", ""))
    endings = "(" + "|".join(SENTENCE_ENDINGS) + ")$"
    told = F.trim(left).rlike("。$") & base.rlike("[\\u3040-\\u309F]$") & F.trim(right).rlike("^[\\u3040-\\u309F]") & ~base.rlike(endings)
    return F.coalesce(told, F.lit(False))


def wrapped(text: Column, width: int = 42) -> Column:
    """Lines of at most ``width`` characters, words whole; text with CJK characters and a width under 1 leave it as it is."""
    import re
    import textwrap

    import pandas as pd

    cjk = re.compile(f"[{CJK}]")

    def run(column: pd.Series) -> pd.Series:
        keep = {"replace_whitespace": False, "break_long_words": False, "break_on_hyphens": False}
        return column.map(lambda t: t if t is None or width < 1 or cjk.search(t) else "\n".join(textwrap.wrap(t, width, **keep)))

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def wrapped_wide(text: Column, width: int) -> Column:
    """Lines of at most ``width`` columns, a CJK character taking two; a width under 1 leaves the text as it is. A character that
    does not fit even alone opens a line of its own."""
    if width < 1:
        return text
    at = F.split(text, "")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("used"))

    def step(held, c):
        w = F.when(c.rlike(f"[{CJK}]"), 2).otherwise(1)
        full = held["used"] + w > width
        return F.struct(F.concat(held["done"], F.when(full, F.lit("\n")).otherwise(F.lit("")), c).alias("done"), F.when(full, w).otherwise(held["used"] + w).alias("used"))

    return F.aggregate(F.filter(at, lambda c: c != ""), empty, step, lambda held: held["done"])


# Lines that a log already holds in its own form, and the start of trace lines.
LOG_LINES = (
    r"^\d{2}:\d{2}:\d{2}-(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)-[^:]+:",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:,\d{3})?\s*-\s*(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\s*-\s*[^:]+:",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:,\d{3})?\s*\[(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\]\s*[^:]+:",
    r"^\[STD(?:ERR|OUT)\]",
    r"^\[SENTINEL\]",
)
TRACE = "[TRACE-ALIGNER"


def is_log_line(line: Column) -> Column:
    """Whether a line is already one of a log."""
    return F.coalesce(line.rlike("|".join(LOG_LINES)), F.lit(False))


def is_kept(message: Column, trace: bool = False) -> Column:
    """Whether a message goes into the log: trace messages only when asked for."""
    return F.lit(True) if trace else ~F.coalesce(F.startswith(message, F.lit(TRACE)), F.lit(False))
