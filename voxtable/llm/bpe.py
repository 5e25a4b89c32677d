"""BPE encoding and decoding of whole texts by tree concatenation (operator 5).

A text of more than LEAF characters is cut by size alone into leaves, which are encoded as one batch in parallel: by tiktoken
with the ranks of the same file where all characters are of long-settled classes, so that both libraries split alike,
else by tokenizers. Pairs of neighbours are joined upwards: the text around a join is encoded anew, in a window that
ends on either side before white space that follows something else, where the byte-level pre-tokenizer always starts
anew, and that grows until its first token is the left part's and its last the right part's.

Runs without such a place are cut further: what the pre-tokenizer leaves unsplit beyond LEAF bytes is encoded by a tree of
byte-level pieces. There, too, a window of tokens on either side of a join is encoded anew and grows until both sides
agree. A BPE sequence is the encoding of its text if and only if each two neighbours are the encoding of theirs, so a
window that agrees on both sides makes the joined sequence exact.

Results equal ``encode(text, add_special_tokens=False)`` and ``decode(ids, skip_special_tokens=False)`` of the
tokenizers library, special tokens within texts included.

Edge cases. Null text counts as empty and has no ids. Rows may repeat; empty tables give no rows; other columns do
not matter. Memory: one batch of texts with their ids, PIECES code points or one text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import table, text_or_empty

LEAF, PIECES = 4096, 400_000
#: White space as the pre-tokenizer sees it (Unicode's White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: Characters other than Latin, Latin supplements and common marks, whose classes no version of Unicode has changed.
UNSETTLED = re.compile("[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u2030-\u205e]")


def byte_alphabet() -> list[str]:
    """The character for each byte in the tokenizer's vocabulary: printable Latin-1 for itself, then from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    """Encodes and decodes with one tokenizer file; kept by a worker over its tasks."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str, leaf: int = LEAF):
        self.path, self.leaf, self.windows, self.joins = path, leaf, 0, 0
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.specials = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        names = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.fast = self._ranked(made)
        vocab = made["model"]["vocab"]
        self.sizes = np.zeros(max([*vocab.values(), *self.specials.values()]) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t) for t in vocab]  # a character of a token's name is a byte

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own; made when first needed, as it takes memory."""
        own = Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        return own

    @cached_property
    def whole(self) -> Tokenizer:
        """The same without splitting and without special tokens, for texts in the byte alphabet."""
        own = Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        own.pre_tokenizer = pre_tokenizers.Sequence([])
        own.encode_special_tokens = True
        return own

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ranked(self, made: dict) -> tiktoken.Encoding | None:
        """The file as ranks, if its ids follow the order of its merges and its splits are the usual ones."""
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        ids = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        usual = made["pre_tokenizer"].get("type") == "ByteLevel" and made["pre_tokenizer"].get("use_regex", True)
        if not usual or made["pre_tokenizer"]["add_prefix_space"] or made.get("normalizer") or ids != sorted(ids):
            return None
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in self.specials}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, unsigned 32-bit."""
        if len(text) > self.leaf:
            if self.has_long_run(text):
                return self.encode_long(text)
            runs = self.special.split(text) if self.special else [text]
            return np.concatenate([np.array([self.specials[r]], "<u4") if k % 2 else self.halves(r) for k, r in enumerate(runs)])
        if self.fast is not None and not UNSETTLED.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]

    def leaves(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special tokens, as one batch."""
        if self.fast is not None and not any(map(UNSETTLED.search, texts)):
            own = self.pool.map if len(texts) >= 16 else map
            return [x.astype("<u4", copy=False) for x in own(self._ordinary, texts)]
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ordinary(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=())

    @cached_property
    def pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(2)

    def has_long_run(self, text: str) -> bool:
        """Whether LEAF characters or more stand without a change between white space and other characters. Looked for at
        every LEAF-th character, one of which each such run covers."""
        for at in range(self.leaf - 1, len(text), self.leaf):
            space = text[at].isspace()
            low, high = at, at + 1
            while low and text[low - 1].isspace() == space and high - low < self.leaf:
                low -= 1
            while high < len(text) and text[high].isspace() == space and high - low < self.leaf:
                high += 1
            if high - low >= self.leaf:
                return True
        return False

    def halves(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens and without long runs: its leaves' ids, joined in pairs upwards."""
        parts = [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]
        if not parts:
            return np.empty(0, "<u4")
        level = list(zip(parts, self.leaves(parts), strict=True))
        while len(level) > 1:
            level = [self.join_texts(*level[i], *level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][1]

    def join_texts(self, left: str, x: np.ndarray, right: str, y: np.ndarray, width: int = 16) -> tuple[str, np.ndarray]:
        """The concatenated text and its ids, from two texts and theirs."""
        self.joins += 1
        while True:
            self.windows += 1
            before, after = left[max(0, len(left) - 4 * width) : max(0, len(left) - width)], right[width : 4 * width]
            edges = [m.start() for m in EDGE.finditer(before)]
            a = max(0, len(left) - 4 * width) + edges[-1] if edges else 0
            found = EDGE.search(after)
            b = width + found.start() if found else len(right)
            if (not edges and len(left) > 4 * width) or (not found and len(right) > 4 * width):
                width *= 2
                continue
            again = self.leaves([left[a:] + right[:b]])[0]
            m = self._tokens(x[::-1], left[a:])
            n = self._tokens(y, right[:b])
            agrees_left = not a or (m and again[0] == x[len(x) - m])
            agrees_right = b == len(right) or (n and again[-1] == y[n - 1])
            if agrees_left and agrees_right:
                return left + right, np.concatenate((x[: len(x) - m], again, y[n:]))
            width *= 2

    def _tokens(self, ids: np.ndarray, text: str) -> int:
        """How many of the first ids make up ``text``, which ends where one does."""
        size = len(text.encode("utf-8", "surrogatepass"))
        most = ids[:size]  # a token has a byte at least
        return int(np.searchsorted(np.cumsum(self.sizes[most]), size, "left")) + 1 if size else 0

    def encode_long(self, text: str) -> np.ndarray:
        """A text with long runs: special tokens, cuts and the pre-tokenizer's own splits first, trees for the rest."""
        parts: list[list[int]] = []
        for k, run in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                parts.append([self.specials[run]])
                continue
            short: list[str] = []
            for unit in UNIT.findall(run):
                if len(unit) < self.leaf:
                    short.append(unit)
                    continue
                parts.append(self._short(short))
                short = []
                pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]
                small = iter(self._raw([p for p in pieces if len(p) <= self.leaf]))
                parts.extend(self.tree(p) if len(p) > self.leaf else next(small) for p in pieces)
            parts.append(self._short(short))
        return np.array([i for p in parts for i in p], "<u4")

    def _short(self, units: list[str]) -> list[int]:
        return self.tokenizer.encode("".join(units), add_special_tokens=False).ids if units else []

    def _raw(self, pieces: list[str]) -> list[list[int]]:
        """BPE of pieces in the byte alphabet, nothing split."""
        return [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]

    def tree(self, piece: str) -> list[int]:
        """BPE of one pre-token, given in the byte alphabet (one character a byte)."""
        cuts = list(range(0, len(piece), self.leaf))
        if len(cuts) > 1 and len(piece) - cuts[-1] < self.leaf // 2:
            cuts.pop()
        ends = [*cuts[1:], len(piece)]
        level = self._raw([piece[a:b] for a, b in zip(cuts, ends, strict=True)])
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int], width: int = 4) -> list[int]:
        """The encoding of the concatenated texts of two encodings."""
        name = self.whole.id_to_token
        while True:
            self.windows += 1
            a, b = max(0, len(left) - width), min(len(right), width)
            again = self._raw(["".join(map(name, left[a:] + right[:b]))])[0]
            agrees_left = a == 0 or again[0] == left[a]
            agrees_right = b == len(right) or again[-1] == right[b - 1]
            if agrees_left and agrees_right and (len(again) > 1 or a == 0 or b == len(right)):
                return left[:a] + again + right[b:]
            width *= 2

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text, ids array<int>: the encoding of each row's text."""

    def run(column: pd.Series) -> pd.Series:
        codec = Codec.of(path)
        return pd.Series([codec.encode(t).astype("int32") for t in column])

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return docs.select("doc_id", "text", F.pandas_udf(run, "array<int>")(text_or_empty()).alias("ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, digests only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path)
        names = np.array([str(i) for i in range(codec.tokenizer.get_vocab_size())], object)
        for frame in frames:
            out = []
            for batch in batches(frame["text"], PIECES):
                encoded = codec.encode_all(batch)
                decoded = codec.tokenizer.decode_batch([x.tolist() for x in encoded], skip_special_tokens=False)
                for ids, text in zip(encoded, decoded, strict=True):
                    listed = ",".join(names[ids])
                    out.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            made.insert(0, "id", frame["id"].to_numpy())
            yield made

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"))
    made = rows.mapInPandas(run, "id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.select(F.col("id").cast(kind).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def batches(texts, most: int) -> Iterator[list[str]]:
    """Consecutive texts, so many that they come to ``most`` code points or are one."""
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_bpe": op5_bpe}
