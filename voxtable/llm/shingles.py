"""Word shingles, MinHash values and band keys of whole texts, vectorised over bytes with numpy.

Words are runs of bytes other than ASCII white space (space, tab to carriage return) in UTF-8.
A text of n >= size words has the n - size + 1 windows of its words as shingles; a shorter text
that has words has one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at once.
PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U))
_LANES = mix(np.arange(1, 4097, dtype=U) + U(7919))
_powers = {_BASE: np.ones(1, U), _INVERSE: np.ones(1, U)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        grown = np.full(max(n, 1 << 16), base, U)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=U)
    return _powers[base][:n]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of each word, in order. Works through pieces of PIECE bytes, so that memory follows the number of words."""
    start, end = word_spans(data) if spans is None else spans
    out = np.empty(len(start), U)
    raw = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + PIECE, "right")))
        n = int(end[to - 1]) - low
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[raw[low : low + n]] * _power(_BASE, n), dtype=U, out=sums[1:])
        a, b = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * _power(_INVERSE, n)[a] + (b - a).astype(U))
        at = to
    return out


class Words:
    """The words of several texts at once; texts are joined by line breaks, so no word and no line spans two.

    start, end, hashes: each word's bytes in ``data`` and its hash; first: index of each text's first word,
    with the number of all words at the end; offsets: where each text begins in ``data``.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.start, self.end = word_spans(self.data)
        self.hashes = word_hashes(self.data, (self.start, self.end))
        self.first = np.append(np.searchsorted(self.start, self.offsets), len(self.start))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of every line, in bytes of ``data``; an empty text has one empty line."""
        breaks = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
        start = np.concatenate(([0], breaks + 1))
        return start, np.append(breaks, len(self.data)), np.searchsorted(self.offsets, start, "right") - 1

    def within(self, size: int) -> np.ndarray:
        """Whether the window of ``size`` words at each word stays in its text."""
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        n = len(text) - size + 1
        return text[:n] == text[size - 1 :] if n > 0 else np.empty(0, bool)


def portions(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts with ``most`` bytes at most, a longer text alone."""
    at = used = 0
    for i, t in enumerate(texts):
        if i > at and used + len(t) > most:
            yield at, i
            at, used = i, 0
        used += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def window_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the windows of ``size`` words, in order and with repeats."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.zeros(n - width + 1, U)
    for j in range(width):
        total += words[j : n - width + 1 + j] * (_LANES[j] | U(1))
    return mix(total + U(width))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(window_hashes(word_hashes(text.encode("utf-8", "surrogatepass")), size))


def minhash(items: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` MinHash values of a non-empty set of 64-bit hashes, 32 bits each."""
    a, b = _LANES[:lanes] | U(1), _LANES[2048 : 2048 + lanes]
    least = np.full(lanes, np.iinfo(U).max, U)
    for at in range(0, len(items), 2048):
        np.minimum(least, (items[at : at + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> U(32)).astype(np.uint32)


def minhash_runs(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int) -> np.ndarray:
    """As minhash(), for items[start:end] of each pair; ranges ascend, do not overlap and are not empty."""
    a, b = _LANES[:lanes] | U(1), _LANES[2048 : 2048 + lanes]
    out = np.empty((len(starts), lanes), np.uint32)
    if not len(starts):
        return out
    cuts = np.column_stack((starts, ends)).ravel()
    cuts = cuts[:-1] if cuts[-1] == len(items) else cuts
    for k in range(lanes):
        out[:, k] = (np.minimum.reduceat(items * a[k] + b[k], cuts)[::2] >> U(32)).astype(np.uint32)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the bands of one signature or of a matrix of them; a key also tells its band."""
    parts = signature.reshape(*signature.shape[:-1], bands, rows).astype(U)
    total = np.broadcast_to(_LANES[3072 : 3072 + bands], parts.shape[:-1]).copy()
    for j in range(rows):
        total = mix(total * U(31) + parts[..., j] + U(1))
    return total


def tune_bands(threshold: float, miss: float, most_lanes: int = 256) -> tuple[int, int]:
    """The (bands, rows) with the most rows a band, hence fewest chance collisions, whose
    probability of missing a pair exactly at ``threshold`` stays under ``miss``."""
    best = None
    for rows in range(1, 9):
        bands = 1
        while (1 - threshold**rows) ** bands > miss and bands * rows <= most_lanes:
            bands += 1
        if bands * rows <= most_lanes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of exactly ``size`` words at a cost that does not grow with ``size``; none of a shorter text."""
    n = len(words)
    if n < size:
        return np.empty(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(words * _power(_BASE, n), dtype=U, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _power(_INVERSE, n)[: n - size + 1])


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each full window of ``width`` values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def anchors(words: np.ndarray, size: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of windows of (size + 1) // 2 words, chosen by their content alone (the least of their
    neighbourhood), so that equal runs of ``size`` words hold an equal choice at equal places. ``within`` tells which
    windows of ``size`` words count, all of them by default."""
    part = (size + 1) // 2
    width = size - part + 1
    found = rolling_hashes(words, part)
    if len(found) < width:
        return np.empty(0, np.int64), np.empty(0, U)
    least = _sliding(found, width, np.minimum)
    if within is not None:
        least = np.where(within, least, U(0))
    pad = np.zeros(width - 1, U)
    at = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), width, np.maximum) == found)
    return at, found[at]
