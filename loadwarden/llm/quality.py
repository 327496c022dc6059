"""Quality rules: base counts and compression bands.

The band of a text is the range its zstandard ratio (compressed by original bytes) may lie in, looked up by its length: repetitive text falls
below, incompressible text (encoded data, noise) above. The whole text has to lie in its band. Longer texts are also cut into overlapping
chunks of one length with a band of their own, and at most one of them may lie outside: what a bad stretch may measure does not grow with
the text. Texts with too few words or too many repeated five-word windows fail before that.

Null texts count as empty; empty texts have no word and fail; texts of any length are read whole; repeated rows get equal results; other
columns are not read.
"""
from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from loadwarden.llm.common import map_texts

# What counts as a symbol, white space, and the base rules.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
# end of fixed values

LEVEL, CHUNK, STEP, MOST_OUTSIDE = 3, 1024, 512, 1
#: Least and greatest ratio of a chunk. Chunks of the sf0.1 texts labelled as good lie between 0.489 and 0.604, no text of them has two outside.
CHUNK_BAND = (0.43, 0.65)
#: Up to this many bytes: least and greatest ratio. The least ratios lie some seven per cent below the lowest of texts labelled as good,
#: the greatest well above the highest and below that of base 64 data of that length.
BANDS = ((63, 0.0, 9.0), (127, 0.60, 1.30), (255, 0.50, 1.05), (511, 0.49, 0.90), (1023, 0.465, 0.82), (2047, 0.43, 0.76), (4095, 0.415, 0.74),
         (8191, 0.395, 0.72), (16383, 0.38, 0.72), (32767, 0.365, 0.72), (131071, 0.33, 0.72), (None, 0.28, 0.72))


def band(size: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if most is None or size <= most)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.uint64, count=len(words))
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h = (h ^ ids[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    at = np.sort(order[np.r_[False, same] | np.r_[same, False]])
    windows = np.stack([ids[at + k] for k in range(WINDOW)], axis=1)  # compared in full: a hash may be shared by chance
    _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = at[counts[which.reshape(-1)] > 1]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def in_bands(data: bytes, press: zstandard.ZstdCompressor, bands=BANDS) -> bool:
    def outside(part: bytes) -> bool:
        low, high = band(len(part), bands)
        return not low <= len(press.compress(part)) / len(part) <= high

    if outside(data):
        return False
    if len(data) <= CHUNK:
        return True
    low, high = CHUNK_BAND
    bad = 0
    for i in range(0, len(data) - CHUNK + STEP, STEP):  # the last one ends with the text
        i = min(i, len(data) - CHUNK)
        bad += not low <= len(press.compress(data[i:i + CHUNK])) / CHUNK <= high
        if bad > MOST_OUTSIDE:
            return False
    return True


def judge(text: str, press: zstandard.ZstdCompressor) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines, repeats = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            repeats += line in lines
            lines.add(line)
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > REPEAT_PERCENT * len(words)
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, repeats, again, failed, not failed and in_bands(data, press)


def apply(docs: DataFrame) -> DataFrame:
    """doc_id and what `judge` finds, per row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    def make():
        press = zstandard.ZstdCompressor(level=LEVEL)

        def work(texts):
            return dict(zip(names, zip(*(judge(t, press) for t in texts))))
        return work

    return map_texts(docs, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
