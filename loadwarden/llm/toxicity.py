"""Toxicity by compression distance: two zstandard dictionaries and calibrated window gains.

A document is cut into windows of whole words. Each window is compressed with a dictionary of ordinary text and with one that also
holds what is typical of toxic text; the bytes saved are the window's gain. Ordinary words cost the same under both, so a gain
means words that only toxic text repeats. A logistic curve over the counts of windows at each gain threshold gives the score.

Null or empty texts have no window and get the score of a document without evidence; texts of any length are scored whole;
repeated rows get equal scores; with no labels of both classes every score is 0. Only `doc_id` and `text` are read.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.llm.common import fold, keep_rows, map_texts, training_sample

WINDOW_BYTES = 96
LEVEL = 12
#: Training rows per class and their longest text; the dictionaries' sizes.
PER_CLASS, MAX_CHARS = 3_000, 20_000
ORDINARY_BYTES, TOXIC_BYTES = 60_000, 4_096
#: A beginning of words is typical of toxic text from this share of toxic documents (counted by distinct words before it, so that copies count
#: once) and this many times its ordinary rate; beginnings have this many bytes, or are whole words.
TYPICAL_SHARE, TYPICAL_LIFT, STEM_BYTES = 0.012, 8.0, range(4, 9)
GAINS = (1, 2, 3, 4)


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """texts -> scores; compressors live in the Python worker."""
        plain, marked = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        weights = np.array(self.weights)

        def score(texts: list[str]) -> np.ndarray:
            x = np.array([_features(_gains(t, plain, marked)) for t in texts])
            return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))

        return score


def _words(text: str) -> list[bytes]:
    return [w.strip(b".,!?;:\"()|") for w in text.lower().encode().split()]


def _windows(words: list[bytes]):
    held: list[bytes] = []
    size = 0
    for w in words:
        for at in range(0, len(w) or 1, WINDOW_BYTES):  # a very long word is cut
            part = w[at:at + WINDOW_BYTES]
            held.append(part)
            size += len(part) + 1
            if size >= WINDOW_BYTES:
                yield b" " + b" ".join(held) + b" "
                held, size = [], 0
    if held:
        yield b" " + b" ".join(held) + b" "


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content or b" the ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW_BYTES, dict_size=len(content), write_checksum=False,
                                                         write_content_size=False, write_dict_id=False)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _gains(text: str, plain, marked) -> np.ndarray:
    return np.array([len(plain.compress(w)) - len(marked.compress(w)) for w in _windows(_words(text))], dtype=np.int32)


def _features(gains: np.ndarray) -> list[float]:
    n = max(1, len(gains))
    hits = [int((gains >= g).sum()) for g in GAINS]
    return [1.0, np.log(n), *(np.log1p(h) for h in hits), *(min(1.0, 4 * h / n) for h in hits), np.log1p(int(gains[gains >= GAINS[0]].sum()))]


def _dictionary(words: list[bytes], size: int) -> bytes:
    """Words joined by spaces up to `size` bytes, the first ones last, where zstandard finds them at the shortest distance."""
    kept, used = [], 1
    for w in words:
        if used + len(w) + 1 > size:
            break
        kept.append(w)
        used += len(w) + 1
    return b" " + b" ".join(reversed(kept)) + b" " if kept else b""


def _stems(word: bytes) -> list[bytes]:
    """The beginnings of a word and, closed by a space, the word."""
    return [word[:n] for n in STEM_BYTES if n < len(word)] + [word + b" "]


def _typical(toxic: list[list[bytes]], ordinary: Counter) -> list[bytes]:
    """Beginnings that toxic documents use far above their ordinary rate, the most frequent first; of two that nearly always occur together the longer."""
    before: dict[bytes, set[bytes]] = defaultdict(set)
    for d in toxic:
        for a, b in zip([b"", *d], d):
            if b:
                for stem in _stems(b):
                    before[stem].add(a)
    usual: Counter = Counter()
    for w, n in ordinary.items():
        for stem in _stems(w):
            usual[stem] += n
    n1, n0 = sum(map(len, toxic)) or 1, sum(ordinary.values()) or 1
    least = max(3, TYPICAL_SHARE * len(toxic))
    found = {s: len(b) for s, b in before.items() if len(b) >= least and len(b) / n1 > TYPICAL_LIFT * (usual[s] + 1) / n0}
    shorter = {s[:-1] for s, n in found.items() if n >= 0.7 * found.get(s[:-1], n + n)}
    return sorted((s for s in found if s not in shorter), key=lambda s: (-found[s], s))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(samples: list[tuple[str, int]], toxic_rate: float) -> ToxicityModel | None:
    """Dictionaries from two thirds of the sample; thresholds and weights calibrated on the rest, at the given rate of toxic documents."""
    samples = list(dict.fromkeys((t, int(y)) for t, y in samples))
    learn, rest = [s for i, s in enumerate(samples) if i % 3], [s for i, s in enumerate(samples) if i % 3 == 0]
    if min(len({y for _, y in part}) for part in (learn, rest)) < 2:
        return None
    docs = {y: [_words(t) for t, z in learn if z == y] for y in (0, 1)}
    seen = Counter(w for d in docs[0] for w in d if w)
    typical = _typical(docs[1], seen)
    heads = tuple(typical)
    common = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if not (w + b" ").startswith(heads)]
    ordinary, toxic = _dictionary(common, ORDINARY_BYTES), _dictionary([h.rstrip(b" ") for h in typical], TOXIC_BYTES)
    plain, marked = _compressor(ordinary), _compressor(toxic + ordinary)
    x = np.array([_features(_gains(t, plain, marked)) for t, _ in rest])
    y = np.array([z for _, z in rest], dtype=float)
    weight = np.where(y == 1, toxic_rate / y.mean(), (1 - toxic_rate) / (1 - y.mean()))
    return ToxicityModel(ordinary, toxic, tuple(_fit_logistic(x, y, weight)))


def train(docs: DataFrame, labels: DataFrame, usable=None) -> ToxicityModel | None:
    """Fits on at most PER_CLASS labelled documents of each class; `usable` is the condition on doc_id that labels must meet."""
    known = labels.filter(F.col("toxic").isNotNull() & (F.lit(True) if usable is None else usable)).select("doc_id", "toxic")
    rate = known.agg(F.avg("toxic")).first()[0]
    if rate is None:
        return None
    return fit(training_sample(docs, known, "toxic", PER_CLASS, MAX_CHARS), min(max(float(rate), 0.01), 0.99))


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, score, predicted for every row of `docs`."""
    def make():
        scorer = model.scorer() if model else lambda texts: np.zeros(len(texts))

        def work(texts):
            s = scorer(texts)
            return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}
        return work

    return map_texts(docs, make, "score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    def make():
        scorer = model.scorer() if model else lambda texts: np.zeros(len(texts))
        return lambda texts: list(scorer(texts) < 0.5)

    return keep_rows(docs, make)


def learning_fold():
    return fold("doc_id", 5) != 0
