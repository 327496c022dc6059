"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are the runs of 2 to 4 code points of a lower-cased text that stay within one word or touch its borders. Their hashed
embeddings are averaged over the whole text; a linear softmax over the average gives the language. The model is linear after the
lookup, so workers hold the product of both tables. The softmax temperature and both rejection thresholds are calibrated on drawn
documents that were not trained on.

A softmax must choose among the learned languages, so it says nothing of text in none of them. Rejection therefore also looks at how much of
a text is familiar: the share of its subwords whose bucket several training documents have. The threshold is set between recognised
calibration documents and the same documents seen as strangers: with the training documents of their own language not counted, and with
their letters shuffled. Where the two overlap, recognised documents are kept. Short texts count as familiar until enough speaks against it.

Null texts and texts without a letter are `und` with score 0 and rejected; texts of any length are read whole, in blocks; repeated
rows get equal results; with no labelled language everything is `und`. Only `doc_id` and `text` are read when predicting.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.llm.common import fold, keep_rows, map_texts, training_sample

BUCKET_BITS, DIMENSIONS = 15, 16
SIZES = (2, 3, 4)
#: Training rows per language and their longest text.
PER_LANGUAGE, MAX_CHARS = 1_500, 20_000
EPOCHS, BATCH, RATE = 6, 64, 2.0
#: Share of correctly recognised calibration documents that the rejection threshold may lose.
LOSS = 0.0005
#: A bucket is familiar if this share of the training documents has it, and at least this many.
FAMILIAR_SHARE, FAMILIAR_DOCS = 0.003, 2
#: Familiar subwords that every text is credited with; share of strangers that may lie above the lower end of the gap.
CREDIT, STRANGERS = 100, 0.01
BLOCK = 1 << 20
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def _blocks(text: str):
    """Hashed subwords of a text, block by block; blocks overlap by what a subword that crosses their border needs."""
    reach = max(SIZES) - 1
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - reach):at + BLOCK].lower()
        codes = np.frombuffer((" " + part + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        space = ~_letters()[codes]
        codes = np.where(space, np.uint64(32), codes)
        keep = ~(space & np.r_[False, space[:-1]])
        codes, space = codes[keep], space[keep]
        if space.all():
            continue
        out = []
        for n in SIZES:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            inner = np.zeros(m, dtype=bool)
            for k in range(n):
                h = (h ^ codes[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    inner |= space[k:k + m]
            out.append((h[~inner] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        yield np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Embeddings times softmax weights: one row per bucket, one column per language.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Least score, and least share of familiar subwords, of an accepted text; the familiar buckets.
    reject_below: float
    strange_below: float
    familiar: np.ndarray

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score and familiarity."""
        total, n, known = np.zeros(len(self.languages)), 0, 0
        for buckets in _blocks(text):
            total += self.logits[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
            known += int(np.count_nonzero(self.familiar[buckets]))
        if not n:
            return UNKNOWN, 0.0, 0.0
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum()), (known + CREDIT) / (n + CREDIT)

    def accepts(self, language: str, score: float, familiarity: float) -> bool:
        return language != UNKNOWN and score >= self.reject_below and familiarity >= self.strange_below


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _bag(text: str) -> np.ndarray:
    """Number of subwords per bucket."""
    return sum((np.bincount(b, minlength=1 << BUCKET_BITS) for b in _blocks(text)), np.zeros(1 << BUCKET_BITS, dtype=np.int64))


def _familiarity(bag: np.ndarray, familiar: np.ndarray) -> float:
    return (int(bag[familiar].sum()) + CREDIT) / (int(bag.sum()) + CREDIT)


def _shuffled(text: str, rng) -> str:
    """The text with its characters in another order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return rng.permutation(codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _familiar_buckets(documents: np.ndarray, of: int) -> np.ndarray:
    return documents >= max(FAMILIAR_DOCS, FAMILIAR_SHARE * of)


def _strange_below(known: list[tuple[str, int]], documents: np.ndarray, sizes: np.ndarray, rng) -> float:
    """The threshold of familiarity from (text, language) pairs that were recognised. `documents` counts training documents per language and
    bucket, `sizes` per language; a document is a stranger to the counts of all other languages."""
    full = _familiar_buckets(documents.sum(axis=0), sizes.sum())
    others = [_familiar_buckets(documents.sum(axis=0) - documents[k], sizes.sum() - sizes[k]) for k in range(len(sizes))]
    own, strange = [], []
    for text, k in known:
        bag = _bag(text)
        own.append(_familiarity(bag, full))
        strange.append(_familiarity(bag, others[k]))
        strange.append(_familiarity(_bag(_shuffled(text, rng)), full))
    if not own:
        return 0.0
    least, most = float(np.quantile(own, LOSS)), float(np.quantile(strange, 1 - STRANGERS))
    return (least + most) / 2 if most < least else least


def fit(samples: list[tuple[str, str]]) -> LanguageModel | None:
    """SGD on four fifths of the sample; temperature and rejection thresholds on the rest."""
    bags, labels, texts = [], [], []
    for text, language in dict.fromkeys(samples):
        bag = _bag(text)
        at = np.flatnonzero(bag)
        if len(at):
            bags.append((at, (bag[at] / bag.sum()).astype(np.float32)))
            labels.append(language)
            texts.append(text)
    if not bags:
        return None
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(7)
    embeddings = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    order = np.arange(len(y))
    train, rest = order[order % 5 > 0], order[order % 5 == 0]
    train = train if len(train) else order

    def rows(ix):
        x = np.zeros((len(ix), 1 << BUCKET_BITS), dtype=np.float32)
        for i, k in enumerate(ix):
            x[i, bags[k][0]] = bags[k][1]
        return x

    steps, done = EPOCHS * (len(train) // BATCH + 1), 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), BATCH):
            ix = mixed[at:at + BATCH]
            x = rows(ix)
            v = x @ embeddings
            g = _softmax(v @ weights + bias)
            g[np.arange(len(ix)), y[ix]] -= 1
            g /= len(ix)
            rate = np.float32(RATE * (1 - done / steps))
            back = g @ weights.T
            weights -= rate * (v.T @ g)
            bias -= rate * g.sum(axis=0)
            embeddings -= rate * 100 * (x.T @ back)  # a bucket holds about a hundredth of a text
            done += 1
    logits = (embeddings @ weights).astype(np.float32)
    rest = rest if len(rest) else order
    z = np.concatenate([rows(rest[i:i + BATCH]) @ logits + bias for i in range(0, len(rest), BATCH)]).astype(np.float64)
    heats = np.geomspace(0.2, 5, 60)
    t = float(min(heats, key=lambda h: -np.log(_softmax(z / h)[np.arange(len(rest)), y[rest]] + 1e-12).sum()))
    p = _softmax(z / t)
    right = p.argmax(axis=1) == y[rest]
    confident = p.max(axis=1)[right]
    below = float(min(np.quantile(confident, LOSS), 0.5)) if len(confident) else 0.0
    documents, sizes = np.zeros((len(languages), 1 << BUCKET_BITS), dtype=np.int64), np.bincount(y[train], minlength=len(languages))
    for k in train:
        documents[y[k], bags[k][0]] += 1
    strange = _strange_below([(texts[k], y[k]) for k in rest[right]], documents, sizes, rng)
    return LanguageModel(languages, logits, bias.astype(np.float64), t, below, strange, _familiar_buckets(documents.sum(axis=0), sizes.sum()))


def train(docs: DataFrame, usable=None) -> LanguageModel | None:
    """Fits on at most PER_LANGUAGE documents of each non-null `lang`; `usable` is the condition on doc_id they must meet."""
    known = docs.filter(F.col("lang").isNotNull() & (F.lit(True) if usable is None else usable)).select("doc_id", "lang")
    return fit(training_sample(docs, known, "lang", PER_LANGUAGE, MAX_CHARS))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of `docs`."""
    def make():
        def work(texts):
            found = [model.predict(t) if model else (UNKNOWN, 0.0, 0.0) for t in texts]
            return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
                    "rejected": [not (model and model.accepts(*x)) for x in found]}
        return work

    return map_texts(docs, make, "lang_pred string, score double, rejected boolean")


def keep_recognised(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents, all columns, whose language is recognised with enough confidence."""
    return keep_rows(docs, lambda: lambda texts: [bool(model) and model.accepts(*model.predict(t)) for t in texts])


def learning_fold():
    return fold("doc_id", 4) != 2
