"""Token ids of whole texts from the tokenizers library, each distinct word encoded once per Python worker and cache filling.

The word tokenizer drops white space before it merges, so the ids of a text are the ids of its parts between ASCII white space. Parts
are looked up in a bounded cache; unseen ones are encoded by the library in batches, plain Latin words many to a call: each gives
one end-of-word id, which tells them apart again.
"""
from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a worker remembers before it starts again, in bytes, at some ENTRY_BYTES for a part besides its letters and ids. Longer parts are not kept.
CACHE_BYTES, ENTRY_BYTES, LONGEST_KEPT = 160 << 20, 180, 64
WORDS_PER_CALL = 256
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SHARED: dict[tuple, "CachedEncoder"] = {}


class CachedEncoder:
    """Ids of texts put together from the ids of their parts; `_cut` cuts texts, `_learn` adds the ids of parts not seen before."""

    def __init__(self, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes = cache_bytes
        self._clear()

    @classmethod
    def shared(cls, path: str) -> "CachedEncoder":
        """The encoder of this Python worker; tasks that the worker runs one after another share its cache."""
        if (cls, path) not in _SHARED:
            _SHARED[cls, path] = cls(path)
        return _SHARED[cls, path]

    def _clear(self) -> None:
        self.index: dict = {}
        self.held, self.slots = 0, 0
        self.store, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, part, ids) -> None:
        self._add_all([part], np.asarray(ids, dtype=np.uint32), np.array([len(ids)]))

    def _add_all(self, parts: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds parts whose ids stand one after another."""
        at, n, end = self.slots, len(ids), self.slots + len(parts)
        if end > len(self.starts):
            self.starts, self.sizes = (np.resize(x, max(2 * len(x), end)) for x in (self.starts, self.sizes))
        if self.used + n > len(self.store):
            self.store = np.resize(self.store, max(2 * len(self.store), self.used + n))
        self.store[self.used:self.used + n] = ids
        self.sizes[at:end] = sizes
        self.starts[at:end] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(parts, range(at, end)))
        self.slots, self.used = end, self.used + n
        self.held += sum(map(len, parts)) + ENTRY_BYTES * len(parts) + 4 * n

    def _same(self, part, known) -> None:
        """A part that has the ids of a known one."""
        self.index[part] = self.index[known]
        self.held += ENTRY_BYTES // 2 + len(part)

    def _ids(self, part) -> np.ndarray:
        at = self.index[part]
        return self.store[self.starts[at]:self.starts[at] + self.sizes[at]]

    def _cut(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """(distinct parts, which of them each part is, parts up to the end of each text)."""
        raise NotImplementedError

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's end), as the library gives them for the whole texts."""
        distinct, which, part_ends = self._cut(column)
        if self.held > self.cache_bytes:
            self._clear()
        unseen = [p for p in distinct if p not in self.index]
        short = [p for p in unseen if len(p) <= LONGEST_KEPT]
        self._learn(short)
        # long parts are there for this call only
        mark = self.slots, self.used, self.held
        long = [p for p in unseen if len(p) > LONGEST_KEPT]
        before = len(self.index)
        self._learn(long)
        at = np.fromiter(map(self.index.__getitem__, distinct), dtype=np.int64, count=len(distinct))[which]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.starts[at] - (ends - sizes), sizes)
        where += np.arange(total)
        ids = self.store[where]
        if long:
            while len(self.index) > before:
                self.index.popitem()
            self.slots, self.used, self.held = mark
            if len(self.store) > (1 << 16) and len(self.store) * 4 > 4 * self.cache_bytes:
                self._clear()
        return ids, np.r_[0, ends][part_ends]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1])


class WordEncoder(CachedEncoder):
    """The word tokenizer of the tokenizers library."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self._prepare(path)
        self.tails = {t: np.array(self._other_ids([t])[0], dtype=np.uint32) for t in ".,"}
        super().__init__(cache_bytes)

    def _prepare(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _cut(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = parts.flatten().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum(pc.list_value_length(parts).to_numpy(), dtype=np.int64)

    def _simple_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their numbers, of lower-case words of plain Latin letters, many to a call: each gives one end-of-word id, which tells them apart again."""
        calls = [" ".join(words[i:i + WORDS_PER_CALL]) for i in range(0, len(words), WORDS_PER_CALL)]
        ids = np.array([i for got in self.plain.encode_batch_fast(calls, add_special_tokens=False) for i in got.ids], dtype=np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _other_ids(self, parts: list[str]) -> list[list[int]]:
        return [got.ids for i in range(0, len(parts), WORDS_PER_CALL)
                for got in self.full.encode_batch_fast(parts[i:i + WORDS_PER_CALL], add_special_tokens=False)]

    def _learn(self, unseen: list[str]) -> None:
        simple, joined, other = {}, [], []
        for part in unseen:
            m = _PLAIN.fullmatch(part)
            if m:
                word = m[1].lower()
                if word not in self.index:
                    simple[word] = None
                if word != part:
                    joined.append((part, word, m[2]))
            else:
                other.append(part)
        if simple:
            words = list(simple)
            self._add_all(words, *self._simple_ids(words))
        if other:
            found = self._other_ids(other)
            self._add_all(other, np.array([i for ids in found for i in ids], dtype=np.uint32), np.array(list(map(len, found))))
        longer = []
        for part, word, tail in joined:
            if tail:
                longer.append((part, np.concatenate([self._ids(word), self.tails[tail]])))
            elif part not in self.index:
                self._same(part, word)
        if longer:
            self._add_all([p for p, _ in longer], np.concatenate([i for _, i in longer]), np.array([len(i) for _, i in longer]))
