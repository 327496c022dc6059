"""Byte-pair encoding and decoding of whole texts by dynamic programming over prefixes.

A row of tokens is what the merges of a word give exactly when every two neighbours are: no merge across their border comes before the merges that close it.
So each prefix of a word has one last token: the token that ends there and is compatible with the last token of the prefix before it.
Tokens that end at a place are read off a suffix automaton of the vocabulary, which follows the word and whose suffix links lead from
the longest match to the shorter ones. Last tokens are stored for every prefix, and the ids are read backwards from the end of the word. The
work is linear in the length of a word, for a fixed vocabulary, also where a text has no white space.

Texts are cut at white space; distinct parts of a piece of text are encoded once per Python worker, within a bound in bytes. How a part falls into words (Unicode
form, lower case, classes of characters) is the business of the tokenizer's own normaliser and pre-tokeniser; special tokens in a text keep their ids.

Null and empty texts have no ids, and no ids decode to an empty text; null ids count as none. Texts of any length are read whole, repeated rows get equal results,
an empty table gives an empty table, and columns other than those named are not read, whatever they are called. Nothing is shuffled.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadwarden.llm.common import in_pieces
from loadwarden.llm.tokens import CACHE_BYTES, WordEncoder, tokenizer_path

#: Pairs of tokens whose compatibility a worker remembers before it starts again.
PAIRS = 1 << 18
#: Symbols: the bytes, and from here on the bytes that end a word.
END = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of the words added; `token` marks the states that are whole words. A word is the longest string of its state, as nothing stands before it."""

    def __init__(self):
        self.length, self.link, self.token = [0], [-1], [-1]
        self.go: dict[int, int] = {}  # state * 512 + symbol -> state
        self._next: list[dict[int, int]] = [{}]

    def _state(self, length: int, link: int, goes: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.token.append(-1)
        self._next.append(goes)
        return len(self.length) - 1

    def add(self, symbols: list[int], token: int) -> None:
        at = 0
        for c in symbols:
            at = self._extend(at, c)
        self.token[at] = token

    def _extend(self, at: int, c: int) -> int:
        known = self._next[at].get(c)
        if known is not None and self.length[known] == self.length[at] + 1:
            return known
        if known is not None:
            return self._split(at, c, known)
        new = self._state(self.length[at] + 1, 0, {})
        while at >= 0 and c not in self._next[at]:
            self._next[at][c] = new
            at = self.link[at]
        if at >= 0:
            found = self._next[at][c]
            self.link[new] = found if self.length[found] == self.length[at] + 1 else self._split(at, c, found)
        return new

    def _split(self, at: int, c: int, old: int) -> int:
        """The strings of `old` up to one symbol longer than those of `at`, as a state of their own."""
        short = self._state(self.length[at] + 1, self.link[old], dict(self._next[old]))
        self.link[old] = short
        while at >= 0 and self._next[at].get(c) == old:
            self._next[at][c] = short
            at = self.link[at]
        return short

    def finish(self) -> None:
        """For every state, its whole words from the longest to the shortest, as (token, length); transitions become one table."""
        self.go = {s * 512 + c: t for s, goes in enumerate(self._next) for c, t in goes.items()}
        self._next = []
        self.words: list[tuple] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            shorter = self.words[self.link[s]]
            self.words[s] = ((self.token[s], self.length[s]), *shorter) if self.token[s] >= 0 else shorter


class PrefixEncoder(WordEncoder):
    """Ids by the unique last token of every prefix; only words come from the library, not ids."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES // 2):
        super().__init__(path, cache_bytes)

    def _prepare(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix or spec.get("decoder") or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("needs a BPE tokenizer with word ends, without a decoder and without normalised special tokens")
        whole = Tokenizer.from_file(path)
        self.normalise, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab, letters = model["vocab"], byte_letters()
        self.byte_of = {letter: b for b, letter in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text_of = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.text_of[i] = text
        #: Order in which the merges make a token (single symbols -1), and the halves of its merge.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.made: dict[int, int] = {}
        symbols = {vocab[x + e]: [b + END * bool(e)] for b, x in enumerate(letters) for e in ("", suffix) if x + e in vocab}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, i = vocab[a], vocab[b], vocab[a + b]
            if self.rank[i] >= 0 or max(self.rank[x], self.rank[y]) >= rank:
                raise ValueError("needs merges that make each token once, from tokens made before")
            self.rank[i], self.left[i], self.right[i] = rank, x, y
            self.made[x * size + y] = rank
            symbols[i] = symbols[x] + symbols[y]
        self.size = size
        self.automaton = SuffixAutomaton()
        for i in sorted(symbols):
            self.automaton.add(symbols[i], i)
        self.automaton.finish()
        self.pairs: dict[int, bool] = {}

    def compatible(self, x: int, y: int) -> bool:
        """Whether `x` and `y` can stand side by side: going down from both along the border, latest merge first, no pair
        that meets there merges before the merge that was just undone. Of equal merges the one to the left comes first."""
        size, made, rank = self.size, self.made, self.rank
        limit = len(made)
        while True:
            across = made.get(x * size + y)
            if across is not None and across < limit:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                limit, x = rank[x], self.right[x]
            else:
                limit, y = rank[y] + 1, self.left[y]

    def words_ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words; the last byte of each is a symbol of its own, as it ends the word. Words go in alphabetical order, so that what
        is stored for the prefixes that a word shares with the one before it stands already."""
        go, link, length, matches = self.automaton.go, self.automaton.link, self.automaton.length, self.automaton.words
        pairs, size = self.pairs, self.size
        known, compatible = pairs.get, self.compatible
        out: list[list[int]] = [[]] * len(words)
        # per prefix: last token, its length, state of the automaton and length of the match
        last, back, states, matched = [-1], [0], [0], [0]
        previous = b""
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            ends = len(word)
            m = min(len(previous), ends)
            differ = int.from_bytes(previous[:m]) ^ int.from_bytes(word[:m])
            # neither the last byte of this word nor that of the one before is shared
            shared = min(m - (differ.bit_length() + 7) // 8, len(previous) - 1, ends - 1)
            shared = max(shared, 0)
            del last[shared + 1:], back[shared + 1:], states[shared + 1:], matched[shared + 1:]
            state, reach = states[shared], matched[shared]
            previous = word
            for i in range(shared + 1, ends + 1):
                c = word[i - 1] if i < ends else word[i - 1] + END
                to = go.get(state * 512 + c)
                if to is None:
                    while to is None and state:
                        state = link[state]
                        to = go.get(state * 512 + c)
                    if to is None:
                        raise ValueError("a symbol is missing in the vocabulary")
                    reach = length[state]
                reach += 1
                state = to
                for token, n in matches[state] if reach == length[state] else matches[link[state]]:
                    if n == i:
                        break
                    key = last[i - n] * size + token
                    fits = known(key)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[key] = compatible(last[i - n], token)
                    if fits:
                        break
                else:
                    raise ValueError("no token ends at a prefix")
                last.append(token)
                back.append(n)
                states.append(state)
                matched.append(reach)
            ids, i = [], ends
            while i:
                ids.append(last[i])
                i -= back[i]
            ids.reverse()
            out[at] = ids
        return out

    def words_of(self, part: str) -> list[bytes | int]:
        """The words that the tokenizer cuts text without ASCII white space into, and the ids of special tokens."""
        out = []
        for piece in self.special_at.split(part) if self.special_at else [part]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += [bytes(map(self.byte_of.__getitem__, word)) for word, _ in self.cut(self.normalise(piece))]
        return out

    def _simple_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.words_ids([w.encode() for w in words])
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array(list(map(len, found)))

    def _other_ids(self, parts: list[str]) -> list[list[int]]:
        cut = [self.words_of(p) for p in parts]
        words = list({w for some in cut for w in some if isinstance(w, bytes)})
        ids_of = dict(zip(words, self.words_ids(words)))
        return [[i for w in some for i in (ids_of[w] if isinstance(w, bytes) else [w])] for some in cut]


class Decoder:
    """The tokens joined by spaces, special tokens included, which is what a tokenizer without a decoder does; unknown ids are left out."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder"):
            raise ValueError("needs a tokenizer without a decoder")
        self.text_of = dict(sorted((i, t) for t, i in [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.text_of[i] for i in ids.tolist() if i in self.text_of])


def _encoded(piece: pa.RecordBatch, encoder: PrefixEncoder) -> pa.RecordBatch:
    ids, ends = encoder.encode_column(piece.column(1))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([piece.column(0), lists], names=["doc_id", "ids"])


def _decoded(piece: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
    texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in piece.column(1)]
    return pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of every text, as an array."""
    path = path or tokenizer_path()
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder.shared(path)
        for piece in in_pieces(batches):
            yield _encoded(piece, encoder)

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids decode to."""
    path = path or tokenizer_path()
    source = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _decoded(batch.slice(at, 256), decoder)

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`encode` and `decode` in one pass over the texts: doc_id, ids and the text that the ids decode to."""
    path = path or tokenizer_path()
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = PrefixEncoder.shared(path), Decoder(path)
        for piece in in_pieces(batches):
            yield _decoded(_encoded(piece, encoder), decoder)

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, text string")
