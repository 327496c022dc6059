"""SentencePiece encoding and decoding of a BPE model by batched numpy Viterbi.

Words of equal length advance together, position by position. The substrings that end at a position are looked up by rolling hashes in the sorted hashes
of the model's pieces; a piece may end there if the piece that the best segmentation of the words before it ends with can stand to its
left. The maximum over the lengths is stored as a back-pointer, and the segmentations are read off backwards.

A BPE model does not maximise a sum of scores, so the value maximised is validity: a row of pieces is what the merges produce exactly when every two
neighbours are (no merge across their border comes before the merges that close it), and then every prefix has exactly one such last
piece. Whether two pieces may be neighbours is decided by going down their merge trees, for all pairs of a batch at once.

Words between spaces are encoded once per Python worker and cache filling. Words of LONG characters and more are cut at pairs of characters that no
piece has side by side, and their parts join the batches of their length; parts over LONG characters, and runs of spaces, whose pieces share one
score, take the same merges one by one, over a heap. Characters outside the model fall back to
bytes. Decoding is the reverse; bytes that are no UTF-8 become replacement characters. As in the library, a text that has U+2581 decodes to spaces.

Null texts count as empty and have no ids; texts of any length are read whole; repeated rows get equal results; other columns are not read.
"""
from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loadwarden.llm.common import map_texts, texts_of
from loadwarden.llm.tokens import CACHE_BYTES, CachedEncoder, tokenizer_path

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
LONG = 64
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.int64(1 << 40)
#: The leading 21 bits of a hash tell at once that most substrings are no piece.
_SEEN_SHIFT = np.uint64(43)


class PieceEncoder(CachedEncoder):
    def __init__(self, path: str, cache_bytes: int = 2 * CACHE_BYTES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        usable = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in usable}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.bytes_of = [b""] * len(ids)
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.pairs = {p[k:k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self._build()
        super().__init__(cache_bytes)

    def _build(self) -> None:
        """Tables over the pieces that encode to themselves: hash, rank (single characters -1), length and the halves of the last merge."""
        trees = {p: self._merge(p, True) for p in self.id_of}
        pieces = [p for p, t in trees.items() if len(t) == 1]
        self.longest = max(map(len, pieces), default=1)
        size = max(self.id_of.values(), default=0) + 1
        order = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: (-self.score[p], self.id_of[p])))}
        self.rank, self.length = np.full(size, -1, dtype=np.int64), np.ones(size, dtype=np.int64)
        self.hash = np.zeros(size, dtype=np.uint64)
        self.left, self.right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.power = np.ones(self.longest * 2 + 1, dtype=np.uint64)
        for k in range(1, len(self.power)):
            self.power[k:] *= _BASE
        for p in pieces:
            i = self.id_of[p]
            self.length[i] = len(p)
            self.hash[i] = self._prefix_hashes(np.array([[ord(c) for c in p]], dtype=np.uint64))[0, -1]
            if len(p) > 1:
                self.rank[i] = order[p]
                half = trees[p][0][1]
                self.left[i], self.right[i] = self.id_of[p[:half]], self.id_of[p[half:]]
        ids = np.array([self.id_of[p] for p in pieces], dtype=np.int64)
        self.keys = np.sort(self.hash[ids])
        self.key_ids = ids[np.argsort(self.hash[ids], kind="stable")]
        self.seen = np.zeros(1 << 21, dtype=bool)
        self.seen[(self.keys >> _SEEN_SHIFT).astype(np.int64)] = True

    @staticmethod
    def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + codes[:, k] + np.uint64(1)
        return out

    def _merge(self, word: str, trees: bool = False) -> list:
        """The merges one by one, best score first, then leftmost. With `trees`, (piece, where its last merge joined) pairs."""
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        end, joined = list(range(1, len(word) + 1)), [0] * len(word)
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(word):
                s = self.score.get(word[a:end[b]])
                if s is not None:
                    heapq.heappush(heap, (-s, a, b, end[b]))

        for k in range(len(word)):
            offer(k)
        while heap:
            _, a, b, to = heapq.heappop(heap)
            if end[a] != b or end[b] != to:  # one of the two has been merged meanwhile
                continue
            joined[a], end[a], after[a], end[b] = b - a, to, after[b], -1
            if after[a] < len(word):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        starts, k = [], 0
        while k < len(word):
            starts.append(k)
            k = end[k]
        if trees:
            return [(word[a:end[a]], joined[a]) for a in starts]
        return [i for a in starts for i in self._ids_of(word[a:end[a]])]

    def _ids_of(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [i] if i is not None else [self.byte_ids.get(b, 0) for b in piece.encode("utf-8", "surrogatepass")]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.seen[(hashes >> _SEEN_SHIFT).astype(np.int64)])  # most substrings are no piece and end here
        probes = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == probes, self.key_ids[at], -1)
        return out

    def _neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' text gives back the two pieces.

        Going back in time from the whole pieces, the younger of the two border symbols is opened: its half at the border stood there until the
        symbol's own merge. A merge across the border that comes before it would have taken place.
        """
        fine = np.ones(len(left), dtype=bool)
        at, x, y, limit = np.arange(len(left)), left, right, np.full(len(left), _FREE)
        while len(at):
            across = self._find(self.hash[x] * self.power[self.length[y]] + self.hash[y])
            clash = (across >= 0) & (np.where(across >= 0, self.rank[across], 0) < limit)
            fine[at[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            open_left = rx > ry
            limit = np.where(open_left, rx, ry + 1)  # of equal merges the left one comes first
            x, y = np.where(open_left, self.right[x], x), np.where(open_left, y, self.left[y])
        return fine

    def _viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, n).astype(np.uint64)
        prefix = self._prefix_hashes(codes)
        last = np.full((m, n + 1), -1, dtype=np.int64)
        step = np.zeros((m, n + 1), dtype=np.int64)
        rows = np.arange(m)
        for i in range(1, n + 1):
            for size in range(1, min(i, self.longest) + 1):  # a longer valid piece replaces a shorter; in exact arithmetic there is just one
                piece = self._find(prefix[:, i] - prefix[:, i - size] * self.power[size])
                if size == 1:
                    step[piece < 0, i] = 1  # a character outside the model stands alone
                some = np.flatnonzero(piece >= 0)
                if i > size and len(some):
                    some = some[step[some, i - size] > 0]
                    before = last[some, i - size]
                    valid = before < 0
                    beside = np.flatnonzero(~valid)
                    valid[beside] = self._neighbours(before[beside], piece[some[beside]])
                    some = some[valid]
                last[some, i], step[some, i] = piece[some], size
        at, found = np.full(m, n), []
        while (at > 0).any():
            open_ = at > 0
            found.append(np.where(open_, at * 64 + step[rows, at], 0))
            if (step[rows, at][open_] == 0).any():
                return [self._merge(w) for w in words]
            at = at - np.where(open_, step[rows, at], 0)
        out = []
        for word, row in zip(words, np.array(found).T[:, ::-1].tolist()):
            out.append([i for v in row if v for i in self._ids_of(word[v // 64 - v % 64:v // 64])])
        return out

    def _cut(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        texts = pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = lists.flatten(), np.r_[0, np.cumsum(counts)]
        # texts with runs of spaces, or with spaces at an end, are cut one by one
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, "")))
        some, at = [], 0
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts = self._parts(texts[i].as_py())
            some += [flat.slice(ends[at], ends[i] - ends[at]), pa.array(parts, pa.string())]
            counts[i], at = len(parts), i + 1
        flat = pa.concat_arrays([*some, flat.slice(ends[at])]) if some else flat
        coded = flat.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum(counts)

    def _parts(self, text: str) -> list[str]:
        """Words without the one space before them; words after several spaces with all of them."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        return [w[1:] if w[1:2] != SPACE else w for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]

    def _pieces(self, word: str) -> list[str]:
        """The parts of a word between characters that no piece has side by side."""
        parts, at = [], 0
        for k in range(1, len(word)):
            if word[k - 1:k + 1] not in self.pairs:
                parts.append(word[at:k])
                at = k
        return [*parts, word[at:]]

    def _learn(self, unseen: list[str]) -> None:
        by_length, found, cut = defaultdict(dict), {}, {}
        for part in unseen:
            if part[:1] == SPACE:
                found[part] = self._merge(part)
            elif len(part) >= LONG:
                cut[part] = self._pieces(SPACE + part)
                for p in cut[part]:
                    by_length[len(p)][p] = None
            else:
                by_length[len(part) + 1][SPACE + part] = None
        ids_of = {}
        for size, words in by_length.items():
            words = list(words)
            if size > LONG:
                ids_of.update((w, self._merge(w)) for w in words)
                continue
            for at in range(0, len(words), 8192):
                some = words[at:at + 8192]
                ids_of.update(zip(some, self._viterbi(some)))
        for part in unseen:
            if part in cut:
                found[part] = list(chain.from_iterable(map(ids_of.__getitem__, cut[part])))
            elif part not in found:
                found[part] = ids_of[SPACE + part]
        if found:
            self._add_all(list(found), np.fromiter(chain.from_iterable(found.values()), dtype=np.uint32), np.fromiter(map(len, found.values()), dtype=np.int64))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of every text, as an array."""
    path = path or tokenizer_path(MODEL)
    source = docs.select("doc_id", "text")

    def run(batches):
        encoder = PieceEncoder.shared(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in encoder.encode(texts_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of every array of ids; null ids give an empty text."""
    path = path or tokenizer_path(MODEL)
    source = encoded.select("doc_id", "ids")

    def run(batches):
        encoder = PieceEncoder.shared(path)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_ids, n_byte_ids (ids of single bytes), ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars, and whether decoding gave the text back."""
    path = path or tokenizer_path(MODEL)

    def make():
        encoder = PieceEncoder.shared(path)
        single = np.array(sorted(encoder.byte_ids.values()), dtype=np.uint32)

        def work(texts):
            ids = encoder.encode(texts)
            back = [encoder.decode(x) for x in ids]
            return {"n_ids": [len(x) for x in ids], "n_byte_ids": [int(np.isin(x, single).sum()) for x in ids],
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], "decoded_chars": [len(b) for b in back],
                    "same_text": [b == t for b, t in zip(back, texts)]}
        return work

    return map_texts(docs, make, "n_ids long, n_byte_ids long, ids_crc32 long, decoded_chars long, same_text boolean")
