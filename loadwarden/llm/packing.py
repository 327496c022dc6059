"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

Documents longer than a sequence are cut; everything else stays whole. Only the number of pieces of each length (at most 4096 numbers)
reaches the driver, where the plan is made in ranks: pieces stand in one order, longest first, and the plan says which
run of ranks goes to which run of sequences.

* Large pieces are rounded up within groups of equal cardinality, which leaves few sizes. The largest size left is combined with
  others so that the sequence is as full as possible (a subset sum over the few sizes), and the combination is used as often as
  the groups allow; this repeats until the groups are empty. Each slot of a combination takes a run of ranks, so actual
  documents, never longer than their group's size, take the places.
* The true room left in every sequence is known from the ranks. Small pieces, longest first, go to the fullest sequence that still takes them.
* Where large ends and small begins is tried at several lengths, as no one border is best for all distributions.

A piece finds its rank from its place among the pieces of its length in its task plus the counts of the tasks before. No row is
gathered anywhere but within a sequence. Null and empty texts are documents of one token, the end id; texts of any length are read
whole; repeated rows are packed each; an empty table gives no row; other columns are not read.
"""
from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwarden.llm.common import in_pieces
from loadwarden.llm.tokens import WordEncoder, tokenizer_path
from loadwarden.session import write_through

LENGTH, END_ID = 4096, 1
#: Large pieces form this many groups of equal cardinality.
SIZE_GROUPS = 1024
#: Pieces up to this part of a sequence are small. Each is planned, and the plan with the fewest sequences is used; the first one wins ties.
SMALL_SHARES = (8, 4, 2)


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, the task `part` that cut it and its `place` among that task's pieces of its length."""
    path = path or tokenizer_path()
    source = docs.select("doc_id", "text")

    def run(batches):
        encoder, part, counts = WordEncoder.shared(path), TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        for batch in in_pieces(batches):
            rows = []
            all_ids, ends = encoder.encode_column(batch.column(1))
            for i, ids in enumerate(np.split(all_ids, ends[:-1])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    cut = ids[at:at + length]
                    rows.append((i, k, at, len(cut), zlib.crc32(cut.tobytes()), int(counts[len(cut)]), cut))
                    counts[len(cut)] += 1
            columns = list(zip(*rows)) or [[]] * 7
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5]),
                      pa.array([part] * len(rows), pa.int32()), pa.array(columns[5], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            if with_ids:
                arrays.append(pa.array([c.astype(np.int32) for c in columns[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * with_ids)


class Plan:
    """Runs of ranks and the sequences they go to: rank r of run i stands in sequence first[i] + (r - rank[i]) // each[i]."""

    def __init__(self, counts: dict[int, int], length: int = LENGTH, size_groups: int = SIZE_GROUPS, small_share: int = SMALL_SHARES[0]):
        self.length, self.small = length, length // small_share
        self.sizes = sorted(counts, reverse=True)
        edges = [0, *accumulate(counts[s] for s in self.sizes)]
        #: Rank of the first piece of each length.
        self.base = dict(zip(self.sizes, edges))
        self._edges, self._lengths = np.array(edges, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        self._runs: list[tuple[int, int, int]] = []
        self.sequences = 0
        #: For each room left, the runs of sequences (first, how many) that have it.
        self._room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
        large = sum(n for s, n in counts.items() if s > self.small)
        self._pack_large(large, size_groups)
        self._pack_small(counts)
        self._runs.sort()
        self.rank, self.first, self.each = (np.array(c, dtype=np.int64) for c in (zip(*self._runs) if self._runs else ([], [], [])))

    def _length_at(self, ranks):
        return self._lengths[np.searchsorted(self._edges, ranks, side="right") - 1]

    def _pack_large(self, n: int, size_groups: int) -> None:
        if not n:
            return
        k = min(size_groups, n)
        at = [i * n // k for i in range(k)]
        left = [b - a for a, b in zip(at, [*at[1:], n])]
        size = [int(x) for x in self._length_at(np.array(at))]
        for g in range(k):
            while left[g]:
                combination = self._fullest(g, size, left)
                times = min(left[i] // q for i, q in combination)
                slots = []
                for i, q in combination:
                    for _ in range(q):
                        slots.append(at[i])
                        at[i] += times
                    left[i] -= q * times
                self._use(slots, times)

    def _fullest(self, g: int, size: list[int], left: list[int]) -> list[tuple[int, int]]:
        """The combination with group g whose sizes fill a sequence best; sums are bits of an integer."""
        room = self.length - size[g]
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for i in range(g, len(size)):
            most = min(left[i] - (i == g), room // size[i])
            if most > 0:
                steps.append((i, most, reach))
                more = reach
                for _ in range(most):
                    more = (more << size[i]) & mask
                    if not more:
                        break
                    reach |= more
                if reach >> room & 1:
                    break
        total, uses = reach.bit_length() - 1, {g: 1}
        for i, most, before in reversed(steps):
            q = next(q for q in range(most + 1) if total - q * size[i] >= 0 and before >> (total - q * size[i]) & 1)
            if q:
                uses[i] = uses.get(i, 0) + q
                total -= q * size[i]
        return list(uses.items())

    def _use(self, slots: list[int], times: int) -> None:
        """Opens `times` sequences; sequence j takes rank slot + j of every slot. Notes the true room by runs of equal lengths."""
        first = self.sequences
        self.sequences += times
        breaks = {0}
        for a in slots:
            self._runs.append((a, first, 1))
            lo, hi = np.searchsorted(self._edges, [a, a + times], side="right")
            breaks.update(int(e) - a for e in self._edges[lo:hi] if a < e < a + times)
        cuts = np.array(sorted(breaks), dtype=np.int64)
        filled = sum(self._length_at(cuts + a) for a in slots)
        for at, to, used in zip(cuts, [*cuts[1:], times], filled):
            self._room[self.length - int(used)].append((first + int(at), int(to - at)))

    def _pack_small(self, counts: dict[int, int]) -> None:
        for size in (s for s in self.sizes if s <= self.small):
            rank, n = self.base[size], counts[size]
            room = size
            while n:
                while room <= self.length and not self._room[room]:
                    room += 1
                if room > self.length:
                    each = self.length // size
                    many = max(1, n // each)
                    self._room[self.length].append((self.sequences, many))
                    self.sequences += many
                    room = self.length
                first, many = self._room[room].pop()
                each = min(n, room // size)
                taken = min(many, n // each)
                self._runs.append((rank, first, each))
                self._room[room - each * size].append((first, taken))
                if taken < many:
                    self._room[room].append((first + taken, many - taken))
                rank += taken * each
                n -= taken * each

    def sequence_of(self, ranks: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.rank, ranks, side="right") - 1
        return self.first[i] + (ranks - self.rank[i]) // self.each[i]


def best_plan(counts: dict[int, int], length: int = LENGTH, size_groups: int = SIZE_GROUPS) -> Plan:
    """The plan with the fewest sequences, over the shares that may count as small."""
    return min((Plan(counts, length, size_groups, share) for share in SMALL_SHARES), key=lambda p: p.sequences)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece (and its ids, if wanted)."""
    cut = write_through(pieces(docs, length, end_id, path, with_ids), "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(counts, length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    base = {size: plan.base[size] for size in plan.base}

    def run(batches):
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            ranks = np.array([base[s] for s in sizes.tolist()], dtype=np.int64) + batch.column("earlier").to_numpy() + batch.column("place").to_numpy()
            yield batch.append_column("rank", pa.array(ranks)).append_column("sequence_id", pa.array(plan.sequence_of(ranks)))

    joined = cut.join(offsets, ["length", "part"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema)
    placed = joined.mapInArrow(run, f"{fields}, rank long, sequence_id long")
    in_order = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                         F.coalesce(F.sum("length").over(in_order), F.lit(0)).alias("offset"), *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id and the ids of its pieces in order, from `pack(..., with_ids=True)`."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
