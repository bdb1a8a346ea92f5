"""Hierarchical multi-length packing.

Documents are routed to context tiers (512 to 4096 tokens): one longer than the
longest tier is cut into full windows of it, and what remains goes, like any
shorter document, to the smallest tier that holds it whole.  Each tier is packed
on its own: a window takes the longest waiting piece and then the longest that
still fits.  What is left open is filled from shorter tiers, longest piece first
again, and the last gap by the front part of a waiting piece, whose rest is
routed anew.  So every window is exactly as long as its tier, and a tier is a
power of two, so nothing is padded.  What waits at the end of a partition is
packed into windows of ever smaller powers of two.

Sequences are dealt to steps of ``step_tokens`` tokens.  A step holds windows of
one tier, as many as fill it exactly; the unfinished steps of a partition are
merged, longest window first, so that all but the partition's last step have the
same number of tokens.

Packing runs where the rows are: one pass per input partition, without a
shuffle.  A task holds one chunk of texts and at most ``LOOKAHEAD`` windows of
pieces a tier, however many rows it reads.

Edge cases: a NULL or empty text is a document of the end id alone.  A
NULL doc_id is kept as NULL.  Rows that repeat a doc_id are packed one by one.
An empty table gives no sequences.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcodec import encoded_chunks

# ---- Fixed values: context tiers and step size ----
TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 16 * 4096
LOOKAHEAD = 32           # windows of a tier that wait before they are packed
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, tier int, step_id bigint")


class Packer:
    """Packs the documents of one partition; ``rows`` collects the finished pieces.

    A piece is (length, serial, doc_id, doc_tokens, start, ids); pieces of a
    tier wait sorted by length.
    """

    def __init__(self, partition: int, tiers=TIERS, step_tokens=STEP_TOKENS, lookahead=LOOKAHEAD):
        self.tiers, self.step_tokens, self.lookahead = tuple(sorted(tiers)), step_tokens, lookahead
        self.base = partition << 33
        self.waiting = {t: [] for t in self.tiers}
        self.held = dict.fromkeys(self.tiers, 0)
        self.unfinished: dict[int, list] = {}
        self.serial = self.sequences = self.steps = 0
        self.rows: list[tuple] = []

    # ---- routing
    def add(self, doc_id, ids: np.ndarray) -> None:
        self._route((len(ids), 0, doc_id, len(ids), 0, ids))
        for tier in reversed(self.tiers):
            if self.held[tier] >= self.lookahead * tier:
                self._pack(tier, 2 * tier)

    def _route(self, piece) -> None:
        longest = self.tiers[-1]
        while piece[0] >= longest:
            front, piece = self._cut(piece, longest)
            self._finish(longest, [front])
        if piece[0]:
            tier = next(t for t in self.tiers if t >= piece[0])
            self.serial += 1
            # a copy, so that a waiting piece does not hold its whole chunk in memory
            insort(self.waiting[tier], (piece[0], self.serial, *piece[2:5], piece[5].copy()),
                   key=lambda p: p[:2])
            self.held[tier] += piece[0]

    @staticmethod
    def _cut(piece, length: int):
        size, serial, doc_id, total, start, ids = piece
        return ((length, serial, doc_id, total, start, ids[:length]),
                (size - length, serial, doc_id, total, start + length, ids[length:]))

    # ---- packing
    def _take(self, tier: int, at: int):
        piece = self.waiting[tier].pop(at)
        self.held[tier] -= piece[0]
        return piece

    def _longest(self, gap: int, tiers):
        """The longest waiting piece of at most ``gap``, the longer tiers first."""
        for tier in tiers:
            at = bisect_right(self.waiting[tier], gap, key=lambda p: p[0]) - 1
            if at >= 0:
                return self._take(tier, at)
        return None

    def _fill(self, size: int, tiers) -> list:
        """Pieces that are ``size`` tokens together; ``tiers`` hold at least as many."""
        pieces, gap = [], size
        while gap:
            piece = self._longest(gap, tiers)
            if piece is None:          # every waiting piece is longer than the gap
                tier = next(t for t in reversed(tiers) if self.waiting[t])
                piece, rest = self._cut(self._take(tier, 0), gap)
                self._route(rest)
            pieces.append(piece)
            gap -= piece[0]
        return pieces

    def _pack(self, tier: int, keep: int) -> None:
        tiers = [t for t in reversed(self.tiers) if t <= tier]
        while self.held[tier] >= max(keep, tier):
            self._finish(tier, self._fill(tier, tiers))

    def close(self) -> None:
        """Pack all that waits, then deal out the unfinished steps."""
        tiers = list(reversed(self.tiers))
        for tier in tiers:
            self._pack(tier, tier)
        while left := sum(self.held.values()):
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            self._finish(size, self._fill(size, tiers))
        step, room = [], self.step_tokens
        for sequence in sorted((s for x in self.unfinished.values() for s in x), key=lambda s: -s[0]):
            if sequence[0] > room:
                self._emit(step)
                step, room = [], self.step_tokens
            step.append(sequence)
            room -= sequence[0]
        self._emit(step)
        self.unfinished = {}

    # ---- steps
    def _finish(self, size: int, pieces: list) -> None:
        step = self.unfinished.setdefault(size, [])
        done, offset = [], 0
        for length, _, doc_id, total, start, ids in pieces:
            done.append((doc_id, start, length, zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")),
                         total, self.base + self.sequences, offset, size))
            offset += length
        self.sequences += 1
        step.append((size, done))
        if len(step) * size >= self.step_tokens:
            self._emit(step)
            self.unfinished[size] = []

    def _emit(self, step: list) -> None:
        for _, pieces in step:
            self.rows += [(*piece, self.base + self.steps) for piece in pieces]
        self.steps += bool(step)

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in range(9)]
        self.rows = []
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)],
                                          names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers=TIERS,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: ``SCHEMA``.  ``sequence_id`` and ``step_id`` are unique over all partitions."""
    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for rows, ids, bounds in encoded_chunks(batches, tokenizer_path, end_id):
            for doc_id, a, b in zip(rows.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                packer.add(doc_id, ids[a:b])
            yield packer.taken()
        packer.close()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
