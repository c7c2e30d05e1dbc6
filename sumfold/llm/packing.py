"""Bounded-space online packing of token sequences into fixed windows.

Every partition keeps at most ``open_windows`` windows open. A document's ids (its text's and the
end id) are cut into whole windows while they are longer than one; the rest goes into the open
window that it fits best. Where it fits none and no further window may be opened, the fullest
window leaves: if its gap is ``min_cut`` ids or more, the document's first ids fill the gap,
otherwise the gap stays as padding. What is open at a partition's end is merged with that of
other partitions, cutting freely, so that one window for each ``merge_partitions`` partitions
stays unfilled at most.

Defined cases: null and empty texts give the end id alone; equal rows are packed as often as they
stand there; a null ``doc_id`` stays null; an empty table gives no pieces; columns other than
``doc_id`` and ``text`` are not looked at. Memory of a task is bounded by the open windows and
the longest text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import texts, written
from sumfold.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_FLUSH = 4 << 20  # bytes of ids in an Arrow batch


class Windows:
    """Open windows of ``capacity`` ids; ``place`` and ``close`` give finished pieces.

    A piece is (document, start, ids, window, offset), a document being whatever the caller gave.
    """

    def __init__(self, capacity: int, open_windows: int, min_cut: int):
        self.capacity, self.most, self.min_cut = capacity, open_windows, min_cut
        self.gaps: list[tuple[int, int]] = []  # of the open windows, smallest gap first
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def _put(self, at: int | None, doc, start: int, ids: bytes) -> Iterator[tuple]:
        if at is None:
            gap, window = self.capacity, self.next
            self.pieces[window], self.next = [], self.next + 1
        else:
            gap, window = self.gaps.pop(at)
        n = len(ids) // 4
        self.pieces[window].append((doc, start, ids, window, self.capacity - gap))
        if gap > n:
            insort(self.gaps, (gap - n, window))
        else:
            yield from self.pieces.pop(window)

    def place(self, doc, ids: bytes, start: int = 0) -> Iterator[tuple]:
        size = 4 * self.capacity
        while len(ids) >= size:
            yield from self._put(None, doc, start, ids[:size])
            ids, start = ids[size:], start + self.capacity
        while ids:
            at = bisect_left(self.gaps, (len(ids) // 4, -1))
            if at < len(self.gaps):
                yield from self._put(at, doc, start, ids)
                return
            if len(self.gaps) < self.most:
                yield from self._put(None, doc, start, ids)
                return
            gap, window = self.gaps[0]
            if gap < self.min_cut:
                self.gaps.pop(0)
                yield from self.pieces.pop(window)
            else:
                yield from self._put(0, doc, start, ids[: 4 * gap])
                ids, start = ids[4 * gap :], start + gap

    def close(self) -> Iterator[tuple]:
        for _, window in self.gaps:
            yield from self.pieces.pop(window)
        self.gaps = []


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _rows(pieces: Iterator[tuple], first: int) -> Iterator[tuple]:
    for (doc_id, total), start, ids, window, offset in pieces:
        yield doc_id, start, len(ids) // 4, total, first + window, offset, ids


def _flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6]) + 64
        if size > _FLUSH:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = 2048, open_windows: int = 32, min_cut: int = 16, merge_partitions: int = 64) -> DataFrame:
    """Pack ``docs`` (doc_id, text); a row of ``PIECES`` for each piece, with its ids.

    ``ids`` are little-endian unsigned 32-bit integers. ``sequence_id`` is unique over all
    partitions and ``offset`` gapless from 0 within it.
    """
    end = end_id.to_bytes(4, "little")
    schema = _SCHEMA.append(pa.field("part", pa.int64()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        windows = Windows(capacity, open_windows, min_cut)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) + end
                    for row in _rows(windows.place((doc_id, len(ids) // 4), ids), part << 32):
                        yield (*row, None)
            for row in _rows(windows.close(), part << 32):
                yield (*row, part)

        yield from _flushed(rows(), schema)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        group = key[0].as_py()
        windows, t = Windows(capacity, 1, 1), t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        out: list[tuple] = []
        for r in t.to_pylist():
            out += windows.place((r["doc_id"], r["doc_tokens"]), r["ids"], r["start"])
        out += windows.close()
        return pa.Table.from_batches([_batch(list(_rows(out, ((1 << 30) + group) << 32)), _SCHEMA)])

    # ``part`` is null in pieces of finished windows; in what was left open it names the partition
    packed = written(texts(docs).mapInArrow(first, PIECES + ", part long"), "packed")
    left = packed.where("part IS NOT NULL").withColumn("part", F.expr(f"part DIV {merge_partitions}"))
    return packed.where("part IS NULL").drop("part").unionByName(left.groupBy("part").applyInArrow(merge, PIECES))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
