"""Packing of documents into fixed-length training windows (operator 6).

Sum-of-squares online packing: each document's last part goes to the fill
level that keeps the sum of squared counts of partly filled windows least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.pretokens import slices
from wordloom.llm.tokens import TextEncoder

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class SumOfSquares:
    """Windows of ``capacity`` ids, tracked by fill level.

    A piece is a tuple (doc, start, ids, doc size).  ``place`` and ``finish``
    return the windows that are complete, each a list of pieces.
    """

    def __init__(self, capacity: int, most_open: int = 4096):
        self.capacity, self.most_open = capacity, most_open
        self.count = np.zeros(capacity + 1, np.int64)  # windows at each level; 0 and capacity stay empty
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """The level whose window takes ``size`` ids best, 0 for a new window.

        Taking one from level h changes the sum by 1 - 2 n(h), reaching level
        h + size by 1 + 2 n(h + size), nothing if that fills the window.  Ties
        go to the fullest window.
        """
        full = self.capacity - size
        change = 2 * self.count[size : self.capacity + 1] + 1
        change[full] = 0
        change[1:] += 1 - 2 * self.count[1 : full + 1]
        change[1:][self.count[1 : full + 1] == 0] = np.iinfo(np.int64).max
        return full - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list[list]:
        doc, start, ids, total = piece
        done, whole = [], len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            done.append([(doc, start + at, ids[at : at + self.capacity], total)])
        rest = ids[whole:]
        if len(rest):
            done += self._put((doc, start + whole, rest.copy(), total))
            if self.count.sum() > self.most_open:
                done += self.merge()
        return done

    def _put(self, piece: tuple) -> list[list]:
        size = len(piece[2])
        h = self.level(size)
        window = []
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
        window.append(piece)
        if h + size == self.capacity:
            return [window]
        self.windows[h + size].append(window)
        self.count[h + size] += 1
        return []

    def merge(self) -> list[list]:
        """Fill the fullest open windows with pieces cut from the emptiest; at most one stays open."""
        left = [w for level in reversed(self.windows) for w in level]
        self.windows = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0
        done, donor = [], len(left) - 1
        for at, window in enumerate(left):
            if at > donor:
                break
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and donor > at:
                doc, start, ids, total = left[donor].pop()
                take = min(room, len(ids))
                window.append((doc, start, ids[:take], total))
                if take < len(ids):
                    left[donor].append((doc, start + take, ids[take:], total))
                room -= take
                if not left[donor]:
                    donor -= 1
            if room:
                size = self.capacity - room
                self.windows[size].append(window)
                self.count[size] += 1
            else:
                done.append(window)
        return done

    def finish(self) -> list[list]:
        """Close all windows; the last ids go to windows of powers of two, which need no padding."""
        done = self.merge()
        rest = [p for level in self.windows for w in level for p in w]
        size = sum(len(p[2]) for p in rest)
        for power in reversed(range(size.bit_length())):
            room, window = (size >> power & 1) << power, []
            while room:
                doc, start, ids, total = rest.pop()
                take = min(room, len(ids))
                window.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
                room -= take
            if window:
                done.append(window)
        return done


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4_000_000, most_open: int = 4096) -> DataFrame:
    """Pieces of all documents in windows of at most ``capacity`` ids.

    Each row is one piece: doc_id, start and length in its document, the
    document's number of ids (end id included), sequence_id, offset in that
    sequence, ids (little-endian 32-bit integers).  Every input partition packs
    its own documents, so nothing is shuffled; it leaves at most one window that
    is not full, which is split by powers of two.  Once over ``most_open``
    windows are partly filled, which bounds memory, they are filled from each
    other by cutting, and placing goes on with at most one of them.  A null text counts as empty
    and gives the end id alone; null and repeated doc_ids are kept row by row.
    An empty table gives no rows.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = TextEncoder.of(tokenizer_path), SumOfSquares(capacity, most_open)
        sequence = TaskContext.get().partitionId() << 36

        def emit(windows: list[list]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    out.append((doc, start, len(ids), total, sequence, offset, ids.tobytes()))
                    offset += len(ids)
                sequence += 1
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

        texts = ((t, i) for b in batches for t, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True))
        for group in slices(texts, slice_bytes):
            ids, counts = encoder.encode([t for t, _ in group], end_id)
            at, done = 0, []
            for (_, doc), n in zip(group, counts.tolist(), strict=True):
                done += packer.place((doc, 0, ids[at : at + n], n))
                at += n
            yield emit(done)
        yield emit(packer.finish())

    return rows.mapInArrow(pack, PIECE_SCHEMA)
