"""Packing of documents into training windows: bounded-space online best fit.

Each partition keeps at most ``open_windows`` windows open.  A document goes into
the open window that it fills most nearly; if it fits none and no more may be
opened, the fullest window is given out and a new one opened.  What is open at the
end of a partition is merged: leftovers are packed again, whole, in ever fewer
partitions (about ``open_windows`` squared leftovers each), until one partition
closes all.  Memory is bounded everywhere, and nothing is shuffled but leftovers.

A document longer than a window fills whole windows of its own with its first
tokens; its rest is packed as any other.  Every token of every document is in
exactly one window.

Result: ``window_id, n_tokens, doc_ids, starts, lengths``; piece ``i`` of a window
is tokens ``starts[i]`` to ``starts[i] + lengths[i]`` of ``doc_ids[i]``.

Which documents share a window depends on how the table is partitioned, as each partition is packed online; ``window_id`` is
unique and no more.  What never depends on it: every token once, no window over its capacity.

Edge cases.  Null and empty texts have no tokens and are in no window; repeated
rows are packed each for itself; of equally full windows the one opened first is
taken; an empty table gives no windows; null doc_ids stay null; extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, bpe
from .storage import stored

PIECES = "is_open boolean, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>"


class Packer:
    """The windows of one partition.  ``add`` and ``close`` return windows given out: ``(used, pieces)``."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.most = capacity, open_windows
        self.room: list[tuple[int, int]] = []  # room left and number of each open window, in order
        self.used: dict[int, tuple[int, list]] = {}
        self.next = 0

    def add(self, size: int, pieces: list) -> list[tuple[int, list]]:
        out = []
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, number = self.room.pop(at)
            self.used[number][1].extend(pieces)
        else:
            if len(self.room) >= self.most:
                room, number = self.room.pop(0)
                out.append((self.capacity - room, self.used.pop(number)[1]))
            room, number = self.capacity, self.next
            self.next += 1
            self.used[number] = (number, list(pieces))
        if room == size:
            out.append((self.capacity, self.used.pop(number)[1]))
        else:
            insort(self.room, (room - size, number))
        return out

    def close(self) -> list[tuple[int, list]]:
        out = [(self.capacity - room, self.used.pop(number)[1]) for room, number in self.room]
        self.room = []
        return out


def _batch(windows: list[tuple[int, list]], is_open: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([is_open] * len(windows), pa.bool_()), pa.array([n for n, _ in windows], pa.int32()), *(pa.array([[p[k] for p in pieces] for _, pieces in windows], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32())))],
        names=["is_open", "n_tokens", "doc_ids", "starts", "lengths"],
    )


def pack(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, open_windows: int = 64, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """Windows of at most ``capacity`` tokens over every document of ``df``."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = bpe.library_encoder(vocabulary), Packer(capacity, open_windows)
        for batch in arrays.eased(batches):
            texts = arrays.text_column(batch.column(1))
            for lo, hi in arrays.slices(texts):
                sizes = np.diff(encoder.encode(texts.slice(lo, hi - lo))[1]).tolist()
                out = []
                for doc, size in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), sizes, strict=True):
                    start = 0
                    while size - start >= capacity:
                        out.append((capacity, [(doc, start, capacity)]))
                        start += capacity
                    if size > start:
                        out += packer.add(size - start, [(doc, start, size - start)])
                if out:
                    yield _batch(out, False)
        yield _batch(packer.close(), True)

    source = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    windows = stored(source.mapInArrow(first, PIECES), "packed")
    done = windows.where("not is_open")
    left = windows.where("is_open")
    count = left.count()
    while count:
        tasks = max(1, count // open_windows**2)
        left = merged(left, tasks, capacity, open_windows)
        if tasks == 1:
            done, count = done.unionByName(left), 0
        else:
            left = stored(left, "packed")
            done, left = done.unionByName(left.where("not is_open")), left.where("is_open")
            count = left.count()
    return done.select(F.monotonically_increasing_id().alias("window_id"), "n_tokens", "doc_ids", "starts", "lengths")


def merged(left: DataFrame, tasks: int, capacity: int, open_windows: int) -> DataFrame:
    """Leftover windows packed again, the fullest first, in ``tasks`` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, open_windows)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += packer.add(row["n_tokens"], list(zip(row["doc_ids"], row["starts"], row["lengths"], strict=True)))
            if out:
                yield _batch(out, False)
        yield _batch(packer.close(), tasks > 1)

    spread = left.repartition(tasks, F.xxhash64("doc_ids", "starts")) if tasks > 1 else left.coalesce(1)
    return spread.sortWithinPartitions(F.desc("n_tokens"), "doc_ids", "starts").mapInArrow(run, PIECES)
