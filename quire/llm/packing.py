"""Packing: sum-of-squares online placement of documents into windows of fixed length.

Method: each task streams its documents.  Of a document's tokens, whole windows are cut off
first; the rest is placed into the fill level h (0: a fresh window) whose choice leaves the
smallest sum of squared counts of partially filled windows.  The counts stand in one level
array, so a placement costs one vectorised look over the levels.  A task may hold LEAST_OPEN
windows open and one more for every OPEN_EACH tokens that it has placed, up to MOST_OPEN, which
bounds memory.  At that number the same rule chooses among the open windows only: those that
take the rest whole and those that it fills, cut there, with what is left over in a window of
its own.  What has been placed stays where it is.  At the end of a task's input the emptiest open
windows are dissolved to fill the fullest, and the last one is cut into sequences whose lengths
are powers of two, so nothing is padded.  `placed` is false for tokens that this end has moved.

Every task packs by itself, so there is no shuffle and a lost task is simply run again.

Defined cases: a null or empty text is the single end id; repeated rows and null ids are
packed like others; a text of many windows is cut at window ends; of levels with an equal sum
the fullest is taken; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quire.llm import _tokens

WINDOW = 1024
END_ID = 0
#: Sequence ids: the task's number times this, plus a running number within the task.
TASK_STRIDE = 1 << 40
OUT_ROWS = 20_000
NEVER = 1 << 60
#: Windows that a task holds open at first and at most (some 16 MB of ids), and tokens placed for each further one.
LEAST_OPEN, MOST_OPEN, OPEN_EACH = 8, 4096, 1 << 14

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed boolean"


class Levels:
    """Partially filled windows by fill level, with the sum-of-squares rule."""

    def __init__(self, window: int = WINDOW, most: int = MOST_OPEN):
        self.window, self.most = window, most
        self.held = self.tokens = 0
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """The level to place `size` into: the smallest change of the sum; ties to the fullest."""
        count, top = self.count, self.window - size
        # Moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2,
        # a window that becomes full by 1 - 2 N[h], a fresh one by 2 N[size] + 1.
        gain = 2 * (count[size : self.window + 1] - count[: top + 1]) + 2
        gain[top] = 1 - 2 * count[top]
        gain[0] = 2 * count[size] + 1
        gain[1:][count[1 : top + 1] == 0] = NEVER
        return top - int(np.argmin(gain[::-1]))

    def choose_open(self, size: int) -> int:
        """The same among open windows; beyond window - size a level is filled by a cut, and what
        is left over opens a window.  Ties to placements without a cut."""
        count, top = self.count, self.window - size
        whole = 2 * (count[size : self.window + 1] - count[: top + 1]) + 2
        whole[top] = 1 - 2 * count[top]
        whole[count[: top + 1] == 0] = NEVER
        whole[0] = NEVER
        cut = 2 * (count[1:size] - count[top + 1 : self.window]) + 2
        cut[count[top + 1 : self.window] == 0] = NEVER
        best = top - int(np.argmin(whole[::-1]))
        if len(cut) and cut.min() < whole[best]:
            return self.window - 1 - int(np.argmin(cut[::-1]))
        return best

    def place(self, piece: tuple, size: int, level: int | None = None) -> list | None:
        """Places a piece, by the rule if no level is given; returns the window if that has filled it."""
        level = self.choose(size) if level is None else level
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.held -= 1
        window.append(piece)
        if level + size == self.window:
            return window
        self.open[level + size].append(window)
        self.count[level + size] += 1
        self.held += 1
        return None

    def place_rest(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> list | None:
        """Places the rest of a document within the number of open windows; returns a window that this has filled."""
        size = len(ids)
        few = not self.held or self.held < min(self.most, LEAST_OPEN + self.tokens // OPEN_EACH)
        self.tokens += size
        level = self.choose(size) if few else self.choose_open(size)
        room = self.window - level
        if size <= room:
            return self.place((doc, start, total, ids), size, level)
        full = self.place((doc, start, total, ids[:room]), room, level)
        self.place((doc, start + room, total, ids[room:]), size - room, 0)
        return full

    def fullest(self, most: int) -> list[tuple]:
        """Takes out the pieces of the `most` fullest windows."""
        out = []
        for level in range(self.window - 1, 0, -1):
            while self.open[level] and most:
                out += self.open[level].pop()
                self.count[level] -= 1
                self.held -= 1
                most -= 1
        return out

    def end(self) -> Iterator[tuple[list, list]]:
        """Full windows, then a last one, as pieces that stay and pieces that were moved there."""
        left = [self.fullest(1) for _ in range(self.held)]
        sizes = [sum(len(p[3]) for p in w) for w in left]
        lo, hi, moved = 0, len(left) - 1, []
        while lo < hi:
            doc, start, total, ids = left[hi].pop()
            part = min(len(ids), self.window - sizes[lo])
            moved.append((doc, start + len(ids) - part, total, ids[len(ids) - part :]))
            if part < len(ids):
                left[hi].append((doc, start, total, ids[: len(ids) - part]))
            sizes[lo] += part
            sizes[hi] -= part
            if sizes[lo] == self.window:
                yield left[lo], moved
                lo, moved = lo + 1, []
            if not sizes[hi]:
                hi -= 1
        if lo == hi:
            yield left[lo], moved


def _cut(pieces: list[tuple], lengths: list[int]) -> Iterator[list[tuple]]:
    """The pieces, cut after each of these lengths."""
    for length in lengths:
        held, size = [], 0
        while size < length:
            doc, start, total, ids, stayed = pieces.pop(0)
            part = ids[: length - size]
            held.append((doc, start, total, part, stayed))
            size += len(part)
            if len(part) < len(ids):
                pieces.insert(0, (doc, start + len(part), total, ids[len(part) :], stayed))
        yield held


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k", most_open: int = MOST_OPEN) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * TASK_STRIDE
        levels, rows, serial = Levels(window, most_open), [], 0

        def close(pieces: list[tuple]) -> None:
            nonlocal serial
            at = 0
            for doc, start, total, ids, stayed in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + serial, at, stayed))
                at += len(ids)
            serial += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.bool_())], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(_tokens.encode(text.as_py() or "", vocabulary), np.uint32(END_ID)).astype("<u4")
                total, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    close([(doc, start, total, ids[start : start + window], True)])
                if whole < total and (full := levels.place_rest(doc, whole, total, ids[whole:].copy())):
                    close([(*p, True) for p in full])
                if len(rows) >= OUT_ROWS:
                    yield out()
        for stay, moved in levels.end():
            pieces = [*((*p, True) for p in stay), *((*p, False) for p in moved)]
            size = sum(len(p[3]) for p in pieces)
            # A full window stays one, the last is cut into powers of two.
            for held in _cut(pieces, [window] if size == window else [1 << k for k in range(window.bit_length() - 1, -1, -1) if size >> k & 1]):
                close(held)
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
