"""Packing of documents into training sequences: bounded-space online best fit.

Within a partition documents come one by one. A document's ids (an end id last) give full sequences while they can;
the rest goes to the open window with the least room that still holds it. At most ``OPEN`` windows are open. When none
fits and no window may be opened, the fullest one is emitted: as it is if its room is small, else topped up with the
head of the piece, whose tail goes on. What is open at the end of a partition is a leftover: leftovers of ``GROUP``
neighbouring partitions are merged end to end, cut where a sequence is full.

A sequence shorter than ``LENGTH`` is padded to it, unless its own length is a power of two.

Leftovers are a fixed number of windows for each partition, whatever its size; a group's are a few MB. The sequences
are written to the shared folder, one row each with its padded ids, so nothing is tokenized twice and a retried task
gives the same rows. Where every document's ids lie is derived by reading that table.

Defined results: null texts are empty and give the end id alone; repeated rows are packed as documents of their own;
a document of any length is cut into pieces; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokenize import encoder, tokenizer_path
from .workers import prepare

LENGTH, OPEN, GROUP, SMALL_ROOM = 1024, 32, 16, 16
COLUMNS = ("sequence_id", "n_ids", "ids", "doc_ids", "starts", "lengths", "totals", "offsets")
SCHEMA = "sequence_id long, n_ids long, ids binary, doc_ids array<long>, starts array<long>, lengths array<long>, totals array<long>, offsets array<long>, closed boolean, part int"


def padded_length(n: int, length: int = LENGTH) -> int:
    """What a sequence of ``n`` ids is stored as."""
    return n if n & (n - 1) == 0 else length


def _sequence(seq: int, pieces: list[tuple], pad: bytes | None, length: int) -> tuple:
    """A row of ``pieces`` (doc_id, start, ids, total) laid end to end; not padded without ``pad``."""
    doc_ids, starts, ids, totals = map(list, zip(*pieces, strict=True))
    lengths = [len(x) // 4 for x in ids]
    n = sum(lengths)
    offsets = [0, *np.cumsum(lengths).tolist()][:-1]
    padding = b"" if pad is None else pad * (padded_length(n, length) - n)
    return seq, n, b"".join(ids) + padding, doc_ids, starts, lengths, totals, offsets


class OpenWindows:
    """The open windows of one partition; ``rows`` are emitted sequences."""

    def __init__(self, first_id: int, length: int, most: int, pad: bytes) -> None:
        self.next_id, self.length, self.most, self.pad = first_id, length, most, pad
        self.rooms: list[tuple[int, int]] = []  # sorted (room, sequence_id)
        self.pieces: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.next_id += 1
        self.pieces[self.next_id - 1] = []
        return self.next_id - 1

    def _emit(self, seq: int, closed: bool = True) -> None:
        self.rows.append((*_sequence(seq, self.pieces.pop(seq), self.pad if closed else None, self.length), closed))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.length:
            seq = self._new()
            self.pieces[seq].append((doc_id, at, ids[4 * at : 4 * (at + self.length)], total))
            self._emit(seq)
            at += self.length
        while at < total:
            need = total - at
            best = bisect_left(self.rooms, (need, -1))
            if best == len(self.rooms):
                if len(self.rooms) < self.most:
                    best_room, seq = self.length, self._new()
                else:
                    best_room, seq = self.rooms.pop(0)
                    if best_room <= SMALL_ROOM:
                        self._emit(seq)
                        continue
            else:
                best_room, seq = self.rooms.pop(best)
            put = min(need, best_room)
            self.pieces[seq].append((doc_id, at, ids[4 * at : 4 * (at + put)], total))
            at += put
            if put == best_room:
                self._emit(seq)
            else:
                insort(self.rooms, (best_room - put, seq))

    def leave(self) -> None:
        for _, seq in self.rooms:
            self._emit(seq, closed=False)
        self.rooms = []

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _frame(rows: list[tuple], part: int) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[*COLUMNS, "closed"])
    frame["part"] = part
    return frame


def first_pass(docs: DataFrame, path: str, end_id: int, pad_id: int, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """Emitted sequences (closed) with their padded ids, and leftovers with theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        windows = OpenWindows(part << 32, length, most, np.array([pad_id], dtype="<u4").tobytes())
        for batch in batches:
            known = [None if x is pd.NA else x for x in batch["doc_id"].astype("Int64").tolist()]
            for doc_id, ids in zip(known, enc.encode(batch["text"].tolist()), strict=True):
                windows.add(doc_id, ids + end)
            if rows := windows.take():
                yield _frame(rows, part)
        windows.leave()
        if rows := windows.take():
            yield _frame(rows, part)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCHEMA)


def merge_leftovers(left: DataFrame, pad_id: int, length: int = LENGTH) -> DataFrame:
    """Leftover windows laid end to end within groups of partitions and cut at full sequences."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sequence_id", kind="stable")
        pad = np.array([pad_id], dtype="<u4").tobytes()
        seq, at, rows, now = (1 << 30 | int(key[0])) << 32, 0, [], []
        for ids, *each in zip(*(group[c] for c in ("ids", "doc_ids", "starts", "lengths", "totals", "offsets")), strict=True):
            for doc_id, start, n, total, offset in zip(*each, strict=True):
                doc_id, done = None if doc_id is None or doc_id != doc_id else int(doc_id), 0
                while done < n:
                    put = min(int(n) - done, length - at)
                    now.append((doc_id, int(start) + done, ids[4 * (offset + done) : 4 * (offset + done + put)], int(total)))
                    done, at = done + put, at + put
                    if at == length:
                        rows.append((*_sequence(seq, now, pad, length), True))
                        seq, at, now = seq + 1, 0, []
        if now:
            rows.append((*_sequence(seq, now, pad, length), True))
        return _frame(rows, key[0])

    grouped = left.withColumn("grp", F.floor(F.col("part") / GROUP).cast("int")).groupBy("grp")
    return grouped.applyInPandas(merge, SCHEMA)


def sequences(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, pad_id: int | None = None) -> DataFrame:
    """sequence_id, n_ids, ids (padded, little-endian unsigned 32-bit), and by turns the documents' pieces in it.

    ``n_ids`` are a sequence's own, the rest is ``pad_id`` (the end id unless given). Pieces: doc_ids, starts (in the
    document), lengths, totals (ids of the whole document) and offsets (in the sequence).
    """
    pad_id = end_id if pad_id is None else pad_id
    first = scratch.materialize(first_pass(docs, path, end_id, pad_id, length), "sequences")
    merged = scratch.materialize(merge_leftovers(first.where(~F.col("closed")), pad_id, length), "merged-sequences")
    return first.where("closed").unionByName(merged).select(*COLUMNS)


def pack(docs: DataFrame, path: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: where every id of every document lies."""
    each = sequences(docs, path, end_id, length).withColumn("p", F.explode(F.arrays_zip("doc_ids", "starts", "lengths", "totals", "offsets")))
    told = F.expr("crc32(substring(ids, cast(4 * p.offsets + 1 as int), cast(4 * p.lengths as int)))").alias("ids_crc32")
    return each.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), told, F.col("p.totals").alias("doc_tokens"), "sequence_id", F.col("p.offsets").alias("offset"))


def report(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    return pack(docs, tokenizer_path(tokenizer), end_id)
