"""Token-ID files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

A file image is one self-contained byte string:

    magic "TGHF", format 1, five unsigned 64-bit integers: documents, tokens, block length, bits, start (ids of all
    documents before the file's first), then four length-prefixed sections: code lengths by id (deflated bytes), document
    ids and token counts (deflated 64-bit integers), checkpoints (the bit at which each block begins), code bits.

Code lengths come from counts over all documents by package-merge, at most ``MAX_BITS``; codes are canonical, so the
lengths are all that a reader needs. A block of ``BLOCK`` ids decodes alone from its checkpoint; the reader steps all
blocks of a file together, one table look-up an id.

Files hold documents in ascending doc_id order (nulls first, then by text hash), and so do files among themselves.
They are rows of a Parquet table in the shared folder, a container that every store of Spark's can hold; ``image`` is
the file, and its bytes stand alone.

Defined results: null texts are empty and have the end id alone; repeated rows are documents of their own; a long
document is never divided between files, its file is as long as needed; an empty table has no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokenize import encoder, tokenizer_path
from .workers import prepare

MAX_BITS, BLOCK, CHUNK_TOKENS = 18, 512, 1 << 19
_HEAD = struct.Struct("<4sI5Q")


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << most:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    items, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(most - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([leaves, packages])
        at = np.argsort(joined, kind="stable")
        items = joined[at]
        is_leaf.append(at < n)
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for flags in reversed(is_leaf):
        n_leaves = int(flags[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids in code order (by length, then id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    most = int(size.max()) if len(size) else 0
    first = np.concatenate(([0], np.cumsum(1 << (most - size)[:-1]))) if len(size) else size
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = (first >> (most - size)).astype(np.uint64)
    return codes, order


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray, int]:
    """Code bits (most significant first), the checkpoints, the number of bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 64 + 2, dtype=np.uint64)
    if bits:
        code, word, room = codes[ids], starts >> 6, 64 - (starts & 63)
        over = np.maximum(size - room, 0)
        high = (code >> over.astype(np.uint64)) << np.maximum(room - size, 0).astype(np.uint64)
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[heads]] = np.bitwise_or.reduceat(high, heads)
        spill = np.flatnonzero(over)
        words[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return words.astype(">u8").tobytes(), starts[::block].astype("<u8"), bits


def unpack_bits(raw: bytes, checkpoints: np.ndarray, n: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids, all blocks decoded in step from a table of all ``most``-bit prefixes."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    _, order = canonical(lengths)
    size = lengths[order].astype(np.int64)
    most = int(size.max())
    width = 1 << (most - size)
    symbol = np.repeat(order.astype(np.uint32), width)
    step = np.repeat(size, width).astype(np.uint64)
    if len(symbol) < 1 << most:  # a lone symbol
        symbol, step = np.resize(symbol, 1 << most), np.resize(step, 1 << most)
    words = np.frombuffer(raw, dtype=">u8").astype(np.uint64)
    at = checkpoints.astype(np.uint64).copy()
    out = np.empty((block, len(at)), dtype=np.uint32)
    last, down = np.uint64(len(words) - 2), np.uint64(64 - most)
    one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
    for k in range(min(block, n)):
        word, off = np.minimum(at >> six, last), at & low
        ahead = (words[word] << off) | ((words[word + one] >> one) >> (low - off))
        index = ahead >> down
        out[k] = symbol[index]
        at += step[index]
    return out.T.reshape(-1)[:n] if n > block else out[:n].T.reshape(-1)[:n]


def _section(raw: bytes) -> bytes:
    return struct.pack("<Q", len(raw)) + raw


def image(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, start: int, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits, checkpoints, n_bits = pack_bits(ids, codes, lengths)
    table = np.concatenate([doc_ids.astype("<i8"), counts.astype("<i8")])
    sections = zlib.compress(lengths.tobytes(), 6), zlib.compress(table.tobytes(), 1), checkpoints.tobytes(), bits
    return _HEAD.pack(b"TGHF", 1, len(doc_ids), len(ids), BLOCK, n_bits, start) + b"".join(map(_section, sections))


def read_image(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """ids, doc_ids, token counts, start."""
    magic, version, n_docs, n_tokens, block, _, start = _HEAD.unpack_from(raw)
    if magic != b"TGHF" or version != 1:
        raise ValueError("not a token-id file")
    sections, at = [], _HEAD.size
    for _ in range(4):
        (size,) = struct.unpack_from("<Q", raw, at)
        sections.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    lengths = np.frombuffer(zlib.decompress(sections[0]), dtype=np.uint8)
    table = np.frombuffer(zlib.decompress(sections[1]), dtype="<i8")
    ids = unpack_bits(sections[3], np.frombuffer(sections[2], dtype="<u8"), n_tokens, lengths, block)
    return ids, table[:n_docs], table[n_docs:], start


#: Stands for a null doc_id in a file's table.
NO_ID = -(1 << 63)


def token_chunks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Sorted documents as chunks of ids: part, before (tokens of the part before the chunk), doc_ids, counts, ids.

    After its chunks a part has one row with ``total`` alone: its counts by id, 64-bit integers, deflated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        kind = np.dtype("<u2") if max(enc.vocabulary, end_id) < 1 << 16 else np.dtype("<u4")
        end, before = np.array([end_id], dtype="<u4").tobytes(), 0
        held = 0
        doc_ids: list[int] = []
        counts: list[int] = []
        raw: list[bytes] = []

        total = np.zeros(max(enc.vocabulary, end_id + 1), dtype="<i8")

        def chunk() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(raw), dtype="<u4").astype(kind)
            np.add(total, np.bincount(ids, minlength=len(total)), out=total)
            return pd.DataFrame({"part": [part], "before": [before], "n": [len(ids)], "width": [kind.itemsize], "doc_ids": [doc_ids], "counts": [counts], "ids": [ids.tobytes()], "total": [None]})

        for batch in batches:
            known = batch["doc_id"].astype("Int64").fillna(NO_ID).tolist()
            for doc_id, ids in zip(known, enc.encode(batch["text"].tolist()), strict=True):
                doc_ids.append(doc_id)
                counts.append(len(ids) // 4 + 1)
                raw.append(ids + end)
                held += counts[-1]
                if held >= CHUNK_TOKENS:
                    yield chunk()
                    before, held, doc_ids, counts, raw = before + held, 0, [], [], []
        if raw:
            yield chunk()
        if total.any():
            yield pd.DataFrame({"part": [part], "before": [0], "n": [0], "width": [kind.itemsize], "doc_ids": [None], "counts": [None], "ids": [None], "total": [zlib.compress(total.tobytes(), 1)]})

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    return ordered.mapInPandas(run, "part int, before long, n long, width int, doc_ids array<long>, counts array<long>, ids binary, total binary")


def write_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the documents' ids and give the table of files: start, image."""
    spark = docs.sparkSession
    out = scratch.new_path(spark, "chunks")
    token_chunks(docs, path, end_id).write.option("compression", "zstd").parquet(out)
    chunks = spark.read.parquet(out)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for told in batch["total"]:
                found = np.frombuffer(zlib.decompress(told), dtype="<i8")
                total = found + (total if len(total) else 0)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    # As many rows as the vocabulary has ids, and as the sorted documents have partitions: bounded whatever the input.
    by_id = chunks.where("total is not null").select("total").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_part = chunks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()
    counts = np.zeros(int(by_id["id"].max()) + 1 if len(by_id) else 1, dtype=np.int64)
    counts[by_id["id"].to_numpy(dtype=np.int64)] = by_id["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(counts)
    base = dict(zip(by_part["part"].tolist(), (by_part["n"].cumsum() - by_part["n"]).tolist(), strict=True))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, _ = canonical(lengths)
        for batch in batches:
            for part, before, width, doc_ids, n, ids in zip(batch["part"], batch["before"], batch["width"], batch["doc_ids"], batch["counts"], batch["ids"], strict=True):
                start = base[part] + before
                yield pd.DataFrame({"start": [start], "image": [image(np.frombuffer(ids, dtype=f"<u{width}"), np.asarray(doc_ids), np.asarray(n), start, lengths, codes)]})

    prepare(spark, 8)
    return scratch.materialize(chunks.where("ids is not null").select("part", "before", "width", "doc_ids", "counts", "ids").mapInPandas(encode, "start long, image binary"), "idfiles")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), one row for each document of the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["image"]:
                ids, doc_ids, counts, start = read_image(raw)
                ends = np.cumsum(counts)
                begins = ends - counts
                data = ids.astype("<u4").tobytes()
                known = pd.array(doc_ids, dtype="Int64")
                known[doc_ids == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": known, "start": start + begins, "ids": [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]})

    prepare(files.sparkSession, 8)
    return files.select("image").mapInPandas(run, "doc_id long, start long, ids binary")


def report(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    rows = read_files(write_files(docs, tokenizer_path(tokenizer), end_id))
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
