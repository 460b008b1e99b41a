"""Substring dedup: repeated word windows found by FM-indexes over content-defined shards.

Indexing every document against every shard would cost the square of the corpus. So text is dealt to shards by its own
content: each window of ``WINDOW`` words has a minimizer, its eight-word run with the least hash, and neighbouring
windows with one minimizer form a stretch of at most 28 windows. Equal windows have equal minimizers, so they meet in
one shard and every other shard can be left alone.

1. Each document gives its stretches: start, number of windows, hashes of the minimizer and of the whole stretch.
2. Minimizers that occur once can't repeat and go. Of the others, equal stretches are one row with a weight; one
   document is named for each to supply the words.
3. Those words go to shards by minimizer. A minimizer that occurs more than ``CROWD`` times is dealt window by window,
   by the hash of the window's words, and equal windows are one row with the sum of their weights. So a passage of the
   whole corpus spreads over all shards, and each of its windows is indexed once, whatever stands around it.
4. From each shard's stretches a weighted FM-index is built and stored, compressed, in the shared folder.
5. The documents' stretches are streamed through their shard's stored index: backward search over the wavelet matrix
   gives matching statistics, and intervals of ``WINDOW`` words or more whose weight is at least two are reported as a
   mask of window starts.
6. Masks return to all occurrences and are gathered by document; words under a reported window go.

Windows are judged on the input alone. Words are compared by 64-bit hashes, position by position over 35 words.

Defined results: null texts have no words; texts of fewer words than a window keep them all; repeated rows repeat each
other; a document may repeat itself; very long texts are handled in stretches; an empty table gives an empty result;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fmindex, scratch
from .workers import prepare

WINDOW, RUN = 35, 8
CROWD, SHARD_WORDS = 5_000, 400_000
#: Stretches that are broadcast, of some 60 bytes each, in at most so many documents' rows.
BROADCAST_STRETCHES = 1_500_000
#: Frequent keys that are broadcast, 16 bytes each.
BROADCAST_KEYS = 500_000
_B = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Spans:
    """Hashes of any span of a word sequence, from running sums of words times powers of an odd base."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.full(n + 1, _B, dtype=np.uint64)
        inverse = np.full(n + 1, pow(_B, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(words + np.uint64(1)) * np.multiply.accumulate(power)[:n], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def stretches(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: begin (in ``words``), number of windows, minimizer hash and stretch hash."""
    n = len(words)
    if n < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    spans = Spans(words)
    at = np.arange(n - run + 1)
    hashes = spans(at, at + run)
    least, size, width = at, 1, window - run + 1
    while 2 * size <= width:
        a, b = least[:-size], least[size:]
        least = np.where(hashes[a] <= hashes[b], a, b)
        size *= 2
    if width > size:
        a, b = least[: len(least) - (width - size)], least[width - size :]
        least = np.where(hashes[a] <= hashes[b], a, b)
    ends = np.repeat(np.cumsum(counts), counts)[: len(least)]
    valid = np.arange(len(least)) + window <= ends
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new)
    upto = np.cumsum(valid)
    last = np.append(begin[1:], len(valid)) - 1
    n_windows = upto[last] - upto[begin] + 1 if len(begin) else begin
    return begin, n_windows, hashes[least[begin]], spans(begin, begin + n_windows + window - 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h and n tell a row's text: its id, a 64-bit hash and the number of bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), text.alias("text"))


def find_stretches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [words_of(t) for t in batch["text"]]
            counts = np.array([len(w) for w in each], dtype=np.int64)
            begin, n_windows, minimizer, whole = stretches(word_hashes([w for ws in each for w in ws]), counts)
            ends = np.cumsum(counts)
            row = np.searchsorted(ends, begin, side="right")
            own = batch[["id", "h", "n"]].iloc[row].reset_index(drop=True)
            yield own.assign(start=begin - (ends - counts)[row], windows=n_windows, minimizer=_signed(minimizer), whole=_signed(whole))

    return _keyed(docs).mapInPandas(run, "id string, h long, n int, start int, windows int, minimizer long, whole long")


def _bounded(by_doc: DataFrame) -> DataFrame:
    """To be broadcast while all its stretches together are within the bound; joined by shuffle beyond."""
    total = by_doc.agg(F.sum(F.size("wanted"))).first()[0] or 0
    return F.broadcast(by_doc) if total <= BROADCAST_STRETCHES else by_doc


def _spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once; rows with the hottest keys stay where they are.

    ``hot``: keys and their number of rows n, more than ``CROWD``, so there are fewer of them by that factor. Of more
    than ``BROADCAST_KEYS`` the hottest are taken, by a bound ten times as high or more; the others are shuffled.
    """
    bound = CROWD
    while hot.where(F.col("n") > bound).limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        bound *= 10
    hot = hot.where(F.col("n") > bound).select(*keys)
    there = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    others = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return rows.join(there, keys).select(others.columns).unionByName(others)


def _contents(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The words of each named stretch: minimizer, whole, weight, offset (of the first window), crowded, words, window hash.

    Repeated rows of a named document give its stretches more than once; their weights are two or more already.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                words = word_hashes(words_of(text))
                spans = Spans(words)
                for s in wanted:
                    at, n = s["start"], s["windows"]
                    if s["crowded"]:
                        place = np.arange(at, at + n)
                        hashes = _signed(spans(place, place + WINDOW)).tolist()
                        rows += [(s["minimizer"], s["whole"], s["weight"], o, words[at + o : at + o + WINDOW].tobytes(), hashes[o], True) for o in range(n)]
                    else:
                        rows.append((s["minimizer"], s["whole"], s["weight"], 0, words[at : at + n + WINDOW - 1].tobytes(), s["minimizer"], False))
            yield pd.DataFrame(rows, columns=["minimizer", "whole", "weight", "offset", "words", "dealt_by", "crowded"])

    by_doc = named.groupBy("id", "h", "n").agg(F.collect_list(F.struct("start", "windows", "minimizer", "whole", "weight", "crowded")).alias("wanted"))
    by_doc = scratch.materialize(by_doc, "named")
    found = _keyed(docs).join(_bounded(by_doc), ["id", "h", "n"]).select("text", "wanted")
    words = scratch.materialize(found.mapInPandas(run, "minimizer long, whole long, weight long, offset int, words binary, dealt_by long, crowded boolean"), "stretch-words")
    scratch.drop(by_doc)
    return words


def _indexed(contents: DataFrame) -> DataFrame:
    """What is indexed: stretches as they are, and each distinct window of crowded ones once, told by two hashes."""
    names = ["minimizer", "whole", "weight", "words", "dealt_by", "crowded"]
    alike = contents.where("crowded").groupBy(F.col("dealt_by").alias("minimizer"), F.xxhash64("words").alias("whole"))
    windows = alike.agg(F.sum("weight").alias("weight"), F.min("words").alias("words")).withColumns({"dealt_by": F.col("minimizer"), "crowded": F.lit(True)})
    return contents.where("not crowded").select(*names).unionByName(windows.select(*names))


def _once(group: pd.DataFrame) -> pd.DataFrame:
    """Repeated rows of the document that supplies a stretch give it more than once."""
    return group.drop_duplicates(["minimizer", "whole", "crowded"])


def _words(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of stretches end to end, and how many each has."""
    return np.frombuffer(b"".join(group["words"]), dtype=np.uint64), np.array([len(w) // 8 for w in group["words"]], dtype=np.int64)


def _build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = _once(group)
    index = fmindex.FMIndex.built(*_words(group), group["weight"].to_numpy(dtype=np.int64))
    return pd.DataFrame({"shard": [key[0]], "image": [index.image()]})


def _search(group: pd.DataFrame, images: pd.DataFrame) -> pd.DataFrame:
    names = ["minimizer", "whole", "mask", "crowded"]
    if not len(group):
        return pd.DataFrame(columns=names)
    group = _once(group)
    words, lengths = _words(group)
    masks = fmindex.repeated_windows(fmindex.FMIndex.read(images["image"].iloc[0]), words, lengths, WINDOW)
    return group.assign(mask=_signed(masks)).loc[masks != 0, names]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, h, n, marks: array of struct(start, mask), for documents with a repeated window."""
    prepare(docs.sparkSession)
    light = scratch.materialize(find_stretches(docs), "stretches")
    shared = light.groupBy("minimizer").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = scratch.materialize(shared, "shared-minimizers")
    met = _spread_join(light, shared, ["minimizer"], shared.where(F.col("times") > CROWD).withColumnRenamed("times", "n"))
    live = scratch.materialize(met.withColumn("crowded", F.col("times") > CROWD).drop("times"), "shared-stretches")
    scratch.drop(light)
    scratch.drop(shared)
    supplier = F.min(F.struct("id", "h", "n", "start", "windows")).alias("s")
    many = scratch.materialize(live.groupBy("minimizer", "whole").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "frequent-stretches")
    named = live.groupBy("minimizer", "whole", "crowded").agg(F.count(F.lit(1)).alias("weight"), supplier).select("minimizer", "whole", "crowded", "weight", "s.*")
    contents = _contents(docs, named)
    indexed = _indexed(contents)
    total = contents.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    dealt = indexed.withColumn("shard", F.pmod(F.xxhash64("dealt_by"), F.lit(shards)).cast("int"))
    indexes = scratch.materialize(dealt.groupBy("shard").applyInPandas(_build, "shard int, image binary"), "fm-indexes")
    streamed = dealt.groupBy("shard").cogroup(indexes.groupBy("shard"))
    masks = scratch.materialize(streamed.applyInPandas(_search, "minimizer long, whole long, mask long, crowded boolean"), "masks")
    scratch.drop(indexes)
    windows = masks.where("crowded").select(F.col("minimizer").alias("dealt_by"), F.col("whole").alias("same"))
    crowd = contents.where("crowded").select("minimizer", "whole", "offset", "dealt_by", F.xxhash64("words").alias("same"))
    again = crowd.join(windows, ["dealt_by", "same"]).select("minimizer", "whole", F.expr("shiftleft(1L, offset)").alias("mask"))
    masks = masks.where("not crowded").select("minimizer", "whole", "mask").unionByName(again)
    answers = scratch.materialize(masks.groupBy("minimizer", "whole").agg(F.bit_or("mask").alias("mask")), "repeated-windows")
    return _spread_join(live, answers, ["minimizer", "whole"], many).groupBy("id", "h", "n").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: kept words joined by one space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, marks in zip(batch["text"], batch["marks"], strict=True):
                words = words_of(text)
                n = len(words)
                if marks is not None:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for m in marks:
                        mask, start = m["mask"] & (1 << 64) - 1, m["start"]
                        while mask:
                            o = (mask & -mask).bit_length() - 1
                            edge[start + o] += 1
                            edge[start + o + WINDOW] -= 1
                            mask &= mask - 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                rows.append((n, n - len(words), b" ".join(words).decode("utf-8")))
            told = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])
            yield pd.concat([batch[["doc_id"]].astype("Int64").reset_index(drop=True), told], axis=1)

    marks = repeated_spans(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"), text.alias("text"))
    joined = rows.join(marks, ["id", "h", "n"], "left").select("doc_id", "text", "marks")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
