"""Language-model scoring: a causal self-attention model over subword ids, with corpus-wide word counts.

Documents whose crc32(doc_id as text) mod 10 is not 0 are learned from; all are scored.

1. Documents are packed into chunks of some MB of text, one row each: the chunk's distinct words (64-bit hashes and
   subword ids) and every document as numbers of words. Texts are read and tokenized once.
2. Word counts come from all learning documents: each chunk gives its distinct words with counts, a window over each
   hash adds them up, and each chunk gets back the counts of its own words that differ from what it counted itself.
   Nothing of the vocabulary's size is broadcast.
3. The model's symbols are the commonest subword ids of all learning documents, ``SYMBOLS`` at most, with an escape for
   other ids that begin a word and one for those that don't; an escaped id has its share of the escape's count.
4. All learning documents train the attention model, each once. Each task that reads chunks is a trainer, so there are
   as many as the input asks for. A trainer runs Adam from common weights through windows in random order, and the
   weights are averaged in a tree: first after one document in ``ROUND`` of every chunk, then, from that average, after
   the others.
5. A chunk is scored in overlapping context windows, each token once, by batched masked attention. The model's
   probability of a token mixes that of its spelling, by attention, with the token's share of the learning tokens,
   which has a weight of ``WORD_SHARE``.

The model's size is fixed: 16 dimensions, one head, 16 to 31 tokens of context, 1024 symbols. Words are told by 64-bit
hashes. Defined results: null texts are empty and have the end alone; null doc_ids count as the empty text, so they are
held out; repeated rows are scored, and learned from, each for itself; very long texts are scored whole; without
learning documents all counts are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import attention as A
from . import scratch
from .tokenize import tokenizer_path
from .workers import prepare

CHUNK_BYTES, SYMBOLS, WORD_SHARE = 8 << 20, 1024, 0.25
#: The first round of training takes one in so many documents, the second the others; and Adam's rates in the rounds.
ROUND, RATES = 4, (0.05, 0.025)
#: Blocks of a step, fewer where a chunk has less than ``LEAST_STEPS`` such.
STEP_BLOCKS, LEAST_STEPS = 512, 64
#: In the place of a word's number: no word, the end of a document.
END = -1


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Chunk:
    n_words: np.ndarray  # by document
    word: np.ndarray  # numbers of the documents' words, end to end
    hashes: np.ndarray  # by distinct word
    sizes: np.ndarray
    ids: np.ndarray  # subword ids of the distinct words, end to end

    def pack(self) -> bytes:
        import zstandard

        parts = [x.astype(t).tobytes() for x, t in zip((self.n_words, self.word, self.hashes, self.sizes, self.ids), ("<i4", "<i4", "<i8", "<i4", "<u4"), strict=True)]
        head = np.array([len(x) for x in parts], dtype="<i8").tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @staticmethod
    def unpack(raw: bytes) -> Chunk:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw)
        sizes = np.frombuffer(raw, "<i8", 5)
        at = 40 + np.cumsum(sizes) - sizes
        part = lambda k, t, n: np.frombuffer(raw, t, int(sizes[k]) // n, int(at[k]))
        return Chunk(part(0, "<i4", 4), part(1, "<i4", 4), part(2, "<i8", 8), part(3, "<i4", 4), part(4, "<u4", 4))

    def learned(self, held: np.ndarray) -> np.ndarray:
        """How often learning documents have each distinct word."""
        return np.bincount(self.word[np.repeat(held == 0, self.n_words)], minlength=len(self.hashes))


class Speller:
    """Words as subword ids of a file of byte-level ranks, each word as it stands after a space."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.begins[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def spell(self, words: list[bytes], at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids end to end."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k in range(0, len(words), at_once):
            some = words[k : k + at_once]
            got = np.array(self.encode((b" " + b" ".join(some)).decode("utf-8", "replace")), dtype=np.uint32)
            begin = np.flatnonzero(self.begins[got])
            if len(begin) == len(some) and begin[0] == 0:
                sizes.append(np.diff(np.append(begin, len(got))))
                ids.append(got)
            else:  # white space beyond ASCII joins words: one by one
                each = [np.array(self.encode(" " + w.decode("utf-8", "replace")), dtype=np.uint32) for w in some]
                sizes.append(np.array([len(e) for e in each]))
                ids += each
        return np.concatenate(sizes), np.concatenate(ids)


_spellers: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    if path not in _spellers:
        _spellers[path] = Speller(path)
    return _spellers[path]


class Packer:
    """Documents on their way into a chunk."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.held: list[int] = []
        self.word: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, held: int, text: bytes) -> None:
        words = words_of(text)
        self.word.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(text)

    def chunk(self) -> Chunk:
        from xxhash import xxh3_64_intdigest

        distinct = list(self.numbers)
        sizes, ids = speller(self.path).spell(distinct)
        hashes = np.fromiter(map(xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct)).view(np.int64)
        word = np.concatenate(self.word) if self.word else np.zeros(0, np.int32)
        return Chunk(np.array([len(w) for w in self.word]), word, hashes, sizes, ids)


def chunks(docs: DataFrame, path: str) -> DataFrame:
    """chunk, doc_ids, held (1 for held out), packed: documents in the order in which a task reads them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, packer = TaskContext.get().partitionId(), 0, Packer(path)

        def done() -> pd.DataFrame:
            return pd.DataFrame({"chunk": [part << 32 | n], "doc_ids": [packer.ids], "held": [packer.held], "packed": [packer.chunk().pack()]})

        for batch in batches:
            known = [None if x is pd.NA else x for x in batch["doc_id"].astype("Int64").tolist()]
            for doc_id, held, text in zip(known, batch["held"].tolist(), batch["text"].tolist(), strict=True):
                packer.add(doc_id, held, text)
                if packer.size >= CHUNK_BYTES:
                    yield done()
                    n, packer = n + 1, Packer(path)
        if packer.ids:
            yield done()

    prepare(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    held = (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0).cast("int")
    rows = docs.select(doc_id.alias("doc_id"), held.alias("held"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return scratch.materialize(rows.mapInPandas(run, "chunk long, doc_ids array<long>, held array<int>, packed binary"), "lm-chunks")


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, Chunk]]:
    for batch in batches:
        for chunk, held, packed in zip(batch["chunk"], batch["held"], batch["packed"], strict=True):
            yield chunk, np.asarray(held), Chunk.unpack(packed)


def word_counts(packed: DataFrame) -> DataFrame:
    """chunk, words (number and count by turns, where the count isn't the chunk's own), distinct, tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, held, c in _each(batches):
            word, n = np.append(np.arange(len(c.hashes)), END), np.append(c.learned(held), np.sum(held == 0))
            # The end is told from a word by its number, and is in every chunk.
            yield pd.DataFrame({"chunk": chunk, "word": word.astype(np.int32), "end": word == END, "hash": np.append(c.hashes, END), "n": n})

    counted = packed.select("chunk", "held", "packed").mapInPandas(run, "chunk long, word int, end boolean, hash long, n long")
    same = Window.partitionBy("hash", "end")
    summed = counted.withColumns({"c": F.sum("n").over(same), "first": F.min("chunk").over(same) == F.col("chunk")})
    told = F.flatten(F.collect_list(F.when((F.col("c") != F.col("n")) | F.col("end"), F.array(F.col("word").cast("long"), "c"))))
    answer = summed.groupBy("chunk").agg(told.alias("words"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("distinct"), F.sum("n").alias("tokens"))
    return scratch.materialize(answer, "lm-counts")


def subword_counts(packed: DataFrame, n_ids: int) -> np.ndarray:
    """How often each subword id occurs in all learning documents: a row for each id, a task gives each at most once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(n_ids, dtype=np.int64)
        for _, held, c in _each(batches):
            n += np.bincount(c.ids, weights=np.repeat(c.learned(held), c.sizes), minlength=n_ids).astype(np.int64)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"id": at, "n": n[at]})

    rows = packed.select("chunk", "held", "packed").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n_ids, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


class Symbols:
    """Subword ids as symbols: those that begin a word, their escape and the end, then the others and their escape."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray) -> None:
        order = np.lexsort((np.arange(len(counts)), -counts))[: SYMBOLS - 3]
        top = order[counts[order] > 0]
        heads, tails = top[begins[top]], top[~begins[top]]
        other = len(heads), len(heads) + 2 + len(tails)
        self.end, self.n_first, self.n_later = len(heads) + 1, len(heads) + 2, len(tails) + 1
        self.of = np.where(begins, *other).astype(np.int32)
        self.of[heads], self.of[tails] = np.arange(len(heads)), self.n_first + np.arange(len(tails))
        self.counts = np.bincount(self.of, weights=counts, minlength=self.n_first + self.n_later)
        #: Natural log of an id's share of its symbol: 0 but for escaped ids.
        self.log_share = np.zeros(len(counts))
        for s in other:
            own = np.flatnonzero(self.of == s)
            self.log_share[own] = np.log((counts[own] + 0.5) / (counts[own] + 0.5).sum())

    def tokens(self, c: Chunk, of: np.ndarray) -> A.Tokens:
        """The documents of a chunk for which ``of`` is true."""
        word, n = c.word[np.repeat(of, c.n_words)], c.n_words[of].astype(np.int64)
        symbol, begin, sizes = self.of[c.ids], (np.cumsum(c.sizes) - c.sizes).astype(np.int32), c.sizes
        is_word = np.ones(len(word) + len(n), dtype=bool)
        is_word[np.cumsum(n + 1) - 1] = False
        each = np.zeros(len(is_word) + 1, dtype=np.int32)
        each[1:][is_word] = sizes[word]
        first, last = np.full((2, len(is_word)), self.end, dtype=np.int32)
        first[is_word], last[is_word] = symbol[begin[word]], symbol[begin[word] + sizes[word] - 1]
        begins = np.cumsum(each, dtype=np.int32)
        take = np.arange(begins[-1], dtype=np.int32)
        take += np.repeat(begin[word] - begins[:-1][is_word], sizes[word])
        return A.Tokens(n + 1, first, last, begins, symbol[take], self.end)


@dataclass
class Model:
    table: Symbols
    flat: np.ndarray

    def weights(self) -> A.Weights:
        return A.views(self.flat, A.shapes(self.table.n_first, self.table.n_later))

    def log_told(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities of all words of a chunk, and of its documents' ends, by the attention model."""
        t = self.table.tokens(c, np.ones(len(c.n_words), dtype=bool))
        token, symbol = A.log_probabilities(self.weights(), t, self.table.n_first)
        end_at = np.cumsum(t.counts) - 1
        is_word = np.ones(len(token), dtype=bool)
        is_word[end_at] = False
        told = token[is_word].astype(np.float64)
        if len(told):
            told += np.add.reduceat(symbol, t.begin[:-1][is_word], dtype=np.float64)
            share = np.add.reduceat(self.table.log_share[c.ids], np.cumsum(c.sizes) - c.sizes)
            told += share[c.word]
        return told, token[end_at].astype(np.float64)


def _fitting(table: Symbols, start: np.ndarray, number: int) -> Callable:
    """One trainer's round ``number``, from the common weights ``start``."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, of, seen = start.copy(), A.shapes(table.n_first, table.n_later), 0
        g = np.zeros_like(flat)
        p, d, adam = A.views(flat, of), A.views(g, of), A.Adam(flat, RATES[number])
        for chunk, held, c in _each(batches):
            t = table.tokens(c, (held == 0) & ((np.arange(len(held)) % ROUND == 0) == (number == 0)))
            placed, came = A.blocks(t.counts), t.came()
            n = len(placed[0])
            step = min(STEP_BLOCKS, max(16, n // LEAST_STEPS))
            lows = np.random.default_rng(chunk).permutation(np.arange(0, n, step))
            for low in lows.tolist():
                tokens = A.gradients(p, d, t, came, placed, low, min(low + step, n), table.n_first)
                g *= np.float32(1 / tokens)
                adam.step(g)
                seen += tokens
        if seen:
            yield pd.DataFrame({"trainer": [TaskContext.get().partitionId()], "n": [seen], "weights": [flat.tobytes()]})

    return fit


def _averaged(rows: DataFrame, start: np.ndarray) -> np.ndarray:
    """Token-weighted mean of trainers' weights, 64 at a time."""

    def mean(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy(dtype=np.float64)
        total = sum(np.frombuffer(w, dtype="<f4").astype(np.float64) * k for w, k in zip(group["weights"], n, strict=True))
        return pd.DataFrame({"trainer": [key[0]], "n": [int(n.sum())], "weights": [(total / n.sum()).astype("<f4").tobytes()]})

    schema = "trainer int, n long, weights binary"
    rows = scratch.materialize(rows, "lm-weights")
    while True:
        last = rows.count() <= 64
        rows = rows.groupBy(F.expr("trainer div 64").cast("int").alias("trainer")).applyInPandas(mean, schema)
        if last:
            found = rows.groupBy(F.lit(0).alias("trainer")).applyInPandas(mean, schema).collect()
            return np.frombuffer(found[0]["weights"], dtype="<f4").copy() if found else start
        rows = scratch.materialize(rows, "lm-weights")


def train(packed: DataFrame, path: str) -> Model:
    """Fit the model; what the driver holds is of the size of the tokenizer's vocabulary or the model."""
    begins = speller(path).begins
    table = Symbols(subword_counts(packed, len(begins)), begins)
    flat = A.initial(table.counts[: table.n_first], table.counts[table.n_first :])
    for number in range(len(RATES)):
        fitted = packed.select("chunk", "held", "packed").mapInPandas(_fitting(table, flat, number), "trainer int, n long, weights binary")
        flat = _averaged(fitted, flat)
    return Model(table, flat)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(packed: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens of every document of the chunks."""
    totals = counts.agg(F.sum("tokens"), F.sum("distinct")).first()
    n_train, n_distinct = int(totals[0] or 0), int(totals[1] or 0)
    shared = packed.sparkSession.sparkContext.broadcast(model)  # under a MB, by SYMBOLS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_ids, words, (_, held, c) in zip(batch["doc_ids"], batch["words"], _each(iter([batch])), strict=True):
                words = np.asarray(words, dtype=np.int64).reshape(-1, 2)
                is_end = words[:, 0] == END
                # The chunk's own counts, replaced by the corpus's where they differ.
                n, n_end = c.learned(held), int(words[is_end, 1].sum())
                n[words[~is_end, 0]] = words[~is_end, 1]
                told, end_told = shared.value.log_told(c)
                room = n_train + 0.1 * (n_distinct + 1)
                with np.errstate(divide="ignore"):
                    share, end_share = np.log(WORD_SHARE * n / max(n_train, 1)), float(np.log(WORD_SHARE * n_end / max(n_train, 1)))
                mixed = np.logaddexp(math.log(1 - WORD_SHARE) + told, share[c.word]) / math.log(10)
                end_mixed = np.logaddexp(math.log(1 - WORD_SHARE) + end_told, end_share) / math.log(10)
                doc = np.repeat(np.arange(len(held)), c.n_words)
                by_doc = lambda x: np.bincount(doc, weights=x, minlength=len(held))  # noqa: B023, E731
                known, base = by_doc((n > 0)[c.word]).astype(np.int64) + (n_end > 0), by_doc(np.log10((n + 0.1) / room)[c.word])
                ids = pd.array([None if x is None or x != x else int(x) for x in doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "held_out": held == 1, "n_tokens": c.n_words.astype(np.int64) + 1, "n_known": known, "base_score": base + math.log10((n_end + 0.1) / room), "score": by_doc(mixed) + end_mixed})

    prepare(packed.sparkSession, 1)
    joined = packed.join(counts.select("chunk", "words"), "chunk").select("chunk", "doc_ids", "held", "packed", "words")
    return joined.mapInPandas(run, _SCORES).withColumn("train_tokens", F.lit(n_train).cast("long"))


def score(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    path = tokenizer_path(tokenizer)
    packed = chunks(docs, path)
    prepare(docs.sparkSession, 1)
    counts = word_counts(packed)
    return scored(packed, counts, train(packed, path))


def report(docs: DataFrame) -> DataFrame:
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
