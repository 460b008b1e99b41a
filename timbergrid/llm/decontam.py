"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

1. Items become windows of 13 consecutive words (one shorter window where an item has fewer words); equal windows of
   several items are one window with a list of items.
2. The words of a window are ordered by rarity, by their counts over all documents. A document holds a window only if
   it holds all its words, so the necessary prefix has one word: the rarest.
3. Each document word that is some window's rarest word gives a candidate: the window must start there less the rare
   word's offset (positional bound) and fit into the document (length bound).
4. Candidates are verified by comparing the document's words over exactly that span.

All of it is DataFrame expressions. Texts are read twice, to count words and to find hits, and their words are never
shuffled: the window table is written in blocks of at most ``BLOCK_ROWS`` rows and about ``BLOCK_BYTES``, and each block
is broadcast to one pass over the texts, so a benchmark beyond one block costs passes, not shuffles. Hits alone are
grouped by document.

Defined results: null texts and texts without words have no words and no hits; items without words have no windows;
a null item_id is written as an empty string; repeated items count once; repeated document rows each get their row;
very long texts are matched whole; an empty table on either side gives no hits; ``report`` ignores other columns,
``keep`` carries them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as X

WINDOW = 13
#: Fixed value: what separates the words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: What is broadcast at once: a block's windows or the benchmark's words are counted before.
BLOCK_ROWS, BLOCK_BYTES = 200_000, 32 << 20
#: Parts of a word's rows where the counts of words are too many to be broadcast.
SALTS = 32


def _marked_words(text: Column) -> Column:
    """An empty marker, then the words; a text that ends with a separator has an empty word at the end."""
    return F.split(F.concat(F.lit(" "), X.lower_ascii(F.coalesce(text, F.lit("")))), SEPARATORS)


def _n_words(marked: Column) -> Column:
    return (F.size(marked) - 1 - F.when((F.size(marked) > 1) & (F.element_at(marked, -1) == ""), 1).otherwise(0)).cast("int")


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """window: array of words, items: array of item ids; one row for each distinct window."""
    marked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _marked_words(F.col("text")).alias("m"))
    words = marked.select("item", F.slice("m", F.lit(2), _n_words(F.col("m"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.least(F.lit(length), F.size("w"))))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _exploded(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), _marked_words(F.col("text")).alias("m"))
    return rows.select("doc_id", "text_hash", "m", _n_words(F.col("m")).alias("n_words"), F.posexplode("m").alias("pos", "word"))


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n) of the vocabulary's words over all documents; words that no document has are left out."""
    words = _exploded(docs).select("word")
    if vocabulary.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
        words = words.join(F.broadcast(vocabulary), "word", "left_semi")
        return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Counted where they are first, so a frequent word is a row for each task.
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left_semi")


def rarest(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The window table with each window's rarest word and its first offset; windows with a word that no document has are gone."""
    vocabulary = scratch.materialize(table.select(F.explode("window").alias("word")).distinct(), "benchmark-words")
    counts = scratch.materialize(word_counts(docs, vocabulary), "word-counts")
    # Ordered by (count, word); counts are exact, so the order is the same in every run.
    placed = table.select("window", "items", F.posexplode("window").alias("offset", "word"))
    if counts.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
        ordered = placed.join(F.broadcast(counts), "word", "left")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ordered = placed.withColumn("salt", F.pmod(F.xxhash64("window"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"], "left")
    first = ordered.groupBy("window", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("r"))
    return first.where("r.n > 0").select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "window", F.size("window").alias("length"), "items")


def hits(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, spans: sorted distinct (start, length, items); starts from 0."""
    table = scratch.materialize(windows(items, length), "windows")
    prefix = scratch.materialize(rarest(docs, table), "prefixes")
    row_bytes = 64 + F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " "))
    n, size = prefix.agg(F.count(F.lit(1)), F.sum(row_bytes)).first()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), math.ceil((size or 0) / BLOCK_BYTES))
    # The marker keeps one row of each document through the first pass; it stands at position 0 only.
    marker = prefix.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("window"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("items"))
    found = None
    for block in range(blocks):
        part = prefix if blocks == 1 else prefix.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        one = _found(docs, part if block else part.unionByName(marker))
        found = one if found is None else found.unionByName(one)
    grouped = found.groupBy("doc_id", "text_hash", "n_words")
    rows = grouped.agg(F.count_if(F.col("span").isNull()).alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"))
    # Repeated rows of one document and text met in one group; each gets its row again.
    return rows.select("doc_id", "text_hash", "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col")


def _found(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, span of every window of a block that a document holds; no span for the marker."""
    found = _exploded(docs).join(F.broadcast(prefix), "word")  # at most a block
    start = F.col("pos") - F.col("offset")
    found = found.where(((F.col("length") == 0) & (F.col("pos") == 0)) | ((F.col("length") > 0) & (start >= 1) & (start + F.col("length") - 1 <= F.col("n_words"))))
    found = found.where((F.col("length") == 0) | (F.slice("m", start + 1, F.col("length")) == F.col("window")))
    span = F.when(F.col("length") > 0, F.struct((start - 1).alias("start"), F.col("length").alias("length"), F.col("items").alias("items")))
    return found.select("doc_id", "text_hash", "n_words", span.alias("span"))


def _covered(spans: Column) -> Column:
    end = lambda s: s["start"] + s["length"]
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], end(s)).alias("upto"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step, lambda a: a["n"]).cast("long")


def report(docs: DataFrame, items: DataFrame, length: int = WINDOW, others: tuple[str, ...] = ()) -> DataFrame:
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))))
    rows = hits(docs, items, length).select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).alias("n_hit"), names.alias("items"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *others,
    )


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    name = X.keep_columns(docs.columns, "_text_hash")
    bad = report(docs, items, others=("text_hash",)).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias(name)).distinct()
    hashed = docs.withColumn(name, F.xxhash64("text"))
    return hashed.join(bad, hashed["doc_id"].eqNullSafe(bad["bad_id"]) & (hashed[name] == bad[name]), "left_anti").drop(name)
