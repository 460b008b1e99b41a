"""Line dedup: levelled sorted runs of line hashes.

The store is a set of runs, each a table of (key hash, number of documents), bucketed by the hash and sorted within its
files. Two runs, or a run and a batch dealt by the hash, meet in a merge join whose bucketed sides aren't shuffled. Spark
doesn't trust the files' order, since a bucket may have several, and sorts each bucket again; and what a merge of two runs
gives is dealt anew when a third is merged into it, as a full join's keys have no partitioning that Spark knows of.
Documents come in batches. A batch is reduced to its own counts,
merge-anti-joined with the keys that the runs already know to be common, and what is left becomes a run of level 0.
When ``FANOUT`` runs share a level they are compacted into one run of the next level, their counts added up. After the
last batch one compaction over all runs gives the exact common keys: a key that the anti-join held back was common
before, and stays so.

A key is told by 96 bits of hash (64-bit xxHash and 32-bit Murmur3).

Defined results: a null or empty text is one empty line; lines whose key is empty are never dropped; each row counts as
a document, repeated rows too; very long texts are processed whole, a row's line positions being its own; null doc_ids
and ties need no rule, as every line of a common key goes; an empty table gives an empty result; ``report`` ignores
other columns, ``clean`` carries them, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import text as X

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FANOUT = 4, 2
#: 16 bytes a row.
BROADCAST_ROWS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return X.lower_ascii(F.btrim(line, F.lit(X.SPACES)))


def _hashes(text: Column, min_chars: int) -> Column:
    """Array of (pos, h, g), one for each line with a key that is long enough."""
    keyed = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("pos"), _key(x).alias("key")))
    return F.transform(F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h"), F.hash(x["key"]).alias("g")))


class RunStore:
    """Levelled runs of (h, g, n).

    Each run is a table in a folder of the store's; ``save`` writes which there are, and ``open`` takes them up again,
    in this session or another, for the next batch.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT, folder: str | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []
        self.folder = folder or scratch.new_path(spark, "runs")
        self.name = f"timbergrid_run_{uuid.uuid4().hex}"
        self.written = 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(self) -> None:
        """A new version of the store's list of runs; readers take the latest."""
        listed = [(level, run.removeprefix(self.name)) for level, runs in enumerate(self.levels) for run in runs]
        rows = self.spark.createDataFrame([(self.name, self.written, self.min_docs, self.fanout, self.buckets, level, run) for level, run in listed], "name string, written int, min_docs int, fanout int, buckets int, level int, run string")
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/list")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> RunStore:
        rows = spark.read.parquet(f"{folder}/list").orderBy("level", "run").collect()  # as many as there are runs
        rows = [r for r in rows if r["written"] == max(x["written"] for x in rows)]
        store = cls(spark, rows[0]["min_docs"], rows[0]["fanout"], folder)
        store.name, store.written, store.buckets = rows[0]["name"], rows[0]["written"], rows[0]["buckets"]
        for r in rows:
            run = store.name + r["run"]
            if not spark.catalog.tableExists(run):
                spark.sql(f"CREATE TABLE {run} (h BIGINT, g INT, n BIGINT) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {store.buckets} BUCKETS LOCATION '{folder}/{run}'")
            while len(store.levels) <= r["level"]:
                store.levels.append([])
            store.levels[r["level"]].append(run)
        return store

    def forget(self) -> None:
        """Take the runs out of the session's catalog; their files stay until the folder goes."""
        for level in self.levels:
            for run in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.levels = []

    def _write(self, run: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        self.written += 1
        run.repartition(self.buckets, "h", "g").write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def _sum(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged two by two: both are sorted by the key, and equal keys' counts add up.

        Not a union that is grouped: Spark 4.1 takes a union of bucketed tables for one that is dealt by their key,
        leaves out the shuffle and gives a key once for each table.
        """
        merged = runs[0]
        for run in runs[1:]:
            other = run.select("h", "g", F.col("n").alias("more"))
            merged = merged.join(other, ["h", "g"], "full").select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return merged

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h, g, n), one row for each key."""
        for run in self.runs():
            batch = batch.join(run.where(F.col("n") >= self.min_docs), ["h", "g"], "left_anti")
        self._place(0, self._write(batch))

    def _place(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._sum([self.spark.table(x) for x in full]))
            for x in full:
                self.spark.sql(f"DROP TABLE {x}")
            self._place(level + 1, merged)

    def common(self) -> DataFrame:
        return self._sum(self.runs()).where(F.col("n") >= self.min_docs).select("h", "g")


def common_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(h, g) of the keys that at least ``min_docs`` documents have."""
    spark = docs.sparkSession
    own = F.array_distinct(F.transform(_hashes(F.col("text"), min_chars), lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    counts = docs.select(batch.alias("batch"), F.explode(own).alias("k")).groupBy("batch", "k.h", "k.g").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.materialize(counts, "line-counts")
    store = RunStore(spark, min_docs)
    for b in range(batches):
        store.add(counts.where(F.col("batch") == b).drop("batch"))
    common = scratch.materialize(store.common(), "common-lines")
    store.forget()
    return common


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with two columns: ``_lines``, the array of lines, and ``_dropped``, the positions (from 0) that go."""
    common = common_keys(docs, min_docs, min_chars, batches)
    if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        common = F.broadcast(common)
    each = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), F.explode(_hashes(F.col("text"), min_chars)).alias("k"))
    gone = each.select("_id", "_text_hash", "k.pos", "k.h", "k.g").join(common, ["h", "g"], "left_semi").groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("pos")).alias("_dropped"))
    whole = docs.withColumn("_hash", F.xxhash64("text"))
    joined = whole.join(gone, whole["doc_id"].eqNullSafe(gone["_id"]) & (whole["_hash"] == gone["_text_hash"]), "left").drop("_id", "_text_hash", "_hash")
    return joined.withColumns({"_dropped": F.coalesce("_dropped", F.array().cast("array<int>")), "_lines": lines_of(F.col("text"))})


def kept_text(lines: Column, dropped: Column) -> Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.when(F.size(dropped) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def report(docs: DataFrame) -> DataFrame:
    return dropped_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_dropped").cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("_lines"), F.col("_dropped")), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with common lines gone from ``text`` and ``n_chars``, where it is there, brought up to date.

    Only what the text needs passes through the join by row; all other columns ride along under their own names.
    """
    own = [c for c in docs.columns]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    rows = dropped_lines(packed)
    text = F.when(F.size("_dropped") == 0, F.col("text")).otherwise(kept_text(F.col("_lines"), F.col("_dropped")))
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in own])
