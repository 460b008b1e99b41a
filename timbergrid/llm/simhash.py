"""SimHash near-dedup with pivot distance tables.

Fingerprints are computed in Arrow batches. Equal fingerprints are one class; all that follows is about classes.
Each class gets its Hamming distances to reference fingerprints, the pivots. By the triangle inequality two classes at
distance d differ by at most d in every coordinate.

Candidates come from the table itself. The pivots are a base and, for each of four 16-bit blocks, ``PIVOTS`` others that
differ from the base within that block alone. So a block's coordinates, less the base's, depend on the fingerprint's bits
there only, and two fingerprints that agree on the block agree on them. Two bits that differ spoil two blocks at most: a
link has equal coordinates on some two blocks, and the six pairs of blocks are the join keys. A candidate whose largest
coordinate difference over all pivots exceeds the limit is discarded; survivors are verified by the bits that differ.

A key with more than ``CROWD`` classes isn't paired within: its classes list the fingerprints at distance 1 or less (65
each); two classes at distance 2 or less, and only such, share one, and no such fingerprint can gather more than 65
classes. Both ways are exact, so the links are.

Defined results: null and blank texts have fingerprint zero and link like any other; ties of bits (exactly half) are 0;
repeated rows have equal fingerprints and one component; null doc_ids take the component of their text and are never
its id unless it has no other; an empty table gives an empty result; very long texts are hashed whole; ``report`` ignores
other columns. ``keep`` carries them, whatever their names; of rows with the doc_id that stays, that with the smallest
text hash stays, and of rows alike in both, the first by its columns as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .workers import prepare

SHINGLE, LIMIT = 3, 2
PIVOTS, BLOCKS, CROWD = 8, 4, 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[a:b], 42) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(bits), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "fp": fp})

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, "doc_id long, text_hash long, fp long")


def _pivots() -> list[int]:
    """The base, then each block's pivots, as signed 64-bit numbers; drawn once and for all."""
    rng, width = np.random.default_rng(64), 64 // BLOCKS
    base = int(rng.integers(0, 1 << 63))
    found = [base] + [base ^ (int(x) << width * b) for b in range(BLOCKS) for x in rng.choice(np.arange(1, 1 << width), PIVOTS, replace=False)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _bit(i: int) -> Column:
    return F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what lies within ``LIMIT`` differing bits; classes: fp, distinct."""
    distances = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("long"))).cast("tinyint") for p in _pivots()])
    table = classes.select("fp", distances.alias("d"))
    block = [F.transform(F.slice("d", 2 + PIVOTS * b, PIVOTS), lambda x: x - F.get("d", F.lit(0))) for b in range(BLOCKS)]
    keys = F.array(*[F.struct(F.lit(BLOCKS * i + j).alias("pair"), F.xxhash64(block[i], block[j]).alias("key")) for i in range(BLOCKS) for j in range(i)])
    spread = table.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    sizes = spread.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.materialize(spread.join(sizes, ["pair", "key"]), "members")
    paired = members.where(F.col("n") <= CROWD).select("pair", "key", "fp", distances.alias("d"))
    a, b = paired.alias("a"), paired.alias("b")
    near = (F.col("a.pair") == F.col("b.pair")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    near = near & F.forall(F.zip_with("a.d", "b.d", lambda x, y: F.abs(x - y)), lambda x: x <= LIMIT)
    survivors = a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    pairs = survivors.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT)
    crowded = members.where(F.col("n") > CROWD).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_bit(i)) for i in range(64)])).alias("at"))
    met = around.groupBy("at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    star = met.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(star)


def classed(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) by row, and (fp, root, component_id) by class."""
    prints = scratch.materialize(fingerprints(docs, shingle), "fingerprints")
    classes = scratch.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, rooted.join(smallest, "root").select("fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    prints, found = classed(docs)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all columns of ``docs``."""
    prints, found = classed(docs)
    one = prints.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = one.groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("rows"))
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash"), "rows", "root")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    kept = rows.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hash") == F.col("stay_hash")))
    # Only ids that several rows have need a choice.
    alike = Window.partitionBy("stay_id", "root").orderBy(F.to_json("row"))
    chosen = kept.where("rows > 1").withColumn("n", F.row_number().over(alike)).where("n = 1")
    return kept.where("rows = 1").select("row").unionByName(chosen.select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
