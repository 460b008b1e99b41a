"""Codes of vectors by parts, whose codebooks are maintained from changes alone.

Vectors of whole components are cut into equal parts; each part position has a codebook. A round assigns every part to the
nearest entry of its codebook and moves each entry to the mean of its parts. Kept between rounds are the assignments, a
table beside the vectors, and for every entry the running sum and number of its parts, in whole numbers. A round shuffles
only what changed: a part that went from one entry to another is a minus for the old one and a plus for the new one, summed
before the shuffle, and these are added to the running sums. As all sums are whole, they equal those made anew.

What reaches the driver are the codebooks: parts x entries x components of a part, whatever the number of vectors.

Defined results: rows that ``vectors.whole`` leaves out take no part. Vectors shorter than the longest, or than the next
multiple of the parts, end in zeros. Of repeated vec_ids each row has its code, and the smallest of their vectors is the
one that may start an entry. With fewer vec_ids than entries there are as many entries as vec_ids. Equal distances go to
the lower entry, entries without parts stay. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .vectors import matrix, padded, products, whole
from .workers import prepare


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    parts: int = 16
    entries: int = 64
    rounds: int = 2


def _seeds(vectors: DataFrame, n: int) -> list[tuple[int, list[int]]]:
    """The ``n`` smallest vec_ids, each with the smallest of its vectors."""
    found: list[tuple[int, list[int]]] = []
    while len(found) < n:
        rest = vectors.where(F.col("vec_id") > found[-1][0]) if found else vectors
        rows = rest.select("vec_id", "v").orderBy("vec_id", "v").limit(n).collect()  # n rows at most
        if not rows:
            break
        for r in rows:
            if len(found) < n and (not found or r.vec_id != found[-1][0]):
                found.append((r.vec_id, list(r.v)))
    return found


def assigned(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, label, v, code) with ``was``, the code so far, and ``code`` and ``error`` under ``codebooks``."""
    parts, entries, size = codebooks.shape
    lengths = (codebooks * codebooks).sum(axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), parts * size)
            code, error = np.zeros((len(x), parts), dtype=np.int32), (x * x).sum(axis=1)
            for p in range(parts):
                far = lengths[p] - 2 * products(x[:, p * size : (p + 1) * size], codebooks[p])
                code[:, p] = far.argmin(axis=1)  # the first of equals
                error += far.min(axis=1) if len(x) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts), pa.int32()), pa.array(code.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), batch.column("code"), lists, pa.array(error, pa.int64())], ["vec_id", "label", "v", "was", "code", "error"])

    prepare(vectors.sparkSession)
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id long, label {label}, v array<int>, was array<int>, code array<int>, error long")


def changes(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """(part, entry, n, s): what entries gain and lose by parts whose assignment isn't what it was."""
    part = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.get("was", p).alias("was"), F.get("code", p).alias("now"), F.slice("v", p * size + 1, F.lit(size)).alias("x")))
    moved = rows.select(F.explode(F.filter(part, lambda m: ~m["was"].eqNullSafe(m["now"]))).alias("m"))
    sides = F.array(F.struct(F.col("m.now").alias("entry"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("m.was").alias("entry"), F.lit(-1).cast("long").alias("sign")))
    each = moved.select("m.part", "m.x", F.explode(sides).alias("to")).where("to.entry is not null").select("part", "to.entry", "to.sign", "x")
    return _summed(each.select("part", "entry", F.col("sign").alias("n"), *[(F.get("x", F.lit(i)) * F.col("sign")).alias(f"s{i}") for i in range(size)]), size)


def _summed(rows: DataFrame, size: int) -> DataFrame:
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)])


def encoded(embeddings: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, was, code, error) under the final codebooks, and these: parts x entries x components."""
    kept = whole(embeddings, settings.scale)
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    size = max(1, -(-longest // settings.parts))
    none = F.lit(None).cast("array<int>")
    vectors = scratch.materialize(padded(kept, size * settings.parts).withColumn("code", none), "vectors")
    seeds = _seeds(vectors, settings.entries)
    if not seeds:
        return vectors.select("vec_id", "label", "v", F.col("code").alias("was"), "code", F.lit(0).cast("long").alias("error")), np.zeros((settings.parts, 0, size), dtype=np.int64)
    codebooks = np.array([v for _, v in seeds], dtype=np.int64).reshape(len(seeds), settings.parts, size).transpose(1, 0, 2).copy()
    running = None
    for _ in range(settings.rounds):
        state = scratch.materialize(assigned(vectors, codebooks), "assignments")
        delta = changes(state, settings.parts, size)
        sums = scratch.materialize(delta if running is None else _summed(running.unionByName(delta), size), "sums")
        for old in (vectors, running):
            if old is not None:
                scratch.drop(old)
        vectors, running = state, sums
        for r in sums.where("n > 0").collect():  # parts x entries rows at most
            codebooks[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(size)]
    return scratch.materialize(assigned(vectors, codebooks), "codes"), codebooks


def report(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    found, codebooks = encoded(embeddings, settings)
    told = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = by_label.select("of", F.least(F.col("sum"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))
