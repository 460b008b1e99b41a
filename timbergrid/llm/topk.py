"""Exact search for the highest inner products by an index of distances to pivots.

Inner products become distances by one more component: with M the largest length of a vector, x goes to (x, sqrt(M^2 -
|x|^2)) and a query q to (q, 0), so that their squared distance is |q|^2 + M^2 - 2 q.x. The highest product is the least
distance, and the triangle inequality holds.

Index. Pivots are fitted on a bounded sample (``SAMPLE`` vectors, those of the smallest hashes). Every vector is keyed by
its nearest pivot and its distance to it. A pivot's vectors lie in annuli of one width; neighbouring annuli share a block
until it has about ``block_rows`` vectors, and an annulus of more has several blocks. A block is one row of a table: its
vectors in the order of their distances. What the driver knows are annuli: pivots x ``ANNULI`` numbers at most.

Search. A vector of a block at distances lo to hi from pivot p can't be nearer to q than d(q,p) - hi or lo - d(q,p), nor
than half of what d(q,p) is longer than q's distance to its own nearest pivot. Each query takes the blocks in the order of
this bound, eight times as many every round, and stops before the first whose bound exceeds the distance of its k-th best
so far. In a block only the annuli between d(q,p) - r and d(q,p) + r are looked at. Bounds are floating point with slack to
spare, scores whole numbers; so nothing is lost. Queries go to blocks packed by up to 512, in a join that Spark can split
where many go to one block; a block of a hot vector is one of many.

Defined results: rows that ``vectors.whole`` leaves out take no part; shorter vectors end in zeros. Rows with a query's
vec_id are its own and no candidates. Repeated candidates have a rank each; repeated queries of one vec_id and vector give
their result once, and other vectors of the same vec_id are queries of their own. Ties go to the smaller vec_id. A query
without candidates gives no rows, an empty table none at all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .vectors import matrix, padded, products, whole
from .workers import prepare

SAMPLE, PIVOTS, ANNULI = 2048, 32, 256
BLOCK_NUMBERS, GROWTH = 1 << 17, 8


@dataclass(frozen=True)
class Pivots:
    """``at``: pivots, the added component last; ``longest``: M."""

    at: np.ndarray
    longest: float

    @property
    def slack(self) -> float:
        return 1e-6 * (self.longest + 1)

    def distances(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        squares = (x * x).sum(axis=1)
        added = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.longest**2 - squares, 0))
        full = np.column_stack((x, added))
        far = (full * full).sum(axis=1)[:, None] - 2 * full @ self.at.T + (self.at * self.at).sum(axis=1)
        return np.sqrt(np.maximum(far, 0))


def fitted(sample: np.ndarray, longest: float, pivots: int = PIVOTS, rounds: int = 5) -> Pivots:
    """Pivots far from each other, then moved to the middle of what is nearest to them."""
    x = sample.astype(np.float64)
    x = np.column_stack((x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))))
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    at = x[chosen]
    for _ in range(rounds):
        near = ((x * x).sum(axis=1)[:, None] - 2 * x @ at.T + (at * at).sum(axis=1)).argmin(axis=1)
        for p in np.unique(near):
            at[p] = x[near == p].mean(axis=0)
    return Pivots(at, longest)


@dataclass(frozen=True)
class Blocks:
    """By block: its pivot, the least and largest distance in it, and into how many rows of the table it is dealt."""

    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    dealt: np.ndarray

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least possible distance of every query (its distances to all pivots: a row of ``d``) from every block."""
        own = d[:, self.pivot]
        return np.maximum(np.maximum(own - self.hi, self.lo - own), np.maximum(0, (own - d.min(axis=1, keepdims=True)) / 2))


@dataclass(frozen=True)
class Index:
    pivots: Pivots
    blocks: Blocks
    table: DataFrame
    width: int


def keyed(vectors: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """(vec_id, v, pivot, d, nr): the nearest pivot, the distance to it, and a number that deals rows out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            d = pivots.distances(matrix(batch.column("v"), width))
            near = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=np.int64)
            nr = pa.array(np.arange(done, done + len(d)), pa.int64())
            done += len(d)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near], pa.float64()), nr], ["vec_id", "v", "pivot", "d", "nr"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<int>, pivot int, d double, nr long")


def _cut(annuli: list, block_rows: int) -> tuple[list[tuple[int, int, int]], Blocks]:
    """(pivot, annulus, block) of every annulus, and the blocks."""
    told, found, fill = [], [], 0
    for a in annuli:
        if not found or found[-1][0] != a.pivot or fill + a.n > block_rows:
            found.append([a.pivot, a.lo, a.hi, 0])
            fill = 0
        fill += a.n
        found[-1][2], found[-1][3] = a.hi, -(-fill // block_rows)
        told.append((a.pivot, a.annulus, len(found) - 1))
    kinds = (np.int64, np.float64, np.float64, np.int64)
    return told, Blocks(*[np.array([f[i] for f in found], dtype=kind) for i, kind in enumerate(kinds)])


def index(vectors: DataFrame, width: int, longest: float) -> Index:
    """Every row of ``vectors`` (vec_id, v of ``width`` components) in blocks by pivot and distance."""
    spark = vectors.sparkSession
    prepare(spark, 4096)
    chosen = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"]  # SAMPLE vectors at most
    pivots = fitted(matrix(chosen.combine_chunks(), width), longest)
    step, block_rows = max(2 * longest, 1.0) / ANNULI, max(64, BLOCK_NUMBERS // width)
    rows = scratch.materialize(keyed(vectors, pivots, width).withColumn("annulus", F.floor(F.col("d") / step).cast("int")), "keyed")
    annuli = rows.groupBy("pivot", "annulus").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("pivot", "annulus").collect()
    told, blocks = _cut(annuli, block_rows)
    places = spark.createDataFrame([(p, a, b, int(blocks.dealt[b])) for p, a, b in told], "pivot int, annulus int, block int, dealt long")
    placed = rows.join(F.broadcast(places), ["pivot", "annulus"])  # PIVOTS x ANNULI rows at most

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        d = group["d"].to_numpy()
        order = np.argsort(d, kind="stable")
        v = matrix(group["v"].combine_chunks(), width, np.int32)[order]
        cells = [v.tobytes(), group["vec_id"].to_numpy()[order].tobytes(), d[order].tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=["block", "part", "vs", "ids", "ds"])

    packed = placed.select("block", F.pmod("nr", F.col("dealt")).alias("part"), "vec_id", "v", "d").groupBy("block", "part").applyInArrow(pack, "block int, part long, vs binary, ids binary, ds binary")
    table = scratch.materialize(packed, "blocks")
    scratch.drop(rows)
    return Index(pivots, blocks, table, width)


def _asked(state: DataFrame, found: Index, first: int, last: int) -> DataFrame:
    """Queries of a batch packed by block: those that have it among their blocks ``first`` to ``last`` and can't do without."""
    blocks, pivots, width = found.blocks, found.pivots, found.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            if not len(v):
                continue
            d = pivots.distances(v, queries=True)
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: none yet
            squares = (v.astype(np.float64) ** 2).sum(axis=1)
            reach = np.sqrt(np.maximum(squares + pivots.longest**2 - 2 * bound, 0)) + pivots.slack + 1e-6 * np.sqrt(squares)
            reach = np.where(np.isnan(reach), np.inf, reach)
            least = blocks.bounds(d)
            order = np.argsort(least, axis=1, kind="stable")[:, first:last]
            wanted = np.zeros(least.shape, dtype=bool)
            np.put_along_axis(wanted, order, np.take_along_axis(least, order, axis=1) <= reach[:, None], axis=1)
            ids, hashes = batch.column("query_id").to_numpy(), batch.column("hash").to_numpy()
            scores = np.where(np.isnan(bound), -np.inf, bound)
            rows = [[] for _ in range(8)]
            for b in np.flatnonzero(wanted.any(axis=0)):
                q = np.flatnonzero(wanted[:, b])
                for cell, x in zip(rows, (b, blocks.dealt[b], v[q].astype(np.int32).tobytes(), ids[q].tobytes(), hashes[q].tobytes(), d[q, blocks.pivot[b]].tobytes(), reach[q].tobytes(), scores[q].tobytes()), strict=True):
                    cell.append(x)
            if rows[0]:
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["block", "dealt", "qv", "qid", "qhash", "qd", "reach", "score"])

    prepare(state.sparkSession, 512)
    asked = state.select("query_id", "hash", "v", "bound").mapInArrow(run, "block int, dealt long, qv binary, qid binary, qhash binary, qd binary, reach binary, score binary")
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dealt") - 1))).drop("dealt")


def _looked_up(asked: DataFrame, found: Index, k: int) -> DataFrame:
    """(query_id, hash, vec_id, score): the best ``k`` of every query in every block that it asked for."""
    width = found.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), dtype=kind)  # noqa: B023, E731
                v, ids, ds = cell("vs", np.int32).reshape(-1, width), cell("ids", np.int64), cell("ds", np.float64)
                qv, qid, qhash, qd, reach, score = cell("qv", np.int32).reshape(-1, width), cell("qid", np.int64), cell("qhash", np.int64), cell("qd", np.float64), cell("reach", np.float64), cell("score", np.float64)
                out = []
                for part in np.array_split(np.argsort(qd, kind="stable"), -(-len(qd) // 64)):
                    a, b = np.searchsorted(ds, (qd[part] - reach[part]).min(), side="left"), np.searchsorted(ds, (qd[part] + reach[part]).max(), side="right")
                    got = products(qv[part].astype(np.int64), v[a:b].astype(np.int64))
                    near = ids[a:b]
                    for i, q in enumerate(part):
                        here = np.flatnonzero((got[i] >= score[q]) & (near != qid[q]))
                        if len(here) > k:
                            here = here[got[i, here] >= np.partition(got[i, here], len(here) - k)[len(here) - k]]
                        here = here[np.lexsort((near[here], -got[i, here]))][:k]
                        out.append((np.full(len(here), qid[q]), np.full(len(here), qhash[q]), near[here], got[i, here]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["query_id", "hash", "vec_id", "score"])

    prepare(asked.sparkSession, 8)
    return asked.join(found.table, ["block", "part"]).mapInArrow(run, "query_id long, hash long, vec_id long, score long")


def best(queries: DataFrame, found: Index, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of every query (query_id, v) in the index."""
    state = scratch.materialize(queries.select("query_id", "v").distinct().withColumns({"hash": F.xxhash64("v"), "bound": F.lit(None).cast("double")}), "queries")
    ranked = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    top, first, last = None, 0, 2
    while True:
        asked = _asked(state, found, first, last)
        if first:
            asked = scratch.materialize(asked, "asked")
            if asked.isEmpty():  # no query has a block left that could hold better ones
                break
        got = _looked_up(asked, found, k)
        whole_ = got if top is None else got.unionByName(top.drop("rank"))
        now = scratch.materialize(whole_.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "top")
        if first:
            scratch.drop(asked)
        if top is not None:
            scratch.drop(top)
        top, first, last = now, last, last * GROWTH
        if first >= len(found.blocks.pivot):
            break
        last_of = top.where(F.col("rank") == k).select("query_id", "hash", F.col("score").cast("double").alias("bound"))
        after = scratch.materialize(state.drop("bound").join(last_of, ["query_id", "hash"], "left"), "queries")
        scratch.drop(state)
        state = after
    return top.select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The ``k`` best of every row whose vec_id is divisible by ``every``, against all other rows."""
    kept = whole(embeddings, scale).drop("label")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sizes = kept.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("square")).first()
    if sizes["width"] is None:
        return kept.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = scratch.materialize(padded(kept, sizes["width"]), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    return best(queries, index(vectors, sizes["width"], float(sizes["square"]) ** 0.5), k)


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings)
