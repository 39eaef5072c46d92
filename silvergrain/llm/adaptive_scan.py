"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Every vector x gets one more coordinate, sqrt(M^2 - |x|^2), where M is the largest
norm; then the smallest distance to (q, 0) is the largest inner product with q.
Lists come from k-means on a bounded sample; every vector is indexed. A random
rotation spreads the distances over all coordinates, so that a few blocks of
columns already estimate a whole distance: after each block, candidates whose
estimate exceeds the bound by more than chance allows are abandoned.

The bound of a query is the distance of its k-th neighbour among some vectors of
the sample, which are real candidates and enter its result. So tasks need not wait for each other.
How many lists a query probes is measured on the sample: as many as give the
wanted recall there against brute force.

Identical vectors are indexed once, with their k + 1 smallest ids: no result
holds more of them. Lists and the queries that probe them are cut into chunks of
bounded size, so a list that holds a third of all vectors is spread over tasks.

Vectors that are null, zero, hold null or non-finite components, have another
number of dimensions than most, or lack a vec_id take no part. Rows that repeat
a vec_id with the same vector count once. Ties go to the smaller vec_id. An empty
table, or one without queries, gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, record
from silvergrain.session import cut_lineage, ship_package

#: Components of vectors whose products are taken at once.
SCORED_NUMBERS = 4_000_000
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors fit the lists, at least ``per_list`` for each; an eighth, up to ``bounding``, gives bounds."""
    neighbours: int = 20
    sample: int = 32_768
    bounding: int = 4_096
    per_list: int = 32
    trials: int = 1_024
    recall: float = 0.965
    columns: int = 16
    confidence: float = 2.1
    candidates: int = 4_096
    queries: int = 4_096
    seed: int = 11


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part, as doubles."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & some))
    usual = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("embedding") == (usual["dims"] if usual else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Index:
    """Centroids, rotation, some vectors that give bounds, and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, ids: list[list[int]], largest: float, total: int, settings: Settings):
        self.settings, self.largest = settings, largest
        rng = np.random.default_rng(settings.seed)
        some = np.sort(rng.choice(len(sample), min(settings.bounding, -(-len(sample) // 8)), replace=False))
        self.bounding, self.ids = sample[some], [ids[i] for i in some]
        dims = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        lists = int(max(1, min(np.sqrt(total), len(sample) // settings.per_list)))
        self.centroids = self._centroids(self.lifted(sample), lists, rng)
        self.probes = self._probes(sample, rng)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest ** 2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    @staticmethod
    def _centroids(points: np.ndarray, lists: int, rng) -> np.ndarray:
        centers = points[rng.choice(len(points), lists, replace=False)].copy()
        for _ in range(8):
            owner = np.concatenate([(centers @ part.T - 0.5 * (centers * centers).sum(1)[:, None]).argmax(0)
                                    for part in np.array_split(points, max(1, len(points) // 4096))])
            sums = np.zeros_like(centers)
            np.add.at(sums, owner, points)
            size = np.bincount(owner, minlength=lists)
            centers[size > 0] = sums[size > 0] / size[size > 0][:, None]
        return centers

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """Distances to the centroids, up to a constant per row."""
        return (self.centroids * self.centroids).sum(1) - 2 * lifted @ self.centroids.T

    def owners(self, x: np.ndarray) -> np.ndarray:
        return self.order(self.lifted(x)).argmin(1)

    @staticmethod
    def flat(queries: np.ndarray) -> np.ndarray:
        return np.concatenate([queries, np.zeros((len(queries), 1))], 1)

    def _probes(self, sample: np.ndarray, rng) -> int:
        k = self.settings.neighbours
        if len(sample) <= k + 1:
            return len(self.centroids)
        trial = rng.choice(len(sample), min(self.settings.trials, len(sample)), replace=False)
        owner, places = self.owners(sample), []
        for part in np.array_split(trial, max(1, len(trial) // 128)):
            scores = sample[part] @ sample.T
            scores[np.arange(len(part)), part] = -np.inf
            best = np.argpartition(-scores, k, axis=1)[:, :k]
            order = self.order(self.flat(sample[part]))
            rank = order.argsort(1).argsort(1)
            places.append(np.take_along_axis(rank, owner[best], 1).ravel())
        return int(np.quantile(np.concatenate(places), self.settings.recall, method="higher")) + 1

    def first_results(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: its bound (the lowest score that may matter), and its best bounding rows with scores."""
        k = min(self.settings.neighbours + 1, len(self.bounding))
        scores = queries @ self.bounding.T
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        exact = np.stack([(self.bounding[b] * q).sum(1) for b, q in zip(best, queries)])
        bound = exact.min(1) if k == self.settings.neighbours + 1 else np.full(len(queries), -np.inf)
        return bound, best, exact

    def scan(self, x: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) pairs within the bound."""
        of_q, of_c = zip(*self.parts(x, queries, bound))
        return np.concatenate(of_q), np.concatenate(of_c)

    def parts(self, x: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of 128 queries at a time, by column blocks with early abandonment."""
        dims = len(self.rotation)
        points = (self.lifted(x) @ self.rotation).astype(np.float32)
        asked = (self.flat(queries) @ self.rotation).astype(np.float32)
        limit = (queries * queries).sum(1) + self.largest ** 2 - 2 * bound
        limit = np.where(np.isfinite(limit), limit, np.inf) * (1 + 1e-5) + 1e-9
        for start in range(0, len(asked), 128):
            part, most = asked[start:start + 128], limit[start:start + 128, None]
            partial, open_q, open_c = np.zeros((len(part), len(points)), np.float32), None, None
            for at in range(0, dims, self.settings.columns):
                end = min(dims, at + self.settings.columns)
                a, b = part[:, at:end], points[:, at:end]
                chance = (1 + self.settings.confidence / np.sqrt(end)) ** 2 * end / dims if end < dims else 1.0
                if open_q is None:  # most candidates are still open: the block as a whole
                    partial += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
                    near = partial <= most * chance
                    if end == dims or near.mean() < 0.1:
                        open_q, open_c = np.nonzero(near)
                        sums = partial[open_q, open_c]
                else:
                    sums = sums + ((a[open_q] - b[open_c]) ** 2).sum(1)
                    near = sums <= most[open_q, 0] * chance
                    open_q, open_c, sums = open_q[near], open_c[near], sums[near]
            yield open_q + start, open_c

    def best(self, x: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, candidates and scores: of each query the first k + 1 pairs within the bound, and what ties with the last.

        One vector of very large norm can leave every pair within the bound, so pairs are scored in
        bounded pieces and reduced after each part of the queries.
        """
        k, piece, found = self.settings.neighbours, max(1, SCORED_NUMBERS // x.shape[1]), []
        for at_q, at_c in self.parts(x, queries, bound):
            scores = np.zeros(len(at_q))
            for at in range(0, len(at_q), piece):
                own = slice(at, at + piece)
                scores[own] = (x[at_c[own]] * queries[at_q[own]]).sum(1)
            order = np.lexsort((-scores, at_q))
            at_q, at_c, scores = at_q[order], at_c[order], scores[order]
            first = np.searchsorted(at_q, at_q, "left")
            top = np.arange(len(at_q)) - first <= k
            tie = scores >= scores[np.minimum(first + k, len(scores) - 1)] if len(scores) else top
            same = at_q[np.minimum(first + k, len(at_q) - 1)] == at_q if len(scores) else top
            keep = np.flatnonzero(top | (tie & same))
            found.append((at_q[keep], at_c[keep], scores[keep]))
        return tuple(map(np.concatenate, zip(*found)))


def _fit(distinct: DataFrame, settings: Settings) -> Index:
    total, largest = distinct.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()
    spot = F.pmod(F.xxhash64("embedding"), F.lit(1 << 40))
    share = int(min(1.0, settings.sample / total) * (1 << 40))
    found = distinct.where(spot < share).limit(2 * settings.sample).toArrow()  # the expected size is ``sample``
    order = np.argsort([i[0] for i in found["ids"].to_pylist()], kind="stable")
    found = found.take(pa.array(order))
    return Index(matrix(found["embedding"]), found["ids"].to_pylist(), largest, total, settings)


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each query, without itself."""
    spark, k = vectors.sparkSession, settings.neighbours
    ship_package(spark)
    rows = cut_lineage(usable(vectors))
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    distinct = cut_lineage(rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("embedding")
                           .agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = cut_lineage(queries.select("embedding").distinct().withColumn("q", F.monotonically_increasing_id()))
    if distinct.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], RESULT)
    index = spark.sparkContext.broadcast(_fit(distinct, settings))  # bounding vectors and lists, both of bounded number

    def assign(batches):
        for batch in batches:
            owner = index.value.owners(matrix(batch.column(0)))
            yield record(list=owner.astype(np.int32), ids=batch.column(1), embedding=batch.column(0))

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, q = matrix(part.column(0)), part.column(1).to_numpy()
                bound, _, _ = index.value.first_results(x)
                order = index.value.order(index.value.flat(x)).argsort(1)[:, :index.value.probes]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                yield record(list=order.ravel().astype(np.int32), q=q[row], bound=bound[row],
                             embedding=part.column(0).take(pa.array(row)))

    def from_sample(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = part.column(1).to_numpy()
                _, best, scores = index.value.first_results(matrix(part.column(0)))
                ids = index.value.ids
                yield record(q=np.repeat(q, best.shape[1]), score=scores.ravel(),
                             ids=([ids[i] for i in best.ravel()], pa.list_(pa.int64())))

    def scan(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not candidates.num_rows or not asking.num_rows:
            return schema.empty_table()
        x, y = matrix(candidates["embedding"]), matrix(asking["embedding"])
        at_q, at_c, scores = index.value.best(x, y, asking["bound"].to_numpy())
        ids = candidates["ids"].combine_chunks().take(pa.array(at_c))
        return pa.table([pa.array(asking["q"].to_numpy()[at_q]), pa.array(scores), ids], schema=schema)

    kind = "embedding array<double>"
    stored = cut_lineage(by_batch(distinct.select("embedding", "ids"), assign, f"list int, ids array<long>, {kind}"))
    probes = cut_lineage(by_batch(asked.select("embedding", "q"), probe, f"list int, q long, bound double, {kind}"))
    chunks = cut_lineage(  # one row per list
        stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.candidates).cast("int").alias("blocks"))
        .join(probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.queries).cast("int").alias("groups")), "list"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (stored.join(F.broadcast(chunks), "list").withColumn("block", F.pmod(F.xxhash64("ids"), "blocks").cast("int"))
            .withColumn("part", upto("groups")).select("list", "block", "part", "ids", "embedding"))
    right = (probes.join(F.broadcast(chunks), "list").withColumn("part", F.pmod(F.xxhash64("q"), "groups").cast("int"))
             .withColumn("block", upto("blocks")).select("list", "block", "part", "q", "bound", "embedding"))
    keys = ["list", "block", "part"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "q long, score double, ids array<long>")
    both = pairs.unionByName(by_batch(asked.select("embedding", "q"), from_sample, "q long, score double, ids array<long>"))
    single = both.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    ranked = single.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    best = (ranked.where(F.col("at") <= k + 1).groupBy("q")
            .agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found")))
    answers = queries.join(asked, "embedding").select("query_id", "q").join(best, "q")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return (answers.select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"))
