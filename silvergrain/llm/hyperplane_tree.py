"""Hard negatives through a multiway hyperplane tree with ranges of distances between siblings.

Each inner node has up to ``fanout`` split points, vectors of its own; a vector
belongs to the nearest of them, so that hyperplanes part the children. For every split point and every
child the node stores the smallest and largest distance from the one to the
vectors of the other, and the range of norms in the child. A search asks for scores in
a window. With |a - x|^2 = |a|^2 + |x|^2 - 2 ax, the window of scores and the norms of
a child give an annulus around the anchor in which the child's answers lie. By the
triangle inequality their distances from a split point then lie in a range, too:
a child whose stored range misses it is left out. Leaves are scored exactly,
so results are exact whatever is left out.

An anchor is first scored in its own leaf. What it finds there narrows its windows
for the search in the tree, once for positives and once for the windows of negatives.

The tree is built level by level: split points, children and ranges of all nodes
of a level come from joins and aggregations, so it grows with the table. Rows
with the same vector and label are one point with their smallest ids: no result holds more of
them. Nodes and leaves are cut into blocks, so that one that can't be split, or the root, is
spread over tasks.

Rows without id, with a null label or vector, or with a null or non-finite
component take no part; nor do those whose squared norm reaches 2^62, as their
scores may not fit into 64 bits. Vectors of different lengths have no inner product and
never meet; empty ones take no part. Rows that repeat id, label and vector count once; another row with the
anchor's id is never its positive or negative. Ties go to the smaller id. An
empty table, or one without anchors, gives an empty result. Further columns are left out.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvergrain.operators.ordering import top_rows
from silvergrain.session import cut_lineage, ship_package

LEAST, MOST = -(1 << 62), 1 << 62
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)
NODE = ["dims", "node"]
LONGS, DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
SPARK_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", LONGS: "array<long>", DOUBLES: "array<double>"}
#: Points dealt to children, and (with a parent) what the children's points of one block sum up to.
DEALT = pa.schema([("dims", pa.int32()), ("node", pa.int64()), ("parent", pa.int64()), ("label", pa.int64()), ("ids", LONGS),
                   ("vector", LONGS), ("n", pa.int64()), ("norm_least", pa.float64()), ("norm_most", pa.float64()),
                   ("least", DOUBLES), ("most", DOUBLES)])
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high`` bound a negative's score in per cent of the positive's; ``leaf`` points are scored as a whole."""
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    fanout: int = 32
    leaf: int = 4_096
    levels: int = 10
    queries: int = 512


def whole_components(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: usable rows, labels turned where 7 divides the id, components as floor(256 x)."""
    parts = F.col("embedding").cast("array<double>")
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    norm = F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.pow(F.lit(256.0) * F.abs(x) + 1, 2))
    return (vectors.where(vec_id.isNotNull() & label.isNotNull() & parts.isNotNull() & fine & (norm < float(MOST)))
            .select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                    F.transform(parts, lambda x: F.floor(F.lit(256.0) * x)).alias("vector")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of ``width`` whole numbers as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, as doubles."""
    a, b = a.astype(float), b.astype(float)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, exact."""
    x, y = a.astype(float), b.astype(float)
    most = np.sqrt((x * x).sum(1).max(initial=0)) * np.sqrt((y * y).sum(1).max(initial=0))
    return (x @ y.T).astype(np.int64) if most < EXACT / 4 else a @ b.T


def survivors(asked: dict, node: dict) -> np.ndarray:
    """(query, child): whether some window of the query may have answers in the child.

    ``asked``: vectors, low, high. ``node``: points; of each child least and most norm (squared) and,
    for each point, the range of distances.
    """
    a, points = asked["vectors"].astype(float), node["points"]
    norm = (a * a).sum(1)
    to_point = np.sqrt(squares(asked["vectors"], points))
    reach = np.sqrt(norm)[:, None] + np.sqrt((points.astype(float) ** 2).sum(1).max()) + np.sqrt(node["norm_most"])[None, :]
    slack = 1e-6 * (1 + reach)
    alive = np.zeros((len(a), len(node["norm_least"])), bool)
    for w in range(asked["low"].shape[1]):
        low, high = asked["low"][:, w, None].astype(float), asked["high"][:, w, None].astype(float)
        outer = norm[:, None] + node["norm_most"][None, :] - 2 * low
        inner = norm[:, None] + node["norm_least"][None, :] - 2 * high
        some = (low <= high) & (outer >= -slack * reach)
        outer, inner = np.sqrt(np.maximum(outer, 0)) + slack, np.sqrt(np.maximum(inner, 0)) - slack
        for i in range(len(points)):
            d = to_point[:, i, None]
            some &= (node["most"][:, i] >= np.maximum(d - outer, inner - d) - slack) & (node["least"][:, i] <= d + outer + slack)
        alive |= some
    return alive


def best_in(points: dict, asked: dict, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """(query, window, score, id): the first k ids of each window, by score and then id."""
    scores = products(asked["vectors"], points["vectors"])
    fit = (asked["label"][:, None] == points["label"][None, :]) == same
    counts = np.diff(points["starts"])
    found = []
    for w in range(asked["low"].shape[1]):
        inside = fit & (scores >= asked["low"][:, w, None]) & (scores <= asked["high"][:, w, None])
        kept = np.where(inside, scores, LEAST)
        if kept.shape[1] > k + 1:  # the anchor's own point may be one of k + 1
            least = np.partition(kept, kept.shape[1] - k - 1, axis=1)[:, -k - 1, None]
            inside &= scores >= least
        q, c = np.nonzero(inside)
        many = counts[c]
        row = np.repeat(np.arange(len(c)), many)
        at = points["starts"][c][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        q, score, ids = q[row], scores[q, c][row], points["ids"][at]
        other = ids != asked["id"][q]
        q, score, ids = q[other], score[other], ids[other]
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        found.append((q[first], np.full(first.sum(), w), score[first], ids[first]))
    return tuple(map(np.concatenate, zip(*found)))


def _blocks(rows: DataFrame, of: list[str], size: int, name: str) -> DataFrame:
    """One row per node: how many blocks of about ``size`` rows it has."""
    return rows.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def _spread(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


class Tree:
    """``leaves``: points with their leaf; ``levels``: one table of inner nodes for each level."""

    def __init__(self, points: DataFrame, settings: Settings):
        self.settings, self.levels, leaves = settings, [], []
        rows = cut_lineage(points.withColumn("node", F.lit(0).cast("long")))
        sizes = cut_lineage(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")))
        for level in range(settings.levels):
            large = sizes.where(F.col("n") > settings.leaf)
            if large.isEmpty():
                break
            leaves.append(rows.join(large.select(*NODE), NODE, "left_anti"))
            rows, sizes = self._split(rows.join(large, NODE), level)
        self.leaves = rows
        for part in leaves:
            self.leaves = self.leaves.unionByName(part)
        self.blocks = cut_lineage(_blocks(self.leaves, NODE, settings.leaf, "blocks"))

    def _split(self, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Deals the rows of all nodes to children and keeps the nodes' split points and ranges."""
        fanout, blocks = self.settings.fanout, F.ceil(F.col("n") / self.settings.leaf).cast("int")
        spot = F.xxhash64("vector", F.lit(level))
        chosen = top_rows(rows.withColumn("spot", spot), NODE, fanout, F.col("spot"), F.col("label"))
        points = cut_lineage(chosen.groupBy(*NODE, "n").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "vector"))), lambda p: p["vector"]).alias("points")))
        left = rows.withColumn("block", F.pmod(F.xxhash64("vector", "label"), blocks).cast("int"))
        right = points.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

        def divide(own: pa.Table, node: pa.Table) -> pa.Table:
            if not own.num_rows:
                return DEALT.empty_table()
            dims = node["dims"][0].as_py()
            at = matrix(pa.chunked_array([node["points"].combine_chunks().flatten()]), dims)
            x = matrix(own["vector"], dims)
            square = squares(x, at)
            child = square.argmin(1)
            names, start = np.unique(child, return_inverse=True)
            distance, norm = np.sqrt(square), (x.astype(float) ** 2).sum(1)
            parent = node["node"][0].as_py()
            below = parent * fanout + 1 + child
            low = np.stack([distance[start == j].min(0) for j in range(len(names))])
            high = np.stack([distance[start == j].max(0) for j in range(len(names))])
            count = len(x) + len(names)
            none = lambda n, kind: pa.nulls(n, kind)
            long, ranges = pa.int64(), DOUBLES
            join = lambda a, b: pa.chunked_array([a, b]).combine_chunks()
            rows_of = lambda m: pa.array(list(m), ranges)
            return pa.table({
                "dims": pa.array(np.full(count, dims, np.int32)),
                "node": join(pa.array(below), pa.array(parent * fanout + 1 + names)),
                "parent": join(none(len(x), long), pa.array(np.full(len(names), parent))),
                "label": join(own["label"].combine_chunks(), none(len(names), long)),
                "ids": join(own["ids"].combine_chunks(), none(len(names), own["ids"].type)),
                "vector": join(own["vector"].combine_chunks(), none(len(names), own["vector"].type)),
                "n": join(none(len(x), long), pa.array(np.bincount(start))),
                "norm_least": join(none(len(x), pa.float64()), pa.array([norm[start == j].min() for j in range(len(names))])),
                "norm_most": join(none(len(x), pa.float64()), pa.array([norm[start == j].max() for j in range(len(names))])),
                "least": join(none(len(x), ranges), rows_of(low)), "most": join(none(len(x), ranges), rows_of(high))},
                schema=DEALT)

        dealt = cut_lineage(left.groupBy(*NODE, "block").cogroup(right.groupBy(*NODE, "block")).applyInArrow(
            divide, ", ".join(f"{f.name} {SPARK_TYPES[f.type]}" for f in DEALT)))
        seen = dealt.where("parent IS NOT NULL")
        child = seen.groupBy("dims", "parent", "node").agg(
            F.sum("n").alias("n"), F.min("norm_least").alias("norm_least"), F.max("norm_most").alias("norm_most"))
        ranges = (seen.select("dims", "parent", "node", F.posexplode(F.arrays_zip("least", "most")).alias("at", "range"))
                  .groupBy("dims", "parent", "node", "at").agg(F.min("range.least").alias("least"), F.max("range.most").alias("most"))
                  .groupBy("dims", "parent", "node").agg(F.array_sort(F.collect_list(F.struct("at", "least", "most"))).alias("ranges")))
        children = cut_lineage(child.join(ranges, ["dims", "parent", "node"]))
        of_node = (children.groupBy("dims", "parent")
                   .agg(F.collect_list(F.struct("node", "norm_least", "norm_most", "ranges")).alias("children"))
                   .withColumnRenamed("parent", "node"))
        self.levels.append(cut_lineage(points.drop("n").join(of_node, NODE)))
        # A child as large as its node can't be split: its vectors are all alike, but for labels.
        whole = points.select("dims", F.col("node").alias("parent"), F.col("n").alias("of"))
        sizes = cut_lineage(children.join(whole, ["dims", "parent"])
                            .select("dims", "node", F.when(F.col("n") < F.col("of"), F.col("n")).otherwise(0).alias("n")))
        return dealt.where("parent IS NULL").select("dims", "node", "label", "ids", "vector"), sizes

    def visits(self, asked: DataFrame) -> DataFrame:
        """``asked`` with every leaf (``node``) that may hold answers."""
        size, found = self.settings.queries, []
        pairs = asked.withColumn("node", F.lit(0).cast("long"))
        fields = asked.columns
        for level in self.levels:
            pairs = cut_lineage(pairs)
            inner = level.select(*NODE)
            found.append(pairs.join(inner, NODE, "left_anti"))
            parts = _blocks(pairs.join(inner, NODE), NODE, size, "parts")
            left = pairs.join(parts, NODE).withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int")).drop("parts")
            right = level.join(parts, NODE).withColumn("part", _spread("parts")).drop("parts")

            def descend(own: pa.Table, node: pa.Table) -> pa.Table:
                if not own.num_rows or not node.num_rows:
                    return own.drop_columns(["part"]).slice(0, 0)
                dims = own["dims"][0].as_py()
                kids = node["children"].combine_chunks().flatten()
                ranges = kids.field("ranges").flatten()
                shape = (len(kids), -1)
                here = {"points": matrix(pa.chunked_array([node["points"].combine_chunks().flatten()]), dims),
                        "norm_least": kids.field("norm_least").to_numpy(), "norm_most": kids.field("norm_most").to_numpy(),
                        "least": ranges.field("least").to_numpy().reshape(shape), "most": ranges.field("most").to_numpy().reshape(shape)}
                alive = survivors(questions(own), here)
                q, c = np.nonzero(alive)
                kept = own.drop_columns(["part"]).take(pa.array(q))
                at = kept.column_names.index("node")
                return kept.set_column(at, "node", kids.field("node").take(pa.array(c)))

            pairs = left.groupBy(*NODE, "part").cogroup(right.groupBy(*NODE, "part")).applyInArrow(
                descend, ", ".join(f"{c} {t}" for c, t in left.drop("part").dtypes))
            pairs = pairs.select(*fields, "node")
        for part in found:
            pairs = pairs.unionByName(part.select(*fields, "node"))
        return pairs

    def scored(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """``q, w, score, vec_id``: of each block of each visited leaf, the first k rows for each window."""
        visits = cut_lineage(visits)
        parts = _blocks(visits, NODE, self.settings.queries, "parts").join(self.blocks, NODE)
        left = (self.leaves.join(parts, NODE).withColumn("block", F.pmod(F.xxhash64("vector", "label"), "blocks").cast("int"))
                .withColumn("part", _spread("parts")).drop("parts", "blocks"))
        right = (visits.join(parts, NODE).withColumn("part", F.pmod(F.xxhash64("q"), "parts").cast("int"))
                 .withColumn("block", _spread("blocks")).drop("parts", "blocks"))
        keys = [*NODE, "block", "part"]

        def score(own: pa.Table, asking: pa.Table) -> pa.Table:
            schema = pa.schema([("q", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
            if not own.num_rows or not asking.num_rows:
                return schema.empty_table()
            ids = own["ids"].combine_chunks()
            points = {"vectors": matrix(own["vector"], own["dims"][0].as_py()), "label": own["label"].to_numpy(),
                      "ids": ids.flatten().to_numpy(), "starts": np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])}
            asked = questions(asking)
            q, w, found, vec_id = best_in(points, asked, same, k)
            return pa.table([pa.array(asked["q"][q]), pa.array(w.astype(np.int32)), pa.array(found), pa.array(vec_id)], schema=schema)

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "q long, w int, score long, vec_id long")

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """``q, w, rank, score, vec_id``: the first k rows of each window of scores, of the same or of other labels."""
        order = (F.desc("score"), F.col("vec_id"))
        near = cut_lineage(top_rows(self.scored(asked.withColumn("node", F.col("home")), same, k), ["q", "w"], k, *order))
        bound = (near.where(F.col("rank") == k).groupBy("q")
                 .agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bound")))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("bound", i), x)))
        narrowed = asked.join(bound, "q", "left").withColumn("low", F.when(F.col("bound").isNull(), F.col("low")).otherwise(raised))
        away = self.visits(narrowed.select(*asked.columns)).where(F.col("node") != F.col("home"))
        both = near.drop("rank").unionByName(self.scored(away, same, k))
        return cut_lineage(top_rows(both, ["q", "w"], k, *order))


def questions(table: pa.Table) -> dict:
    """Arrays of the columns that a search asks with."""
    width = len(table["low"][0]) if table.num_rows else 0
    return {"q": table["q"].to_numpy(), "id": table["id"].to_numpy(), "label": table["label"].to_numpy(),
            "vectors": matrix(table["vector"], len(table["vector"][0])),
            "low": matrix(table["low"], width), "high": matrix(table["high"], width)}


def per_cent(score: Column, of: int, up: bool) -> Column:
    """``of`` per cent of a whole number that isn't negative, rounded up or down without leaving 64 bits."""
    rest = F.pmod(score, F.lit(100))
    more = F.call_function("div", rest * of + (99 if up else 0), F.lit(100))
    return F.call_function("div", score - rest, F.lit(100)) * of + more


def hard_negatives(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of rows ``vec_id, label, vector``.

    ``vector`` holds whole numbers; ``is_anchor`` tells the anchors.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = cut_lineage(vectors.select("vec_id", "label", "vector"))
    most = max(settings.positives, settings.negatives) + 1
    place = F.dense_rank().over(Window.partitionBy("vector", "label").orderBy("vec_id"))
    points = (rows.withColumn("place", place).where(F.col("place") <= most).groupBy("vector", "label")
              .agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("dims", F.size("vector"))
              .where(F.col("dims") > 0).select("dims", "label", "ids", "vector"))
    anchors = rows.where(is_anchor).distinct()
    if anchors.isEmpty() or rows.isEmpty():
        return spark.createDataFrame([], RESULT)
    tree = Tree(points, settings)
    homes = tree.leaves.select(F.col("node").alias("home"), "dims", "vector", "label")
    anchors = cut_lineage(anchors.join(homes, ["vector", "label"]).withColumn("q", F.monotonically_increasing_id()))
    window = lambda low, high: (F.array(F.lit(low).cast("long")).alias("low"), F.array(F.lit(high).cast("long")).alias("high"))
    fields = ("q", F.col("vec_id").alias("id"), "label", "home", "dims", "vector")
    positives = tree.search(anchors.select(*fields, *window(LEAST, MOST)), True, settings.positives)
    positives = positives.select("q", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score"))
    scores = positives.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "positive_score"))).alias("scores"))
    each = F.sequence(F.lit(0), F.lit(settings.positives - 1))
    score_of = lambda i: F.try_element_at("scores", i)
    usable = lambda i: F.coalesce(score_of(i) >= 0, F.lit(False))
    low = F.transform(each, lambda i: F.when(usable(i), per_cent(score_of(i), settings.low, True)).otherwise(F.lit(1).cast("long")))
    high = F.transform(each, lambda i: F.when(usable(i), per_cent(score_of(i), settings.high, False)).otherwise(F.lit(0).cast("long")))
    asked = cut_lineage(anchors.join(scores, "q").select(*fields, low.alias("low"), high.alias("high")))
    negatives = tree.search(asked, False, settings.negatives)
    named = anchors.select("q", F.col("vec_id").alias("anchor_id"))
    return (negatives.join(positives, ["q", "w"]).join(named, "q")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
