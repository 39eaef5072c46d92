"""Near-duplicate documents by MinHash with tensored banding, every link confirmed.

A document is its set of distinct five-word shingles. Documents with one and the
same set are one node. Two small collections of MinHash tuples are computed for
each node; a table is a pair of one tuple of each, so that n + n tuples give n * n
tables. Nodes that agree in a table are candidates. A tuple that no other node
has can't be part of an agreement, so only tuples that occur twice are paired.

Two sets with similarity s share no table with probability of about
2 * (1 - s^2)^14: 2e-5 at the limit of 0.75, 2e-6 at 0.8.

Inside a table, candidates are not paired off. Nodes are first checked
against their tables' leaders, the smallest nodes, on the full sets; links join components. What
then still lies apart in some table is searched exactly: two sets that are
similar enough share one of the shingles that stand first in them, when all are
ordered from rare to common. Rows of a shared shingle that stand too late in
their sets for any partner go before rows are paired, so a passage or a template
that thousands share pairs none of them where all lie too far apart. Pairs inside one
component can't change the result and are left out.

Missing or wordless text has an empty set and is linked with nothing. Rows that
repeat a doc_id with one set are one document; rows that give a doc_id different
sets are different documents, each linked and kept by its own set. Components
are called by their smallest doc_id, so only such rows may give two components
one name. A row without doc_id is linked with nothing and kept. An empty table gives an empty result. Further columns are
left out.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from silvergrain.llm.common import by_batch, hold, record, texts
from silvergrain.llm.components import components
from silvergrain.session import cut_lineage

SHINGLE = 5
#: Tuples in each of the two collections, and hashes in a tuple.
TUPLES, WIDTH = 14, 2
#: Tables in which a node must meet a leader to be checked with it at first; similar sets meet in dozens.
MEETINGS = 4
#: Links need 100 * intersection >= LEAST * union.
LEAST = 75
#: Up to so many ids (of 8 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Shingles whose hashes are computed together.
CHUNK = 16_384

_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(1, 1 << 63, 2 * TUPLES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, 2 * TUPLES * WIDTH, dtype=np.uint64)
PLACES = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only; ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += mix(hashes[k:k + n] * PLACES[k])
    return np.unique(mix(total))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the smallest value under each hash function; sets must not be empty."""
    out = np.full((len(sets), len(FACTORS)), np.iinfo(np.uint64).max, np.uint64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(flat), CHUNK):
        values = flat[at:at + CHUNK, None] * FACTORS + TERMS
        own = owner[at:at + CHUNK]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        np.minimum.at(out, own[starts], np.minimum.reduceat(values, starts, axis=0))
    return out


def tuple_keys(smallest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the two collections of tuples."""
    parts = smallest.reshape(len(smallest), 2, TUPLES, WIDTH)
    keys = np.zeros(parts.shape[:3], np.uint64)
    for k in range(WIDTH):
        keys = mix(keys ^ parts[..., k])
    return keys[:, 0].astype(np.int64), keys[:, 1].astype(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    def sign(batches):
        hold(None)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            some = [i for i, s in enumerate(sets) if len(s)]
            left = right = np.zeros((0, TUPLES), np.int64)
            if some:
                left, right = tuple_keys(minhashes([sets[i] for i in some]))
            a, b = [None] * len(sets), [None] * len(sets)
            for n, i in enumerate(some):
                a[i], b[i] = left[n], right[n]
            keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield record(doc_id=batch.column(0), n_shingles=([len(s) for s in sets], pa.int64()), set_key=(keys, pa.binary()),
                         a=(a, pa.list_(pa.int64())), b=(b, pa.list_(pa.int64())))

    return by_batch(texts(docs), sign, "doc_id long, n_shingles long, set_key binary, a array<long>, b array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    def cut(batches):
        hold(None)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            yield record(doc_id=batch.column(0), set_key=([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                         shingles=([s.astype(np.int64) for s in sets], pa.list_(pa.int64())))

    return by_batch(docs, cut, "doc_id long, set_key binary, shingles array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with the key of their set in ``_set_key``, empty for an empty set."""
    at = docs.columns.index("text")

    def key(batches):
        hold(None)
        for batch in batches:
            sets = [shingles(t.as_py() or "") for t in batch.column(at)]
            keys = pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "_set_key"])

    return by_batch(docs, key, StructType([*docs.schema.fields, StructField("_set_key", BinaryType())]))


def _shared(nodes: DataFrame, side: str) -> DataFrame:
    """``node, i, key`` of the tuples that at least two nodes have."""
    rows = nodes.select("node", F.posexplode(side).alias(f"i_{side}", f"key_{side}"))
    twice = rows.groupBy(f"i_{side}", f"key_{side}").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(twice, [f"i_{side}", f"key_{side}"])


def _tables(nodes: DataFrame) -> DataFrame:
    """``node, bucket`` for each table in which a node has company."""
    both = _shared(nodes, "a").join(_shared(nodes, "b"), "node")
    rows = cut_lineage(both.select("node", F.xxhash64("i_a", "i_b", "key_a", "key_b").alias("bucket")))
    live = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return cut_lineage(rows.join(live, "bucket").select("node", "bucket"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``x, y`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("of_x"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("of_y"))
    common, total = F.size(F.array_intersect("of_x", "of_y")), F.size("of_x") + F.size("of_y")
    return pairs.join(left, "x").join(right, "y").where(100 * common >= LEAST * (total - common)).select("x", "y")


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds each node's component; one without links is its own."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def _leader_pairs(tables: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes with the smallest node of their tables, where they meet often and their sizes allow a link."""
    leaders = tables.groupBy("bucket").agg(F.min("node").alias("leader"))
    pairs = (tables.join(leaders, "bucket").where("node <> leader").groupBy(*_ordered("node", "leader"))
             .agg(F.count(F.lit(1)).alias("tables")).where(F.col("tables") >= MEETINGS))
    of_x = lengths.select(F.col("node").alias("x"), F.col("n_shingles").alias("n_x"))
    of_y = lengths.select(F.col("node").alias("y"), F.col("n_shingles").alias("n_y"))
    return (pairs.join(of_x, "x").join(of_y, "y")
            .where(f"100 * least(n_x, n_y) >= {LEAST} * greatest(n_x, n_y)").select("x", "y"))


def _first_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``shingle, node, label, n, rank`` of the shingles that stand first in the sets of ``node, label``: an exact prefix filter.

    Of n shingles, a similar set must hold one of the first n - ceil(0.75 n) + 1,
    in any order common to all, and from the first common one on there must be
    enough left in both. The order is by the number of sets that hold a shingle.
    A shingle whose sets all lie in one component is dropped.
    """
    rows = cut_lineage(nodes.join(sets, "node").select(
        "node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("label") != F.max("label")).alias("torn"))
    shared = rows.join(common.where("df > 1"), "shingle")
    own = Window.partitionBy("node")  # one document's shingles
    placed = (shared.withColumn("rare", F.col("n") - F.count(F.lit(1)).over(own))
              .withColumn("rank", F.col("rare") + F.row_number().over(own.orderBy("df", "shingle"))))
    return cut_lineage(placed.where(f"torn AND rank <= n - ceil({LEAST} * n / 100) + 1").select("shingle", "node", "label", "n", "rank"))


NEAR = (f"label <> of_other AND 100 * least(n, n_other) >= {LEAST} * greatest(n, n_other)"
        " AND n_other <= most AND n <= most_other")


def _others(live: DataFrame) -> DataFrame:
    return live.select("shingle", F.col("node").alias("other"), F.col("label").alias("of_other"), F.col("n").alias("n_other"),
                       F.col("most").alias("most_other"))


def _central_pairs(first: DataFrame) -> DataFrame:
    """Pairs of rows outside a shingle's largest component with one of its rows, the one with the most room for partners.

    That is the text with the fewest shingles of its own, which many are close to. One
    pair a row; what they link needs no further search in :func:`_apart_pairs`.
    """
    live = _prospects(first)
    centre = (live.where("label = main").groupBy("shingle")
              .agg(F.max(F.struct(F.expr("most - n").alias("room"), "node", "label", "n", "most")).alias("c"))
              .select("shingle", "c.node", "c.label", "c.n", "c.most"))
    return live.where("label <> main").join(_others(centre), "shingle").where(NEAR).select(*_ordered("node", "other")).distinct()


def _apart_pairs(first: DataFrame) -> DataFrame:
    """Candidate pairs in different components; where most sets of a shingle lie in one, only the others look for partners."""
    live = _prospects(first)
    return live.where("label <> main").join(_others(live), "shingle").where(NEAR).select(*_ordered("node", "other")).distinct()


def _prospects(first: DataFrame) -> DataFrame:
    """The rows ``shingle, node, label, n, rank`` that may have a partner, with ``main``, their shingle's largest component.

    If the shingle at ``rank`` is the first in common, the sets share at most
    1 + n - rank shingles, so a partner has at most ``most`` of them. Of two
    partners the smaller one's ``most`` reaches the larger one's size, and with
    it its own: a row for which it doesn't needs a smaller partner for which it
    does. So a template whose texts are all too far apart leaves no row.
    """
    first = first.withColumn("most", F.expr(f"({100 + LEAST} * (1 + n - rank)) div {LEAST} - n"))
    able = F.col("most") >= F.col("n")
    main = (first.groupBy("shingle", "label")
            .agg(F.count(F.lit(1)).alias("size"), F.min(F.when(able, F.col("n"))).alias("least_n"),
                 F.max(F.when(able, F.col("most"))).alias("reach"))
            .groupBy("shingle")
            .agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"),
                 F.min("least_n").alias("least_n"), F.max("reach").alias("reach"))
            .where("labels > 1 AND least_n IS NOT NULL").drop("labels"))
    return (first.join(main, "shingle").where("most >= n OR (most >= least_n AND n <= reach)")
            .select("shingle", "node", "label", "n", "most", "main"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links between nodes."""
    ends = (links.join(labels.select(F.col("node").alias("x"), F.col("label").alias("l_x")), "x", "left")
            .join(labels.select(F.col("node").alias("y"), F.col("label").alias("l_y")), "y", "left")
            .select(F.coalesce("l_x", "x").alias("u"), F.coalesce("l_y", "y").alias("v")))
    found = components(ends)
    moved = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut_lineage(old.union(found.join(labels.select("node"), "node", "left_anti")))


def _judged(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, component_id, kept`` for every document."""
    rows = texts(docs)
    signed = cut_lineage(_signatures(rows))
    known = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("a").alias("a"),
                                         F.first("b").alias("b"), F.first("n_shingles").alias("n_shingles"))
    # a number of its own for each set, as a doc_id may stand for several; fixed by being written
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    tables = _tables(nodes)
    wanted = cut_lineage(tables.select("node").distinct())
    keys = nodes.select("node", "doc_id", "set_key").join(wanted, "node", "left_semi")
    ids = cut_lineage(keys.select("doc_id").distinct())
    few = ids.count() <= BROADCAST_IDS
    chosen = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = cut_lineage(_sets(chosen).join(keys, ["doc_id", "set_key"])
                       .dropDuplicates(["node"]).select("node", "shingles"))
    tested = cut_lineage(_leader_pairs(tables, nodes.select("node", "n_shingles")))
    labels = components(_confirmed(tested, sets).select(F.col("x").alias("u"), F.col("y").alias("v")))
    labelled = cut_lineage(_with_labels(tables, labels))
    torn = labelled.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("torn")).where("torn")
    apart = cut_lineage(labelled.join(torn, "bucket", "left_semi").select("node", "label").distinct())
    first = _first_shingles(apart, sets)
    central = cut_lineage(_central_pairs(first).join(tested, ["x", "y"], "left_anti"))
    labels = _joined(labels, _confirmed(central, sets))
    first = cut_lineage(_with_labels(first.drop("label"), labels))
    pairs = cut_lineage(_apart_pairs(first).join(tested.union(central), ["x", "y"], "left_anti"))
    labels = _joined(labels, _confirmed(pairs, sets))
    one = F.struct("doc_id", "set_key")
    firsts = nodes.select("node", one.alias("one")).join(labels, "node").groupBy("label").agg(F.min("one").alias("first"))
    of_node = labels.join(firsts, "label").select("node", "first")
    of_set = (nodes.select("node", "set_key", one.alias("one")).join(of_node, "node", "left")
              .select("set_key", F.coalesce("first", "one").alias("first")))
    linked = F.col("doc_id").isNotNull() & F.col("first").isNotNull()
    return (signed.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
            .select("doc_id", "n_shingles", "set_key",
                    F.when(linked, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    (~linked | ((F.col("doc_id") == F.col("first.doc_id"))
                                & (F.col("set_key") == F.col("first.set_key")))).alias("kept")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents themselves, one of each group; of rows with one doc_id and set one stays."""
    judged = cut_lineage(_judged(docs).where("doc_id IS NOT NULL")
                         .groupBy("doc_id", F.coalesce("set_key", F.lit(b"")).alias("_set_key"))
                         .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")))
    kept = cut_lineage(judged.groupBy("doc_id").agg(F.max("_kept").alias("_kept"), F.sum("_rows").alias("_rows"))
                       .where("_kept"))
    few = kept.count() <= BROADCAST_IDS
    once = kept.where("_rows = 1").select("doc_id")
    more = kept.where("_rows > 1").select("doc_id")
    single = docs.join(F.broadcast(once) if few else once, "doc_id", "left_semi")
    several = (_keyed(docs.join(F.broadcast(more) if few else more, "doc_id", "left_semi"))
               .join(judged.where("_kept").select("doc_id", "_set_key"), ["doc_id", "_set_key"], "left_semi")
               .dropDuplicates(["doc_id", "_set_key"]).drop("_set_key"))
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL"))
