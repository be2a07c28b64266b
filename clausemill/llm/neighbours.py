"""Approximate nearest neighbours by NN-descent, nearness being the largest inner product.

Equal vectors form one node, numbered by its smallest id, that keeps its ``TOP + 1`` smallest ids, more than any result can
hold.  A first graph comes from leaves of random hyperplane trees, each leaf of bounded size
compared within itself.  NN-descent then joins neighbours of neighbours: for each node its
neighbours and a bounded number of reverse neighbours meet, and each learns of the others
that are nearer than its worst, until hardly a neighbour changes.  A query starts from its
node's neighbours and goes on greedily to neighbours of the best found, until it has gone on
from all of its best.  Descent can settle short of the nearest, and the more the larger the
table.  So a bounded sample of queries is compared with all nodes, and queries visit the leaves
nearest to them of further trees until the sample's recall is TARGET, or until BATCHES batches of trees are
spent; the recall that was measured is a column of the result.  Recall counts scores, not ids:
whatever is as near as the last of the true nearest is found.  Results are scored anew in double
precision.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, free_shuffles, save

TOP, QUERY_MODULO = 20, 20
#: Neighbours in the graph, trees and rows of a leaf of the first graph.
NEIGHBOURS, TREES, LEAF = 30, 8, 400
#: Descent ends once a round changes at most this share of neighbours; a query ends once it
#: has gone on from each of its BEAM best.
CHANGED, BEAM = 0.01, 40
#: Share of the nearest that must be found for SAMPLE queries compared with all nodes.
TARGET, SAMPLE = 0.95, 200
#: Most batches of further trees, and how much nearer (in relation) single precision may put a node.
BATCHES, ROUNDING = 16, 1e-5
#: Leaves of a further tree that a query visits, and planes near it that it may cross to them.
PROBES, NEAR_PLANES = 16, 6
SEED = 11


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double array) of rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    big = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", v.alias("v")).filter(F.coalesce(sound, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return rows.filter(F.size("v") == (usual["size"] if usual else 0))


def _pack(batches):
    for batch in batches:
        rows = [np.array(x, np.float32).tobytes() for x in batch.column("v").to_pylist()]
        yield batch.append_column("x", pa.array(rows, pa.binary()))


def _matrix(column) -> np.ndarray:
    rows = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _leaves(planes: list[tuple[np.ndarray, np.ndarray]], most: int):
    """A node's leaf in each tree: the sides of the tree's hyperplanes that it lies on."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m, out = _matrix(batch.column("x")), []
            for t, (normal, middle) in enumerate(planes):
                side = (m @ normal > middle) @ (1 << np.arange(normal.shape[1])) if normal.shape[1] else np.zeros(len(m), np.int64)
                out.append(batch.append_column("tree", pa.array(np.full(len(m), t, np.int32))).append_column("leaf", pa.array(side.astype(np.int64))))
            yield from out

    return run


def _visits(planes: list[tuple[np.ndarray, np.ndarray]], probes: int):
    """A query's leaf in each tree, and those nearest to it beyond the hyperplanes that it lies closest to."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("x"))
            for t, (normal, middle) in enumerate(planes):
                margin = m @ normal - middle
                bits = 1 << np.arange(normal.shape[1])
                near = np.argsort(np.abs(margin), axis=1)[:, :NEAR_PLANES]
                # which of the nearest planes are crossed, in all ways
                ways = (np.arange(1 << near.shape[1])[:, None] >> np.arange(near.shape[1])) & 1
                cost, flips = np.take_along_axis(margin**2, near, 1) @ ways.T, bits[near] @ ways.T
                cheap = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                leaves = ((margin > 0) @ bits)[:, None] ^ np.take_along_axis(flips, cheap, 1)
                rows = batch.take(pa.array(np.repeat(np.arange(len(m)), leaves.shape[1])))
                yield rows.append_column("tree", pa.array(np.full(rows.num_rows, t, np.int32))).append_column("leaf", pa.array(leaves.ravel().astype(np.int64)))

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best, of repeated ids one."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], scores[order]


def _groups(batches, keys: list[str], columns: list[str]):
    """Column lists of each run of equal keys in sorted rows."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in [*keys, *columns]))

    for _, group in groupby(rows(), key=lambda r: r[: len(keys)]):
        yield [list(c) for c in zip(*group)][len(keys) :]


def _lists(rows):
    nodes, ids, scores = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32()))],
        ["node", "ids", "scores"],
    )


_LISTS = "node long, ids array<bigint>, scores array<float>"


def _leaf_join(k: int):
    """The k best in its leaf for each node that is asked for."""

    def run(batches):
        for nodes, xs, asked in _groups(batches, ["tree", "leaf", "part"], ["node", "x", "asked"]):
            m, ids, of = _matrix(xs), np.array(nodes), np.flatnonzero(asked)
            take = min(k, len(ids) - 1)
            if take and len(of):
                s = m[of] @ m.T
                s[np.arange(len(of)), of] = -np.inf
                near = np.argpartition(-s, take - 1, axis=1)[:, :take]
                yield _lists([(int(i), ids[n].tolist(), s[r, n].tolist()) for r, (i, n) in enumerate(zip(ids[of], near))])

    return run


def _visit_join(k: int):
    """The k best nodes of a leaf for each query that visits it, of those nearer than its worst."""

    def run(batches):
        for nodes, xs, worst in _groups(batches, ["tree", "leaf", "part"], ["node", "x", "worst"]):
            m, ids = _matrix(xs), np.array(nodes)
            of = np.array([w is not None for w in worst])
            if not of.any() or of.all():
                continue
            s, own = m[of] @ m[~of].T, ids[~of]
            better = (s > np.array([w for w in worst if w is not None], np.float32)[:, None]) & (own != ids[of][:, None])
            out = []
            for r in np.flatnonzero(better.any(1)):
                n = np.flatnonzero(better[r])
                if len(n) > k:
                    n = n[np.argpartition(-s[r, n], k - 1)[:k]]
                out.append((int(ids[of][r]), own[n].tolist(), s[r, n].tolist()))
            yield _lists(out)

    return run


def _merge(k: int):
    """The best k of all lists of a node, best first, and how many of them it didn't know."""

    def run(batches):
        for batch in batches:
            out, fresh = [], []
            for node, ids, scores, known in zip(*(batch.column(c).to_pylist() for c in ("node", "ids", "scores", "known"))):
                i, s = _best(np.array(ids, np.int64), np.array(scores, np.float32), k)
                i = i.tolist()
                out.append((node, i, s.tolist()))
                fresh.append(len(set(i).difference(known)))
            yield _lists(out).append_column("fresh", pa.array(fresh, pa.int32()))

    return run


def _merged(lists: DataFrame, k: int, graph: DataFrame | None = None) -> DataFrame:
    """(node, ids, scores, fresh) of new lists and those of a graph."""
    lists = lists.withColumn("known", F.array().cast("array<bigint>"))
    if graph is not None:
        lists = graph.select("node", "ids", "scores", F.col("ids").alias("known")).unionByName(lists)
    grouped = lists.groupBy("node").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "scores", "known")))
    return grouped.mapInArrow(_merge(k), _LISTS + ", fresh int")


def _local_join(k: int):
    """All that meet at a centre learn of those that are nearer than their worst."""

    def run(batches):
        out = []
        for nodes, worst, xs in _groups(batches, ["centre"], ["node", "worst", "x"]):
            m, ids = _matrix(xs), np.array(nodes)
            s = m @ m.T
            np.fill_diagonal(s, -np.inf)
            better = s > np.array(worst, np.float32)[:, None]
            for r in np.flatnonzero(better.any(1)):
                n = np.flatnonzero(better[r])
                if len(n) > k:
                    n = n[np.argpartition(-s[r, n], k - 1)[:k]]
                out.append((int(ids[r]), ids[n].tolist(), s[r, n].tolist()))
            if len(out) > 20_000:
                yield _lists(out)
                out = []
        yield _lists(out)

    return run


def _worst(k: int):
    return F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")


def _planes(nodes: DataFrame, n: int, trees: int, leaf: int, batch: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hyperplanes of each tree of a batch."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    rng = np.random.default_rng([SEED, batch])
    # a bounded sample places the hyperplanes; it affects balance alone
    drawn = nodes.select("x").orderBy(F.xxhash64("x"), "x").limit(2000).toArrow()["x"].to_pylist()
    m = _matrix(drawn)
    planes = []
    for _ in range(trees if bits else 1):
        normal = rng.standard_normal((m.shape[1], bits)).astype(np.float32)
        planes.append((normal, np.median(m @ normal, axis=0)))
    return planes


def tree_lists(nodes: DataFrame, n: int, k: int, trees: int, leaf: int, batch: int = 0) -> DataFrame:
    """(node, ids, scores), saved: near nodes in the leaves of a batch of random trees, of the
    nodes of (node, x, asked) that are asked for."""
    planes = _planes(nodes, n, trees, leaf, batch)
    dealt = nodes.select("node", "x", "asked").mapInArrow(_leaves(planes, leaf), "node long, x binary, asked boolean, tree int, leaf long")
    dealt = save(dealt)
    # Spark broadcasts the sizes, trees * 2^bits rows, where they are small enough
    sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("parts"))
    dealt2 = dealt.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")).cast("int"))
    key = ["tree", "leaf", "part"]
    lists = save(dealt2.repartition(*key).sortWithinPartitions(*key).select(*key, "node", "x", "asked").mapInArrow(_leaf_join(k), _LISTS))
    drop_saved(dealt)
    return lists


def visit_lists(nodes: DataFrame, n: int, queries: DataFrame, k: int, trees: int, leaf: int, batch: int, probes: int = PROBES) -> DataFrame:
    """(node, ids, scores), saved: for queries (q, x, worst) the nodes nearer than their worst in the
    ``probes`` leaves of each tree of a batch that they lie nearest to."""
    planes = _planes(nodes, n, trees, leaf, batch)
    dealt = save(nodes.select("node", "x").mapInArrow(_leaves(planes, leaf), "node long, x binary, tree int, leaf long"))
    visits = queries.select(F.col("q").alias("node"), "x", "worst").mapInArrow(_visits(planes, probes), "node long, x binary, worst float, tree int, leaf long")
    # Spark broadcasts the sizes, trees * 2^bits rows, where they are small enough
    sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("parts"))
    both = dealt.withColumn("worst", F.lit(None).cast("float")).unionByName(visits).join(sizes, ["tree", "leaf"])
    # nodes and visits of a crowded leaf are dealt over its parts
    key = ["tree", "leaf", "part"]
    both = both.withColumn("part", F.pmod(F.xxhash64("node", "tree", "leaf"), F.col("parts")).cast("int")).select(*key, "node", "x", "worst")
    lists = save(both.repartition(*key).sortWithinPartitions(*key).mapInArrow(_visit_join(k), _LISTS))
    drop_saved(dealt)
    return lists


def build_graph(nodes: DataFrame, n: int, k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, changed: float = CHANGED) -> DataFrame:
    """(node, ids, scores, fresh) of (node, x): k near nodes each, best first."""
    lists = tree_lists(nodes.withColumn("asked", F.lit(True)), n, k, trees, leaf)
    graph = save(_merged(lists, k))
    drop_saved(lists)
    share = 1.0
    while share > changed:
        free_shuffles(nodes.sparkSession)
        edges = graph.select(F.col("node").alias("centre"), F.posexplode("ids").alias("place", "member"))
        back = Window.partitionBy("centre").orderBy("place", "member")
        reverse = edges.select(F.col("member").alias("centre"), "place", F.col("centre").alias("member")).withColumn("rn", F.row_number().over(back)).filter(F.col("rn") <= k)
        meet = edges.select("centre", "member").unionByName(reverse.select("centre", "member")).distinct()
        known = graph.select("node", _worst(k).alias("worst")).join(nodes.select("node", "x"), "node")
        meet = meet.join(known, meet["member"] == known["node"]).select("centre", "node", "worst", "x")
        learnt = meet.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join(k), _LISTS)
        new = save(_merged(learnt, k, graph))
        drop_saved(graph)
        graph = new
        share = graph.agg(F.sum("fresh") / F.sum(F.size("ids"))).first()[0] or 0.0
    return graph


def _score_pairs(batches):
    for batch in batches:
        if batch.num_rows:
            s = (_matrix(batch.column("qx")) * _matrix(batch.column("x"))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(s, pa.float32())], ["q", "node", "score"])


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM, keep: int = 64) -> DataFrame:
    """(q, node, score): nodes found near to each query node, by greedy search from its neighbours
    until each of its ``beam`` best has been gone on from."""
    found = graph.join(queries, graph["node"] == queries["q"], "left_semi").select(F.col("node").alias("q"), F.inline(F.arrays_zip("ids", "scores"))).toDF("q", "node", "score")
    found = save(found.withColumn("gone_on", F.lit(False)))
    vectors = nodes.select("node", "x")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "node")
    while True:
        go = save(found.withColumn("rn", F.row_number().over(best)).filter((F.col("rn") <= beam) & ~F.col("gone_on")).select("q", "node"))
        if go.isEmpty():
            break
        reached = go.join(graph.select("node", "ids"), "node").select("q", F.explode("ids").alias("node")).distinct()
        fresh = reached.join(found.select("q", "node"), ["q", "node"], "left_anti").filter("q <> node")
        pairs = fresh.join(vectors, "node").join(queries.select("q", F.col("x").alias("qx")), "q")
        scored = pairs.select("q", "node", "qx", "x").mapInArrow(_score_pairs, "q long, node long, score float")
        been = found.join(go.withColumn("now", F.lit(True)), ["q", "node"], "left").select("q", "node", "score", (F.col("gone_on") | F.coalesce("now", F.lit(False))).alias("gone_on"))
        every = been.unionByName(scored.withColumn("gone_on", F.lit(False)))
        new = save(every.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= max(keep, 2 * beam)).drop("rn"))
        drop_saved(found, go)
        found = new
        free_shuffles(nodes.sparkSession)
    return found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= keep).select("q", "node", "score")


def _nearest_of(qs: list[int], queries: np.ndarray, k: int):
    """The k nearest of a few queries among all rows of a partition."""

    def run(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.float32))] * len(qs)
        for batch in batches:
            if batch.num_rows:
                ids, s = np.asarray(batch.column("node")), queries @ _matrix(batch.column("x")).T
                for r, q in enumerate(qs):
                    other = ids != q
                    near = np.argpartition(-s[r], k)[: k + 1] if len(ids) > k + 1 else np.arange(len(ids))
                    near = near[other[near]]
                    held[r] = _best(np.append(held[r][0], ids[near]), np.append(held[r][1], s[r, near]), k)
        yield _lists([(q, i.tolist(), s.tolist()) for q, (i, s) in zip(qs, held)])

    return run


def true_nearest(nodes: DataFrame, queries: DataFrame, k: int, most: int = SAMPLE) -> DataFrame:
    """(q, least, m), saved: of at most ``most`` query nodes, compared with all nodes, how many
    nodes there are among the k nearest and the least of their scores."""
    drawn = queries.orderBy(F.xxhash64("x"), "q").limit(most).select("q", "x").toArrow()
    if not drawn.num_rows:
        return save(queries.select("q", F.lit(0.0).cast("float").alias("least"), F.lit(0).cast("long").alias("m")))
    lists = nodes.select("node", "x").mapInArrow(_nearest_of(drawn["q"].to_pylist(), _matrix(drawn["x"]), k), _LISTS)
    rows = lists.select(F.col("node").alias("q"), F.inline(F.arrays_zip("ids", "scores"))).toDF("q", "node", "score")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "node")
    return save(rows.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("m")))


def measured_recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the sample's nearest that are found, or others as near."""
    near = F.count_if(F.col("score") >= F.col("least") - F.abs("least") * ROUNDING)
    # SAMPLE rows are sent
    per = F.broadcast(truth).join(found, "q", "left").groupBy("q").agg(F.least(near, F.first("m")).alias("hits"), F.first("m").alias("m"))
    r = per.agg(F.sum("hits").alias("hits"), F.sum("m").alias("m")).first()
    return r.hits / r.m if r.m else 1.0


def complete(found: DataFrame, nodes: DataFrame, n: int, queries: DataFrame, k: int, trees: int, leaf: int, keep: int, target: float = TARGET, batches: int = BATCHES) -> tuple[DataFrame, float]:
    """``found`` and what queries find in the leaves of further trees, until ``target`` of the
    sample's nearest are found or ``batches`` batches are spent, and the recall reached.  Each batch
    of trees is drawn anew, so that each finds a share of what is missing.  A query visits PROBES leaves
    of a tree, so that nodes, which are many more, are dealt to few trees."""
    truth = true_nearest(nodes, queries, k)
    found, batch = save(found), 0
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "node")
    while (recall := measured_recall(found, truth)) < target and batch < batches:
        batch += 1
        last = found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") == k).select("q", F.col("score").alias("worst"))
        asked = queries.join(last, "q", "left").select("q", "x", F.coalesce("worst", F.lit(float("-inf"))).cast("float").alias("worst"))
        lists = visit_lists(nodes, n, asked, k + 4, trees, leaf, batch)
        more = lists.select(F.col("node").alias("q"), F.inline(F.arrays_zip("ids", "scores"))).toDF("q", "node", "score")
        every = found.unionByName(more).groupBy("q", "node").agg(F.max("score").alias("score"))
        new = save(every.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= keep).drop("rn"))
        drop_saved(found, lists)
        found = new
        free_shuffles(nodes.sparkSession)
    drop_saved(truth)
    return found, recall


def nearest(vectors: DataFrame, top: int = TOP, modulo: int = QUERY_MODULO, leaf: int = LEAF, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score, sample_recall): for each row of ``vectors`` (vec_id,
    embedding) whose id is divisible by ``modulo`` its ``top`` nearest other rows that were found,
    ties to the smaller id.  ``sample_recall`` is one value, measured on SAMPLE queries.

    Rows with a null id, or a vector that is null, zero, holds null or non-finite components or
    has another length than most (of equally common lengths the least counts), take no part.  Repeated rows are rows
    of their own.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = save(valid(vectors).withColumn("digest", F.xxhash64("v")))
    own = Window.partitionBy("digest", "v").orderBy("vec_id")
    members = save(rows.withColumn("rn", F.row_number().over(own)).filter(F.col("rn") <= top + 1))
    nodes = save(members.filter("rn = 1").select(F.col("vec_id").cast("long").alias("node"), "digest", "v").mapInArrow(_pack, "node long, digest long, v array<double>, x binary"))
    n = nodes.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, sample_recall double")
    graph = build_graph(nodes, n, max(NEIGHBOURS, top + 4), trees, leaf)
    asked = rows.filter(F.col("vec_id") % modulo == 0).select(F.col("vec_id").alias("query_id"), "digest", "v")
    asked = save(asked.join(nodes.select("node", "digest", "v", "x"), ["digest", "v"]).select("query_id", F.col("node").alias("q"), "x"))
    queries = asked.select("q", "x").dropDuplicates(["q"])
    found = search(graph, nodes, queries, max(BEAM, top), max(64, top + 1))
    found, recall = complete(found, nodes, n, queries, top, trees, leaf, max(64, top + 1))
    found = found.select("q", "node").unionByName(queries.select("q", F.col("q").alias("node"))).distinct()
    vec = nodes.select("node", "v")
    near = found.join(vec, "node").join(vec.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    near = near.select("q", "node", product.alias("score"))
    # enough nodes for any query of the node, then their members
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "node")
    ids = members.join(nodes.select("digest", "v", "node"), ["digest", "v"]).select("node", "vec_id")
    ties = near.withColumn("place", F.rank().over(best)).filter(F.col("place") <= max(64, top + 1))
    hits = ties.join(ids, "node").select("q", "vec_id", "score")
    first = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= top + 1)
    answers = asked.select("query_id", "q").join(hits, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rn"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score", F.lit(recall).alias("sample_recall"))
