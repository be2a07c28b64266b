"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds its distinct five-word shingles.  Two documents link when their
sets' Jaccard similarity is 0.8 or more; the join returns the connected components.

* Documents with equal sets form a class; from here on a class is one node.
* A node's point is its counts of shingles by hash group, with about two shingles a group.  An
  R-tree packs points of like top coordinates into leaves.  The sum of two points' coordinate
  minima bounds the overlap of their sets, that of two boxes' upper corners the overlap of any
  of their members; pairs of boxes, then of points, that cannot reach the threshold are passed
  over, and sets of the pairs that are left are compared.
* The tree is partitioned by rare shingles.  Nodes that can link share a shingle among the
  rarest fifth of their sets, in any order that is the same for all; here by how often the
  shingle's slot of SLOT_BITS-bit counters occurs, then by hash.  A group is the nodes that
  hold such a shingle; shingles of the same nodes are one group.  A node that shares none of
  its rare shingles takes no further part.
* Groups of more than a block, if there are any, are linked first: their nodes' sets are
  compared in blocks that are dealt anew until a deal links nothing more, so that a large group
  of near copies becomes one component without a comparison of all with all.
* Then groups that several components share send their points alone; trees over them find the
  nodes that may link with one of another component.  Sets of only these are sent, once each, by
  families of the components that such pairs connect.
* Of groups of more than a block the members outside the largest component meet all, block by
  block.

No step gathers a group of unbounded size or emits its pairs, and pairs that are connected
already aren't compared.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_saved, free_shuffles, save
from .words import LOWER, NON_SPACE, WordHasher, ngram_hashes, text_blocks, word_borders

SHINGLE, PERCENT = 5, 80
#: Counters of shingles: 2^24, dealt in pieces of 2^16; their levels take a byte each.
SLOT_BITS, PIECE_BITS = 24, 16
#: Most nodes and most shingles of a block (a block holds one node at least).
BLOCK, BLOCK_SHINGLES = 2048, 1 << 18
LEAF = 16
#: Bits of the table by which texts are picked.
TABLE_BITS = 25
#: Most rows of a table of ids and hashes that is broadcast (about 20 MB).
SENT_ROWS = 1 << 20
#: A shingle whose slot occurs more often than this is dealt over several tasks.
SPLIT = 4096


def shingle_sets(column, hasher: WordHasher):
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    for _, raw, offsets in text_blocks(column):
        data = LOWER[raw]
        starts, ends, first = word_borders(data, offsets, NON_SPACE)
        h = hasher(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        grams = ngram_hashes(h, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            else:
                yield ngram_hashes(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counted(batches):
    """This task's counters, as pieces that hold anything: (piece, width of a count, places of
    counts or null where there is one for each slot, counts)."""
    total, hasher, size = np.zeros(1 << SLOT_BITS, np.int32), WordHasher(), 1 << PIECE_BITS
    for batch in batches:
        for s in shingle_sets(batch.column(0), hasher):
            np.add.at(total, _slots(s), np.int32(1))
    rows = []
    for piece in range(len(total) // size):
        part = total[piece * size : (piece + 1) * size]
        if most := int(part.max()):
            width = 1 if most < 256 else 2 if most < 65536 else 4
            at = np.flatnonzero(part)
            few = 8 * len(at) < size
            data = (part[at] if few else part).astype(f"<u{width}").tobytes()
            rows.append((piece, width, zlib.compress(at.astype("<u2").tobytes(), 1) if few else None, zlib.compress(data, 1)))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["piece", "width", "places", "counts"])


def _summed(batches):
    """Sums of the pieces of all tasks: (piece, shingles, counts)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, width, places, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "width", "places", "counts"))):
            total = held.setdefault(piece, np.zeros(1 << PIECE_BITS, np.int64))
            at = slice(None) if places is None else np.frombuffer(zlib.decompress(places), "<u2")
            total[at] += np.frombuffer(zlib.decompress(data), f"<u{width}").astype(np.int64)
    for piece, part in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([int(part.sum())], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["piece", "shingles", "counts"])


def level_of(counts, mean: float):
    """Logarithmic levels, a byte each: a twelfth of an octave from the mean of all slots on."""
    return np.minimum(255, np.round(12 * np.log2(1 + 16 * np.asarray(counts) / mean))).astype(np.uint8)


def count_of(levels, mean: float):
    """The most counts that a level stands for (below level 255)."""
    return mean / 16 * (2.0 ** ((np.asarray(levels, np.float64) + 0.5) / 12) - 1)


def slot_levels(texts: DataFrame) -> tuple[np.ndarray, float]:
    """Levels of 2^SLOT_BITS counters of all shingles of all texts, and the mean count.  On the
    driver they take 2^SLOT_BITS bytes, however large the corpus."""
    pieces = texts.mapInArrow(_counted, "piece int, width int, places binary, counts binary")
    # 2^8 pieces: few tasks do
    summed = save(pieces.repartition("piece").coalesce(16).mapInArrow(_summed, "piece int, shingles long, counts binary"))
    mean = max(1.0, (summed.agg(F.sum("shingles")).first()[0] or 0) / (1 << SLOT_BITS))

    def leveled(batches):
        for batch in batches:
            got = [level_of(np.frombuffer(zlib.decompress(c), np.int64), mean).tobytes() for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(got, pa.binary())], ["piece", "levels"])

    levels = np.zeros((1 << SLOT_BITS - PIECE_BITS, 1 << PIECE_BITS), np.uint8)
    for r in summed.mapInArrow(leveled, "piece int, levels binary").collect():
        levels[r.piece] = np.frombuffer(r.levels, np.uint8)
    drop_saved(summed)
    return levels.reshape(-1), mean


def _signatures(levels, mean: float, percent: int):
    """Of each document: size and digest of its set, the rarest part of the set, over how many
    tasks each shingle of that part is dealt, and the set's point."""

    def run(batches):
        level, hasher = levels.value, WordHasher()
        deals = np.minimum(1 << 20, np.ceil(count_of(np.arange(256), mean) / SPLIT)).astype(np.int32)
        for batch in batches:
            sizes, digests, prefixes, parts, points = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), hasher):
                k, of = prefix_length(len(s), percent), level[_slots(s)]
                if k < len(s):
                    rare = np.lexsort((s, of))[:k]
                    prefixes.append(s[rare].view(np.int64))
                    parts.append(deals[of[rare]])
                else:
                    prefixes.append(s.view(np.int64))
                    parts.append(deals[of])
                sizes.append(len(s))
                points.append(pack_point(count_point(s)))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            ends = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            prefix = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            deal = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), prefix, deal, pa.array(points, pa.binary())],
                ["doc_id", "th", "n_shingles", "digest", "prefix", "deal", "point"],
            )

    return run


def _shared_rows(batches):
    """Of rows sorted by (shingle, salt) those whose shingle occurs again, or may in another
    task (salt above 0).  Holds back one row at most."""
    before, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, salt, node, n = (np.asarray(batch.column(c)) for c in ("shingle", "salt", "node", "n"))
        if held:
            shingle, salt, node, n = (np.append(np.array([h], a.dtype), a) for h, a in zip(held, (shingle, salt, node, n)))
        same = np.append(held is None and before == (shingle[0], salt[0]), (shingle[1:] == shingle[:-1]) & (salt[1:] == salt[:-1]))
        keep = same | np.append(same[1:], False) | (salt > 0)
        before = (shingle[-1], salt[-1])
        held = None if keep[-1] else (shingle[-1], salt[-1], node[-1], n[-1])
        yield pa.RecordBatch.from_arrays([pa.array(shingle[keep]), pa.array(node[keep]), pa.array(n[keep])], ["shingle", "node", "n"])


def bit_table(keys: DataFrame) -> np.ndarray:
    """2^TABLE_BITS bits, two set for each key: 4 MB, however many keys there are (with some ten
    million it passes a fifth of all rows, with more than a hundred nearly all)."""
    places = keys.select(F.explode(F.array(*(F.shiftrightunsigned("key", k).bitwiseAND((1 << TABLE_BITS) - 1) for k in (0, 32)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    got = words.toArrow()
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table[np.asarray(got["word"])] = np.asarray(got["bits"])
    return table.view(np.uint64)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys, found = keys.view(np.uint64), True
    for shift in (0, 32):
        p = keys >> np.uint64(shift) & np.uint64((1 << TABLE_BITS) - 1)
        found = found & (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    i = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * i >= percent * (len(a) + len(b) - i)


def count_point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by their top bits; larger sets have more groups, always a power of two."""
    groups = 16
    while groups < 4096 and groups * 2 < len(s):
        groups *= 2
    return np.bincount((s >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups).astype(np.int32)


def pack_point(point: np.ndarray) -> bytes:
    """The bits of a count (4 if all are below 16), the counts."""
    if point.max() < 16:
        return b"\x04" + (point[::2] << 4 | point[1::2]).astype(np.uint8).tobytes()
    kind = np.uint8 if point.max() < 256 else np.int32
    return bytes([8 * np.dtype(kind).itemsize]) + point.astype(kind).tobytes()


def unpack_point(packed: bytes) -> np.ndarray:
    if packed[0] == 4:
        two = np.frombuffer(packed, np.uint8, offset=1)
        return np.column_stack([two >> 4, two & 15]).ravel().astype(np.int32)
    return np.frombuffer(packed, np.uint8 if packed[0] == 8 else np.int32, offset=1).astype(np.int32)


class CountRTree:
    """Points (counts of shingles by hash group) packed into leaves of like points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.sizes = points.sum(1)
        self.points = points.astype(np.uint8) if points.max(initial=0) < 256 else points
        # points whose largest coordinates are the same, then of like size, share a leaf
        coarse = points.reshape(len(points), 16, -1).sum(2)
        top = np.argsort(-coarse, axis=1, kind="stable")
        order = np.lexsort((self.sizes, top[:, 2], top[:, 1], top[:, 0]))
        self.leaves = [order[i : i + leaf] for i in range(0, len(order), leaf)]
        self.upper = np.stack([self.points[leaf].max(0) for leaf in self.leaves])
        self.least = np.array([self.sizes[leaf].min() for leaf in self.leaves])
        self.most = np.array([self.sizes[leaf].max() for leaf in self.leaves])

    def survivors(self, other: CountRTree, percent: int = PERCENT, left=None, right=None):
        """Arrays (i, j) of points that may link, for each leaf that has such; of a tree and
        itself each pair of leaves once.  Pairs of equal ``left`` and ``right`` (components of
        the points of both trees) are left out."""
        for x, leaf in enumerate(self.leaves):
            # i overlap >= percent / (100 + percent) * (sizes' sum)
            near = (100 * other.most >= percent * self.least[x]) & (100 * self.most[x] >= percent * other.least)
            if other is self:
                near[:x] = False
            at = np.flatnonzero(near)
            at = at[(100 + percent) * np.minimum(self.upper[x], other.upper[at]).sum(1, dtype=np.int64) >= percent * (self.least[x] + other.least[at])]
            if not len(at):
                continue
            mates = np.concatenate([other.leaves[y] for y in at])
            if left is not None:
                own = left[leaf]
                mates = mates[right[mates] != own[0]] if (own == own[0]).all() else mates
            for lo in range(0, len(mates), step := max(1, (1 << 22) // (len(leaf) * self.points.shape[1]))):
                some = mates[lo : lo + step]
                bound = np.minimum(self.points[leaf][:, None], other.points[some][None]).sum(2, dtype=np.int64)
                fit = (100 + percent) * bound >= percent * (self.sizes[leaf][:, None] + other.sizes[some][None])
                if left is not None:
                    fit &= left[leaf][:, None] != right[some][None]
                i, j = np.nonzero(fit)
                if len(i):
                    yield leaf[i], some[j]


def point_survivors(points: list[np.ndarray], left, right, percent: int = PERCENT, comps: np.ndarray | None = None):
    """Arrays (i, j) of positions in ``points``, of ``left`` and ``right``, that may link and are
    of two components.

    There is a tree for each number of groups.  Sizes of sets that link differ by less than
    half, so only points of as many groups, or of twice as many, can meet; the latter are
    folded by adding neighbouring counts.
    """

    def forest(positions):
        by: dict[int, list[int]] = {}
        for i in positions:
            by.setdefault(len(points[i]), []).append(i)
        out = {g: (np.array(at), np.stack([points[i] for i in at])) for g, at in by.items()}
        return {g: (at, CountRTree(stacked)) for g, (at, stacked) in out.items()}

    def folded(at, tree):
        return at, CountRTree(tree.points.astype(np.int32).reshape(len(at), -1, 2).sum(2))

    a = forest(left)
    b = a if left is right else forest(right)
    pairs = [(a[g], b[g]) for g in a if g in b] + [(a[g], folded(*b[2 * g])) for g in a if 2 * g in b]
    if b is not a:
        pairs += [(folded(*a[g]), b[g // 2]) for g in a if g // 2 in b]
    for (at, tree), (to, other) in pairs:
        for i, j in tree.survivors(other, percent, *(() if comps is None else (comps[at], comps[to]))):
            yield at[i], to[j]


def block_links(nodes, comps, sets, left, right, percent: int = PERCENT):
    """Links between members of ``left`` and of ``right`` (positions), as far as they connect
    what isn't connected yet: of each component one node, linked to one node of those it
    comes to belong to."""
    if not left or not right:
        return []
    # positions of a component have one label; labels change as components meet
    names, first, label = np.unique(np.array(comps), return_index=True, return_inverse=True)
    if len(names) == 1:
        return []
    started = label.copy()
    sizes = np.array([len(s) for s in sets])
    local = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(max(int(x.max()) for x in local) + 1, np.uint8)
    for some, mates in point_survivors([count_point(s) for s in sets], left, right, percent, label):
        for x in np.unique(some).tolist():
            ys = mates[some == x]
            ys = ys[label[ys] != label[x]]
            if not len(ys):
                continue
            mark[local[x]] = 1
            hits = mark[np.concatenate([local[y] for y in ys])]
            mark[local[x]] = 0
            common = np.add.reduceat(hits, np.cumsum(np.append(0, sizes[ys][:-1])), dtype=np.int64)
            for y in ys[100 * common >= percent * (sizes[x] + sizes[ys] - common)].tolist():
                if label[x] != label[y]:
                    label[label == max(label[x], label[y])] = min(label[x], label[y])
    heads = label[first]
    return [(nodes[first[k]], nodes[first[heads[k]]]) for k in np.flatnonzero(heads != started[first]).tolist()]


def _by_block(batches, names, work):
    """Calls ``work`` with the rows of each (grp, block, mates), by which rows come sorted;
    yields what it returns."""
    current, rows = None, []
    for batch in batches:
        for grp, block, mates, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "mates", *names))):
            if (grp, block, mates) != current:
                if rows:
                    yield work(rows)
                current, rows = (grp, block, mates), []
            rows.append(row)
    if rows:
        yield work(rows)


def _sides(rows):
    left = [i for i, r in enumerate(rows) if r[0] == 0]
    if not rows[0][3]:
        return left, left
    return left, [i for i, r in enumerate(rows) if r[0] == 1]


def _longs(rows, names):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def _in_lots(results, names):
    """Lists of rows as batches of some thousand rows."""
    held: list = []
    for rows in results:
        held.extend(rows)
        if len(held) > 10_000:
            yield _longs(held, names)
            held.clear()
    yield _longs(held, names)


def _link_blocks(percent: int):
    """Links of each block: side 0 is compared with side 1, or with itself where not ``mated``."""

    def run(batches):
        def work(rows):
            left, right = _sides(rows)
            return block_links([r[1] for r in rows], [r[2] for r in rows], [np.frombuffer(r[4], np.uint64) for r in rows], left, right, percent)

        yield from _in_lots(_by_block(batches, ("side", "node", "comp", "mated", "set"), work), ["a", "b"])

    return run


def _near_blocks(percent: int):
    """Nodes with a point near enough to one of another component: (node, comp, head), head
    being a component that such pairs lead to."""

    def run(batches):
        def work(rows):
            left, right = _sides(rows)
            comps = np.array([r[2] for r in rows], np.int64)
            if not left or not right or (comps == comps[0]).all():
                return []
            near, heads = np.zeros(len(rows), bool), comps.copy()
            for i, j in point_survivors([unpack_point(r[4]) for r in rows], left, right, percent, comps):
                near[i] = near[j] = True
                while (open_ := heads[i] != heads[j]).any():
                    k = int(open_.argmax())
                    p, q = heads[i[k]], heads[j[k]]
                    heads[heads == max(p, q)] = min(p, q)
            return [(rows[k][1], rows[k][2], int(heads[k])) for k in np.flatnonzero(near).tolist()]

        yield from _in_lots(_by_block(batches, ("side", "node", "comp", "mated", "point"), work), ["node", "comp", "head"])

    return run


def _blocks(nodes, shingles):
    """How many blocks so many nodes and shingles make."""
    return F.greatest(F.ceil(nodes / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """Deals groups of (grp, node, comp, n, ...) into blocks, with columns block, mates, side and
    mated more; n is the node's number of shingles.  Groups of one component are left out.  Of
    a group of several blocks the members outside its largest component meet all its members,
    block by block."""
    rest = [c for c in rows.columns if c not in ("grp", "node", "comp")]
    by = rows.groupBy("grp", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sizes = by.groupBy("grp").agg(F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "w", -F.col("comp"))).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    sizes = sizes.select("grp", _blocks(F.col("m"), F.col("w")).alias("blocks"), (-F.col("main.col3")).alias("main"), _blocks(F.col("m") - F.col("main.m"), F.col("w") - F.col("main.w")).alias("outer"))
    wide = rows.join(sizes, "grp")
    single = F.array(F.struct(F.lit(0).alias("block"), F.lit(-1).alias("mates"), F.lit(0).alias("side"), F.lit(False).alias("mated")))
    apart, own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("outer")).cast("int"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(apart.alias("block"), k.alias("mates"), F.lit(0).alias("side"), F.lit(True).alias("mated")))
    every = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda k: F.struct(k.alias("block"), own.alias("mates"), F.lit(1).alias("side"), F.lit(True).alias("mated")))
    places = F.when(F.col("blocks") == 1, single).when(F.col("comp") == F.col("main"), every).otherwise(F.concat(asking, every))
    return wide.select("grp", "node", "comp", *rest, F.inline(places))


def _compared(blocks: DataFrame, payload: str, work, schema: str) -> DataFrame:
    key = ["grp", "block", "mates"]
    return save(blocks.repartition(*key).sortWithinPartitions(*key).select(*key, "side", "node", "comp", "mated", payload).mapInArrow(work, schema))


def _with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with the component that ``links`` give each node: comp."""
    found = components(links).select(F.col("id").alias("node"), F.col("component").alias("comp"))
    return rows.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


class Classes:
    """Saved tables of a join.

    rows: (doc_id, th, n_shingles, digest) of each row, th being a hash of the text; nodes:
    (node, digest, doc_id, th, n_shingles), a class of equal sets each; linked: (node,
    component), nodes of components of several nodes.
    """

    def __init__(self, documents: DataFrame, percent: int = PERCENT):
        spark = documents.sparkSession
        docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
        docs = docs.withColumn("th", F.xxhash64("text"))
        levels, mean = slot_levels(docs.select("text"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        levels = spark.sparkContext.broadcast(levels)
        signed = save(docs.mapInArrow(_signatures(levels, mean, percent), f"doc_id {kind}, th long, n_shingles long, digest binary, prefix array<bigint>, deal array<int>, point binary"))
        levels.destroy()
        self.rows = save(signed.select("doc_id", "th", "n_shingles", "digest"))
        # a class's node: its smallest id (nulls last); equal sets share the rest
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
        least = signed.filter("n_shingles > 0").groupBy("digest").agg(first, F.any_value(F.struct("n_shingles", "prefix", "deal", "point")).alias("s"))
        nodes = save(least.select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.th", "s.*"))
        self.nodes = nodes.select("node", "digest", "doc_id", "th", "n_shingles")
        drop_saved(signed)
        free_shuffles(spark)

        members = self._groups(nodes)
        self.linked = spark.createDataFrame([], "node long, component long")
        if members.isEmpty():
            return
        # 1. large groups, if any
        blocks = _blocks(F.col("size"), F.col("weight"))
        links = self._large_links(docs, members.withColumn("blocks", blocks).filter("blocks > 1"), percent)
        placed = members.select("grp", "node", "n")
        placed = placed.withColumn("comp", F.col("node")) if links is None else save(_with_component(placed, links))
        # 2. groups that components share: points
        near = _compared(_dealt(placed).join(nodes.select("node", "point"), "node"), "point", _near_blocks(percent), "node long, comp long, head long")
        free_shuffles(spark)
        # 3. families of components with near points are compared set by set
        families = components(near.select(F.col("comp").alias("a"), F.col("head").alias("b"))).select(F.col("id").alias("comp"), F.col("component").alias("grp"))
        sets = self._sets(docs, near)
        family = save(near.select("node", "comp").distinct().join(families, "comp").join(sets.select("node", "n"), "node"))
        more = _compared(_dealt(family).join(sets.select("node", "set"), "node"), "set", _link_blocks(percent), "a long, b long")
        drop_saved(sets)
        free_shuffles(spark)
        self.linked = save(components(more if links is None else links.unionByName(more)).select(F.col("id").alias("node"), "component"))

    @staticmethod
    def _groups(nodes: DataFrame) -> DataFrame:
        """(grp, size, weight, node, n), saved: nodes that share a rare shingle, and how many nodes
        and shingles of nodes there are in the group; shingles of the same nodes are one group."""
        rare = nodes.select(F.inline(F.arrays_zip("prefix", "deal")), "node", "n_shingles").toDF("shingle", "deal", "node", "n")
        salt = F.when(F.col("deal") > 1, 1 + F.pmod(F.xxhash64("node"), F.col("deal"))).otherwise(0).cast("int")
        rare = rare.select("shingle", salt.alias("salt"), "node", "n").repartition("shingle", "salt").sortWithinPartitions("shingle", "salt")
        shared = save(rare.mapInArrow(_shared_rows, "shingle long, node long, n long"))
        free_shuffles(nodes.sparkSession)
        of = shared.groupBy("shingle").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("m > 1")
        groups = of.groupBy("m", "w", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle", F.col("m").alias("size"), F.col("w").alias("weight"))
        members = save(shared.join(groups, "shingle").select(F.col("shingle").alias("grp"), "size", "weight", "node", "n"))
        drop_saved(shared)
        return members

    def _sets(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """(node, n, set), saved, of the nodes of ``members``.  Only texts whose id and hash pass
        a bit table of those wanted are scanned, and sets, not texts, are shuffled."""
        spark = docs.sparkSession
        wanted = save(self.nodes.join(members.select("node").distinct(), "node").select("node", "doc_id", "th"))
        key = F.xxhash64("doc_id", "th")
        bits = spark.sparkContext.broadcast(bit_table(wanted.select(key.alias("key"))))

        def packed(batches):
            hasher = WordHasher()
            for batch in batches:
                batch = batch.filter(pa.array(in_table(bits.value, np.asarray(batch.column("key")))))
                sets = list(shingle_sets(batch.column("text"), hasher))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["i", "t", "n", "set"]
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        got = docs.select("doc_id", "th", "text", key.alias("key")).mapInArrow(packed, f"i {kind}, t long, n long, set binary")
        if not self.rows.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
            got = got.groupBy("i", "t").agg(F.any_value(F.struct("n", "set")).alias("s")).select("i", "t", "s.*")
        return save(wanted.join(got, wanted["doc_id"].eqNullSafe(got["i"]) & wanted["th"].eqNullSafe(got["t"])).select("node", "n", "set"))

    def _large_links(self, docs: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
        """Links within blocks of groups of several, each node in its largest.  Blocks are dealt
        anew as long as that finds links."""
        if members.isEmpty():
            return None
        sets = self._sets(docs, members)
        home = members.groupBy("node").agg(F.max(F.struct("size", "grp", "blocks")).alias("s"))
        # some of the group's nodes have another home, so these are blocks enough
        rows, links, deal = home.select("node", "s.grp", "s.blocks", F.col("node").alias("comp")), None, 0
        while True:
            block = F.pmod(F.xxhash64("node", F.lit(deal)), F.col("blocks")).cast("int")
            placed = rows.select("grp", block.alias("block"), F.lit(-1).alias("mates"), F.lit(0).alias("side"), F.lit(False).alias("mated"), "node", "comp")
            found = _compared(placed.join(sets.select("node", "set"), "node"), "set", _link_blocks(percent), "a long, b long")
            links = links.unionByName(found) if links else found
            free_shuffles(docs.sparkSession)
            if found.isEmpty():
                drop_saved(sets)
                return links
            rows, deal = save(_with_component(rows.select("grp", "blocks", "node"), links)), deal + 1

    def by_row(self) -> DataFrame:
        """(doc_id, th, n_shingles, digest, component_id, component) of each row."""
        with_node = self.rows.join(self.nodes.select("digest", "node", F.col("doc_id").alias("own")), "digest", "left")
        heads = self.linked.join(self.nodes.select("node", "doc_id"), "node")
        least = heads.groupBy("component").agg(F.min("doc_id").alias("head"))
        named = self.linked.join(least, "component").select("node", "head", "component")
        out = with_node.join(named, "node", "left")
        own = F.when(F.col("n_shingles") > 0, F.col("own")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "th", "n_shingles", "digest", F.coalesce("head", own).alias("component_id"), F.coalesce("component", "node").alias("component"))


def join_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): doc_id, n_shingles (the set's size)
    and component_id (the smallest doc_id that links reach, its own included).

    Null and empty texts, or texts of white space, have an empty set and link with nothing:
    their component is their own id.  With fewer than five words the whole sequence is the
    one shingle.  Repeated rows stay and share a component; null ids stay, and a component of
    null ids alone is null.  Other columns are ignored; an empty table gives an empty result.
    """
    return Classes(documents, percent).by_row().select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``documents``, with all their columns, reduced to one row of each component: that of
    the smallest id (of repeated rows, one).  Rows with an empty set stay."""
    named = save(Classes(documents, percent).by_row().filter("n_shingles > 0").select("doc_id", "th", "component"))
    keep = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th", F.lit(True).alias("kept"))
    same = named.groupBy("doc_id", "th").count()
    keep = keep.withColumnsRenamed({"doc_id": "i", "th": "t"})
    state = same.join(keep, same["doc_id"].eqNullSafe(keep["i"]) & (same["th"] == keep["t"]), "left").select("doc_id", "th", "count", F.coalesce("kept", F.lit(False)).alias("kept"))
    # rows to drop, and repeated rows of which one is kept
    state = save(state.filter("NOT kept OR count > 1").select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "kept"))
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(F.col("text").cast("string")).alias("th"))

    # up to SENT_ROWS rows of some 20 bytes are sent to all tasks; more are joined by a shuffle
    state = F.broadcast(state) if state.count() <= SENT_ROWS else state

    def match(other):
        return rows["row.doc_id"].eqNullSafe(other["i"]) & (rows["th"] == other["t"])

    out = rows.join(state, match(state), "left_anti").select("row")
    again = state.filter("kept")
    if not again.isEmpty():
        several = rows.join(again, match(again)).groupBy("i", "t").agg(F.any_value("row").alias("row"))
        out = out.unionByName(several.select("row"))
    return out.select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT a, b FROM sides UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.other = sides.a
), c AS (
  SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
