"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: bit k is set if it is set in over half of the 64-bit hashes
of its three-word shingles, repeats included.  Fingerprints that differ in RADIUS bits or fewer
link; the result is the connected components.

The tables are a covering: each bit gets a nonzero vector of RADIUS + 1 bits, and the mask of the
nonzero vector v keeps the bits whose vector has an odd product with v.  The vectors of RADIUS
differing bits or fewer don't span the space, so some v is orthogonal to all of them: its mask
keeps none of those bits, and the pair has the same key in its table.  With 2^4 - 1 = 15 tables
every link is found, whatever the data.

* Equal fingerprints are one node, so a bucket (table and key) holds distinct fingerprints.
* Buckets are counted first, by partial sums.  Of two members the count's least and greatest are
  the pair; others up to BLOCK members are compared in one task, which sends a star for what it
  connects, not pairs.
* A larger bucket is dealt again by a covering of the bits that its mask leaves free.  The third
  such level leaves eight bits free, hence at most 256 distinct members: no bucket stays large,
  and no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_saved, free_shuffles, save
from .words import LOWER, NON_SPACE, text_blocks, word_borders

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Most members of a bucket that are compared with each other in one task.
BLOCK = 512
#: Shingles that are hashed at a time.
PIECE = 1 << 16
#: Most rows of a table of three numbers that is broadcast (some 30 MB).
SENT_ROWS = 1 << 20
LEVELS = 3


def _bits_set(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the hashes of these ranges of ``text`` have each bit, the lowest first."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(starts), PIECE):
        ranges = zip(starts[lo : lo + PIECE].tolist(), ends[lo : lo + PIECE].tolist())
        h = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in ranges], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprints(column):
    """The fingerprint of each text of an Arrow column; 0 of texts without a word."""
    for _, raw, offsets in text_blocks(column):
        data = LOWER[raw]
        starts, ends, first = word_borders(data, offsets, NON_SPACE)
        # the same words with one space after each
        is_word = NON_SPACE[data]
        keep = is_word.copy()
        keep[1:] |= is_word[:-1]
        place = np.append(0, np.cumsum(keep))
        text = np.where(is_word, data, 32).astype(np.uint8)[keep].tobytes()
        starts, ends = place[starts], place[ends]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if a == b:
                yield 0
                continue
            width = min(SHINGLE, b - a)
            n = b - a - width + 1
            counts = _bits_set(text, starts[a : a + n], ends[b - n : b])
            yield int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches):
    for batch in batches:
        got = np.fromiter(fingerprints(batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def covering(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the bits of ``free`` such that of any ``radius`` of them one mask keeps none."""
    vectors = (1 << radius + 1) - 1
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for k, b in enumerate(bits) if (k % vectors + 1 & v).bit_count() % 2) for v in range(1, vectors + 1)]


def tables(radius: int = RADIUS, levels: int = LEVELS) -> list[list[tuple[int, int, int]]]:
    """Of each level its tables: (the bucket's table one level up, 0 at first; number; mask)."""
    out, above = [], [(0, 0)]
    for _ in range(levels):
        level = []
        for parent, kept in above:
            level += [(parent, parent * 16 + k + 1, kept | mask) for k, mask in enumerate(covering(~kept & (1 << 64) - 1, radius))]
        out.append(level)
        above = [(number, mask) for _, number, mask in level]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(fp: np.ndarray, end: np.ndarray, radius: int = RADIUS):
    """(a, b) positions of fingerprints, sorted by bucket, that connect what links within buckets;
    ``end`` has the end of each row's bucket."""
    left, right, i, step = [], [], np.arange(len(fp)), 0
    while len(i := i[i + (step := step + 1) < end[i]]):
        near = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        left.append(near)
        right.append(near + step)
    label = np.arange(len(fp))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while (apart := label[a] != label[b]).any():
            a, b = a[apart], b[apart]
            low = np.minimum(label[a], label[b])
            for ends in (a, b, label[a], label[b]):
                np.minimum.at(label, ends, low)
            label = label[label]
        # positions above point to smaller ones alone; follow them to the end
        while (label != label[label]).any():
            label = label[label]
    b = np.flatnonzero(label != np.arange(len(fp)))
    return label[b], b


def _bucket_links(batches):
    """Links of rows (path, key, fp) that come sorted by bucket; holds back one bucket."""
    held = [np.empty(0, np.int64)] * 3

    def links(path, key, fp):
        new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])))
        a, b = stars(fp.view(np.uint64), np.repeat(np.append(new[1:], len(fp)), np.diff(np.append(new, len(fp)))))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    for batch in batches:
        rows = [np.append(h, np.asarray(batch.column(c))) for h, c in zip(held, ("path", "key", "fp"))]
        if len(rows[0]):
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            held = [x[last] for x in rows]
            rows = [x[~last] for x in rows]
        if len(rows[0]):
            yield links(*rows)
    if len(held[0]):
        yield links(*held)


def sent_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), saved: of distinct fingerprints (fp) enough links to connect all that are linked."""
    spark = nodes.sparkSession
    rows, found = nodes.select(F.lit(0).cast("long").alias("parent"), "fp"), []
    for level in tables(radius):
        if level[0][0] == 0:
            keyed = rows.select(F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for _, k, m in level))), "fp")
        else:  # 225 or 3,375 rows are sent
            masks = spark.createDataFrame([(p, k, _signed(m)) for p, k, m in level], "parent long, path long, mask long")
            keyed = rows.join(F.broadcast(masks), "parent").select("path", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        buckets = save(keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
        free_shuffles(spark)
        found.append(buckets.filter(f"n = 2 AND bit_count(a ^ b) <= {radius}").select("a", "b"))
        several = buckets.filter("n > 2").select("path", "key", "n")
        wide = save(keyed.join(sent_if_small(several), ["path", "key"]))
        small = wide.filter(F.col("n") <= BLOCK).repartition("path", "key").sortWithinPartitions("path", "key")
        found.append(save(small.select("path", "key", "fp").mapInArrow(_bucket_links, "a long, b long")))
        free_shuffles(spark)
        rows = wide.filter(F.col("n") > BLOCK).select(F.col("path").alias("parent"), "fp")
        if rows.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return save(links.distinct())


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): doc_id, fingerprint (16 lower-case hex
    digits) and component_id, the smallest doc_id that links reach, its own included.

    Null and empty texts and texts of white space have the fingerprint zero and link like any
    other.  With fewer than three words the whole sequence is the one shingle.  Repeated rows
    stay; null ids stay, and a component of null ids alone is null.  Other columns are ignored;
    an empty table gives an empty result.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = save(docs.mapInArrow(_fingerprinted, f"doc_id {kind}, fp long"))
    nodes = save(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("own")))
    links = near_links(nodes.select("fp"), radius)
    linked = save(components(links).withColumnRenamed("id", "fp"))
    drop_saved(links)
    # only fingerprints of several rows or of a component of several have another id than their row's
    named = nodes.join(linked, "fp", "left").filter("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "fp"))
    heads = named.groupBy("component").agg(F.min("own").alias("head"))
    shared = save(named.join(heads, "component").select("fp", "head"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(sent_if_small(shared), "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.coalesce("head", "doc_id").alias("component_id"))
