"""BM25 retrieval over a term-keyed postings table, with authority gates and conflict groups.

An index is a folder of postings (a row for each chunk, with its terms and their counts), terms and
a row that says what it is: version, kind, digest of the corpus, counts.  It is written aside and
swapped in; one that is missing, of another version, of another corpus or damaged is built anew.
Chunks are scored a batch at a time where they lie, with the weights of all queries' terms; nothing
that grows with chunks times queries is sorted or hashed.  Lists of the best k first lose, in each
task, what k others surpass.  Collection statistics are those of the whole corpus, filters apply to
candidates alone.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..dims import BM25_B, BM25_K1
from ..functions.text import dot, once, tier_order, tokens
from ..sources.saved import swapped_in


INDEX_VERSION, INDEX_TYPE = 2, "bm25"
#: Most rows of query terms that are sent to all tasks; products of postings and queries, and scores, held at once.
SMALL, AT_ONCE = 1 << 18, 1 << 20
#: About so many parts of each query's ranking are sorted apart.
PARTS = 256
_META = "schema_version int, index_type string, digest string, n_docs long, avg_length double, n_chunks long, n_terms long"


class IndexMismatch(ValueError):
    """A saved index that can't serve: another version, kind or corpus, or files that lack."""


@dataclass
class Index:
    """chunks (chunk_id, length, terms, tfs) with a token, terms (term, df, idf), the number of chunks and
    their mean length."""

    chunks: DataFrame
    terms: DataFrame
    n_docs: int
    avg_length: float

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, length)."""
        return postings_of(self.chunks)


def postings_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "length", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).select("chunk_id", "term", "tf", "length")


def _counted(kind: pa.DataType):
    """(chunk_id, length, terms, tfs) of rows (chunk_id, words) that come sorted; rows of one chunk are
    added up.  A chunk's terms stand in the order in which they first occur."""
    schema = pa.schema([("chunk_id", kind), ("length", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])

    def counted(ids, n, terms, tf, row):
        """Chunks of rows with ``n`` words, and of words that occur ``tf`` times in their row."""
        known = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh = np.append(True, known[1:] != known[:-1])
        chunk = np.cumsum(fresh) - 1
        length, some = np.zeros(chunk[-1] + 1, np.int32), np.flatnonzero(n)[::-1]
        length[chunk[some]] = n[some]  # of a chunk's rows the first one with words
        words = terms.dictionary_encode()
        cells = chunk[row] * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
        _, first, cell = np.unique(cells, return_index=True, return_inverse=True)
        order = np.argsort(first)
        first, tfs = first[order], np.bincount(cell, tf, len(order)).astype(np.int64)[order]
        ends = np.searchsorted(chunk[row][first], np.arange(len(length) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (terms.take(pa.array(first)), pa.array(tfs))]
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(fresh)), pa.array(length), *lists], schema=schema)

    def with_words(batch):
        return batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))

    def run(batches):
        last = None  # the last chunk may go on
        for batch in batches:
            done, spent = 0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            while done < len(batch):
                # whole rows, one at least
                to = max(done + 1, int(np.searchsorted(spent, (spent[done - 1] if done else 0) + AT_ONCE, "right")))
                ids, words = (c.slice(done, to - done) for c in batch.columns)
                n, terms = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), words.flatten()
                tf, row = np.ones(len(terms)), np.repeat(np.arange(len(n)), n)
                if last is not None:
                    old, times = last.column("terms").flatten(), last.column("tfs").flatten().to_numpy()
                    ids, terms, n = pa.concat_arrays([last.column(0), ids]), pa.concat_arrays([old, terms]), np.append(last.column("length").to_numpy(), n)
                    tf, row = np.append(times, tf), np.append(np.zeros(len(times), np.int64), row + 1)
                rows = counted(ids, n, terms, tf, row)
                yield with_words(rows.slice(0, len(rows) - 1))
                last, done = rows.slice(len(rows) - 1), to
        if last is not None:
            yield with_words(last)

    return run


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, length, terms, tfs) of chunks (chunk_id, text) with a token: texts are dealt by chunk
    and counted there, so postings aren't shuffled."""
    kind = chunks.schema["chunk_id"].dataType
    dealt = chunks.select("chunk_id", "text").repartition("chunk_id").sortWithinPartitions("chunk_id")
    words = dealt.select("chunk_id", tokens(F.col("text")).alias("words"))
    return words.mapInArrow(_counted(to_arrow_type(kind)), f"chunk_id {kind.simpleString()}, length int, terms array<string>, tfs array<long>")


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, length).  The length is a sum over the key's array, so that counting
    terms is the one shuffle."""
    t = texts.select(key, tokens(F.col("text")).alias("_t"))
    rows = t.select(key, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_digest(chunks: DataFrame) -> tuple[int, str]:
    """The number of chunks (chunk_id, text), and a digest of them in any order, by one pass."""
    h = F.xxhash64("chunk_id", "text")
    r = chunks.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("text", "chunk_id")).alias("x")).first()
    return r.n, f"{r.n}:{r.s or 0}:{r.x or 0}"


def save_index(chunks: DataFrame, path: str, digest: tuple[int, str] | None = None) -> None:
    """Builds the index of (chunk_id, text) and swaps it in at ``path``.  Texts are tokenized once:
    terms and averages come from the postings that were written.  Chunks without a token count in
    the averages."""
    spark = chunks.sparkSession
    n_docs, name = digest or corpus_digest(chunks)

    def write(folder: str) -> None:
        chunk_terms(chunks).write.parquet(f"{folder}/postings")
        counted = spark.read.parquet(f"{folder}/postings")
        postings = postings_of(counted)
        df = F.count("*")
        idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        postings.groupBy("term").agg(df.alias("df")).select("term", "df", idf.alias("idf")).write.parquet(f"{folder}/terms")
        total = counted.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), F.count("*").alias("n")).first()
        n_terms = spark.read.parquet(f"{folder}/terms").count()
        row = (INDEX_VERSION, INDEX_TYPE, name, n_docs, (total.tokens or 0) / n_docs if n_docs else 0.0, total.n, n_terms)
        spark.createDataFrame([row], _META).coalesce(1).write.parquet(f"{folder}/meta")

    swapped_in(spark, path, write)


def load_index(spark, path: str, digest: str | None = None) -> Index:
    """The index at ``path``; IndexMismatch if it isn't of this version and kind, not of the corpus
    with this digest, or hasn't the rows that it had when it was written."""
    try:
        (meta,) = spark.read.schema(_META).parquet(f"{path}/meta").collect()
        chunks, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
        counts = (chunks.count(), terms.count())  # from the files' footers
    except (PySparkException, Py4JJavaError, ValueError) as error:
        raise IndexMismatch(f"{path} can't be read") from error
    if (meta.schema_version, meta.index_type) != (INDEX_VERSION, INDEX_TYPE):
        raise IndexMismatch(f"{path} is {meta.index_type} of version {meta.schema_version}")
    if digest is not None and meta.digest != digest:
        raise IndexMismatch(f"{path} is of another corpus")
    if counts != (meta.n_chunks, meta.n_terms):
        raise IndexMismatch(f"{path} lacks rows")
    return Index(chunks, terms, meta.n_docs, meta.avg_length)


def load_or_build(chunks: DataFrame, path: str) -> Index:
    """The saved index of (chunk_id, text) at ``path``, built anew if it can't serve."""
    spark, digest = chunks.sparkSession, corpus_digest(chunks)
    try:
        return load_index(spark, path, digest[1])
    except IndexMismatch:
        save_index(chunks, path, digest)
        return load_index(spark, path, digest[1])


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; beyond, Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _weighted(hits: DataFrame, k1: float, b: float, digits: int) -> DataFrame:
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * weight), digits).alias("score"), F.count("*").alias("matched"))


def _scored(weights, kind: pa.DataType, query_kind: pa.DataType, keep: list[tuple[str, pa.DataType]], k1: float, b: float, avg_length: float):
    """Scores of chunks (chunk_id, length, terms, tfs, keep) for all queries with one of their terms.
    ``weights``: a broadcast of sorted (term, query_id, weight)."""
    schema = pa.schema([("query_id", query_kind), ("chunk_id", kind), ("score", pa.float64()), ("matched", pa.int64()), *keep])

    def run(batches):
        table = weights.value
        names = table.column("term").combine_chunks().dictionary_encode()
        asked, term = names.dictionary, names.indices.to_numpy()
        begin = np.append(np.searchsorted(term, np.arange(len(asked))), len(term))
        coded = table.column("query_id").combine_chunks().dictionary_encode()
        queries, query, weight = coded.dictionary, coded.indices.to_numpy(), table.column("w").to_numpy()
        for batch in batches:
            terms, length = batch.column("terms"), batch.column("length").to_numpy()
            chunk = pc.list_parent_indices(terms).to_numpy()
            at = pc.fill_null(pc.index_in(terms.flatten(), asked), -1).to_numpy(zero_copy_only=False)
            tf, hit = batch.column("tfs").flatten().to_numpy(), at >= 0
            at, chunk, tf = at[hit], chunk[hit], tf[hit]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[chunk] / avg_length))
            n = begin[at + 1] - begin[at]
            done, spent = 0, np.cumsum(np.bincount(chunk, weights=n, minlength=len(batch)).astype(np.int64) + len(queries))
            while done < len(batch):
                # whole chunks, one at least
                to = max(done + 1, int(np.searchsorted(spent, (spent[done - 1] if done else 0) + AT_ONCE, "right")))
                cut = slice(*np.searchsorted(chunk, (done, to)))
                m = n[cut]
                each = np.repeat(np.arange(len(m)), m)
                where = begin[at[cut]][each] + np.arange(len(each)) - (np.cumsum(m) - m)[each]
                cell = (chunk[cut][each] - done) * len(queries) + query[where]
                size = (to - done) * len(queries)
                matched = np.bincount(cell, minlength=size)
                found = np.flatnonzero(matched)
                score = np.bincount(cell, weights=weight[where] * part[cut][each], minlength=size)
                rows = pa.array(done + found // len(queries))
                columns = [queries.take(pa.array(found % len(queries))), batch.column("chunk_id").take(rows), pa.array(score[found]), pa.array(matched[found]), *(batch.column(c).take(rows) for c, _ in keep)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                done = to

    return run


def bm25(index: Index, queries: DataFrame, k1: float = BM25_K1, b: float = BM25_B, digits: int = 9, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, matched): all chunks that share a term with the query of
    (query_id, text).  A repeated query term weighs by its count.  With ``chunks`` (chunk_id, ...)
    only these, with their columns: they join the index, not the scores.

    Up to SMALL rows of query terms are sent to all tasks, which score chunks a batch at a time;
    beyond, postings are joined with them."""
    asked = term_counts(queries, "query_id").select("query_id", "term", F.col("tf").alias("qtf"))
    weights = asked.join(index.terms.select("term", "idf"), "term")
    rows, keep = index.chunks, []
    if chunks is not None:
        rows, keep = rows.join(chunks, "chunk_id"), [f for f in chunks.schema if f.name != "chunk_id"]
    found = weights.select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("w")).limit(SMALL + 1).toArrow()
    if len(found) > SMALL:
        hits = index.postings.join(asked.select("term").distinct(), "term", "left_semi").repartition("chunk_id").join(weights, "term")
        out = _weighted(hits.withColumn("avg_length", F.lit(index.avg_length)), k1, b, digits)
        return out if chunks is None else out.join(chunks, "chunk_id")
    kind, query_kind = index.chunks.schema["chunk_id"].dataType, queries.schema["query_id"].dataType
    sent = index.chunks.sparkSession.sparkContext.broadcast(found.sort_by([("term", "ascending"), ("query_id", "ascending")]))
    run = _scored(sent, to_arrow_type(kind), to_arrow_type(query_kind), [(f.name, to_arrow_type(f.dataType)) for f in keep], k1, b, index.avg_length or 1.0)
    schema = T.StructType([T.StructField("query_id", query_kind), T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType()), T.StructField("matched", T.LongType()), *keep])
    return rows.mapInArrow(run, schema).withColumn("score", F.round("score", digits))


def promising(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """``scored`` without rows that k rows with the same ``by`` surpass within a batch or before it
    in the same task; what equals the k-th best stays, and so does all that can be among the best k."""

    wide = 1 << (62 // len(by))

    def run(batches):
        ids: list[dict] = [{} for _ in by]
        codes, tops = np.empty(0, np.int64), np.empty(0)  # up to k scores of each code, by code and falling score

        def enough(code, score):
            """Whether a score isn't below the k-th of its code."""
            last = np.searchsorted(codes, code, "right")
            full = last - np.searchsorted(codes, code, "left") == k
            return ~full | (score >= tops[np.maximum(last - 1, 0)]) if len(tops) else np.ones(len(code), bool)

        for batch in batches:
            code, score = np.zeros(len(batch), np.int64), batch.column("score").to_numpy(zero_copy_only=False)
            for c, known in zip(by, ids):
                d = batch.column(c).dictionary_encode(null_encoding="encode")
                own = np.array([known.setdefault(v, len(known)) for v in d.dictionary.to_pylist()], np.int64)
                code = code * wide + own[d.indices.to_numpy(zero_copy_only=False)] if len(own) else code
            if any(len(known) > wide for known in ids):  # too many values to be told apart: nothing goes
                yield batch
                continue
            stay = np.flatnonzero(enough(code, score))
            both, value = np.append(codes, code[stay]), np.append(tops, score[stay])
            order = np.lexsort((-value, both))
            both, value = both[order], value[order]
            first = np.arange(len(both)) - np.searchsorted(both, both, "left") < k
            codes, tops = both[first], value[first]
            stay = stay[enough(code[stay], score[stay])]
            if len(stay):
                yield batch.take(pa.array(stay))

    return scored.mapInArrow(run, scored.schema)


def search(chunks: DataFrame, queries: DataFrame, k1: float = BM25_K1, b: float = BM25_B, digits: int = 9) -> DataFrame:
    """What ``bm25`` gives, without an index: terms that no query asks for are dropped as chunks
    (chunk_id, text) are tokenized, and the rest is dealt by chunk, which serves both the counts
    and the sums."""
    asked = term_counts(queries, "query_id").select("query_id", "term", F.col("tf").alias("qtf"))
    words = once(chunks, ["chunk_id"], words=tokens(F.col("text")))
    averages = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avg_length"))
    rows = words.select("chunk_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    rows = rows.join(small(asked.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
    counts = rows.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(averages), how="cross")  # one row of averages
    weights = asked.join(terms.select("term", idf.alias("idf"), "avg_length"), "term")
    return _weighted(counts.join(small(weights), "term"), k1, b, digits)


def top_k(scored: DataFrame, k: int, by: str = "query_id", ties: list[Column] | None = None) -> DataFrame:
    """rank 1..k by score, ties in the order of ``ties`` and then of chunk_id."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), *(ties or []), "chunk_id")
    return promising(scored, k, [by]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def kept(chunks: DataFrame, *, categories=(), types=(), tiers=()) -> DataFrame:
    """Chunks of the given attributes; an empty filter lets all pass."""
    keep = F.lit(True)
    if categories:
        keep = keep & F.arrays_overlap("risk_categories", F.array(*map(F.lit, categories)))
    if types:
        keep = keep & F.col("chunk_type").isin(*types)
    if tiers:
        keep = keep & F.col("authority_tier").isin(*tiers)
    return chunks.filter(keep)


def filtered(scored: DataFrame, chunks: DataFrame, **wanted) -> DataFrame:
    """Scored chunks with their attributes, those that ``kept`` lets pass."""
    return scored.join(kept(chunks, **wanted).drop("text"), "chunk_id")


#: Rows of a block of vectors and of a block of queries; scores of so many pairs are held at once.
VECTOR_BLOCK, QUERY_BLOCK, PAIRS_AT_ONCE = 1 << 13, 1 << 12, 1 << 22


def _best_products(k: int, digits: int):
    """(qid, vec_id, score) of rows (part, of_query, id, v) that come sorted: of each block of queries
    and vectors all pairs that can be among a query's best k.

    A matrix product finds pairs that come within rounding of the k-th best; these are multiplied anew
    and added up in the order of their components, as the score is defined.  Rounding itself is
    Spark's: pairs too near to its border to tell stay, but of equal sums k."""
    unit = 10.0**digits

    def products(q, m):
        step = max(1, (1 << 22) // max(q.shape[1], 1))
        return np.concatenate([np.cumsum(q[i : i + step] * m[i : i + step], axis=1)[:, -1] for i in range(0, len(q), step)] or [np.empty(0)])

    def firsts(ids, keys):
        """The k smallest ids of each key."""
        order = np.lexsort((ids, keys))
        key = keys[order]
        return order[np.arange(len(key)) - np.searchsorted(key, key, "left") < k]

    def block(qids, q, ids, m):
        step = max(1, PAIRS_AT_ONCE // len(ids))
        size = np.abs(m).max(initial=0.0) * m.shape[1]
        for lo in range(0, len(qids), step):
            own = q[lo : lo + step]
            s = own @ m.T
            slack = 2 / unit + 1e-12 * size * np.abs(own).max(axis=1, initial=0.0)
            same = qids[lo : lo + step, None] == ids[None, :]
            s[same] = -np.inf
            least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - slack if len(ids) > k else np.full(len(own), -np.inf)
            r, c = np.nonzero((s >= least[:, None]) & ~same)
            x = products(own[r], m[c])
            ends = np.searchsorted(r, np.arange(len(own) + 1))
            stay = []
            for a, b in zip(ends[:-1], ends[1:]):
                place = x[a:b] * unit + 0.5
                whole = np.floor(place)
                near = np.abs(place - np.round(place)) < 1e-6 + 1e-15 * np.abs(place)
                sure, unsure = np.flatnonzero(~near), np.flatnonzero(near)
                best = sure[np.lexsort((ids[c[a:b]][sure], -whole[sure]))[:k]]
                if len(best) == k:
                    unsure = unsure[np.round(place[unsure]) >= whole[best[-1]]]
                stay += [a + best, a + unsure[firsts(ids[c[a:b]][unsure], x[a:b][unsure])]]
            at = np.concatenate(stay)
            yield qids[lo + r[at]], ids[c[at]], x[at]

    def run(batches):
        held, part = ([], []), None

        def flush():
            if part is not None and all(held):
                (qi, qv), (ii, iv) = (tuple(map(np.concatenate, zip(*side))) for side in held)
                for some in block(qi, qv, ii, iv):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], ["qid", "vec_id", "score"])

        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            parts, side, ids = batch.column("part").to_numpy(), batch.column("of_query").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            cuts = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(parts))):
                if parts[a] != part:
                    yield from flush()
                    held, part = ([], []), parts[a]
                held[0 if side[a] else 1].append((ids[a:b], v[a:b]))
        yield from flush()

    return run


def nearest_by_product(vectors: DataFrame, asked: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(qid, vec_id, score, rank): of each row of ``asked`` (qid, e) the ``k`` rows of ``vectors``
    (vec_id, embedding) with another id and the largest inner product, rounded; ties to the smaller id.

    All pairs are compared, which is quadratic, block by block: a task holds a block of vectors and
    one of queries.  Rows without a vector, with null or non-finite components or of another length than
    most are compared one by one."""
    v, e = F.col("embedding").cast("array<double>"), F.col("e").cast("array<double>")
    sizes = vectors.groupBy(F.size("embedding").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    usual = max(sizes["size"] or 0, 0) if sizes else 0

    def plain(x):
        return F.coalesce((F.size(x) == usual) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < 1e100)), F.lit(False)) & F.lit(usual > 0)

    n, m = vectors.count(), asked.count()
    blocks, query_blocks = n // VECTOR_BLOCK + 1, m // QUERY_BLOCK + 1
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of))
    rows = vectors.filter(plain(v) & F.col("vec_id").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_b"), block("vec_id", blocks).alias("_a"), F.lit(False).alias("of_query"), F.col("vec_id").cast("long").alias("id"), v.alias("v")
    )
    qs = asked.filter(plain(e)).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_a"), block("qid", query_blocks).alias("_b"), F.lit(True).alias("of_query"), F.col("qid").cast("long").alias("id"), e.alias("v"))
    both = rows.unionByName(qs).withColumn("part", F.col("_a") * query_blocks + F.col("_b")).drop("_a", "_b")
    near = both.repartition("part").sortWithinPartitions("part", F.col("of_query").desc()).mapInArrow(_best_products(k, digits), "qid long, vec_id long, score double")
    odd, all_ = vectors.filter(~plain(v) & F.col("vec_id").isNotNull()), vectors.filter("vec_id IS NOT NULL")
    other = F.col("vec_id") != F.col("qid")
    singly = odd.join(asked, other).unionByName(all_.filter(plain(v)).join(asked.filter(~plain(e)), other))
    pairs = near.unionByName(singly.select("qid", "vec_id", dot(F.col("e"), F.col("embedding")).alias("score"))).withColumn("score", F.round("score", digits))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_by_canonical(scored: DataFrame, k: int) -> DataFrame:
    """The best hit of each canonical id, then the best k of these."""
    w = Window.partitionBy("query_id", "canonical_id").orderBy(F.col("score").desc(), "chunk_id")
    return top_k(promising(scored, 1, ["query_id", "canonical_id"]).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"), k)


def _parted(cuts):
    """Rows of a ranking with ``_part``, the number of their query's cuts that stand before them.
    ``cuts``: a broadcast of each query's sorted (-score, tier's order, chunk_id)."""

    def run(batches):
        sorted_ = {q: (np.array([r[0] for r in rows]), [r[1:] for r in rows]) for q, rows in cuts.value.items()}
        for batch in batches:
            asked = batch.column("query_id").dictionary_encode(null_encoding="encode")
            code, part = asked.indices.to_numpy(zero_copy_only=False), np.zeros(len(batch), np.int32)
            score, by_query = -batch.column("score").to_numpy(zero_copy_only=False), np.argsort(code, kind="stable")
            ends = np.searchsorted(code[by_query], np.arange(len(asked.dictionary) + 1))
            for k, q in enumerate(asked.dictionary.to_pylist()):
                if q in sorted_:
                    own, (scores, rest) = by_query[ends[k] : ends[k + 1]], sorted_[q]
                    part[own], to = np.searchsorted(scores, score[own], "left"), np.searchsorted(scores, score[own], "right")
                    tied = np.flatnonzero(part[own] < to)
                    if not len(tied):
                        continue
                    names = [batch.column(c).take(pa.array(own[tied])).to_pylist() for c in ("_tier", "chunk_id")]
                    part[own[tied]] = [bisect_left(rest, name, a, b) for name, a, b in zip(zip(*names), part[own[tied]], to[tied])]
            yield batch.append_column("_part", pa.array(part))

    return run


def part_sample(chunks: DataFrame, n: int, most: int = PARTS) -> DataFrame:
    """About ``most`` of ``n`` chunks by their ids' hash, to part rankings by."""
    return chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // most))) == 0)


def in_parts(scored: DataFrame, sample: DataFrame, k: int = 0) -> DataFrame:
    """``scored`` (query_id, chunk_id, score, authority_tier, ...) with the order of its tier, ``_tier``, and the
    part of its query's ranking by score, tier and chunk that it is in, ``_part``.  The rows of
    ``sample``, the scores of a few chunks, part the rankings, so that a task sorts parts; any
    sample is right.  At most SMALL of its rows count, which go to all tasks.  With ``k`` the survey of
    parts instead, see ``_surveyed``."""
    tier = tier_order(F.col("authority_tier"))
    drawn = sample.select("query_id", "chunk_id", "score", tier.alias("_tier")).orderBy(F.xxhash64("chunk_id"), "query_id").limit(SMALL).toArrow()
    cuts: dict = {}
    for q, chunk, score, t in zip(*(drawn.column(c).to_pylist() for c in ("query_id", "chunk_id", "score", "_tier"))):
        cuts.setdefault(q, []).append((-score, t, chunk))
    sent = scored.sparkSession.sparkContext.broadcast({q: sorted(rows) for q, rows in cuts.items()})
    rows = scored.withColumn("_tier", tier)
    parted, schema = _parted(sent), T.StructType([*rows.schema, T.StructField("_part", T.IntegerType())])
    if k:
        return rows.mapInArrow(lambda batches: _surveyed(k)(parted(batches)), T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField("_n", T.LongType())]))
    return rows.mapInArrow(parted, schema)


def _surveyed(k: int):
    """A task's sizes of parts, ``_n``, with nulls beside, and what can be among each query's best k, which
    has no ``_n``."""

    def run(batches):
        known, sizes, schema = {}, np.zeros((0, 1), np.int64), None
        for batch in batches:
            schema = pa.schema([*((f.name, f.type) for f in batch.schema), ("_n", pa.int64())])
            asked = batch.column("query_id").dictionary_encode(null_encoding="encode")
            own = np.array([known.setdefault(q, len(known)) for q in asked.dictionary.to_pylist()], np.int64)
            code, part = own[asked.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64), batch.column("_part").to_numpy()
            wide = max(sizes.shape[1], int(part.max(initial=0)) + 1)
            sizes = np.pad(sizes, ((0, len(known) - len(sizes)), (0, wide - sizes.shape[1])))
            sizes += np.bincount(code * wide + part, minlength=sizes.size).reshape(sizes.shape)
            # rows behind k others of their query in parts before can't be among its best
            ahead = np.cumsum(sizes, axis=1) - sizes
            best = batch.filter(pa.array(ahead[code, part] < k)).sort_by([("score", "descending"), ("_tier", "ascending"), ("chunk_id", "ascending")])
            code = best.column("query_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            best = best.take(pa.array(order[np.arange(len(code)) - np.searchsorted(code[order], code[order], "left") < k]))
            yield pa.RecordBatch.from_arrays([*best.columns, pa.nulls(len(best), pa.int64())], schema=schema)
        code, part = np.nonzero(sizes)
        if len(code):
            values = {"query_id": pa.array(list(known), schema.field("query_id").type).take(pa.array(code)), "_part": pa.array(part, pa.int32()), "_n": pa.array(sizes[code, part])}
            yield pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(len(code), f.type)) for f in schema], schema=schema)

    return run


def with_conflict_siblings(scored: DataFrame, k: int, sample: DataFrame, few: bool = True) -> DataFrame:
    """(query_id, chunk_id, conflict_group, score, rank): the best k, and beyond them members of a conflict
    group of which one is among them.  ``sample`` parts the rankings, see ``in_parts``; ``few``: whether
    a row for each part and k groups of each query may go through the driver to all tasks.

    Chunks are scored twice: for the parts' sizes and the best k, and to be ranked, a part at a time."""
    spark, scored = scored.sparkSession, scored.select("query_id", "chunk_id", "conflict_group", "score", "authority_tier")
    rows, survey = in_parts(scored, sample), in_parts(scored, sample, k)
    one = F.struct((-F.col("score")).alias("_s"), "_tier", "chunk_id", "conflict_group")
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("_n").isNull(), one))), 1, k)
    parts = survey.groupBy("query_id", "_part").agg(F.sum("_n").alias("_n"), best.alias("_best"))
    parts = spark.createDataFrame(parts.toArrow(), parts.schema) if few else parts
    send = F.broadcast if few else lambda df: df
    before = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    heads = parts.select("query_id", "_before", F.posexplode("_best").alias("_at", "_b")).filter((F.col("_before") + F.col("_at") < k) & (F.col("_b.conflict_group") != ""))
    groups = heads.select("query_id", F.col("_b.conflict_group").alias("conflict_group"), F.lit(True).alias("sibling")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(F.col("score").desc(), "_tier", "chunk_id"))
    ranked = rows.drop("authority_tier").withColumn("_place", place).join(send(parts.select("query_id", "_part", "_before")), ["query_id", "_part"])
    ranked = ranked.withColumn("rank", (F.col("_before") + F.col("_place")).cast("int"))
    out = ranked.join(send(groups), ["query_id", "conflict_group"], "left").filter((F.col("rank") <= k) | F.col("sibling"))
    return out.select("query_id", "chunk_id", "conflict_group", "score", "rank")


def precedence(records: DataFrame, *by: str) -> DataFrame:
    """Rank within a conflict group: later year first (none last), then tier, then id."""
    w = Window.partitionBy(*by, "conflict_group").orderBy(F.col("source_year").desc_nulls_last(), tier_order(F.col("authority_tier")), "chunk_id")
    return records.withColumn("precedence_rank", F.row_number().over(w))


def conflict_sets(records: DataFrame, *by: str) -> DataFrame:
    """Groups of two or more records, their ids in the order of precedence."""
    ranked = precedence(records.filter("conflict_group <> ''"), *by)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("precedence_rank", "chunk_id"))), lambda x: x["chunk_id"])
    return ranked.groupBy(*by, "conflict_group").agg(F.count("*").alias("members"), ids.alias("chunk_ids")).filter("members >= 2")


def gated_retrieval(scored: DataFrame, grounding_k: int, explanation_k: int, sample: DataFrame, few: bool = True) -> DataFrame:
    """(query_id, chunk_id, original_rank, use): two rankings from one scoring, grounding over official
    evidence with conflict siblings, explanation over practice sources; ``original_rank`` is that in
    the unlimited list.  ``sample`` and ``few`` as of ``with_conflict_siblings``."""
    evidence = (F.col("chunk_type") == "evidence") & F.col("authority_tier").isin("A0", "A1", "A2")
    practice = F.col("authority_tier").isin("B", "C")
    grounding = with_conflict_siblings(scored.filter(evidence), grounding_k, sample.filter(evidence), few).withColumn("use", F.lit("grounding"))
    explanation = top_k(scored.filter(practice), explanation_k, ties=[tier_order(F.col("authority_tier"))]).withColumn("use", F.lit("explanation"))
    columns = ("query_id", "chunk_id", "rank", "use")
    return grounding.select(*columns).unionByName(explanation.select(*columns)).withColumnRenamed("rank", "original_rank")


def recall_at(ranked: DataFrame, relevant: DataFrame, ks=(3, 5)) -> DataFrame:
    """Share of queries of (query_id, chunk_id) ``relevant`` with a relevant chunk among the best k."""
    best = relevant.join(ranked.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    return best.agg(F.count("*").alias("queries"), *(F.round(F.avg(F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))), 6).alias(f"recall_at_{k}") for k in ks))


def caveat_coverage(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, canonical_id, hits, caveat_present, label_violation) of scored chunks (query_id, en,
    canonical_id, chunk_id, score, caveat, translated), the best ``k`` canonical ids of either side.

    The target is the first of the side that isn't English, or else the English one.  A required
    caveat is covered if the target has hits and none of them lacks it; an English hit that isn't
    a translation is labelled as if it were evidence.
    """
    best = promising(hits, 1, ["query_id", "en", "canonical_id"]).groupBy("query_id", "en", "canonical_id").agg(F.max("score").alias("score"), F.min_by(F.struct("chunk_id", "caveat", "translated"), F.struct(-F.col("score"), "chunk_id")).alias("_c"))
    w = Window.partitionBy("query_id", "en").orderBy(F.col("score").desc(), "canonical_id")
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    whole = Window.partitionBy("query_id")  # 2 k rows; a join would score all chunks twice
    first = lambda en: F.max(F.when((F.col("rank") == 1) & (F.col("en") == en), F.col("canonical_id"))).over(whole)
    top = top.withColumn("target", F.coalesce(first(False), first(True)))
    on, lacks = F.col("canonical_id") == F.col("target"), F.coalesce(F.trim("_c.caveat"), F.lit("")) == ""
    return top.groupBy("query_id", F.col("target").alias("canonical_id")).agg(
        F.count_if(on).alias("hits"), ((F.count_if(on) > 0) & (F.count_if(on & lacks) == 0)).alias("caveat_present"), (F.count_if(F.col("en") & ~F.col("_c.translated")) > 0).alias("label_violation")
    )


def _anchored(anchors, words: int):
    """(chunk_id, text, anchor) of texts with the words of an anchor in a row.  ``anchors``: a broadcast of
    different runs of ``words`` words, joined by spaces."""

    def run(batches):
        names = anchors.value
        flat = pa.array([w for a in names for w in a.split(" ")], pa.string())
        vocabulary = flat.unique()
        asked = pc.index_in(flat, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, words)
        state, levels = asked[:, 0], []
        for j in range(1, words):  # each run of j + 1 first words has a number
            keys = state * len(vocabulary) + asked[:, j]
            levels.append(np.unique(keys))
            state = np.searchsorted(levels[-1], keys)
        name = pa.array([names[i] for i in np.argsort(state)], pa.string())
        for batch in batches:
            done, spent = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while done < len(batch):
                # whole texts, one at least
                to = max(done + 1, int(np.searchsorted(spent, (spent[done - 1] if done else 0) + 8 * AT_ONCE, "right")))
                rows = batch.slice(done, to - done)
                split = pc.split_pattern_regex(rows.column("text"), r"[ \t\n\x0b\f\r]+")
                held, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
                code = pc.fill_null(pc.index_in(held, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                some = pc.not_equal(held, "").to_numpy(zero_copy_only=False)
                row, code = row[some], code[some]
                at = np.arange(max(len(row) - words + 1, 0))
                at = at[(code[at] >= 0) & (row[at] == row[at + words - 1])]
                found = code[at]
                for j, known in enumerate(levels, 1):
                    keys = np.where(code[at + j] >= 0, found * len(vocabulary) + code[at + j], -1)
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    same = known[place] == keys
                    at, found = at[same], place[same]
                pairs = np.unique(np.stack([row[at], found]), axis=1)
                yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(pairs[0])) for c in ("chunk_id", "text")] + [name.take(pa.array(pairs[1]))], ["chunk_id", "text", "anchor"])
                done = to

    return run


def holding(chunks: DataFrame, items: DataFrame, words: int = 3) -> DataFrame:
    """(query_id, chunk_id) of chunks (chunk_id, text) whose text holds the whole text of an item
    (query_id, item).  Candidates share the item's second to fourth word, which are whole words
    there too.  Items of fewer than ``words`` + 2 words are left out.  Up to SMALL runs of words are
    sent to all tasks, which look for them in arrays of words; beyond, all runs of a text are joined."""
    parts = items.select("query_id", "item", F.filter(F.split("item", r"\s+"), lambda w: w != "").alias("w")).filter(F.size("w") >= words + 2)
    asked = parts.select("query_id", "item", F.array_join(F.slice("w", 2, words), " ").alias("anchor"))
    anchors = asked.select("anchor").distinct().limit(SMALL + 1).toArrow()["anchor"].to_pylist()
    if not anchors or words > 1 and len(anchors) <= SMALL:
        sent, kind = chunks.sparkSession.sparkContext.broadcast(anchors), chunks.schema["chunk_id"].dataType
        near = chunks.select("chunk_id", "text").mapInArrow(_anchored(sent, words), f"chunk_id {kind.simpleString()}, text string, anchor string") if anchors else chunks.limit(0).select("chunk_id", "text", F.lit("").alias("anchor"))
        return near.join(small(asked), "anchor").filter(F.contains("text", F.col("item"))).select("query_id", "chunk_id").distinct()
    split = once(chunks, ["chunk_id", "text"], w=F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1)))
    grams = split.select("chunk_id", "text", F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("w", i, words), " ")))).alias("anchor"))
    return grams.join(small(asked), "anchor").filter(F.contains("text", F.col("item"))).select("query_id", "chunk_id").distinct()
