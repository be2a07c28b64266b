"""Spelling variants: a trie self-join with active-node sets.

The vocabulary is the distinct words of a corpus that occur often enough.  Two words are near if
one insertion, deletion or replacement of a code point turns one into the other.  A word's form is
its near word of largest count, if that is at least twice its own; forms lead on to a root.

A trie's node w has as its active nodes those at distance one.  They follow from those of the
node u above it, w being u and the code point c: the c-children of u's active nodes, u itself,
u's other children and w's children.  Where w and an active node both end a word, the pair is near.

The trie is partitioned by prefixes.  Of a near pair whose shorter word has c code points the
words share their first f = c // 2 or their last c - f code points, so each word goes to the
subtrie of its first f and to that of its last c - f code points, for the two values of c that
its length allows.  Pairs that the first kind of subtrie gives are left out of the second, so each
pair comes once.  A subtrie of more than WEIGHT code points is partitioned again by the same rule
on what its words don't share; once that is one or two code points, there are at most 90 + 90^2
different words, so that no subtrie stays large and none is cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, free_shuffles, save

#: Least code points and least occurrences of a word.
SHORTEST, LEAST = 5, 3
#: One (document, run) pair in so many loses a code point.
SLIPS = 97
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
#: Words that a task holds before it hands its counts on.
HELD = 1 << 17
#: Most code points of a subtrie that one task builds (more than 90 + 2 * 90^2).
WEIGHT = 1 << 16
_ROW = "word string, n long"


def _counted(batches):
    """(word, n): counts of this task, handed on whenever HELD words are reached."""
    total: Counter[str] = Counter()

    def handed_on():
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{doc_id}:".encode())
            # bytes.lower() changes A-Z alone
            for run, k in Counter(_RUN.findall(text.as_py().lower().decode())).items():
                h = zlib.crc32(run.encode(), seed)
                if h % SLIPS == 0:
                    i = h % len(run)
                    run = run[:i] + run[i + 1 :]
                    if len(run) < SHORTEST:
                        continue
                total[run] += k
            if len(total) >= HELD:
                yield handed_on()
    if total:
        yield handed_on()


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n) of the words of SHORTEST code points and LEAST occurrences or more."""
    docs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counted, _ROW).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def trie_pairs(words: list[str]):
    """Pairs (i, j), i < j, of distinct words at distance one, by active-node sets."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        node = 0
        for c in word:
            down = children[node].get(c)
            if down is None:
                down = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = down
        ends[node] = i
    stack = [(0, set(children[0].values()))]
    while stack:
        u, active = stack.pop()
        if (i := ends[u]) >= 0:
            for v in active:
                if ends[v] > i:
                    yield i, ends[v]
        for c, w in children[u].items():
            of_w = {children[v][c] for v in active if c in children[v]}
            of_w.update(children[u].values(), children[w].values())
            of_w.add(u)
            of_w.discard(w)
            stack.append((w, of_w))


def _near(batches):
    """(word, near, near_n), both ways, of subtries (rows that come sorted by grp)."""

    def work(rows):
        _, floor, skip, *_ = rows[0]
        rests = [word[lo:hi] for _, _, _, word, _, lo, hi in rows]
        for i, j in trie_pairs(rests):
            a, b = (rests[i], rests[j]) if len(rests[i]) <= len(rests[j]) else (rests[j], rests[i])
            # two words of a length above the subtrie's meet in another one
            if len(a) == floor and not (skip and b.startswith(a)):
                yield rows[i][3], rows[j][3], rows[j][4]
                yield rows[j][3], rows[i][3], rows[i][4]

    def batch_of(found):
        words, near, n = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    rows, found = [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "floor", "skip", "word", "n", "lo", "hi"))):
            if rows and rows[0][0] != row[0]:
                found.extend(work(rows))
                rows = []
                if len(found) > 10_000:
                    yield batch_of(found)
                    found = []
            rows.append(row)
    if rows:
        found.extend(work(rows))
    yield batch_of(found)


def _partitioned(rows: DataFrame) -> DataFrame:
    """Rows (grp, floor, skip, word, n, lo, hi) of subtries, each once by the first half and once
    by the last half of the floor code points that the shorter word of a pair has."""
    f = F.floor(F.col("floor") / 2).cast("int")
    g = F.col("floor") - f

    def subtrie(side, key, floor, skip, lo, hi):
        return F.struct(F.concat_ws("", "grp", F.lit(side), key).alias("grp"), floor.alias("floor"), skip.alias("skip"), "word", "n", lo.alias("lo"), hi.alias("hi"))

    first = subtrie("<", F.substring(F.col("word"), F.col("lo") + 1, f), g, F.col("skip"), F.col("lo") + f, F.col("hi"))
    last = subtrie(">", F.substring(F.col("word"), F.col("hi") - g + 1, g), f, F.lit(True), F.col("lo"), F.col("hi") - g)
    return rows.select(F.inline(F.array(first, last)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), saved, of distinct ``words`` (word, n): each near pair both ways."""
    spark = words.sparkSession
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda c: c >= SHORTEST)).alias("floor")
    rows = words.select(lengths, "word", "n", F.lit(0).alias("lo"), size.alias("hi"))
    rows = rows.select(F.col("floor").cast("string").alias("grp"), "floor", F.lit(False).alias("skip"), "word", "n", "lo", "hi")
    found = []
    while True:
        rows = save(_partitioned(rows))
        held = F.col("hi") - F.col("lo")
        sizes = rows.groupBy("grp").agg(F.sum(held).alias("weight"), F.count("*").alias("m"), F.bool_or(held == F.col("floor")).alias("any"))
        wide = save(rows.join(sizes.filter("m > 1 AND any").select("grp", "weight"), "grp"))
        drop_saved(rows)
        free_shuffles(spark)
        # as many tasks as the session says: a trie takes far longer than its few bytes suggest
        light = wide.filter(F.col("weight") <= WEIGHT).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp").sortWithinPartitions("grp")
        found.append(save(light.select("grp", "floor", "skip", "word", "n", "lo", "hi").mapInArrow(_near, "word string, near string, near_n long")))
        rows = wide.filter(F.col("weight") > WEIGHT).drop("weight")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms are followed two, four, eight ... at a time.  Counts
    at least double from word to form, so there is no circle and few rounds end it."""
    known = save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not known.filter("moved").isEmpty():
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = save(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_saved(known)
        known = new
    return known.select("word", "root")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """A row for each word of the vocabulary of ``documents`` (doc_id, text): word, form (its near
    word of largest count, of equal ones the smallest in code-point order, if that count is at
    least twice the word's; else null), root (from the word along forms to the last), n, n_near
    (how many words are near) and form_n.

    Runs of A-Z, a-z and U+00C0 to U+00FF are words once A-Z is lower-cased.  Where 97 divides the
    crc32 of ``<doc_id>:<run>``, the run loses the code point at that number modulo its length (a
    null id is the empty text).  Null and empty texts have none; repeated rows count again; other
    columns are ignored; an empty table gives an empty result.
    """
    words = save(vocabulary(documents))
    free_shuffles(words.sparkSession)
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    wins = -F.col("best.k") >= 2 * F.col("n")
    forms = save(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.k")).alias("form_n")
        )
    )
    roots = _roots(forms.filter("form IS NOT NULL"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE steps(k, c, i) AS (
  SELECT k, k, 0 FROM range(256) t(k)
  UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i + 1 FROM steps WHERE i < 8
), crc AS (
  SELECT list(c ORDER BY k) AS t FROM steps WHERE i = 8
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS b
  FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda h, x: xor(h // 256, t[CAST(xor(h % 256, x) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, crc
), slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * v.n THEN b.top END AS form_n,
    CASE WHEN b.top >= 2 * v.n THEN (SELECT min(x.near) FROM near x WHERE x.word = v.word AND x.near_n = b.top) END AS form
  FROM v LEFT JOIN best b ON b.word = v.word
), walk(word, root, d) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT w.word, f.form, d + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, d) AS root FROM walk GROUP BY word
)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""
