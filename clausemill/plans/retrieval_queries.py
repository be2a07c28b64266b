"""Retrieval and text queries over documents, benchmark, conversations and embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import KOREAN
from ..functions import text as tx
from ..operators import retrieval as rt
from ..sources.readers import read_table
from ..sources.saved import shared_folder
from .registry import query

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[가-힣]+')"
_TIER = "['A0', 'A1', 'A2', 'B', 'C'][1 + CAST(substr(source, 4) AS INTEGER) % 5]"

INDEX_SQL = f"""
d AS (SELECT doc_id AS chunk_id, {TOKENS} AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d),
p AS (SELECT chunk_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT chunk_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))), 6) AS score, count(*) AS matched
      FROM q JOIN t USING (term) JOIN p USING (term) CROSS JOIN n GROUP BY ALL),
c AS (SELECT doc_id AS chunk_id, lang, source, {_TIER} AS tier, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'g' || (doc_id % 37) END AS grp, 2010 + doc_id % 15 AS yr FROM documents)
"""


def index_of(spark, sf):
    """The saved index of all documents, below the shared folder."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return rt.load_or_build(docs, f"{shared_folder(spark)}/indexes/{hashlib.sha256(sf.encode()).hexdigest()[:16]}")


def scored(spark, sf, chunks=None):
    """BM25 of each benchmark item against all documents, with columns of ``chunks``."""
    return rt.bm25(index_of(spark, sf), read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), digits=6, chunks=chunks)


def scored_with_sample(spark, sf, chunks):
    """BM25 as of ``scored``, that of a few chunks alone, which parts the rankings, and whether queries are few."""
    index, queries = index_of(spark, sf), read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    some = rt.part_sample(chunks, index.n_docs)
    few = queries.limit(rt.SMALL + 1).count() <= rt.SMALL
    return rt.bm25(index, queries, digits=6, chunks=chunks), rt.bm25(index, queries, digits=6, chunks=some), few


def chunk_table(spark, sf):
    k = F.col("doc_id")
    tier = F.element_at(F.array(*map(F.lit, ("A0", "A1", "A2", "B", "C"))), F.substring("source", 4, 9).cast("int") % 5 + 1)
    return read_table(spark, sf, "documents").select(
        k.alias("chunk_id"), "lang", "source", tier.alias("authority_tier"), F.when(tier.startswith("A"), "evidence").otherwise("practice").alias("chunk_type"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("g"), k % 37)).alias("conflict_group"), (2010 + k % 15).alias("source_year"), F.array("lang").alias("risk_categories"), F.col("source").alias("canonical_id"),
    )


@query(f"WITH {INDEX_SQL} SELECT query_id, chunk_id, score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3")
def bm25_topk_documents(spark, sf):
    return rt.top_k(scored(spark, sf), 3)


@query(f"WITH {INDEX_SQL} SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_position(['A0','A1','A2','B','C'], tier), chunk_id) AS rank FROM s JOIN c USING (chunk_id) WHERE lang = 'en' AND tier IN ('A0', 'A1')) WHERE rank <= 5")
def bm25_filtered_topk(spark, sf):
    """Filters bear on candidates alone, after the statistics."""
    wanted = rt.kept(chunk_table(spark, sf), categories=("en",), tiers=("A0", "A1"))
    hits = scored(spark, sf, wanted.select("chunk_id", "authority_tier"))
    return rt.top_k(hits, 5, ties=[tx.tier_order(F.col("authority_tier"))]).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {INDEX_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM t CROSS JOIN n")
def doc_frequency(spark, sf):
    return index_of(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_length, max(n) AS longest FROM (SELECT lang, len({TOKENS}) AS n FROM documents) GROUP BY lang")
def token_length_stats(spark, sf):
    n = F.size(tx.tokens(F.col("text")))
    return read_table(spark, sf, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("avg_length"), F.max("n").cast("long").alias("longest"))


_KO = "[" + ", ".join(f"'{p}'" for p in KOREAN) + "]"


@query(f"""
WITH t AS (SELECT o_orderkey AS id, {_KO}[1 + o_orderkey % {len(KOREAN)}] || ' ' || o_orderpriority || ' ' || {_KO}[1 + o_custkey % {len(KOREAN)}] AS text FROM orders),
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+')) AS x FROM t),
g AS (SELECT id, x AS token FROM w UNION ALL
      SELECT id, substr(x, i, n) FROM (SELECT id, x, n, unnest(generate_series(1, length(x) - n + 1)) AS i FROM w, (VALUES (2), (3)) v(n) WHERE regexp_matches(x, '^[가-힣]') AND length(x) >= n))
SELECT id, token, count(*) AS tf FROM g GROUP BY ALL
""")
def hangul_ngram_tokens(spark, sf):
    """Of a mixed text for each order."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, KOREAN)), (F.col(k) % len(KOREAN) + 1).cast("int"))
    text = F.concat_ws(" ", pick("o_orderkey"), "o_orderpriority", pick("o_custkey"))
    rows = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.explode(tx.tokens(text)).alias("token"))
    return rows.groupBy("id", "token").agg(F.count("*").alias("tf"))


@query(f"""
WITH {INDEX_SQL}, r AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s),
b AS (SELECT query_id, min(rank) AS best FROM r LEFT JOIN k USING (query_id, chunk_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN best <= 3 THEN 1 ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN best <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5 FROM b
""")
def recall_at_k(spark, sf):
    """Share of items that the retrieval finds in a document holding them."""
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    relevant = rt.holding(docs, items)
    ranked = rt.top_k(scored(spark, sf), 5)
    return rt.recall_at(ranked, relevant)


@query(f"WITH {INDEX_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS m FROM s JOIN c USING (chunk_id)) SELECT query_id, source AS canonical_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f WHERE m = 1) WHERE rank <= 4")
def canonical_first_hit(spark, sf):
    hits = scored(spark, sf, chunk_table(spark, sf).select("chunk_id", "canonical_id"))
    return rt.first_by_canonical(hits, 4).select("query_id", "canonical_id", "chunk_id", "score", "rank")


@query(f"""
WITH {INDEX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_position(['A0','A1','A2','B','C'], tier), chunk_id) AS rank FROM s JOIN c USING (chunk_id)),
g AS (SELECT DISTINCT query_id, grp FROM r WHERE rank <= 3 AND grp <> '')
SELECT query_id, chunk_id, grp AS conflict_group, score, rank FROM r LEFT JOIN (SELECT *, true AS sib FROM g) USING (query_id, grp) WHERE rank <= 3 OR sib
""")
def conflict_sibling_topk(spark, sf):
    hits, *how = scored_with_sample(spark, sf, chunk_table(spark, sf).select("chunk_id", "authority_tier", "chunk_type", "conflict_group"))
    return rt.with_conflict_siblings(hits, 3, *how).select("query_id", "chunk_id", "conflict_group", "score", "rank")


@query(f"WITH {INDEX_SQL} SELECT chunk_id, grp AS conflict_group, row_number() OVER (PARTITION BY grp ORDER BY yr DESC NULLS LAST, list_position(['A0','A1','A2','B','C'], tier), chunk_id) AS precedence_rank FROM c WHERE grp <> ''")
def precedence_rank(spark, sf):
    return rt.precedence(chunk_table(spark, sf).filter("conflict_group <> ''")).select("chunk_id", "conflict_group", "precedence_rank")


@query(f"WITH {INDEX_SQL} SELECT lang, grp AS conflict_group, count(*) AS members, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY yr DESC NULLS LAST, list_position(['A0','A1','A2','B','C'], tier), chunk_id) AS chunk_ids FROM c WHERE grp <> '' GROUP BY ALL HAVING count(*) >= 2")
def conflict_sets(spark, sf):
    found = rt.conflict_sets(chunk_table(spark, sf), "lang")
    return found.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ","))


@query(f"""
WITH {INDEX_SQL}, j AS (SELECT * FROM s JOIN c USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_position(['A0','A1','A2','B','C'], tier), chunk_id) AS rank FROM j WHERE tier LIKE 'A%'),
g AS (SELECT DISTINCT query_id, grp, true AS sib FROM r WHERE rank <= 2 AND grp <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_position(['A0','A1','A2','B','C'], tier), chunk_id) AS rank FROM j WHERE tier IN ('B', 'C'))
SELECT query_id, 'grounding' AS "use", chunk_id, rank AS original_rank FROM r LEFT JOIN g USING (query_id, grp) WHERE rank <= 2 OR sib
UNION ALL SELECT query_id, 'explanation', chunk_id, rank FROM e WHERE rank <= 3
""")
def dual_gated_retrieval(spark, sf):
    hits, *how = scored_with_sample(spark, sf, chunk_table(spark, sf).select("chunk_id", "authority_tier", "chunk_type", "conflict_group"))
    return rt.gated_retrieval(hits, 2, 3, *how).select("query_id", "use", "chunk_id", "original_rank")


@query(f"""
WITH a AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS w FROM conversations),
p AS (SELECT x.conv_id, x.turn, y.turn AS other, len(list_intersect(x.w, y.w)) / greatest(len(list_distinct(list_concat(x.w, y.w))), 1) AS j FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn > x.turn)
SELECT conv_id, turn, other, round(j, 6) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(j, 6) DESC, other) AS rank FROM p
""")
def jaccard_rerank(spark, sf):
    """Later turns of a conversation reranked by their words' overlap with a turn."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    pairs = turns.join(turns.select("conv_id", F.col("turn").alias("other"), F.col("w").alias("v")), "conv_id").filter("other > turn")  # turns of one conversation
    out = pairs.select("conv_id", "turn", "other", F.round(tx.jaccard(F.col("w"), F.col("v")), 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.col("score").desc(), "other")))


_WORDS = ("the", "de", "ing", "en")


@query("""
WITH c AS (SELECT doc_id, [(length(lower(text)) - length(replace(lower(text), w, ''))) / length(w) for w in ['the', 'de', 'ing', 'en']] AS n FROM documents)
SELECT doc_id, round(n[1] / greatest(list_sum(n), 1), 6) AS e0, round(n[2] / greatest(list_sum(n), 1), 6) AS e1, round(n[3] / greatest(list_sum(n), 1), 6) AS e2, round(n[4] / greatest(list_sum(n), 1), 6) AS e3 FROM c
""")
def keyword_embedding(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.keyword_embedding(F.col("text"), _WORDS).alias("e")).select("doc_id", *(F.get("e", F.lit(k)).alias(f"e{k}") for k in range(4)))


@query("""
WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT qid, vec_id, round(list_sum([CAST(x.a AS DOUBLE) * CAST(x.b AS DOUBLE) for x in list_transform(list_zip(q.e, v.embedding), lambda z: struct_pack(a := z[1], b := z[2]))]), 4) AS score FROM q, embeddings v WHERE vec_id <> qid)) WHERE rank <= 5
""")
def embedding_dot_topk(spark, sf):
    """Five nearest rows of each row whose id is divisible by 50, by comparison with all."""
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e"))
    return rt.nearest_by_product(vectors, asked, 5)


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {TOKENS} AS w FROM conversations),
p AS (SELECT u.conv_id, u.turn, a.turn AS finding, len(list_intersect(list_distinct(u.w), list_distinct(a.w))) AS overlap FROM t u JOIN t a ON u.conv_id = a.conv_id WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, arg_max(finding, overlap * 1000 - finding) AS finding, max(overlap) AS overlap FROM p WHERE overlap > 0 GROUP BY ALL
""")
def best_match_finding(spark, sf):
    """The answer that shares most words with a user's turn; the first of equals; none without overlap."""
    t = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    pairs = t.filter("role = 'user'").join(t.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("finding"), F.col("w").alias("v")), "conv_id")
    pairs = pairs.select("conv_id", "turn", "finding", F.size(F.array_intersect("w", "v")).cast("long").alias("overlap")).filter("overlap > 0")
    return pairs.groupBy("conv_id", "turn").agg(F.max_by("finding", F.struct("overlap", -F.col("finding"))).alias("finding"), F.max("overlap").alias("overlap"))


@query(f"""
WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), i AS (SELECT doc_id, list_distinct(w[1 : len(w) // 2]) AS a, list_distinct(w[len(w) // 2 + 1 :]) AS b FROM d)
SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS iou FROM i
""")
def token_iou(spark, sf):
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(tx.TOKEN), F.lit(0))
    """Overlap of the words of a document's two halves."""
    half = F.floor(F.size("w") / 2).cast("int")
    rows = tx.once(read_table(spark, sf, "documents"), ["doc_id"], w=w)
    return rows.select("doc_id", F.round(tx.jaccard(F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w")), 1.0), 6).alias("iou"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'num' END AS tag FROM documents
""")
def language_tag(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.language_tag(F.col("text")).alias("tag"))


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a FROM documents), u AS (SELECT doc_id, trim(a) AS a, trim(regexp_replace(replace(trim(a), 'e', 'o'), '\\s+', ' ', 'g')) AS b FROM t)
SELECT doc_id, round(CASE WHEN length(a) = 0 THEN 0 ELSE levenshtein(a, b) / length(a) END, 6) AS cer FROM u
""")
def cer_near_copies(spark, sf):
    """Character error rate of an edited copy of each whole text."""
    a = tx.squeeze(F.col("text"))
    rows = read_table(spark, sf, "documents").select("doc_id", a.alias("a")).withColumn("b", F.replace("a", F.lit("e"), F.lit("o")))
    return rows.select("doc_id", F.round(tx.char_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query()
def wer_near_copies(spark, sf):
    """Word error rate of a copy of each whole text that lacks its second word."""
    words = F.split(tx.squeeze(F.col("text")), " ")
    rows = tx.once(read_table(spark, sf, "documents"), ["doc_id"], w=words).select("doc_id", F.array_join("w", " ").alias("a"), F.array_join(F.concat(F.slice("w", 1, 1), F.slice("w", F.lit(3), F.size("w"))), " ").alias("b"))
    return rows.select("doc_id", F.round(tx.word_error_rate(F.col("a"), F.col("b")), 6).alias("wer"))


@query("""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
e AS (SELECT doc_id, unnest(s) AS x, unnest(generate_series(1, len(s))) AS i FROM s), k AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id, regexp_replace(x, '[\\s.!?]', '', 'g') ORDER BY i) AS n FROM e)
SELECT doc_id, count(*) AS kept, sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM k WHERE n = 1 GROUP BY doc_id
""")
def dedupe_lines(spark, sf):
    """Lines that differ in white space and end marks alone are kept once, the first."""
    lines = F.filter(F.transform(F.split("text", "\n+"), lambda x: F.trim(x)), lambda s: s != "")
    rows = read_table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("i", "x"))
    first = Window.partitionBy("doc_id", F.regexp_replace("x", r"[\s.!?]", "")).orderBy("i")
    kept = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]), " ")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sha2(text, 256).alias("digest"))


@query()
def limit_sentences(spark, sf):
    """The first two sentences after repeated ones went."""
    return tx.distinct_sentences(read_table(spark, sf, "documents"), "doc_id", 2).withColumnRenamed("text", "summary")


@query("""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[mail]', 'g'), '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[ip]', 'g'), '[0-9]{7,}', '[number]', 'g')) AS digest FROM documents
""")
def sanitize_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(tx.mask_personal(F.col("text")), 256).alias("digest"))


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS snippet, 'doc-' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || 'None' || '|' || lang), 1, 12) AS stable_id, lower(regexp_replace(regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM t JOIN documents USING (doc_id)
""")
def snippets_and_ids(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.stable_id("doc", F.col("doc_id"), F.lit(None).cast("string"), F.col("lang")).alias("stable_id"), tx.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"))


@query(f"""
WITH {INDEX_SQL}, a AS (SELECT query_id, source, max(score) AS m FROM s JOIN c USING (chunk_id) WHERE lang = 'en' GROUP BY ALL), b AS (SELECT query_id, source, max(score) AS m FROM s JOIN c USING (chunk_id) WHERE lang <> 'en' GROUP BY ALL),
x AS (SELECT query_id, list(source ORDER BY source) AS l FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, source) AS r FROM a) WHERE r <= 3 GROUP BY 1), y AS (SELECT query_id, list(source ORDER BY source) AS l FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, source) AS r FROM b) WHERE r <= 3 GROUP BY 1)
SELECT query_id, len(list_intersect(x.l, y.l)) AS shared, round(len(list_intersect(x.l, y.l)) / greatest(len(list_distinct(list_concat(x.l, y.l))), 1), 6) AS agreement FROM x JOIN y USING (query_id)
""")
def koen_consistency(spark, sf):
    """Agreement of the best three canonical sources over two halves of a corpus by language."""
    hits = scored(spark, sf, chunk_table(spark, sf).select("chunk_id", "lang", "canonical_id"))
    best = hits.groupBy("query_id", (F.col("lang") == "en").alias("side"), "canonical_id").agg(F.max("score").alias("m"))
    w = Window.partitionBy("query_id", "side").orderBy(F.col("m").desc(), "canonical_id")
    tops = best.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("query_id").pivot("side", [True, False]).agg(F.collect_set("canonical_id")).toDF("query_id", "a", "b")
    tops = tops.filter("size(a) > 0 AND size(b) > 0")
    return tops.select("query_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("agreement"))


_OPENERS = ("", "Here is the reply: ", "창작자님, 답변은 다음과 같습니다: ", "The answer to your question is this. Here's more: ", "정산에 대해 물어보세요. ", "  답변: 아래와 같습니다. ")


def _peeled_sql(column: str) -> str:
    for p in tx.PREAMBLES:
        column = f"ltrim(regexp_replace({column}, '{p.replace(chr(39), chr(39) * 2)}', ''), E' \\t\\n\\r\\x0b\\x0c')"
    return column


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, {list(_OPENERS[:3])!r}[1 + CAST(turn % 3 AS INTEGER)] || {[x.replace("'", "’") for x in _OPENERS[3:]]!r}[1 + CAST(conv_id % 3 AS INTEGER)] || coalesce(text, '') AS whole FROM conversations),
r(conv_id, turn, whole, x, i) AS (SELECT conv_id, turn, whole, ltrim(whole, E' \t\n\r\x0b\x0c'), 0 FROM t UNION ALL SELECT conv_id, turn, whole, {_peeled_sql("x")}, i + 1 FROM r WHERE i < 4)
SELECT conv_id, turn, CASE WHEN trim(x, E' \t\n\r\x0b\x0c') <> '' THEN trim(x, E' \t\n\r\x0b\x0c') ELSE trim(whole, E' \t\n\r\x0b\x0c') END AS text FROM r WHERE i = 4
""")
def stripped_preambles(spark, sf):
    """Turns behind one or two openers."""
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col(k) % 3 + 1).cast("int"))
    whole = F.concat(pick(_OPENERS[:3], "turn"), pick([x.replace("'", "’") for x in _OPENERS[3:]], "conv_id"), F.coalesce("text", F.lit("")))
    return read_table(spark, sf, "conversations").select("conv_id", "turn", tx.without_preamble(whole).alias("text"))
