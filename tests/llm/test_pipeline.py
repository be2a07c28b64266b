import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from clausemill.llm import decontaminate, quality, token_output
from clausemill.llm.common import save, table
from clausemill.llm.jaccard_join import linked, shingle_sets
from clausemill.llm.words import WordHasher

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(spark):
    import pyarrow as pa

    docs = table(spark, SF, "documents")
    outs = [docs]
    for _, stage in P.STAGES[:-1]:
        outs.append(save(stage(spark, outs[-1], SF)))
        assert outs[-1].columns == docs.columns
    first, good, unique, clean, mixed = ([r.asDict() for r in x.collect()] for x in outs)
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, table(spark, SF, "labels")).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, p in scores.items() if p) and len(good) < len(first)
    # no two kept documents are near duplicates, and each that went has a link among the good ones
    sets = dict(zip([r["doc_id"] for r in good], shingle_sets(pa.array([r["text"] for r in good]), WordHasher())))
    kept = {r["doc_id"] for r in unique}
    for i in sets:
        mates = [j for j in sets if j != i and len(sets[i]) and linked(sets[i], sets[j])]
        assert mates if i not in kept else not (set(mates) & kept)
    windows = {w for r in table(spark, SF, "benchmark").collect() for w in decontaminate.item_windows(r.text)}
    hit = {r["doc_id"] for r in unique if any(w in windows for w in decontaminate.item_windows(r["text"]))}
    assert {r["doc_id"] for r in clean} == kept - hit
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in clean}
    tok = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    got = sorted((tuple(r) for r in P.token_stage(spark, outs[-1], SF).collect()), key=lambda r: r[1])
    start = 0
    by_id = {r["doc_id"]: r["text"] for r in clean}
    for i, s, n, crc in got:
        ids = tok.encode(by_id[i], add_special_tokens=False).ids + [1]
        assert (s, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert [r[0] for r in got] == sorted(r["doc_id"] for r in mixed)


def test_mixing_keeps_every_row(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    lost = docs.select("doc_id").exceptAll(P.mixing_stage(spark, docs, "/root/testdata/sf0.1").select("doc_id").distinct())
    assert docs.count() == docs.select("doc_id").distinct().count() and lost.count() == 0


CLASHING = ("row", "th", "score", "label", "domain", "n_words", "items", "component", "tokens", "features")


def odd_rows(spark):
    """Documents with columns whose names the operators use themselves, and rows of every odd kind."""
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents")
    good = max((r for r in docs.collect() if r.doc_id % 3 == 0 and r.n_chars > 1500 and "http" not in r.text), key=lambda r: r.n_chars)
    odd = [
        (9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, " \n\t", "de", None, 3), (None, good.text + " and one more ending", None, "src1", None), (None, None, None, None, None),
        (9004, good.text + "\n" + "A sentence that goes on, and on. " * 40_000, "en", "src2", 1), (9005, good.text[::-1], "fr", "src3", 7), *[(9006, good.text, "es", "src3", 7)] * 3, (9007, "x", "es", "src3", 1),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def test_odd_rows_and_clashing_columns_through_all_stages(spark):
    docs = save(odd_rows(spark))
    outs = [docs]
    for name, stage in P.STAGES[:-1]:
        outs.append(save(stage(spark, outs[-1], SF)))
        assert outs[-1].columns == docs.columns, name
        assert outs[-1].distinct().exceptAll(outs[-2].distinct()).count() == 0, name  # rows as they were
    assert outs[1].filter("doc_id IS NULL").count() >= 1  # a null id is no reason to go
    unique = outs[2].filter("text IS NOT NULL AND trim(text) <> ''")
    assert unique.groupBy("doc_id", "text").count().filter("count > 1").count() == 0  # repeated rows: one stays
    assert outs[4].select("doc_id", "text").distinct().count() == outs[3].select("doc_id", "text").distinct().count()  # mixing drops nothing
    digest = P.token_stage(spark, outs[4], SF).collect()
    assert len(digest) == outs[4].count() and min(r.start for r in digest) == 0 and all(r.n_tokens >= 1 for r in digest)


def test_empty_documents_through_all_stages(spark):
    docs = save(odd_rows(spark).limit(0))
    for _, stage in P.STAGES:
        docs = save(stage(spark, docs, SF))
        assert docs.count() == 0
    assert docs.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
