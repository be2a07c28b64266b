"""The saved index: loaded while it serves, built anew when it doesn't."""

from pathlib import Path

import pytest

from clausemill.operators import retrieval as rt
from clausemill.sources.saved import swapped_in

ROWS = [(1, "the fee is due"), (2, "fee fee 정산 내역"), (3, ""), (4, None), (5, "The late fee, and the due date")]


def chunks_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "chunk_id int, text string")


def stamp(path):
    return sorted((p.name, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet"))


@pytest.fixture
def path(spark, tmp_path):
    rt.save_index(chunks_of(spark), f"file://{tmp_path}/index")
    return tmp_path / "index"


def test_scores_equal_those_without_an_index(spark, path):
    queries = spark.createDataFrame([("q1", "late fee fee"), ("q2", "정산"), ("q3", ""), ("q4", "unknown")], "query_id string, text string")
    index = rt.load_index(spark, f"file://{path}")
    got = sorted(tuple(r) for r in rt.bm25(index, queries).collect())
    assert got and got == sorted(tuple(r) for r in rt.search(chunks_of(spark), queries).collect())
    assert (index.n_docs, {r.term: r.df for r in index.terms.collect()}["fee"]) == (5, 3)


def test_an_index_that_serves_is_loaded(spark, path):
    before = stamp(path)
    index = rt.load_or_build(chunks_of(spark, ROWS[::-1]).repartition(3), f"file://{path}")  # the order of rows doesn't count
    assert stamp(path) == before and index.postings.count() > 0


@pytest.mark.parametrize("rows", [ROWS[:-1], [*ROWS, ROWS[0]], [(1, "the fee is paid"), *ROWS[1:]], [(2, ROWS[0][1]), (1, ROWS[1][1]), *ROWS[2:]]])
def test_another_corpus_is_built_anew(spark, path, rows):
    before = stamp(path)
    index = rt.load_or_build(chunks_of(spark, rows), f"file://{path}")
    assert stamp(path) != before and index.n_docs == len(rows)
    want = {(r.chunk_id, r.term): r.tf for r in rt.term_counts(chunks_of(spark, rows), "chunk_id").collect()}
    assert {(r.chunk_id, r.term): r.tf for r in index.postings.collect()} == want


def damage_meta(path):
    for p in (path / "meta").iterdir():
        p.unlink()


def damage_postings(path):
    next((path / "postings").glob("*.parquet")).unlink()


def cut_terms(path):
    for p in (path / "terms").glob("*.parquet"):
        p.write_bytes(p.read_bytes()[:-20])
    for p in (path / "terms").glob(".*.crc"):
        p.unlink()


@pytest.mark.parametrize("damage", [damage_meta, damage_postings, cut_terms])
def test_a_damaged_index_is_built_anew(spark, path, damage):
    damage(path)
    with pytest.raises(rt.IndexMismatch):
        rt.load_index(spark, f"file://{path}")
    assert rt.load_or_build(chunks_of(spark), f"file://{path}").postings.count() == rt.term_counts(chunks_of(spark), "chunk_id").count()


def test_another_version_is_built_anew(spark, path, monkeypatch):
    monkeypatch.setattr(rt, "INDEX_VERSION", 99)
    with pytest.raises(rt.IndexMismatch):
        rt.load_index(spark, f"file://{path}")
    rt.load_or_build(chunks_of(spark), f"file://{path}")
    assert spark.read.parquet(f"file://{path}/meta").first().schema_version == 99


def test_a_build_that_fails_leaves_the_old_index(spark, path):
    before = stamp(path)

    def write(folder):
        spark.range(3).write.parquet(f"{folder}/postings")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        swapped_in(spark, f"file://{path}", write)
    assert stamp(path) == before and [p.name for p in path.parent.iterdir()] == ["index"]


def test_empty_corpus(spark, tmp_path):
    index = rt.load_or_build(chunks_of(spark, []), f"file://{tmp_path}/index")
    assert (index.n_docs, index.avg_length, index.postings.count()) == (0, 0.0, 0)


def test_chunks_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    rows = [(1, []), (1, ["b", "a", "b"]), (2, []), (3, ["a"]), (3, ["c", "a"]), (3, ["a"]), (None, ["x"]), (None, ["y", "x"])]
    want = [(1, 3, ["b", "a"], [2, 1]), (3, 1, ["a", "c"], [3, 1]), (None, 1, ["x", "y"], [2, 1])]
    for most, size in ((1 << 20, 8), (1, 8), (2, 3), (1, 1)):
        monkeypatch.setattr(rt, "AT_ONCE", most)
        cut = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), (pa.int64(), pa.list_(pa.string())))], ["chunk_id", "words"]) for i in range(0, len(rows), size)]
        got = list(rt._counted(pa.int64())(iter(cut)))
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    assert max(map(len, got)) == 1  # no more words at once than asked for


def test_only_texts_with_hangul_are_looked_through_word_by_word(spark):
    from pyspark.sql import functions as F

    from clausemill.functions import text as tx

    df = spark.createDataFrame([("A fee",), ("fee 정산내 fee",), ("",), (None,)], "text string").select(tx.tokens(F.col("text")).alias("w"))
    assert [r.w for r in df.collect()] == [["a", "fee"], ["fee", "정산내", "정산", "산내", "정산내", "fee"], [], []]
    assert "CASE WHEN" in df._jdf.queryExecution().analyzed().toString().split("transform(")[0]
