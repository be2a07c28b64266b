import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from clausemill.llm import token_output as O
from clausemill.llm.common import scratch_dir, table


def brute(rows):
    tok, start, out = Tokenizer.from_file(public_tokenizers.path(O.TOKENIZER)), 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_edge_cases(spark):
    odd = ["", None, " ", "It's <|endoftext|>\u00a0they've  1234\x0bx\x0cy \x1c\x85 z", "e\u0301 \u0301 Σας ΣΑΣ İ", "ab" * 3000, "漢字 かな\u3000!?", "word " * 20000, "a\n\r\n\tb'll"]
    rows = [(k * 3, t, 1) for k, t in enumerate(odd)][::-1]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = [tuple(r) for r in O.encode_and_digest(df).orderBy("doc_id").collect()]
    assert got == brute((i, t) for i, t, _ in sorted(rows, key=lambda r: r[0]))


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b c"), (None, "d")], "doc_id long, text string")
    got = sorted(O.encode_and_digest(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert O.encode_and_digest(df.limit(0)).count() == 0


def test_whole_table_and_selective_reads(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    path = scratch_dir(spark)
    O.write_tokens(docs, path)
    want = brute((r.doc_id, r.text) for r in docs.orderBy("doc_id").select("doc_id", "text").collect())
    assert [tuple(r) for r in O.token_digest(spark, path).orderBy("doc_id").collect()] == want
    meta = O.read_metadata(spark, path)
    assert [tuple(r) for r in meta.orderBy("doc_id").collect()] == [w[:3] for w in want]
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()
    # ids lie in the files in ascending order of doc_id
    files = sorted(spark.read.parquet(f"{path}/ids").inputFiles())
    ids = [r.doc_id for f in files for r in spark.read.parquet(f).collect()]
    assert ids == [w[0] for w in want]


def test_files_are_encoded_as_stated(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    path = f"file://{tmp_path}/out"
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    small = O.WRITE_OPTIONS | {"parquet.block.size": str(256 << 10), "parquet.page.row.count.limit": "50", "parquet.block.row.count.limit": "200"}
    try:
        O.write_tokens(docs, path, options=small)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    (file,) = [f for f in (tmp_path / "out/ids").iterdir() if f.name.endswith(".parquet")]
    meta = pq.ParquetFile(file).metadata
    columns = {meta.schema.column(k).path.split(".")[0]: k for k in range(meta.num_columns)}
    assert meta.num_rows == 1000 and meta.num_row_groups > 1
    before = None
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        assert group.num_rows <= 200
        ids, tokens = (group.column(columns[c]) for c in ("doc_id", "tokens"))
        for name in ("doc_id", "shard_start", "n_tokens"):
            c = group.column(columns[name])
            assert "DELTA_BINARY_PACKED" in c.encodings and not c.has_dictionary_page
            assert c.has_offset_index and c.has_column_index
        assert tokens.has_dictionary_page and "RLE_DICTIONARY" in tokens.encodings and tokens.has_offset_index
        # row groups follow each other by doc_id, so that a predicate on it can pass over them
        assert before is None or ids.statistics.min > before
        before = ids.statistics.max
    asked = O.read_tokens(spark, path).filter("doc_id BETWEEN 40 AND 42")
    assert "GreaterThanOrEqual(doc_id,40)" in asked._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in asked.collect()) == [40, 41, 42]


def test_memory_of_words_is_bounded():
    path = public_tokenizers.path(O.TOKENIZER)
    tok, encode = Tokenizer.from_file(path), O.WordEncoder(path, slots=128)
    rng = np.random.default_rng(4)
    for _ in range(6):
        texts = [" ".join(f"w'{i}x, {i % 7}." for i in rng.integers(0, 60, 9)) for _ in range(5)] + [None, ""]
        (ids, ends), *more = encode(pa.array(texts))
        assert not more
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
        assert encode.table.words <= 64 and len(encode.table.ids) == 256
    assert encode.table.words > 40


def test_word_table_finds_what_was_added():
    rng, t = np.random.default_rng(5), O.WordTable(256)
    keys = rng.integers(0, 2**63, 90, np.uint64) << np.uint64(5)  # many meet in the same slots
    keys = np.unique(keys)
    for part in np.array_split(keys, 4):
        length = np.full(len(part), 2)
        t.add(part, length, np.repeat((part % np.uint64(1000)).astype(np.int32), 2))
    rows = t.find(np.append(keys, np.arange(1, 50, dtype=np.uint64)))
    assert (rows[: len(keys)] >= 0).all() and (rows[len(keys) :] < 0).all()
    assert (t.ids[t.begin[rows[: len(keys)]]] == (keys % np.uint64(1000)).astype(np.int32)).all()
    t.add(np.arange(1, 200, dtype=np.uint64), np.ones(199, np.int64), np.arange(199, dtype=np.int32))
    assert t.words == 128 and (t.find(np.arange(1, 200, dtype=np.uint64)) >= 0).sum() == 128 - len(keys)


def test_words_are_cut_where_the_tokenizer_cuts(spark):
    path = public_tokenizers.path(O.TOKENIZER)
    tok, encode = Tokenizer.from_file(path), O.WordEncoder(path)
    rng = np.random.default_rng(6)
    signs = list("abcXYZ019.,-_;:!?/\\\"'()[]{}@#$%^&*+=~`<>|é漢 \t\n")
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("ab12.-:/ "), 40)) for _ in range(2000)]
    (ids, ends), *more = encode(pa.array(texts))
    assert not more
    for got, t in zip(np.split(ids, ends[:-1]), texts):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, t
