"""Readers over files written here, chunk projections, and typed loads."""

import pytest
from pyspark.sql import functions as F

from clausemill.sources import readers as rd
from clausemill.sources import sinks
from clausemill.sources import typed as ty


def written(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return f"file://{path}"


def test_csv_with_mark_quotes_and_line_ends(spark, tmp_path):
    path = written(tmp_path, "a.csv", '﻿id, title\r\n1,"a ""b"", c\nd"\r\n2,\r\n')
    df = rd.read_csv(spark, path, ["id", "title"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "b", c\nd'), ("2", None)] and set(dict(df.dtypes).values()) == {"string"}
    with pytest.raises(ValueError, match="lacks the columns year"):
        rd.read_csv(spark, path, ["id", "year"])
    with pytest.raises(rd.EmptySource):
        rd.read_csv(spark, written(tmp_path, "b.csv", "id,title\n"), ["id"])


def test_json_lines(spark, tmp_path):
    path = written(tmp_path, "a.jsonl", '{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    assert [tuple(r) for r in rd.read_jsonl(spark, path, "id int, t string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.read_jsonl(spark, written(tmp_path, "b.jsonl", '{"id": 1}\nnot json\n'), "id int").collect()
    with pytest.raises(rd.EmptySource):
        rd.read_jsonl(spark, written(tmp_path, "c.jsonl", "\n"), "id int")


def test_yaml_and_binary(spark, tmp_path):
    path = written(tmp_path, "rules.yaml", "rules:\n- {id: R1, weight: 0.5}\n- {id: R2, weight: 1.0}\n")
    assert [tuple(r) for r in rd.read_yaml_rows(spark, path, "rules", "id string, weight double").collect()] == [("R1", 0.5), ("R2", 1.0)]
    written(tmp_path, "p.png", b"\x89PNG")
    (row,) = rd.read_binary(spark, f"file://{tmp_path}", "*.png").collect()
    assert row.length == 4 and bytes(row.content) == b"\x89PNG" and len(row.filename_hash) == 64


def test_ocr_rows_and_page_means(spark):
    line = lambda conf, text: "\t".join(["5", "1", "1", "1", "1", "1", "10", "20", "0", "8", str(conf), text])
    rows = spark.createDataFrame([(1, line(90, "fee")), (1, line(-1, "")), (1, line("x", "bad")), (1, line(-1, "low")), (1, line(70.0, "due")), (2, line(50, "end")), (2, "short")], "page int, line string")
    spans = rd.parse_ocr_tsv(rows)
    assert sorted((r.page, r.text, r.confidence, r.w) for r in spans.collect()) == [(1, "due", 0.7, 1), (1, "fee", 0.9, 1), (2, "end", 0.5, 1)]
    assert {r.page: (r.confidence, r.spans) for r in rd.merge_pages([spans, spans.filter("page = 2")]).collect()} == {1: (0.8, 2), 2: (0.5, 2)}


def test_chunks_of_four_sources(spark):
    base = {"source_ids": "A1-3; A1-9", "risk_categories": "F1,F2", "public": "yes"}
    evidence = rd.evidence_chunks(spark.createDataFrame([{"evidence_id": "E1", "title": "T", "summary": "S", **base}]))
    glossary = rd.glossary_chunks(spark.createDataFrame([{"canonical_id": "fee", "ko": "수수료", "en": " ", "alias": "charge", "caveat": "not equal", **base, "source_ids": "B-1"}]))
    cards = rd.card_chunks(spark.createDataFrame([{"card_id": "K1", "title": "T", "text": "X", **base, "source_ids": "B-1|C-2"}]))
    lists = rd.checklist_chunks(spark.createDataFrame([{"item_id": "C1", "question": "Q?", "answer": "A", **base, "source_ids": "C-2", "risk_categories": "F3"}]))
    got = {r.chunk_id: r for r in rd.corpus([evidence, glossary, cards, lists]).collect()}
    assert set(got) == {"E1", "GL-fee", "K1", "CL-C1"}
    assert {k: (r.chunk_type, r.authority_tier, r.score_eligible) for k, r in got.items()} == {"E1": ("evidence", "A1", True), "GL-fee": ("glossary", "B", False), "K1": ("card", "B/C", False), "CL-C1": ("checklist", "C", False)}
    assert got["GL-fee"].text == "수수료 charge not equal" and got["CL-C1"].text == "Q? A" and got["E1"].source_ids == ["A1-3", "A1-9"] and got["E1"].public_export
    assert rd.chunk_violations(rd.corpus([evidence, glossary, cards, lists])).count() == 0
    assert rd.count_check({"e": evidence}, {"e": 2}) == {"e": (1, 2)}


def test_bad_rows_come_back_with_reasons(spark, tmp_path):
    good = '{"canonical_id": "a", "ko": "가", "caveat": "c", "is_evidence": false}'
    lines = [good, "", "[1", '{"canonical_id": " ", "ko": "가", "caveat": "c", "is_evidence": "maybe"}', '{"canonical_id": "b", "ko": "나", "caveat": "c", "is_evidence": true, "en": "x"}', '"text"']
    rows = ty.read_typed_jsonl(spark, written(tmp_path, "g.jsonl", "\n".join(lines)), ty.GLOSSARY)
    ok, bad = ty.split_rows(rows)
    assert [(r.canonical_id, r.is_evidence) for r in ok.collect()] == [("a", False)]
    assert sorted(r.problems for r in bad.collect()) == [["canonical_id: missing", "is_evidence: not boolean"], ["is_evidence: may not be evidence"], ["line: not an object"], ["line: not an object"]]
    counts = {r.source: (r.good, r.bad, r.problem) for r in ty.counts_by_source({"g": rows, "none": rows.limit(0)}, {"g": 2, "none": 0}).collect()}
    assert counts == {"g": (1, 4, "expected 2"), "none": (0, 0, "no rows")}


def test_rules_of_the_four_sources(spark):
    evidence = {"evidence_id": "E", "title": "T", "summary": "short", "authority_tier": "A1", "source_ids": "A1-2", "risk_categories": "F1", "year": "2024"}
    card = {"card_id": "K", "text": "t", "source_ids": "B-1", "score_eligible": "false"}
    item = {"item_id": "I", "category": "F3", "question": "q", "source_ids": "C-1"}
    for fields, row, broken in [
        (ty.EVIDENCE, evidence, {"summary": ("w " * 15, "too long"), "authority_tier": ("B", "not official"), "source_ids": ("B-1", "not official"), "risk_categories": (" ; ", "no category"), "year": ("1500", "out of range")}),
        (ty.CARD, card, {"source_ids": ("A1-1", "official source"), "score_eligible": ("true", "may not score")}), (ty.CHECKLIST, item, {"category": ("X1", "unknown"), "question": ("", "missing")}),
    ]:
        rows = [row, *({**row, c: v} for c, (v, _) in broken.items())]
        got = [r.problems for r in ty.typed(spark.createDataFrame([tuple(x.values()) for x in rows], list(row)), fields).collect()]
        assert got == [[], *([f"{c}: {reason}"] for c, (_, reason) in broken.items())]
    assert ty.typed(spark.createDataFrame([("E",)], ["evidence_id"]), ty.EVIDENCE).first().problems[0] == "title: missing"


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A & B", ["x", "<y>"])], "doc_id int, title string, items array<string>")
    sinks.write_bundle(rows, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/markdown").first().body == "# A & B\n\n- x\n- <y>\n"
    assert spark.read.parquet(f"file://{tmp_path}/out/html").first().body == "<h1>A &amp; B</h1><ul><li>x</li><li>&lt;y&gt;</li></ul>"
    payload = sinks.json_reports(rows, "doc_id").first()
    assert payload.payload == '{"items":["x","<y>"],"title":"A & B"}' and len(payload.payload_sha256) == 64
    assert spark.read.json(f"file://{tmp_path}/out/json").count() == 1 and rows.select(F.size("items")).first()[0] == 2
