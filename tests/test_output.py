"""Resolution of references, evaluation data and outputs on inline tables."""

import pytest

from tessera.operators import locate, output
from tessera.sources import evaluation


def test_references_are_resolved(spark):
    text = "\n".join(f"line number {i}" for i in range(1, 11))
    sources = spark.createDataFrame([("c", "p1", "f", "s1", text), ("c", "p2", "f", "s2", "other\ntext here")], "case_id string, source_path string, filename string, source_id string, text string")
    rows = [("span", "c", "p1", "", "", "a paraphrase", 2, 4), ("quote", "c", "p1", "", "", "line number 5", None, None), ("near", "c", "", "", "s2", "zz...text here", 9, 3), ("none", "c", "", "f", "", "nowhere", 90, 91), ("lost", "x", "p", "", "", "q", None, None)]
    rows.append(("quote", "d", "", "", "s1", "of another", None, None))  # the same ids in another case
    sources = sources.unionByName(spark.createDataFrame([("d", "p1", "f", "s1", "text\nof another case")], sources.schema))
    refs = spark.createDataFrame(rows, "ref_id string, case_id string, source_path string, filename string, source_id string, quote string, line_start int, line_end int")
    out = {(r.case_id, r.ref_id): r for r in locate.resolved(refs, sources).collect()}
    assert len(out) == len(rows) and (out["d", "quote"].confidence, out["d", "quote"].line_start, out["d", "quote"].excerpt) == ("exact", 2, "of another case")
    out = {k[1]: r for k, r in out.items() if k[0] != "d"}
    assert (out["span"].confidence, out["span"].line_start, out["span"].anchor_id) == ("validated_span", 2, "s1#line-2") and out["span"].excerpt.count("\n") == 2
    assert (out["quote"].confidence, out["quote"].line_start) == ("exact", 5) and out["quote"].context == "\n".join(f"line number {i}" for i in range(2, 9))
    assert (out["near"].confidence, out["near"].line_start, out["near"].source_id) == ("approximate", 2, "s2")
    assert (out["none"].confidence, out["none"].error, out["none"].source_id) == ("unmatched", "line_span_invalid_and_quote_not_found", "")
    assert (out["lost"].confidence, out["lost"].error) == ("unmatched", "source_not_found")


def test_evaluation_data(spark, tmp_path):
    main = spark.createDataFrame([(2, "q1", "c1"), (3, "q2", "c9")], "excel_row int, question string, primary_id string")
    details = spark.createDataFrame([(2, 2, "c2", "", "", "", ""), (2, 1, "c1", "", "", "", ""), (2, 3, "c1", "", "", "", "")], "excel_row int, pos int, chunk_id string, source_path string, location string, excerpt string, support string")
    rows = evaluation.items(main, details)
    assert {r.item_id: r.gold_ids for r in rows.collect()} == {"row-2": ["c1", "c2"], "row-3": []}
    assert evaluation.checked(rows, 2).count() == 2
    with pytest.raises(ValueError):
        evaluation.checked(rows)
    assert evaluation.chosen(rows, ["row-3"]).count() == 1 and evaluation.chosen(rows, limit=1).count() == 1
    with pytest.raises(ValueError):
        evaluation.chosen(rows, ["row-9"])
    (tmp_path / "r.jsonl").write_text('{"item_id":"row-2","fingerprint":"f","status":"answer_failed"}\n\n{"item_id":"row-2","fingerprint":"f","status":"judge_failed"}\n{"item_id":"row-3","fingerprint":"old","status":"scored"}\n')
    records = evaluation.checkpoint(spark, str(tmp_path / "r.jsonl"))
    assert {r.item_id: r.todo for r in evaluation.routes(rows, records, "f").collect()} == {"row-2": "judge", "row-3": "answer"}


def test_outputs(spark):
    q = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "row_index int, question string, answer string")
    a = spark.createDataFrame([(1, "succeeded", "new"), (2, "failed", "bad")], "row_index int, status string, answer string")
    assert [r.answer for r in output.backfilled(q, a).orderBy("row_index").collect()] == ["new", "old"]
    rows = spark.createDataFrame([("x", "accurate", "odd", True), ("y", "inaccurate", "correct", None)], "id string, r string, u string, usable boolean")
    assert [(r.r_label, r.u_label) for r in output.labelled(rows, ["r", "u"]).orderBy("id").collect()] == [("召回准确", "odd"), ("召回不准确", "引用正确")]
    assert [r.id for r in output.bad_cases(rows).collect()] == ["y"]
    items = spark.createDataFrame([("c", 2, "B", 1, "t3", ["z"]), ("c", 1, "A", 2, "t2", []), ("c", 1, "A", 1, "t1", ["x", "y"])], "case_id string, section_no int, section string, pos int, title string, lines array<string>")
    assert output.playbook(items).head().markdown == "# c\n\n## A\n\n### t1\n- x\n- y\n\n### t2\n\n\n## B\n\n### t3\n- z"
    results = spark.createDataFrame([("i", "scored", 90.0, "full", ["a"], "yes"), ("j", "answer_failed", None, "part", ["a", "b"], None)], "item_id string, status string, total_score double, stratum string, error_tags array<string>, answer string")
    text = output.report(results, spark.createDataFrame([("full",), ("none",)], "stratum string"))
    assert "| full | 1 | 90.0 | 1.0 |" in text and "| none | 0 | 0.0 | 0.0 |" in text and "| a | 2 |" in text
    assert [(r.item_id, r.total, r.grade, r.tags) for r in output.result_rows(results).orderBy("item_id").collect()] == [("i", 90.0, "excellent", "a"), ("j", None, "", "a；b")]
