"""Objects with renamed keys, fingerprints, evidence texts read back, and material under a budget, against loops."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tessera.functions import trees
from tessera.operators import materials, segments


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", column.alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.k)]


def test_canonical_texts_and_fingerprints(spark):
    bad = ['{"a":1}}', '{"a":1}]', "1,2", '1,"y":2', "", " ", "{", '{"a":1,"a":2}', "nonsense", None]
    assert values(spark, trees.canonical(F.col("text")), bad) == [None] * len(bad)
    good = [' { "b" : [1, {"z":null,"a":"x: \\"q\\" , y"}], "a" : "\\u5ba2" } ', '"s"', "[]", "{}", "12", "null"]
    expected = [json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for t in good]
    assert values(spark, trees.canonical(F.col("text")), good) == expected
    assert values(spark, trees.fingerprint(F.col("text")), good) == [hashlib.sha256(e.encode()).hexdigest() for e in expected]
    blanks = [json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True) for t in good]
    assert values(spark, trees.fingerprint(F.col("text"), blanks=True), good) == [hashlib.sha256(e.encode()).hexdigest() for e in blanks]


def test_keys_are_renamed_at_every_depth_and_back(spark):
    rng, names = random.Random(5), ["answer", "text", "score", "metadata", "chunk_id", "citations"]

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["answer", 'a "text":', "文本", 3, 2.5, None, True, ""])
        return [tree(depth - 1) for _ in range(rng.randrange(4))] if kind < 0.5 else {k: tree(depth - 1) for k in rng.sample(names, rng.randrange(1, 5))}

    def named(t):
        if isinstance(t, list):
            return [named(x) for x in t]
        return {trees.ANSWER_KEYS.get(k, k): named(v) for k, v in t.items()} if isinstance(t, dict) else t

    objects = [{"answer": tree(5)} for _ in range(60)]
    texts = [json.dumps(o) for o in objects]
    there = values(spark, trees.renamed(F.col("text")), texts)
    assert all(r.refused is None for r in there) and [json.loads(r.json) for r in there] == [named(o) for o in objects]
    back = values(spark, trees.restored(F.col("text")), [r.json for r in there])
    assert [json.loads(r.json) for r in back] == objects
    refused = ['{"zzz":1}', '{"answer":1,"智能体回答":2}', "{", '{"客户":{"x":[{"Key":1}]}}']
    assert [(r.json, r.refused) for r in values(spark, trees.renamed(F.col("text")), refused)] == [(None, "english_key"), (None, "duplicate_key"), (None, "invalid_json"), (None, "english_key")]
    assert [r.refused for r in values(spark, trees.restored(F.col("text")), ["[1]", '{"answer":1}', "{}}"])] == ["not_an_object", "english_key", "invalid_json"]
    assert values(spark, trees.renamed(F.col("text")), [None])[0].refused is None


def test_objects_are_parsed_once_for_each_text(spark):
    parses = lambda c: spark.createDataFrame([("{}",)], "text string").select(c)._jdf.queryExecution().analyzed().toString().count("parse_json(")
    one = parses(trees.canonical(F.col("text")))
    assert one and parses(trees.renamed(F.col("text"))) == parses(trees.restored(F.col("text"))) == 2 * one  # as it comes, and with other names


def test_evidence_texts_are_read_back(spark):
    text = "案例：A\n关键要点：\n- 一\n续\n- 二\n来源原文：原话：x\n\n定义：\n没有项目\n- 不是项目\n别名："
    rows = segments.segments(spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "plain")], "id int, text string"), "id")
    got = {(r.id, r.pos): (r.kind, r.label, r.origin, r.value, r["items"]) for r in rows.collect()}
    assert got == {
        (1, 1): ("field", "案例", "generated", "A", None),
        (1, 2): ("block", "关键要点", "generated", None, ["一\n续", "二"]),
        (1, 3): ("field", "来源原文", "source", "原话：x", None),
        (1, 4): ("block", "定义", "generated", None, []),
        (1, 5): ("plain", None, None, "没有项目", None),
        (1, 6): ("plain", None, None, "- 不是项目", None),
        (1, 7): ("block", "别名", "generated", None, []),
        (4, 1): ("plain", None, None, "plain", None),
    }
    assert {r.id: r.structured for r in segments.structured(rows, "id").collect()} == {1: True, 4: False}


def _material(case, name, sources, budget):
    """The material of one section, source by source."""
    out = materials.INTRO % (case, name)
    for kind, file, sid, text in sources:
        if not (text or "").strip():
            continue
        head = materials.HEAD % (kind, file, sid)
        body = "\n".join(f"L{i:03d}: {line}" for i, line in enumerate(text.splitlines(), 1))
        room = budget - len(out) - len(head) - 4
        if room <= len(materials.CUT):
            return out + "\n\n" + materials.LEFT_OUT
        out += "\n\n" + head + "\n" + (body if len(body) <= room else body[: room - len(materials.CUT)].rstrip() + materials.CUT)
    return out


def test_materials_keep_to_their_budget(spark):
    rng, rows = random.Random(9), []
    for s in range(40):
        for i in range(rng.choice([0, 1, 3, 60])):
            words = [rng.choice(["客户", "plan", "\n", "\r\n", " ", "x" * 30, " "]) for _ in range(rng.choice([0, 1, 5, 40]))]
            rows.append((s, i, f"c{s}", "开场", "text", f"f{i}.txt", str(i), rng.choice([None, "".join(words), "".join(words), "".join(words)])))
    sources = spark.createDataFrame(rows, "section int, at int, case_name string, section_name string, source_type string, filename string, source_id string, text string")
    for budget in (200, 400, 1500):
        got = {r.section: r.material for r in materials.section_materials(sources, ["section"], ["at"], budget).collect()}
        want = {s: _material(f"c{s}", "开场", [r[4:] for r in rows if r[0] == s], budget) for s in {r[0] for r in rows}}
        assert got == want
    assert materials.section_materials(sources.limit(0), ["section"], ["at"]).count() == 0
