"""The pipeline's stages against brute force on a small table."""

import random

import corpus_pipeline
from tessera.llm import pii

from .test_pairs_and_repeats import brute_components


def table(spark, path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return df


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(120):
        if i % 6 == 5:
            text = rows[-1][1] + (" end" if i % 12 == 5 else "")
        else:
            text = " ".join(word() for _ in range(rng.randint(30, 90))) + (" call +1 (875) 555-8822" if i % 7 == 0 else "")
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 4 if i % 3 else 0}", len(text)))
    rows += [(200, "too short", "en", "s1", 9), (201, None, None, None, None), (202, "same words " * 40, "en", "s2", 440)]
    docs = table(spark, f"file://{tmp_path}", rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "pii", "source_mixing", "best_fit_packing"]
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert not {200, 201, 202} & set(after) and set(range(120)) <= set(after)
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, c in brute_components([(d, texts[d]) for d in before]).values()}
        if name == "pii":
            assert set(after) == set(before) and not any("555-8822" in r.text for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "source_mixing":
            assert 0 < len(after) <= len(before) and all(after[d] == before[d] for d in after)
        if name == "best_fit_packing":
            assert set(after) == set(before)
        else:
            assert docs.columns == columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()} == set(after)
    assert pii.ROUNDS % 2 == 0


def test_verdicts_belong_to_rows(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(60))
    long = [text() for _ in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(long[:6])]
    rows += [(None, "too short", "en", "s", 9), (None, None, None, None, None), (None, long[6], "en", "s", 1), (None, long[6], "en", "s", 1), (None, long[0], "en", "s", 1)]
    rows += [rows[1], rows[1], (9, "too short", "en", "s", 9), (9, long[7], "en", "s", 1)]
    docs = table(spark, f"file://{tmp_path}", rows)
    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert sorted(r.text for r in good.collect()) == sorted(r[1] for r in rows if r[1] not in (None, "too short"))
    out = corpus_pipeline.ngram_jaccard_join(spark, good, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([*((str(i), t) for i, t in enumerate(long[:6])), ("None", long[6]), ("9", long[7])])


def test_a_broken_run_goes_on_and_names_may_clash(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(60))
    rows = [(i, text(), "en", "s", 1, "a", "b", i, True, "c") for i in range(30)] + [(40, "word " * 200_000, "en", "s", 1, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, source_ string, topic_ string, row_ int, drawn_ boolean, k_ string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    work, ran = f"file://{tmp_path}/work", []

    def watched(name, stage):
        def run(*args):
            ran.append(name)
            if name == "source_mixing" and ran.count(name) == 1:
                raise OSError("lost")
            return stage(*args)
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    try:
        corpus_pipeline.run(spark, f"file://{tmp_path}", work)
        raise AssertionError
    except OSError:
        pass
    out = corpus_pipeline.run(spark, f"file://{tmp_path}", work)
    assert ran == ["quality_rules", "ngram_jaccard_join", "pii", "source_mixing", "source_mixing", "best_fit_packing"]
    assert spark.read.parquet(f"{work}/source_mixing").columns == docs.columns and 0 < out.count() <= 30
    assert corpus_pipeline.run(spark, f"file://{tmp_path}", work).count() == out.count() and len(ran) == 6


def test_pipeline_of_no_rows(spark, tmp_path):
    table(spark, f"file://{tmp_path}", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_tables_can_be_cleared(spark):
    from tessera.llm import shared

    before = list(shared._made)
    shared._made.clear()
    table = shared.written(spark.range(5).toDF("n"), "clear-test")
    assert table.count() == 5 and len(shared._made) == 1
    path = shared._made[0]
    shared.clear(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not shared._made and not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    shared._made.extend(before)
    assert shared.fresh(spark.range(1).toDF("Row_"), "row_") == "row__"
