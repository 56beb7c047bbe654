"""Quality rules, token counts, audio, packing, mixing and pseudonyms against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, mixing, packing, pii, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "Short one.", "the cat and the dog sat on the mat with a hat and a bat for it", "a b c d e f " * 9, "one line here\nother line\none line here\n\n\nother line\r", "### $$$ %% && ** x y z w v u t s r q p", "é ü ñ Ä ß 1 2 3 | < >", "word " * 3000]


def test_base_counts_match_brute_force(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, ["en", None, "xx"][i % 3], "c") for i, t in rows], "doc_id long, text string, lang string, classes string")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = WORD.findall(t or "")
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = len({j for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 10 or 100 * rep > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_distance_is_jensen_shannon(spark):
    def plain(a, b):
        p, q = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (p + q) / 2
        kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
        return math.sqrt((kl(p) + kl(q)) / 2)

    rows = [([1, 0, 3], [0.2, 0.5, 0.3]), ([5, 0, 0], [0.0, 1.0, 0.0]), ([1, 1, 1], [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<long>, b array<double>").select("a", "b", quality_rules.distance("a", "b").alias("d"))
    for r in df.collect():
        assert r.d == pytest.approx(plain(r.a, r.b), abs=1e-9)
    assert spark.createDataFrame([([0, 0], [1.0, 0.0])], "a array<long>, b array<double>").select(quality_rules.distance("a", "b").alias("d")).head().d is None


def test_divergence_rejects_symbols_and_keeps_prose(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("etaoinshr"), 5))
    prose = lambda: " ".join(("the " if rng.random() < 0.2 else "") + word() for _ in range(200))
    rows = [(i, prose(), "en") for i in range(40)] + [(100, " ".join(word().upper() + "###" for _ in range(200)), "en")]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got.pop(100) is False and all(got.values())
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_kept_follows_stored_references(spark):
    rng = np.random.default_rng(15)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    prose = lambda n, letters="bdflmnprst": " ".join(rng.choice(quality_rules.COMMON["en"]) if rng.random() < 0.3 else word(letters) for _ in range(n))
    clean = spark.createDataFrame([(i, prose(150), "en") for i in range(40)], "doc_id long, text string, lang string")
    refs = quality_rules.references(quality_rules.counts(clean)).cache()
    rows = [(i, prose(int(rng.integers(5, 400))), "en", "x") for i in range(20)] + [(100 + i, prose(200, "#*%&|"), "en", "x") for i in range(60)]  # junk is the more
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, class_ref string")
    out = quality_rules.judged(docs, refs=refs).collect()
    ref = refs.head()

    def far(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        m = (p + q) / 2
        return math.sqrt(max(sum(u * math.log2(u / v) for x in (p, q) for u, v in zip(x, m) if u) / 2, 0))

    counted = {r.doc_id: r for r in quality_rules.counts(docs).collect()}
    for r in out:
        c = counted[r.doc_id]
        near = (r.word_chars < 200 or far(c.classes, ref.class_ref) <= 0.15 + 1 / math.sqrt(r.word_chars)) and (r.n_words < 20 or far(c.common, ref.word_ref) <= 0.08 + 2 / math.sqrt(r.n_words))
        assert r.kept == (not r.base_failed and near)
    assert all(r.kept == (r.doc_id < 100 and not r.base_failed) for r in out)


def test_a_long_text_without_common_words_is_judged(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("bcfgjkpvwx"), 6))
    prose = lambda n: " ".join(rng.choice(quality_rules.COMMON["en"]) if rng.random() < 0.3 else word() for _ in range(n))
    rows = [(i, prose(60 + 10 * i), "en") for i in range(40)]
    rows += [(100, " ".join(word() for _ in range(120)), "en"), (101, " ".join(["the", *(word() for _ in range(400))]), "en"), (102, " ".join(word() for _ in range(400)), "xx")]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].kept for i in (100, 101)] == [False, False] and got[102].word_distance is None and got[100].word_distance > 0.3
    assert all(got[i].kept for i in range(40))


def test_languages_outside_the_list_have_their_own_class_reference(spark):
    rng = np.random.default_rng(6)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(150))
    rows = [(i, text("абвгдежз"), "ru") for i in range(30)] + [(i, text("abcdefgh"), "pl") for i in range(30, 60)]
    rows += [(60, text("ABCDEFGH"), "pl"), (61, text("абвг"), "pl"), (70, text("ABCDEFGH"), "EN"), (71, text("ABCDEFGH"), None)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if not r.kept} == {60, 61}
    assert got[70].class_distance is None and got[71].class_distance is None


def test_token_counts_and_cache(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, "Short one."), (50, "<s> </s> <unk> hello")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = token_counts.counter("piece_bpe_32k.model", token_counts.tokenizer_file())
    expected = sorted((str(d), len((t or "").encode()), count([t or ""])[0]) for d, t in rows)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        out = token_counts.token_counts(docs, cache=cache, limit=100).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == expected
        assert all(r.over_limit == (r.n_tokens > 100) for r in out)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})  # nothing is encoded again
    assert token_counts.token_counts(docs, carry=()).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    other = token_counts.token_counts(docs, tokenizer="byte_bpe_50k.json", cache=cache).collect()
    assert len(other) == len(rows) and len({r.version for r in spark.read.parquet(cache).collect()}) == 2
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_repeated_rows_are_encoded_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(token_counts, "MAX_MISSES", most)
    rows = [(5, "some equal rows", 1)] * 50 + [(None, "some equal rows", 2)] * 50 + [(i, f"text {i}", 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(8)
    cache = f"file://{tmp_path}/cache"
    for more in (docs, docs.unionByName(spark.createDataFrame([(1, "new", 0)] * 9, docs.schema))):
        assert token_counts.token_counts(more, cache=cache).count() == more.count()
        assert spark.read.parquet(cache).count() == 21 + (more is not docs)


def test_audio_round_trip(spark):
    rows = [(i, t, "m") for i, t in enumerate([*TEXTS, "x" * 64, "word " * 3000])] + [(9, TEXTS[9], "m"), (None, "x", None)]
    media = audio.stored_media(spark.createDataFrame(rows, "doc_id long, text string, media string"))
    held = {r.doc_id: bytes(r.media) for r in media.collect()}
    got = audio.audio_features(media).collect()
    out = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(held[i]) and r.media_sha256 == hashlib.sha256(held[i]).hexdigest()
        assert audio.samples_of(held[i])[1].tobytes() == payload
        table = audio.read_tensors(bytes(r.tensors))
        patches = table["mel"].combine_chunks().to_numpy_ndarray()
        assert str(table.schema.field("mel").type).startswith("extension<arrow.fixed_shape_tensor") and patches.shape[1:] == (audio.PATCH, audio.BANDS) and len(patches) == -(-r.frames // audio.PATCH)
        assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist())) and all(s.start_s < s.end_s for s in r.spans)
    assert out[9].feature == out[11].feature and len(got) == len(rows)
    assert audio.audio_features(audio.stored_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_log_mel_is_the_transform_written_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=900) / 4
    bands, energy = audio.log_mel(x, 8000)
    t, k = np.arange(audio.FRAME), np.arange(audio.FRAME // 2 + 1)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(20) + (mel(4000) - mel(20)) * i / (audio.BANDS + 1)) / 2595) - 1) for i in range(audio.BANDS + 2)]
    x = np.pad(x, (0, 7 * audio.HOP))
    assert len(bands) == 7
    for i in range(len(bands)):
        frame = x[i * audio.HOP : i * audio.HOP + audio.FRAME]
        shape = 0.5 - 0.5 * np.cos(2 * np.pi * t / (audio.FRAME - 1))
        power = [abs((frame * shape * np.exp(-2j * np.pi * t * f / audio.FRAME)).sum()) ** 2 / audio.FRAME for f in k]
        for b in range(audio.BANDS):
            lo, mid, hi = edges[b : b + 3]
            own = sum(p * max(0, min((f * 8000 / audio.FRAME - lo) / (mid - lo), (hi - f * 8000 / audio.FRAME) / (hi - mid))) for f, p in zip(k, power))
            assert bands[i, b] == pytest.approx(max(audio.FLOOR_DB, 10 * math.log10(own + 1e-9)), abs=2e-3)
        assert energy[i] == pytest.approx(10 * math.log10((frame**2).mean() + 1e-9), abs=1e-6)


def test_slices_give_what_the_whole_gives(monkeypatch):
    raw = np.random.default_rng(4).integers(0, 256, 50_001).astype(np.uint8)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        whole = audio.resampled((raw.astype(np.float64) - 128) / 128, up, down)
        samples = audio.Samples(raw, up, down)
        assert samples.size == len(whole)
        for a, b in ((0, 10), (5, 4000), (20_000, 20_001), (len(whole) - 700, len(whole))):
            assert np.allclose(samples.span(a, b), whole[a:b], atol=1e-12)
    whole = audio.log_mel(audio.Samples(raw), 8000)
    monkeypatch.setattr(audio, "FRAMES_AT_ONCE", 13)
    cut = audio.log_mel(audio.Samples(raw), 8000)
    assert np.abs(whole[0] - cut[0]).max() <= 0.0011 and np.allclose(whole[1], cut[1])


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (1, 1)])
def test_resampling_keeps_a_tone(up, down):
    tone = lambda n, rate: np.sin(2 * np.pi * 500 * np.arange(n) / rate)
    got = audio.resampled(tone(6000, 16000), up, down)
    assert np.abs(got - tone(len(got), 16000 * up / down))[60:-60].max() < 0.01


def test_hysteresis():
    energy = np.array([-80, -29, -20, -29, -80, -29, -29, -80, -10])
    assert audio.segments(energy, -24, -30) == [(1, 4), (8, 9)]


def test_packing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)) + f" {i if i % 3 else 'same'}", f"s{i % 2 if i % 5 else 0}") for i, n in enumerate(rng.integers(0, 60, 300))]
    rows += [(900, None, None), (901, "", "s1"), (902, "long " * 250, "s1"), (None, "x y", "s0"), (1, rows[1][1], "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.packed(docs, capacity=100, max_per_source=2, shard_pieces=64, tokenizer=None).toPandas()
    words = {(d, i): len((t or "").split()) for i, (d, t, _) in enumerate(rows)}
    assert out["n_tokens"].sum() == sum(words.values())
    assert len(out) == sum(max(1, -(-n // 100)) for n in words.values())
    text = {d: (t or "").lower() for d, t, _ in rows}
    for _, b in out.groupby("bin"):
        assert b["n_tokens"].sum() <= 100 and (b.groupby("source").size() <= 2).all()
        clusters = [" ".join(text[None if d != d else int(d)].split()) for d in b["doc_id"]]
        assert len(set(clusters)) == len(clusters)
        placed = b.sort_values(["offset", "n_tokens"])
        assert (placed["offset"].iloc[1:].to_numpy() >= (placed["offset"] + placed["n_tokens"]).iloc[:-1].to_numpy()).all()
    assert packing.packed(docs.limit(0)).count() == 0


def test_packing_takes_clusters_and_tokens_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, 5), (2, "a b d", "s", 7, 6), (3, "e", "s", 8, 7)], "doc_id long, text string, source string, component_id long, n long")
    near = {r.doc_id: r for r in packing.packed(docs, cluster_col="component_id", tokenizer=None).collect()}
    assert near[1].bin != near[2].bin and [near[i].n_tokens for i in (1, 2, 3)] == [3, 3, 1]
    assert {r.doc_id: r.n_tokens for r in packing.packed(docs, tokens_col="n").collect()} == {1: 5, 2: 6, 3: 7}
    both = {r.doc_id: r for r in packing.packed(docs, cluster_col="component_id", tokens_col="n").collect()}
    assert both[1].bin != both[2].bin and both[3].n_tokens == 7 and len({r.bin for r in packing.packed(docs).collect()}) == 1


def test_null_ids_and_repeated_rows_spread_over_shards(spark):
    rows = [(None, f"text {i}", "s") for i in range(3000)] + [(7, "equal", "s")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = packing.packed(docs, shard_pieces=200, tokenizer=None).toPandas()
    sizes = out.groupby(out["bin"] // 2**32).size()
    assert len(out) == 6000 and len(sizes) == 30 and sizes.max() < 300
    equal = out[out.doc_id == 7]
    assert len(equal) == 3000 and equal["bin"].nunique() == 3000
    same = packing.packed(docs.repartition(7), shard_pieces=200, tokenizer=None).toPandas()
    assert sorted(out["bin"] * 10_000 + out["offset"]) == sorted(same["bin"] * 10_000 + same["offset"])


def test_packing_counts_tokens_and_fills_bins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.packed(docs).toPandas()
    count = token_counts.counter("piece_bpe_32k.model", token_counts.tokenizer_file())
    assert out["n_tokens"].sum() == sum(count([r.text or ""])[0] for r in docs.select("text").collect())
    own = packing.packed(docs, max_per_source=1 << 10).toPandas()
    fill = own["n_tokens"].sum() / (own["bin"].nunique() * packing.CAPACITY)
    assert (out.groupby("bin")["n_tokens"].sum() <= packing.CAPACITY).all() and fill > 0.9


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_takes_the_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    n = 5 if not seed else 400
    sizes, clusters, sources = ([60, 50, 45, 40, 40], "abcac", "sssst") if not seed else (sorted((int(x) for x in rng.integers(0, 101, n)), reverse=True), rng.integers(0, 40, n).tolist(), rng.integers(0, 5, n).tolist())

    def brute():
        bins, out = [], []
        for n, c, s in zip(sizes, clusters, sources):
            fits = [(100 - sum(x[0] for x in b), i) for i, b in enumerate(bins) if 100 - sum(x[0] for x in b) >= n and all(x[1] != c for x in b) and sum(x[2] == s for x in b) < 2]
            i = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([])
            out.append(i)
            bins[i].append((n, c, s))
        return out

    assert packing.best_fit(sizes, clusters, sources, 100, 2)[0] == brute()


def test_raking_meets_the_targets(spark):
    rng = np.random.default_rng(4)
    cells = [(s, lang, t, int(rng.integers(1, 1000))) for s in "abcd" for lang in ("en", "de") for t in ("x", "y") if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"lang": spark.createDataFrame([("en", 0.3), ("de", 0.7), ("absent", 0.5)], "value string, share double")}
    got = {(r.source, r.lang, r.topic): r for r in mixing.raked(df, targets, tolerance=1e-6).collect()}
    w = {c[:3]: float(c[3]) for c in cells}
    share = []
    for d in range(3):
        has = Counter()
        for c in cells:
            has[c[d]] += c[3]
        own = {"en": 0.3, "de": 0.7} if d == 1 else {k: (v / sum(has.values())) ** list(mixing.EXPONENTS.values())[d] for k, v in has.items()}
        share.append({k: v / sum(own.values()) for k, v in own.items()})
    for _ in range(200):
        for d in range(3):
            sums = Counter()
            for c, v in w.items():
                sums[c[d]] += v
            w = {c: v * share[d][c[d]] / sums[c[d]] for c, v in w.items()}
    top = max(w[c[:3]] / c[3] for c in cells)
    for c in cells:
        assert got[c[:3]].probability == pytest.approx(w[c[:3]] / c[3] / top, rel=1e-3)


def test_sampling(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small", "en") for i in range(3000)] + [(None, None, None, None), (7, "text 7", "big", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.sampled(docs).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("source"):
        assert abs(g["drawn_"].mean() - g["probability_"].mean()) < 0.05
    assert out[out.doc_id == 7]["drawn_"].nunique() == 1
    assert mixing.sampled(docs.limit(0)).count() == 0


def test_clashing_names_and_given_topics(spark):
    columns = ["doc_id", "text", "lang", "source", "topic_", "probability_", "drawn_", "source_", "lang_", "tokens", "topic"]
    rows = [(i, f"some words of text {i % 50}", "en" if i % 4 else "de", f"s{i % 3}", "t", 0.5, True, "x", "y", i, f"k{i % 2}") for i in range(400)] + [(None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic_ string, probability_ double, drawn_ boolean, source_ string, lang_ string, tokens int, topic string")
    out = mixing.sampled(docs)
    assert out.columns == [*columns, "topic__", "probability__", "drawn__"] and out.select(*columns).exceptAll(docs).count() == 0 and out.count() == 401
    kept = mixing.drawn(docs, topic_col="topic")
    assert kept.columns == columns and 0.6 < kept.count() / 401 <= 1
    assert {r.topic__ for r in mixing.sampled(docs, topic_col="topic").collect()} == {"k0", "k1", "?"}


def test_few_cells_are_raked_as_many_are(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(f"s{i}", lang, f"t{t}", int(rng.integers(1, 3000) if i else 40_000)) for i in range(7) for lang in ("en", "de") for t in range(2) if rng.random() < 0.9]
    cells = spark.createDataFrame([*rows, ("s1", "xx", "t0", 5)], "source string, lang string, topic string, tokens long")
    targets = {"lang": spark.createDataFrame([("en", 0.4), ("de", 0.6), ("absent", 1.0)], "value string, share double")}
    for keep in (0.6, None):
        few = {r[:3]: r for r in mixing.raked(cells, targets, keep=keep).collect()}
        with monkeypatch.context() as m:
            m.setattr(mixing, "MAX_CELLS", 0)
            many = {r[:3]: r for r in mixing.raked(cells, targets, keep=keep).collect()}
        for k, r in many.items():
            assert few[k].probability == pytest.approx(r.probability, rel=1e-6, abs=1e-12) and few[k].weight == pytest.approx(r.weight, rel=1e-6, abs=1e-12)
        assert set(many) <= set(few) and all(few[k].probability == 0 for k in set(few) - set(many))
    assert mixing.raked(cells.limit(0), targets, keep=0.5).count() == 0


def test_topics_divide_each_language(spark):
    rng = np.random.default_rng(7)
    kinds = [[f"{lang}{t}{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] for lang in "ed" for t in range(3)]
    rows = [(i, " ".join(rng.choice(kinds[3 * (i % 2) + i % 3], 80)), "ed"[i % 2], "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    topics = mixing.Topics.learned(docs, k=3, steps=8)
    out = mixing.with_topics(docs, topics, None, "topic", "tokens").toPandas()
    assert (out["tokens"] == 80).all()
    for lang, own in out.groupby("lang"):  # each kind of words goes to one topic, all but a few
        assert own.groupby(own["doc_id"] % 3)["topic"].agg(lambda x: x.value_counts(normalize=True).iloc[0]).mean() > 0.8
    again = mixing.with_topics(docs.repartition(7), mixing.Topics.learned(docs.repartition(5), k=3, steps=8), None, "topic", "tokens").toPandas()
    assert dict(zip(out["doc_id"], out["topic"])) == dict(zip(again["doc_id"], again["topic"]))


def test_drawn_tokens_meet_the_marginals(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(5, 60)), ["en", "de", "fr"][int(i % 10 > 5) + int(i % 10 > 8)], f"s{i * i % 7 % 4}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.35), ("fr", 0.15)], "value string, share double")}
    out = mixing.sampled(docs, targets, keep=0.5).where("drawn_").toPandas()
    tokens = out["text"].str.split().str.len()
    share = tokens.groupby(out["lang"]).sum() / tokens.sum()
    assert abs(share["en"] - 0.5) < 0.02 and abs(share["de"] - 0.35) < 0.02 and abs(share["fr"] - 0.15) < 0.02
    assert tokens.sum() / sum(len(r[1].split()) for r in rows) == pytest.approx(0.5, abs=0.02)


def test_one_document_of_a_new_source_leaves_the_sample(spark):
    cells = [(f"s{i}", lang, "x", 40_000 + 1000 * i) for i in range(6) for lang in ("en", "de")]
    get = lambda rows, **more: {r[:3]: r.probability for r in mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), keep=0.8, **more).collect()}
    before, after = get(cells), get([*cells, ("new", "en", "x", 20)])
    kept = lambda p: sum(p[c[:3]] * c[3] for c in cells) / sum(c[3] for c in cells)
    assert kept(before) == pytest.approx(0.8, abs=0.005) and kept(after) == pytest.approx(0.8, abs=0.005)
    assert after[("new", "en", "x")] == pytest.approx(1, abs=0.01) and all(after[c] == pytest.approx(p, abs=0.01) for c, p in before.items())


def test_a_hot_source_beside_many_small_ones(spark):
    rows = [("hot", "en", "x", 100_000), *((f"s{i}", "en", "x", 200) for i in range(1000))]
    with pytest.warns(UserWarning, match="1000 values of source") as told:
        out = mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), keep=0.85).cache()
    assert not any("off a marginal" in str(w.message) for w in told)
    p = {r.source: r.probability for r in out.collect()}
    assert sum(p[r[0]] * r[3] for r in rows) == pytest.approx(0.85 * 300_000, rel=0.01) and 0.5 < p["hot"] < 0.6
    shares = {r.value: (r.wanted, r.expected) for r in mixing.marginals(out).where("dimension = 'source'").collect()}
    assert shares["hot"][0] < shares["hot"][1] == pytest.approx(p["hot"] * 100 / 255, rel=0.01)


def test_targets_leave_out_what_they_do_not_list(spark):
    rows = [(s, lang, "x", 1000) for s in "ab" for lang in ("en", "de", "fr")]
    targets = {"lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "value string, share double")}
    p = {r[:2]: r.probability for r in mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), targets, keep=0.5).collect()}
    assert all(p[s, "fr"] == 0 and p[s, "en"] == pytest.approx(0.6, abs=0.01) and p[s, "de"] == pytest.approx(0.4, abs=0.01) for s in "ab")


def feistel(symbols, kind, alphabet=pii.DIGITS, key="k"):
    def stream(r, half):
        return hashlib.sha512(f"{key}|{kind}|{r}|{half}".encode()).hexdigest()

    def added(half, s):
        return "".join(alphabet[(alphabet.index(c) + int(s[2 * i : 2 * i + 2], 16)) % len(alphabet)] for i, c in enumerate(half))

    if len(symbols) < 2:
        return added(symbols, stream(0, ""))
    a, b = symbols[: len(symbols) // 2], symbols[len(symbols) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        a, b = b, added(a, stream(r, b))
    return a + b


def luhn(digits):
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return (10 - total % 10) % 10


def test_pseudonyms_match_brute_force(spark):
    texts = ["card 4111 1111 1111 1111 x", "card 4111111111111111.", "bad 4111111111111112", "call +1 (875) 555-8822!", "ssn 123-45-6789", "at 2024-02-29 and 2023-02-30", "ip 10.20.30.40 no 300.1.1.1", "Mail a.b9@x.example.com.", 'token = "' + "0a1b" * 10 + '"', None, "", "no data", "year 2024, 12 apples", "to GB29 NWBK 6016 1331 9268 19, not GB30 NWBK 6016 1331 9268 19", "us 12/31/1999", "tel 555-123-4567"]
    out = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    plain = re.sub(r"\D", "", out[0])
    h = feistel("411111111111111", "account")
    assert [plain, re.sub(r"\D", "", out[1])] == [h + str(luhn(h))] * 2
    assert re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4} x", out[0])
    assert out[2] == texts[2]
    assert re.sub(r"\D", "", out[3]) == "1" + feistel("8755558822", "phone") and re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}!", out[3])
    assert re.sub(r"\D", "", out[4]) == feistel("123456789", "ssn")
    assert out[5].endswith("and 2023-02-30") and date.fromisoformat(out[5][3:13]) != date(2024, 2, 29)
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3} no 300\.1\.1\.1", out[6]) and "10.20.30.40" not in out[6]
    f = feistel("ab9", "email", pii.ALNUM)
    g = feistel("xexample", "domain", pii.ALNUM)
    assert out[7] == f"Mail {f[0]}.{f[1:]}@{g[0]}.{g[1:]}.com."
    assert out[8] == 'token = "' + feistel("0a1b" * 10, "token", pii.HEX) + '"'
    assert out[9:13] == [None, "", "no data", "year 2024, 12 apples"]
    d = feistel("60161331926819", "iban")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    check = 98 - number(f"NWBK{d}GB00") % 97
    assert out[13] == f"to GB{check:02d} NWBK {d[:4]} {d[4:8]} {d[8:12]} {d[12:]}, not GB30 NWBK 6016 1331 9268 19"
    assert re.fullmatch(r"us \d\d/\d\d/\d{4}", out[14]) and out[14] != "us 12/31/1999"
    assert re.sub(r"\D", "", out[15]) == feistel("5551234567", "phone")
    plan = pii.pseudonymised(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_phone_number_ends_where_another_value_begins(spark):
    phones = ["+1 (826) 555-4081", "+44 20 7946 0958", "+49 30123456", "+49 30 1234 5678"]
    others = ["190.137.223.204", "2021-03-04", "04/03/2021", "04.03.2021", "123-45-6789", "4929 1234 5678 9015", "4929123456789015", "3782 822463 10005", "555-123-4567", "12ab34cd56ef7890", "12bob@x.example.com", "GB29 NWBK 6016 1331 9268 19"]
    plain = ["+1 (826) 555-4081 24 hours", "+1 826 555 4081 2024", "+18265554081 24", "+1 (826) 555-4081"]
    texts = [*phones, *others, *plain, *(f"{p} {o}" for p in phones for o in others), *(f"{p} {o} 24 hours" for p in phones for o in others[:5])]
    out = {r.before: r.text for r in pii.pseudonymised(spark.createDataFrame([(t, t) for t in texts], "before string, text string"), "k").collect()}
    assert all(out[v] != v for v in [*phones, *others])
    for p in phones:
        assert [out[f"{p} {o}"] for o in others] == [f"{out[p]} {out[o]}" for o in others]
        assert [out[f"{p} {o} 24 hours"] for o in others[:5]] == [f"{out[p]} {out[o]} 24 hours" for o in others[:5]]
    ten = feistel("8265554081", "phone")
    assert [re.sub(r"\D", "", out[t])[:11] for t in plain] == ["1" + ten] * 4
    assert [out[t].split()[-1] for t in plain[:3]] == ["hours", "2024", "24"] and " 24 hours" in out[plain[0]]


def blocks(symbols, kind, alphabet):
    cut = [symbols[i : i + pii.BLOCK] for i in range(0, len(symbols), pii.BLOCK)]
    return "".join(feistel(x, f"{kind}#{i}" if i else kind, alphabet) for i, x in enumerate(cut))


def test_long_values_change_whole(spark):
    rng = np.random.default_rng(8)
    some = lambda letters, n: "".join(rng.choice(list(letters), n))
    token, big, name = some(pii.HEX, 160), some(pii.HEX.upper(), 40), some(pii.ALNUM, 300)
    unique = "123e4567-e89b-12d3-a456-426614174000"
    texts = [f"k {token}.", f"k {big}.", f"id {unique}, {unique.upper()}", f"to {name}@example.com now", "a@b" + ".cc" * 1_000_000, "a@b" + ".1" * 500_000, "a" * 1_000_000 + " 1", "1" * 1_000_000, some("ab1", 200_000) + "@x.org", "@" * 100_000]
    schema = "doc_id long, text string, source string, found string, parts int"
    rows = [(i, t, "s", "x", i) for i, t in enumerate(texts)] + [(0, texts[0], "s", "x", 0), (None, texts[1], None, None, None)]
    got = pii.pseudonymised(spark.createDataFrame(rows, schema).repartition(4), "k")
    assert got.columns == ["doc_id", "text", "source", "found", "parts"]
    rows = got.collect()
    out = {r.doc_id: r.text for r in rows}
    assert out[0] == f"k {blocks(token, 'token', pii.HEX)}." and out[1] == out[None] == f"k {blocks(big, 'token', pii.HEX.upper())}."
    plain = unique.replace("-", "")
    f, g = feistel(plain, "token", pii.HEX), feistel(plain.upper(), "token", pii.HEX.upper())
    cut = lambda x: "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:]))
    assert out[2] == f"id {cut(f)}, {cut(g)}"
    assert out[3] == f"to {blocks(name, 'email', pii.ALNUM)}@{feistel('example', 'domain', pii.ALNUM)}.com now"
    assert out[4] != texts[4] and len(out[4]) == len(texts[4]) and out[4].endswith(".cc") and out[8] != texts[8] and len(out[8]) == len(texts[8])
    assert [out[i] for i in (5, 6, 7, 9)] == [texts[i] for i in (5, 6, 7, 9)] and len(rows) == 12 and sum(r.text == out[0] for r in rows) == 2
    assert pii.pseudonymised(spark.createDataFrame([], schema), "k").count() == 0


def test_permutations_are_bijective(spark):
    numbers = spark.range(1000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert numbers.distinct().count() == 1000
    days = spark.range(146097).select(pii.permuted_number(F.col("id"), "k", "d", pii.DAYS).alias("p")).agg(F.count_distinct("p").alias("n"), F.max("p").alias("m")).head()
    assert (days.n, days.m) == (146097, 146096)
