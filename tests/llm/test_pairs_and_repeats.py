"""n-gram join and repeated windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join, recompression
from tessera.llm.ngram_join import instances, ngram_components, signatures
from tessera.llm.recompression import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed, groups, size, copies, edits):
    """Groups of graded near copies, with shared lines, exact copies, short, empty and null texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choice(words) for _ in range(9))
    texts = [None, "", "  \n ", "One two", "one TWO", "a b c d e", "a b c d e f"]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(*size))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                i = rng.randrange(len(own))
                own[i : i + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
            texts.append(" ".join(own) + (f"\n{line}" if rng.random() < 0.5 else ""))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("shape", [(12, (5, 40), 8, 3), (3, (120, 160), 40, 9), (2, (300, 420), 20, 25)])
def test_components_match_brute_force(spark, shape):
    rows = corpus(sum(shape[1]), *shape)
    out = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows)


def test_components_of_odd_rows(spark):
    schema = "doc_id long, text string, sign long, rep string"
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (None, "a b c d e f", None, None), (2, None, 2, "y"), (None, None, 3, "z")]
    out = ngram_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("None", 0, "None"), ("None", 2, "1")]
    assert ngram_components(spark.createDataFrame([], schema)).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(21)
    text = lambda: [f"u{rng.randrange(10**6)}" for _ in range(40)]
    a, b, c = text(), text(), text()
    near = lambda w: [*w[:-1], "other"]
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, c), (4, near(c)), (6, c), (6, text()), (11, text()), (5, a)]
    rows = [(d, " ".join(w)) for d, w in rows] + [(11, None), (None, " ".join(b)), (12, "")]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in out if r.n_shingles and r.doc_id} == {5: 5, 7: 5, 8: 5, 9: 4, 4: 4, 6: 4, 11: 11}
        assert [r.component_id for r in out if r.doc_id is None] == [5] and len(out) == len(rows)


def test_verification_counts_words():
    rng = random.Random(31)
    for _ in range(200):
        texts = [" ".join(rng.choice("aAbc") for _ in range(rng.randint(0, 30))) for _ in range(2)]
        x, y = ngram_join.numbered_ngrams(texts, 5)
        p, q = map(shingles, texts)
        assert (len(x), len(y), len(np.intersect1d(x, y))) == (len(p), len(q), len(p & q))


def test_similar_sets_share_signatures():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(4, 400)), dtype=np.uint64))
        b = a[rng.permutation(len(a))[int(rng.integers(0, len(a) // 5 + 1)) :]]
        more = int(len(b) / 0.8) - len(a)
        if more < 0:
            continue
        both = len(b)
        b = np.sort(np.concatenate([b, rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
        if min(len(a), len(b)) < 4 or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (x, p), (y, q) = signatures(a), signatures(b)
        common = np.intersect1d(x, y)
        assert len(common)
        for parity in (0, 1):
            if {i[0] for i in instances(len(a), 80) if i[1] == parity} & {i[0] for i in instances(len(b), 80) if i[1] == parity}:
                assert np.count_nonzero(common & np.uint64(1) == parity) >= max(p[parity], q[parity])


def brute_repeats(rows):
    own = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(own):
        for i in range(len(own[d]) - 12):
            first.setdefault(tuple(own[d][i : i + 13]), d)
    out = {}
    for d, w in own.items():
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                keep[i : i + 13] = [False] * 13
        out[d] = (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest())
    return out


def repeats(seed):
    rng = random.Random(seed)
    letters = list("abcdefgh")
    passages = [[rng.choice(letters) for _ in range(30)] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " ".join("a" * 40))]
    for d in range(3, 260):
        w = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                w += rng.choice(passages)[rng.randint(0, 10) : rng.randint(15, 30)]
            elif kind < 0.8:
                w += [rng.choice(letters)] * rng.randint(1, 40)
            else:
                w += [f"x{rng.random()}" for _ in range(8)]
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "held", "rounds", "known"), [(1, 1 << 20, 2, 1 << 20), (2, 50, 2, 1 << 20), (3, 1 << 20, 3, 40), (4, 1 << 20, 2, 1 << 20)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, held, rounds, known):
    monkeypatch.setattr(recompression, "HELD", held)
    monkeypatch.setattr(recompression, "KNOWN", known)
    if seed == 4:  # all names are frequent
        monkeypatch.setattr(recompression, "HEAVY", 1 << 30)
    if seed > 2:  # so that tasks have several slices
        monkeypatch.setattr(recompression, "slices", lambda texts: ngram_join.slices(texts, 2000))
    rows = repeats(seed)
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rounds=rounds).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out} == brute_repeats(rows)


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    schema = "doc_id long, text string, name long, n int"
    out = without_repeats(spark.createDataFrame([(1, text, 1, 1), (1, text, 1, 1), (2, text, 2, 2), (None, text, 3, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in out) == [("1", 20, 0), ("1", 20, 0), ("2", 20, 20), ("None", 20, 0)]
    assert without_repeats(spark.createDataFrame([], schema)).count() == 0


def test_rows_of_one_id_have_windows_of_their_own(spark):
    rng = random.Random(12)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = text(40), text(25), text(60)
    rows = [(1, " ".join(a)), (2, " ".join(c[:20] + a[:20])), (2, " ".join(b)), (2, " ".join(text(5))), (3, " ".join(b[:15] + c)), (4, " ".join(a + b)), (4, None), (4, " ".join(text(400) + a))]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    wins = lambda w: [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
    expected = []
    for d, t in rows:
        w = (t or "").split()
        low = {x for e, u in rows if e < d for x in wins((u or "").split())}
        gone = {j for i, x in enumerate(wins(w)) if x in low for j in range(i, i + 13)}
        expected.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == sorted(expected)


def test_very_long_texts(spark):
    rng = random.Random(13)
    words = [f"{rng.randrange(1 << 30):x}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, "new " + " ".join(words[1000:250_000]) + " end"), (3, "x" * 2_000_000), (4, " ".join(["same"] * 200_000))]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (300_000, 0), 2: (249_002, 249_000), 3: (1, 0), 4: (200_000, 0)}


def test_words_of_many_letters_have_digests_of_their_own():
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    (s,) = ngram_join.slices(ngram_join.pa.array([f"{thue} {other} {thue}"]), 1 << 20)
    x, y, z = s.digests().tolist()
    assert x == z != y


def test_equal_windows_pick_equal_names():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 6, 5000).astype(np.uint64)
    digests = ngram_join.mix(words + np.uint64(1))
    at, name = recompression.picks(digests, np.array([0, 1000, 1005, 5000]), 13, 2)
    seen = {}
    for i, n in zip(at, name):
        assert seen.setdefault(tuple(words[i : i + 13]), n) == n


def test_the_windows_shuffle_goes_with_its_query(spark, monkeypatch):
    seen, plain, before = [], recompression.written, spark.conf.get(recompression.CLEANUP, "false")
    monkeypatch.setattr(recompression, "written", lambda df, name: (seen.append((name, spark.conf.get(recompression.CLEANUP))), plain(df, name))[1])
    text = " ".join(f"w{i}" for i in range(20))
    out = without_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    assert [(r.n_words, r.n_removed) for r in out.orderBy("doc_id").collect()] == [(20, 0), (20, 20)]
    assert seen == [("judged", "true")] and spark.conf.get(recompression.CLEANUP, "false") == before
