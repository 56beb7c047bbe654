"""Alignment of tokenizers, spelling variants and exact top-k against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import alignment, impact_index, spelling
from tessera.llm.alignment import alignment_scores, encoder_a, encoder_b
from tessera.llm.impact_index import top_k
from tessera.llm.spelling import Trie, near_words, spelling_variants
from tessera.llm.token_counts import tokenizer_file


def brute_alignment(rows):
    """Tokens as ranges of bytes, all pairs of overlapping ranges."""
    (encode_a, bytes_a), (encode_b, bytes_b) = encoder_a(tokenizer_file(alignment.A)), encoder_b(tokenizer_file(alignment.B))
    docs, held = [], Counter()
    for i, text in rows:
        a, b = (encode([t])[0] if text else [] for encode, t in ((encode_a, f" {text}"), (encode_b, text)))
        if b"".join(bytes_a[x] for x in a) != b"".join(bytes_b[x] for x in b) or b"".join(bytes_a[x] for x in a) != f" {text}".encode():
            a, b = [], []
        ranges = []
        for ids, pieces in ((a, bytes_a), (b, bytes_b)):
            end, own = 0, []
            for x in ids:
                own.append((end, end := end + len(pieces[x]), x))
            ranges.append(own)
        links = [(x, y) for s, e, x in ranges[0] for t, f, y in ranges[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in own if start <= s and e <= cut) for own in ranges))
            start = cut
        docs.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if cuts else ""))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted((str(i), n_a, n_b, n, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), d) for i, n_a, n_b, n, ls, d in docs)


ODD_TEXTS = [None, "", " ", "a", "plain words, twice words", "<|endoftext|> and <s> stay text </s>", "tab\there\n\n\nlines  and   blanks ", "naïve ÆØÅ 漢字 🙂 é", "▁ stands for itself", "x" * 3000, "1234567 89,0", "\u0000nul", "﻿bom", "a\r\nb"]


@pytest.mark.parametrize("merged", [alignment.MERGED, 40])
def test_alignment_matches_brute_force(spark, monkeypatch, merged):
    monkeypatch.setattr(alignment, "MERGED", merged)
    monkeypatch.setattr(alignment, "CALL", 500)
    rng, words = random.Random(3), "the of counting tokenizers don't straße fluß überall 12 3.5 (see) https://a.b/c?d=e".split()
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)])]
    rows += [(None, "a text without an id"), rows[20], rows[20]]
    out = alignment_scores(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keys string").repartition(5)).collect()
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out)
    assert got == brute_alignment(rows)
    assert sum(r.n_a > 0 for r in out) > 45 and {r.groups_sha256 for r in out if not r.n_a} == {""}


def test_words_are_encoded_once_and_cuts_change_nothing(monkeypatch):
    files, given = (tokenizer_file(alignment.A), tokenizer_file(alignment.B)), []

    def counted(encoder):
        def made(file):
            encode, pieces = encoder(file)
            return lambda texts: given.append(sum(map(len, texts))) or encode(texts), pieces

        return made

    monkeypatch.setattr(alignment, "encoder_a", counted(alignment.encoder_a))
    monkeypatch.setattr(alignment, "encoder_b", counted(alignment.encoder_b))

    def rows(texts, cut):
        given.clear()
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "n_chars": [len(t) for t in texts]})
        return [tuple(r.values()) for out in alignment._aligned(*files, cut)(iter([batch])) for r in out.to_pylist()]

    assert alignment.whole_words(*files)
    often = [" ".join(["counting", "tokenizers", "again"] * 2000 + [f"w{i}"]) for i in range(5)]
    got = rows(often, True)
    assert sum(given) < 200 < 100_000 < len(often[0]) * 5
    assert got == rows(often, False)
    rng, parts = random.Random(5), [*"aZ7é▁ß漢🙂#=\n\t\r\0\x7f\x85\xa0\u2028\u3000\u0301\u200d", " ", " ", " ", "  ", "don't", "'s", "'", "3.5", "<s>", "<|endoftext|>", "<0x41>", "of", "word"]
    odd = [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    whole = rows(odd, False)
    for joined, kept in ((1 << 13, 1 << 22), (1, 50)):
        monkeypatch.setattr(alignment, "JOINED", joined)
        monkeypatch.setattr(alignment, "KEPT", kept)
        monkeypatch.setattr(alignment, "CALL", kept)
        assert rows(odd, True) == whole
    assert 500 < sum(r[1] > 0 for r in whole) < len(odd)


def test_texts_of_other_tokenizers_are_encoded_whole():
    from sentencepiece import sentencepiece_model_pb2

    file_a, file_b = tokenizer_file(alignment.A), tokenizer_file(alignment.B)
    a = json.loads(file_a)
    a["pre_tokenizer"]["use_regex"] = False
    assert not alignment.whole_words(json.dumps(a).encode(), file_b)
    for change in ("piece", "normalizer"):
        b = sentencepiece_model_pb2.ModelProto.FromString(file_b)
        if change == "piece":
            b.pieces.add(piece="of▁the", score=-1.0)
        else:
            b.normalizer_spec.remove_extra_whitespaces = True
        assert not alignment.whole_words(file_a, b.SerializeToString())


def test_alignment_of_nothing(spark):
    schema = "doc_id long, text string"
    assert alignment_scores(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in alignment_scores(spark.createDataFrame([(1, None), (2, "")], schema)).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if edit_one(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("shard_words", [spelling.SHARD_WORDS, 7])
def test_variants_match_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcéÿ×") for _ in range(rng.randint(6, 9))) for _ in range(25)]

    def edited(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + ["", rng.choice("abé"), rng.choice("abc") + w[i]][kind] + w[i + 1 :]

    words = [*stems, *map(edited, stems * 3), "chain" + "a" * 8, "chain" + "a" * 9, "chain" + "a" * 10]
    weights = [rng.choice([1, 6, 40, 300]) for _ in words[:-3]] + [400, 60, 8]
    texts = [" ".join(rng.choices([*words, *(w.upper() for w in words[:9])], [*weights, *weights[:9]], k=120)) for _ in range(130)] + [None, "", "ab1cd Āā", ("long" * 20000 + " ") * 5]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (0, texts[0])]
    out = spelling_variants(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3), shard_words=shard_words).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    assert got == brute_variants(rows) and len(got) == len(out)
    assert got["chain" + "a" * 10][1] == "chain" + "a" * 8 and sum(v[0] is not None for v in got.values()) > 20


def test_variants_of_nothing(spark):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (2, ""), (3, "too few words")]):
        assert spelling_variants(spark.createDataFrame(rows, schema)).collect() == []


def test_automaton_walks_as_edit_distance():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(120)})
    trie = Trie.of([w.encode() for w in words], [len(w) + 1 for w in words])
    for w in [*words, "aaaaaaaab", "c", ""]:
        assert sorted((x.decode(), n) for x, n in near_words(trie, w.encode())) == [(x, len(x) + 1) for x in words if edit_one(w, x)]
    deep = b"ab" * 100_000
    trie = Trie.of([deep, deep + b"b"], [1, 2])
    assert list(near_words(trie, deep)) == [(deep + b"b", 2)]


def brute_top(rows, k, every):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j) for b, (j, w) in enumerate(rows) if a != b)[:k]
            out += [(i, r, j, -s) for r, (s, _, j) in enumerate(best, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "spread"), [(4096, 1), (64, 1), (64, 40), (3, 1)])
def test_top_k_matches_brute_force(spark, monkeypatch, block, spread):
    monkeypatch.setattr(impact_index, "BLOCK", block)
    monkeypatch.setattr(impact_index, "BLOCKS", 2)
    monkeypatch.setattr(impact_index, "PIECE", 5)
    rng = np.random.default_rng(block + spread)
    centres = rng.normal(size=(4, 12)) * spread
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + rng.normal(size=12)]) for i in range(300)]
    rows += [(400 + i, rows[20][1]) for i in range(9)] + [(20, rows[20][1]), (500, rows[3][1][:5]), (550, []), (600, None), (601, [1.0, None]), (602, [float("nan")]), (610, [float("inf")]), (None, rows[40][1]), (-10, rows[7][1])]
    out = top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4), every=10).collect()
    assert sorted(str(tuple(r)) for r in out) == brute_top(rows, 5, 10)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).collect() == []
    assert top_k(spark.createDataFrame([(50, [1.0])], schema)).collect() == []
    out = top_k(spark.createDataFrame([(50, [1.0, 2.0]), (7, [0.5, -1.0]), (3, [0.5, -1.0])], schema)).orderBy("rank").collect()
    assert [tuple(r) for r in out] == [(50, 1, 3, 128 * 256 - 512 * 256), (50, 2, 7, 128 * 256 - 512 * 256)]
