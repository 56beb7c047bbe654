"""Page text and URL verdicts."""

import html
import re

import numpy as np

from tessera.llm import page_text, url_filter


def test_made_pages_have_a_label_for_each_block():
    for page, labels in page_text.labelled_pages(100, 1):
        assert len(page_text.Blocks(page).blocks) == len(labels)


def test_held_out_blocks():
    field, right, total = page_text.fit(), 0, 0
    for page, labels in page_text.labelled_pages(200, 4242):
        got = field.decoded(page_text.features(page_text.Blocks(page).blocks))
        right += sum(int(a == b) for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        names = {f"f{i}": i for i in range(n)}
        field = page_text.Field(names, rng.normal(size=(n, 2)), rng.normal(size=(2, 2)))
        rows = [[f"f{i}"] for i in range(n)]

        def score(path):
            return sum(field.weights[i, y] for i, y in enumerate(path)) + sum(field.turns[a, b] for a, b in zip(path, path[1:]))

        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert score(field.decoded(rows)) == max(map(score, paths))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    field = page_text.Field({}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
    rows, labels = [np.array([0, 1]), np.array([2]), np.array([3, 4, 1]), np.array([5])], np.array([0, 1, 1, 0])
    score = lambda path: sum(field.weights[row, y].sum() for row, y in zip(rows, path)) + sum(field.turns[a, b] for a, b in zip(path, path[1:]))
    plain = lambda: score(labels) - np.log(sum(np.exp(score([k >> i & 1 for i in range(4)])) for k in range(16)))
    own, grad, turn = field.likelihood(rows, labels)
    assert abs(own - plain()) < 1e-9
    for table, slope in ((field.weights, grad), (field.turns, turn)):
        for at in np.ndindex(table.shape):
            table[at] += 1e-6
            high = plain()
            table[at] -= 2e-6
            low = plain()
            table[at] += 1e-6
            assert abs((high - low) / 2e-6 - slope[at]) < 1e-5


def test_scores_by_element_are_those_by_features():
    field = page_text.fit()
    for page, _ in page_text.labelled_pages(60, 99):
        blocks = page_text.Blocks(page).blocks
        assert np.allclose(field.block_scores(blocks), field.scores(page_text.features(blocks)))


def test_formulas_stay_in_their_sentence():
    page = "<article><h1>Sums of two</h1><p>We know that <math><mi>a</mi><mo>+</mo><mn>1</mn></math> is true, and <x-term>so</x-term> on it goes.<p>More <object>of it</object> follows here as well, they say.</article><footer>end</footer>"
    assert page_text.extracted(page, page_text.fit()) == "Sums of two We know that a+1 is true, and so on it goes. More of it follows here as well, they say."


def test_deep_and_long_pages_take_time_by_length():
    import time

    field = page_text.fit()
    pages = [lambda n: "<div>" * n + "<p>a sentence of some words." * n, lambda n: "<b>" * n + "<div>x y." * n, lambda n: "<ul>" * n + "</ul>x" * n, lambda n: "<p><span>" * n, lambda n: "<p class='c1 c2'>Text of a page, and more of it." * n, lambda n: "</i>" * n + "<i>" * n + "</b>" * n, lambda n: "<div><p>a b.</p>" * n]
    for page in pages:
        seconds = []
        for n in (5_000, 20_000):
            began = time.process_time()
            page_text.extracted(page(n), field)
            seconds.append(time.process_time() - began)
        assert seconds[1] < 10 * seconds[0] + 0.5


def test_extraction(spark):
    page = """<html><head><title>t</title><script>var x = "</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<article><h1>Big &amp;\n  news</h1><p>It is <b>ve</b>ry true that many things happened here today.<p>And so on, as they say, it goes on and on.</article>
<div class="comments"><p>First!</p></div><aside><p>Related</p></aside><footer>&copy; 2024 us</footer></body></html>"""
    rows = [(1, "http://a", page, "x"), (1, "http://a", page, "x"), (2, None, None, None), (3, "u", "", ""), (None, "v", "<", "")]
    out = {str(r.page_id): r for r in page_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out["1"].text == "Big & news It is very true that many things happened here today. And so on, as they say, it goes on and on."
    assert out["1"].n_chars == len(out["1"].text) and out["2"].text == "" and out["3"].n_chars == 0
    assert page_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in page_text.page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def brute(url, entries):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)(/[^?#]*)?", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2] or ""
    best = max(((r, len(h) + len(p), h, p, v) for h, p, v, r in entries if (host == h or host.endswith("." + h)) and path.startswith(p) and host), default=None)
    return host, path, best[2] + best[3] if best and best[0] else None, best[4] if best else "allow"


def test_verdicts(spark):
    entries = url_filter.RULES + url_filter.LISTED + [("x.org", "", "block", True)]
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x", "https://a.example.com/en/8", "http://example.net/de/8/x", "http://b.example.net/de/1#y", "http://org/es/", "http://x.org", "http://x.org?/q", "http://notx.org/", "http://www.cheap-pills.example.com/a", "http://www.cheap-pills.example.com/en/4", "://h/", "http://a.b://c/en/", "http://com/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])]
    out = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(entries, url_filter.ENTRIES)).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in out) == sorted((i, h, p, str(r), v) for i, u in rows for h, p, r, v in [brute(u, entries)])
    none = spark.createDataFrame([], url_filter.ENTRIES)
    assert {r.verdict for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), none).collect()} == {"allow"}


def test_lists_of_many_path_lengths_and_odd_tables(spark):
    entries = [("long.org", "/" + "a" * n, "block" if n % 2 else "allow", False) for n in range(1500)]
    urls = [f"http://x.long.org/{'a' * n}/" for n in (0, 3, 700, 1499, 1600)] + ["http://long.org/" + "b" * 100_000, "http://" + "a." * 3000 + "long.org/aa"]
    schema = "page_id long, url string, host string, path int, rule string, tail string"
    rows = [(i, u, "h", 1, "r", "t") for i, u in enumerate(urls)]
    got = {r.page_id: (r.verdict, r.listed) for r in url_filter.url_verdicts(spark.createDataFrame(rows, schema), spark.createDataFrame(entries, url_filter.ENTRIES)).collect()}
    assert got == {0: ("allow", True), 1: ("block", True), 2: ("allow", True), 3: ("block", True), 4: ("block", True), 5: ("allow", True), 6: ("allow", True)}
    assert url_filter.url_verdicts(spark.createDataFrame([], schema), spark.createDataFrame(entries, url_filter.ENTRIES)).count() == 0


def test_filter_has_no_false_negatives(spark):
    entries = spark.range(5000).selectExpr("concat('h', id, '.com') AS host", "'/a' AS path", "'block' AS verdict", "false AS rule")
    words = url_filter.bloom(entries)
    digests = lambda n, m: spark.range(n, m).selectExpr("xxhash64(concat('h', id, '.com'), '/a') AS d").toPandas()["d"].to_numpy()

    def share(d):
        block, bits = url_filter._places(d, len(words) * 64 // url_filter.BLOCK_BITS)
        at = block[:, None] * url_filter.BLOCK_BITS + bits.astype(np.int64)
        return (((words[at >> 6] >> (at & 63)) & 1).all(axis=1)).mean()

    assert share(digests(0, 5000)) == 1.0 and share(digests(10_000, 60_000)) < 0.02


def test_url_of_very_many_labels(spark):
    hosts = {1: "a." * 200_000 + "shop.example", 2: "a." * 200_000 + "notshop.example", 3: "shop.example"}
    rows = [(i, f"https://{h}/x/y") for i, h in hosts.items()]
    entries = [("shop.example", "/x", "block", True), ("example", "/none", "block", False), ("a.b.shop.example", "/", "block", False)]
    out = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(entries, url_filter.ENTRIES)).collect()
    assert {r.page_id: (r.verdict, r.rule) for r in out} == {1: ("block", "shop.example/x"), 2: ("allow", None), 3: ("block", "shop.example/x")}
