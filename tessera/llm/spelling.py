"""Spelling variants of a corpus's words: those one edit away, and the frequent form that a rare one stands for.

Words are counted in each task, counts are summed by word. Words are dealt by their first letters (BEGINNING) and sorted by the cluster, and become shards of up to SHARD_WORDS words and
SHARD_LETTERS letters; a task makes each a compact trie: a letter and a 32-bit number of its first child a node, nodes by depth, so that a
node's children are neighbours. There are shards of the words and shards of the words read backwards. Shards are broadcast one by one, each bounded by these two figures, and every word's
Levenshtein automaton of distance one goes through every shard depth-first: its state is the middle of a row of the edit distance's
matrix, of which there are a few, so a node of a trie is visited once at most. A near word that shares a word's first half is
found in a shard of words, where the automaton allows its edit behind that half only; one that doesn't shares the second half and is found in a backward shard, likewise. So each is
found once, and a word leaves most shards after a few letters instead of trying all that they begin with. What a task finds for a word in a shard
is one row, its number of near words and the best of them; these rows are summed by word. Roots come by doubling: forms grow in number at
each step, so a chain has no circle and few steps.

Each occurrence counts, so repeated rows count again. A null id counts as an empty one. Null and empty texts have no words; whole texts are read, and a run of
letters may have any length. Ties for the most frequent near word go to the smallest in code-point order. Other columns of the table are not read. An
empty table gives an empty one.

Bounds: a task's counts hold up to HELD words, then are passed on; the driver and the workers hold one shard at a time. The number of near words of a word follows its
letters only: they are in U+0000..U+00FF.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written

#: The letters of words, ASCII in lower case.
LETTERS = "[a-z\u00c0-\u00ff]"
MIN_LETTERS, MIN_COUNT, RATIO, SLIPS = 6, 5, 5, 199
HELD, SHARD_WORDS, SHARD_LETTERS, BEGINNING, TASK_WORDS = 1 << 19, 1 << 17, 1 << 22, 3, 2000
TRIE, NEAR = "shard long, letters binary, firsts binary, counts binary", "word string, n_near long, form_n long, form string"


def slipped(word: str, start: int, every: int = SLIPS) -> str:
    """word, or without one of its letters where its checksum after start is divisible by every."""
    h = zlib.crc32(word.encode(), start)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counted(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, int] = defaultdict(int)
        # a run of too few letters is too short with or without one of them, and a longer one matches whole
        runs = re.compile(f"{LETTERS}{{{least},}}").findall

        def passed() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            for i in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                # bytes.lower() changes A-Z only
                own = Counter(runs(text.as_buffer().to_pybytes().lower().decode())) if text.is_valid else {}
                for word, n in own.items():
                    word = slipped(word, start, slip) if slip else word
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield from passed()
                    held.clear()
        yield from passed()

    return run


def word_counts(docs: DataFrame, least: int = MIN_LETTERS, seldom: int = MIN_COUNT, slip: int = SLIPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least so many letters that occur at least so often, written. slip: of so many words of a document one loses a letter; 0: none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_counted(least, slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seldom), "words")


class Trie:
    """letters[v] leads to node v, whose children are firsts[v] up to firsts[v + 1]; counts[v] is over 0 where a word ends."""

    def __init__(self, letters: bytes, firsts: array, counts: array):
        self.letters, self.firsts, self.counts = letters, firsts, counts

    @staticmethod
    def of(words: list[bytes], n: list[int]) -> Trie:
        """words are in order and differ."""
        letters, firsts, counts = bytearray(1), array("i"), array("q")
        level = [(0, len(words))] if words else []
        depth = 0
        while level:
            below = []
            for low, high in level:  # words[low:high] share what leads to this node
                ends = len(words[low]) == depth
                counts.append(n[low] if ends else 0)
                firsts.append(len(letters))
                low += ends
                while low < high:
                    letter, first = words[low][depth], low
                    while low < high and words[low][depth] == letter:
                        low += 1
                    letters.append(letter)
                    below.append((first, low))
            level, depth = below, depth + 1
        firsts.append(len(letters))
        return Trie(bytes(letters), firsts, counts)


def _step(state: tuple[int, int, int], same: tuple[bool, bool, bool]) -> tuple[int, int, int]:
    """The next row of the matrix: distances, 2 and more as 2, of the letters so far from the word's beginnings that are one shorter, as long and one
    longer; same: whether the next letter is the word's before this place, at it, after it."""
    short, level, more = state
    a = min(level + 1, short + (not same[0]), 2)
    b = min(more + 1, a + 1, level + (not same[1]), 2)
    return a, b, min(b + 1, more + (not same[2]), 2)


#: The automaton of distance one, by numbered states; the last state is dead.
STATES = [*product(range(3), repeat=3)]
NEXT = [[STATES.index(_step(s, same)) for same in product((False, True), repeat=3)] for s in STATES]
START, DEAD = STATES.index((2, 0, 1)), STATES.index((2, 2, 2))
LOOSE = [NEXT[s][0] != DEAD for s in range(len(STATES))]
#: The places of the word (before, at, after) whose letters alone lead on from a state.
LIVE = [[i for i in range(3) if NEXT[s][4 >> i] != DEAD] for s in range(len(STATES))]
#: A word's rest is one edit away if it is as many letters longer than where the state is, -1, 0 or 1.
ACCEPTS = [[s[1 + rest] == 1 for rest in (0, 1, -1)] for s in STATES]


def near_words(trie: Trie, word: bytes, held: int = 0) -> Iterator[tuple[bytes, int]]:
    """The words of a trie that are exactly one edit from word and share its first held letters, each with its count."""
    letters, firsts, counts, size = trie.letters, trie.firsts, trie.counts, len(word)
    padded = b"\0" + word + b"\0\0"  # the place before, at and after depth d is padded[d : d + 3]
    node = 0 if counts else -1
    for i in range(held):
        if node < 0:
            break
        node = letters.find(word[i], firsts[node], firsts[node + 1])
    todo = [(node, held, START, None)] if node >= 0 else []
    while todo:
        node, depth, state, path = todo.pop()
        if counts[node] and size - depth <= 1 and ACCEPTS[state][size - depth]:
            near, back = bytearray(), path
            while back:
                back, letter = back
                near.append(letter)
            yield word[:held] + near[::-1], counts[node]
        if depth > size:
            continue
        low, high = firsts[node], firsts[node + 1]
        before, at, after = padded[depth : depth + 3]
        if LOOSE[state]:
            children = range(low, high)
        else:
            live = LIVE[state]
            tried = padded[depth + live[0] : depth + live[0] + 1] if len(live) == 1 else {padded[depth + i] for i in live}
            children = [c for c in (letters.find(x, low, high) for x in tried) if c >= 0]
        for child in children:
            c = letters[child]
            after_it = NEXT[state][4 * (c == before) + 2 * (c == at) + (c == after)]
            if after_it != DEAD:
                todo.append((child, depth + 1, after_it, (path, c)))


def _tries(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, size, last = [], [], 0, None

        def made() -> pa.RecordBatch:
            t = Trie.of(words, n)
            return pa.RecordBatch.from_pylist([{"shard": len(words), "letters": t.letters, "firsts": t.firsts.tobytes(), "counts": t.counts.tobytes()}])

        for batch in batches:
            for word, k, shard in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "shard")), strict=True):
                word = word.encode("latin-1")
                if words and (shard != last or len(words) >= shard_words or size + len(word) > SHARD_LETTERS):
                    yield made()
                    words, n, size = [], [], 0
                last = shard
                words.append(word)
                n.append(k)
                size += len(word)
        if words:
            yield made()

    return run


def near_here(trie: Trie, word: bytes, backward: bool) -> list[tuple[bytes, int]]:
    """The near words of word that share its first half, or, where trie has words backwards, the others."""
    half = len(word) // 2
    if not backward:
        return list(near_words(trie, word, half))
    found = ((near[::-1], n) for near, n in near_words(trie, word[::-1], len(word) - half))
    return [(near, n) for near, n in found if not near.startswith(word[:half])]


def _searched(shard, backward: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, firsts, counts = shard.value
        trie = Trie(letters, array("i", firsts), array("q", counts))
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                found = [(-n, near) for near, n in near_here(trie, word.encode("latin-1"), backward)]
                if found:
                    n, form = min(found)
                    rows.append((word, len(found), -n, form.decode("latin-1")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["word", "n_near", "form_n", "form"])

    return run


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of the words of (word, n) that have a near word: how many, and the most frequent of them."""
    spark, n = words.sparkSession, words.count()
    dealt = max(1, -(-n // shard_words))
    # words next to each other take alike ways; dealt out evenly, as many a task as are worth one
    queries = written(words.select("word").repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_WORDS))), "queries")
    parts = []
    for backward in (False, True):
        key = F.reverse("word") if backward else F.col("word")
        shard = F.pmod(F.xxhash64(F.left(key, F.lit(BEGINNING))), F.lit(dealt)).alias("shard")
        shards = words.select(key.alias("word"), "n", shard).repartition(dealt, "shard").sortWithinPartitions("shard", "word")
        for t in written(shards.mapInArrow(_tries(shard_words), TRIE), "tries", "zstd").drop("shard").toLocalIterator():
            shard = spark.sparkContext.broadcast((bytes(t.letters), bytes(t.firsts), bytes(t.counts)))
            parts.append(written(queries.mapInArrow(_searched(shard, backward), NEAR), "near"))
            shard.destroy()
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form): form, the form of that, and so on to the last. Each round, written, doubles the way that a word has gone."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not steps.where("moved").head(1):
            return steps.select("word", "root")
        roots = steps.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, **words) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs: form is its most frequent near word, if that occurs ratio times as often at least, and
    root the end of the chain of forms, the word itself without one."""
    counts = word_counts(docs, **words)
    near = counts.join(neighbours(counts, shard_words), "word", "left")
    better = F.col("form_n") >= ratio * F.col("n")
    rows = written(near.select("word", F.when(better, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("form_n")).alias("form_n")), "variants")
    roots = rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
