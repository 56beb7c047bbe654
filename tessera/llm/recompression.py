"""Repeated word windows by recompression.

A round names runs of one symbol and then pairs of neighbours (left symbol of
the left half of the alphabet, right one of the right half; the halves are drawn
anew each round). A name is a digest of what it stands for, so it is the same in
all documents of the corpus without a dictionary to look up. Whether a run or a
pair is named depends on nearby symbols only; each symbol carries the words that
settled it. So a symbol whose settling words lie inside a window comes out the
same wherever this window occurs: equal windows hold the same such symbols.

Each window picks the longest of them (the least name among equals; a lower
round's, at last a word, where none is settled). Documents are sent to that
name, one row for each stretch of windows with the same pick, with digests of
the windows. Names that documents share reveal the repeats; the windows' digests
verify them (name and digest together are 112 bits: among 10**13 windows about one pair in 10**7 such
corpora would agree by chance). What repeats inside one
slice of a task is settled there and only its smallest document goes on. A task keeps
the windows that repeated in a slice, KNOWN at most, with the smallest document so far, and settles them in later slices too;
what it doesn't keep goes on as any other. So a passage that a third of the corpus holds
costs a task a row or two, and no reducer gets a row for each document. A name that more than a share of
1 / HEAVY of the windows picks is split into SPLIT names by the windows' digests. SAMPLED rows show which names these
are, HEAVY at most; they decide where windows meet and not what is found.

A null or blank text has no words, removes nothing and keeps the empty text.
Windows belong to a row (its id and a hash of its text) and are compared by id:
rows with equal ids are one document to the rule: a row removes nothing for the
sake of another with the same id, also if their texts differ. A null id takes part in nothing. Other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.llm.words import joined, mix, slices, windows

WINDOW, ROUNDS = 13, 2


class Symbols:
    """A text of symbols: names, bytes covered, and words that settle them."""

    def __init__(self, names, length, lo, hi, row, first, last):
        #: lo..hi: the words that settle a symbol; first, last: of the row; a symbol that the row's edge settles has lo or hi outside
        self.names, self.length, self.lo, self.hi, self.row, self.first, self.last = names, length, lo, hi, row, first, last

    @classmethod
    def of_words(cls, digests: np.ndarray, bounds: np.ndarray, sizes_of_words: np.ndarray) -> Symbols:
        at, sizes = np.arange(len(digests)), np.diff(bounds)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return cls(digests, sizes_of_words, at, at + 1, row, bounds[:-1][row], bounds[1:][row])

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before and hi of the one after, beyond the row at its edges."""
        n = len(self.names)
        same = self.row[1:] == self.row[:-1]
        lo, hi = self.first - 1, self.last + 1
        lo[1:] = np.where(same, self.lo[:-1], lo[1:])
        hi[: n - 1] = np.where(same, self.hi[1:], hi[: n - 1])
        return lo, hi

    def _merged(self, starts: np.ndarray, names, lo, hi) -> Symbols:
        return Symbols(names, np.add.reduceat(self.length, starts), lo, hi, self.row[starts], self.first[starts], self.last[starts])

    def runs(self) -> Symbols:
        """Each run of one symbol becomes a symbol, named by what it repeats and how often."""
        new = np.ones(len(self.names), bool)
        new[1:] = (self.names[1:] != self.names[:-1]) | (self.row[1:] != self.row[:-1])
        starts = np.flatnonzero(new)
        count = np.diff(starts, append=len(new))
        lo, hi = self._beside()
        names = np.where(count > 1, joined(self.names[starts], count.astype(np.uint64)), self.names[starts])
        return self._merged(starts, names, lo[starts], hi[starts + count - 1])

    def pairs(self, round_: int) -> Symbols:
        """Each left symbol followed by a right one becomes a symbol with it."""
        left = mix(self.names ^ np.uint64(0xA5A5A5A5A5A5A5A5 + round_)) & np.uint64(1) == 0
        n = len(left)
        opens = np.zeros(n, bool)
        opens[: n - 1] = left[:-1] & ~left[1:] & (self.row[1:] == self.row[:-1])
        second = np.zeros(n, bool)
        second[1:] = opens[:-1]
        lo, hi = self._beside()
        # a left symbol alone is settled by what follows it, a right one by what is before it
        lo, hi = np.where(left | second, self.lo, lo), np.where(left & ~opens, hi, self.hi)
        starts = np.flatnonzero(~second)
        ends = starts + opens[starts]
        names = np.where(opens[starts], joined(self.names[starts], self.names[ends]), self.names[starts])
        return self._merged(starts, names, lo[starts], hi[ends])


def picks(digests: np.ndarray, bounds: np.ndarray, width: int, rounds: int, bytes_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each window of width words inside a row: its first word and the name it picks."""
    symbols = Symbols.of_words(digests, bounds, np.ones(len(digests), np.int64) if bytes_of is None else bytes_of)
    at = np.arange(len(digests))
    at = at[at + width <= symbols.last]
    found, best = np.zeros(len(at), np.uint64), np.full(len(at), np.iinfo(np.uint64).max)
    levels = [symbols]
    for r in range(rounds if len(at) else 0):
        symbols = symbols.runs().pairs(r)
        levels.append(symbols)
    for level, s in enumerate(levels):
        # the least key: the longest symbol, then the least digest
        key = (np.uint64(127) - np.minimum(s.length, 127).astype(np.uint64) << np.uint64(57)) | (mix(s.names + np.uint64(level)) >> np.uint64(7))
        i = np.searchsorted(s.lo, at)  # the symbols that the window settles are i..j-1
        j = np.searchsorted(s.hi, at + width, "right")
        tables = [key]
        while 2 << len(tables) - 1 <= width:
            step = 1 << len(tables) - 1
            tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]) if len(tables[-1]) > step else tables[-1][:0])
        for p, table in enumerate(tables):
            w = np.flatnonzero((j - i >= 1 << p) & (j - i < 2 << p))
            if len(w):
                least = np.minimum(table[i[w]], table[j[w] - (1 << p)])
                best[w] = np.where(least < best[w], least, best[w])
    found = mix(best)
    return at, found


#: Bytes of a window's digest that go with its name.
KEPT = 6
#: Windows of one name that a task holds between batches; what is beyond goes to a join.
HELD = 1 << 20
#: Repeated windows that a task keeps from slice to slice.
KNOWN = 1 << 20


#: Rows that show frequent names; the inverse of a frequent name's share, and so the most there can be; names that one is split into; partitions of windows for each of an other shuffle.
SAMPLED, HEAVY, SPLIT, SPREAD = 4000, 4096, 64, 1


class Known:
    """Windows that a task has seen in several documents, with the smallest of these."""

    def __init__(self, most: int):
        self.most, self.windows, self.least = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def lowered(self, window: np.ndarray, doc: np.ndarray, least: np.ndarray) -> None:
        """least, where a smaller document is known; and the other way round."""
        if len(self.windows):
            i = np.minimum(np.searchsorted(self.windows, window), len(self.windows) - 1)
            hit = self.windows[i] == window
            i, held = i[hit], self.least.copy()
            np.minimum.at(self.least, i, doc[hit])
            least[hit] = np.minimum(least[hit], held[i])

    def keep(self, window: np.ndarray, least: np.ndarray) -> None:
        new = np.zeros(len(window), bool) if not len(self.windows) else self.windows[np.minimum(np.searchsorted(self.windows, window), len(self.windows) - 1)] == window
        window, least = window[~new][: self.most - len(self.windows)], least[~new][: self.most - len(self.windows)]
        both = np.concatenate([self.windows, window])
        order = np.argsort(both, kind="stable")
        self.windows, self.least = both[order], np.concatenate([self.least, least])[order]


def _revealed(width: int, rounds: int, heavy: np.ndarray):
    """Rows (name, doc_id, row, start, n, windows): a stretch of n windows that pick a
    name, with KEPT bytes of each window; without these, and with a name of no meaning, what a task settles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = Known(KNOWN)
        for batch in batches:
            ids, keys = batch.column(0).fill_null(-1).to_numpy(), batch.column(2).to_numpy()
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1)):
                digests = s.digests()
                if len(digests) < width:
                    continue
                at, name = picks(digests, s.words, width, rounds)
                row = np.searchsorted(s.words, at, "right") - 1
                ok = known[s.first + row]
                at, name, row = at[ok], name[ok], row[ok]
                if not len(at):
                    continue
                doc, window = ids[s.first + row], windows(digests, width)[at]
                start = at - s.words[row]
                if len(heavy):
                    split = heavy[np.minimum(np.searchsorted(heavy, name), len(heavy) - 1)] == name
                    name = np.where(split, joined(name, window % np.uint64(SPLIT)), name)
                # of a window that several documents of this slice hold, the smallest goes on
                order = np.argsort(window, kind="stable")
                head = np.ones(len(order), bool)
                head[1:] = window[order][1:] != window[order][:-1]
                heads = np.flatnonzero(head)
                least = np.empty_like(doc)
                times = np.diff(heads, append=len(order))
                lowest = np.minimum.reduceat(doc[order], heads)
                least[order] = np.repeat(lowest, times)
                several = heads[np.maximum.reduceat(doc[order], heads) > lowest]
                repeated.lowered(window, doc, least)
                repeated.keep(window[order][several], least[order][several])
                settled = least < doc
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (settled[1:] != settled[:-1]) | ((name[1:] != name[:-1]) & ~settled[1:])
                heads = np.flatnonzero(new)
                size = np.diff(heads, append=len(new))
                gone = settled[heads]
                offsets = np.concatenate([[0], np.cumsum(np.where(gone, 0, size * KEPT))]).astype(np.int32)
                packed = np.ascontiguousarray(window[~settled].view(np.uint8).reshape(-1, 8)[:, :KEPT])
                held = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                spread = np.where(gone, mix(doc[heads].view(np.uint64) + start[heads].astype(np.uint64)), name[heads])
                columns = [spread.view(np.int64), doc[heads], keys[s.first + row[heads]], start[heads].astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), held], names=["name", "doc_id", "row", "start", "n", "windows"])

    return run


def _stretches(doc, row, start, hit) -> tuple[np.ndarray, ...]:
    """(doc, row, start, n) of each run of neighbouring windows that are hit."""
    doc, row, start = doc[hit], row[hit], start[hit]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    return doc[heads], row[heads], start[heads], np.diff(heads, append=len(doc))


def _judged(most: int):
    """Of rows sorted by (name, doc_id): the stretches of windows that a smaller
    document holds, with null name; and, for names with more than most windows,
    (name, doc_id, row, start, window) for a join (start -1: judged already)."""

    def out(doc, row, start, n, name=None, window=None) -> pa.RecordBatch:
        null = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([null if name is None else pa.array(name), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), null if window is None else pa.array(window)], names=["name", "doc_id", "row", "start", "n", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_doc, over = None, np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            name, doc, row, start, n = (batch.column(i).to_numpy() for i in range(5))
            sizes = np.diff(np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :][: len(name) + 1]) if len(name) else n
            done = sizes == 0
            if done.any():
                yield out(doc[done], row[done], start[done], n[done])
                batch = batch.filter(pa.array(~done))
                name, doc, row, start, n = (x[~done] for x in (name, doc, row, start, n))
            if not len(name):
                continue
            column = batch.column(5)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(name) + 1]
            packed = np.zeros((int(n.sum()), 8), np.uint8)
            packed[:, :KEPT] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, KEPT)
            window = packed.view(np.int64).ravel()
            place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            name, doc, row, start = np.repeat(name, n), np.repeat(doc, n), np.repeat(row, n), np.repeat(start, n) + place
            if name[0] != last:
                held, held_doc, over = held[:0], held_doc[:0], False
            order = np.lexsort((window, name))  # stable: documents ascend within a window
            head = np.ones(len(order), bool)
            head[1:] = (window[order][1:] != window[order][:-1]) | (name[order][1:] != name[order][:-1])
            least = np.empty_like(doc)
            least[order] = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            first = name == last
            if first.any() and len(held):
                i = np.minimum(np.searchsorted(held, window[first]), len(held) - 1)
                least[first] = np.where(held[i] == window[first], np.minimum(least[first], held_doc[i]), least[first])
            yield out(*_stretches(doc, row, start, least < doc))
            if over and first.any():
                yield out(doc[first], row[first], start[first], np.ones(int(first.sum())), name[first], window[first])
            if name[-1] != last:
                last, held, held_doc, over = name[-1], held[:0], held_doc[:0], False
            if not over:
                own = name == last
                held, i = np.unique(np.concatenate([held, window[own]]), return_index=True)
                held_doc = np.concatenate([held_doc, doc[own]])[i]
                if len(held) > most:
                    yield out(held_doc, held_doc, np.full(len(held), -1), np.ones(len(held)), np.full(len(held), last), held)
                    held, held_doc, over = held[:0], held_doc[:0], True

    return run


def _without(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, removed = [], [], []
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                own = (text.as_py() or "").encode().split()  # bytes split at 0x20 and 0x09-0x0D
                words.append(len(own))
                if marks.is_valid:
                    marks = marks.values
                    start, n = (marks.field(i).to_numpy() for i in (0, 1))
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + width - 1, -1)
                    own = [w for w, k in zip(own, np.cumsum(edge)) if not k]
                removed.append(words[-1] - len(own))
                texts.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def _counted(width: int, rounds: int):
    """(name, n): the windows of each slice that pick a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                digests = s.digests()
                if len(digests) >= width:
                    names, n = np.unique(picks(digests, s.words, width, rounds)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["name", "n"])

    return run


def frequent_names(texts: DataFrame, width: int, rounds: int) -> np.ndarray:
    """The names, in order, that more than 1 / HEAVY of the windows of SAMPLED rows pick, about."""
    # a sample, and not a limit, for which each task would shuffle so many rows
    some = texts.sample(min(1.0, SAMPLED / max(texts.count(), 1)), seed=1)
    counts = some.mapInArrow(_counted(width, rounds), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    shares = counts.withColumn("all", F.sum("n").over(Window.partitionBy()))
    return np.sort(np.array([r[0] for r in shares.where(f"n * {HEAVY} > all").select("name").collect()], np.int64).view(np.uint64))


#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))


def repeated_windows(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, start, n): n windows of width words, from word start on, each of
    which also starts in a document with a smaller id; row is the hash of the text."""
    texts = _texts(docs, id_col, text_col)
    heavy = frequent_names(texts, width, rounds)
    rows = texts.mapInArrow(_revealed(width, rounds, heavy), "name long, doc_id long, row long, start int, n int, windows binary")
    # the windows are some times the input, so their partitions are more than those of other shuffles
    parts = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "name").sortWithinPartitions("name", "doc_id").mapInArrow(_judged(HELD), "name long, doc_id long, row long, start int, n int, window long")
    # nothing reads the windows' shuffle after this query: its files go as the query ends, before texts are shuffled
    conf = docs.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        rows = written(rows, "judged")
    finally:
        conf.set(CLEANUP, before)
    over = rows.where("name is not null")
    least = over.groupBy("name", "window").agg(F.min("doc_id").alias("least"))
    late = over.where("start >= 0").join(least, ["name", "window"]).where("least < doc_id")
    return rows.where("name is null").select("doc_id", "row", "start", "n").unionByName(late.select("doc_id", "row", "start", "n"))


def without_repeats(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row of docs: text has the
    words that no repeated window covers, joined by one space."""
    marks = repeated_windows(docs, width, rounds, id_col, text_col).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    rows = _texts(docs, id_col, text_col).join(marks, ["doc_id", "row"], "left")
    return rows.mapInArrow(_without(width), "doc_id long, text string, n_words long, n_removed long")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
