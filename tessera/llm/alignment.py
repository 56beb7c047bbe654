"""Alignment of two tokenizers over a corpus: which tokens of one stand where which of the other do.

Tokens are byte ranges, so the ends of both tokenizers, merged,
cut the text into ranges that belong to one token of either: each range is a link, and the ends
that both have cut the tokens into groups. Where a space follows a printable ASCII character, neither of the two tokenizers has a token
across, nor looks across (whole_words checks that of their files), so a text is cut there into stretches, mostly words, which each tokenizer
encodes once as long as a task keeps them; a document's tokens, groups and links are those of its stretches, in order. Texts of other tokenizers are encoded
whole. A pair of ids is one int64, A's id above B's. The pairs of the documents
are counted by np.unique in each task, partial counts are range-partitioned and sorted by the whole cluster, and equal
keys, then neighbours, summed in runs. Each range is a shard, two files of sorted keys and counts in the shared folder; to
score documents, tasks map the shards into memory and find keys by searchsorted.

A pair's count is the number of rows that hold it, so repeated rows count each, and so do rows of one id. Texts that are null
or empty, or whose tokens' bytes don't give the text back, have no tokens: zeros, and no digest. Long texts are taken whole. Ties for an
A id's highest count all are best. Other columns of the table are not read. An empty table gives an empty one.

Bounds: a task holds the tokens of documents of CALL characters together, or of one longer text, what it knows of KEPT bytes of stretches and one call's, and up to MERGED distinct pairs before it
passes partial counts on; the highest count of each A id is an array by the vocabulary; shards are mapped, not loaded.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shards import Writer, folder, mapped
from tessera.llm.shared import written
from tessera.llm.token_counts import tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of documents that are aligned together, but for a longer single text; bytes of stretches that a task keeps; pairs that a task merges or looks up at a time.
CALL, KEPT, MERGED = 1 << 20, 1 << 22, 1 << 21
#: Bytes of stretches that are encoded as one text; what the pieces of B have for a space.
JOINED, SPACE = 1 << 13, "▁".encode()
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SHARD = "first long, keys string, counts string, ids string, best string"


def byte_level(token: str, table: dict[str, int] = {}) -> bytes:  # noqa: B006
    """The bytes of a byte-level token: printable Latin-1 stands for itself, the other bytes for the letters from U+0100 on, in order."""
    if not table:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in set(plain)]
        table |= {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


def encoder_a(file: bytes):
    """A function from texts to ids of the byte-level tokenizer, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(file)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)], [byte_level(t.id_to_token(i) or "") for i in range(t.get_vocab_size())]


def encoder_b(file: bytes):
    """The same of the piece tokenizer."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=file)
    pieces = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
    return lambda texts: p.encode(texts, num_threads=1), pieces


def whole_words(file_a: bytes, file_b: bytes) -> bool:
    """Whether texts may be cut before a space that follows a printable ASCII character: A splits texts by the byte-level expression, as they are; B is
    a BPE of texts as they are behind a space, and no piece has a space behind something else."""
    from sentencepiece import sentencepiece_model_pb2

    a, b = json.loads(file_a), sentencepiece_model_pb2.ModelProto.FromString(file_b)
    split, model, norm, how = a.get("pre_tokenizer") or {}, a["model"], b.normalizer_spec, b.trainer_spec
    byte_level = not a.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")
    plain = model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in a.get("added_tokens", []))
    as_is = not norm.precompiled_charsmap and not norm.normalization_rule_tsv and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    bpe = how.model_type == how.BPE and not how.treat_whitespace_as_suffix and not any(x.type == x.USER_DEFINED for x in b.pieces)
    return bool(byte_level and plain and as_is and bpe and not any("▁" in x.piece.lstrip("▁") for x in b.pieces))


def stretch_starts(data: np.ndarray, ends: np.ndarray, cut: bool) -> np.ndarray:
    """Where stretches start in the bytes of texts that end at ends; each text starts with a space and has two bytes at least. A last space is none."""
    starts = np.zeros(len(data), bool)
    if cut:
        starts[1:] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)
        starts[ends - 1] = False
    starts[np.append(0, ends[:-1])] = True
    return np.flatnonzero(starts)


def links(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The packed pair of ids of each link, in the text's order; end_: where tokens end."""
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two runs in order
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]


class Names:
    """Ids as decimal text with what stands behind them."""

    def __init__(self, n: int):
        self.inside, self.of_a, self.of_b = (np.array([f"{i}{c}" for i in range(n)], object) for c in ",|;")

    def groups(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, cuts: np.ndarray) -> str:
        at_a, at_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(at_b, at_a)] = np.where(cuts[at_a] == end_a, self.of_a[a], self.inside[a])
        out[np.arange(len(b)) + np.searchsorted(at_a, at_b, "right")] = np.where(cuts[at_b] == end_b, self.of_b[b], self.inside[b])
        return "".join(out)[:-1]


class Stretches:
    """(n_a, n_b, n_groups, n_links, groups, links) of stretches, encoded once as long as they are kept; zeros if their tokens don't give them back."""

    def __init__(self, file_a: bytes, file_b: bytes, cut: bool):
        self.cut = cut
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = encoder_a(file_a), encoder_b(file_b)
        self.width_a, self.width_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.names, self.known, self.size = Names(max(len(self.bytes_a), len(self.bytes_b))), {}, 0

    def of(self, stretches: list[bytes]) -> list[tuple]:
        if self.size > KEPT:
            self.known, self.size = {}, 0
        new = [s for s in stretches if s not in self.known]
        self.size += sum(map(len, new))
        if new:
            self._add(new)
        return [self.known[s] for s in stretches]

    def _tokens(self, new: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
        """Stretches with the ids of A and B of all of them in a row, or without ids if these don't give them back. Where a text may be cut it may be joined as well, so
        that stretches share a call, JOINED bytes of them; what doesn't end as a cut needs it, or looks like a piece's space, is encoded by itself."""
        joined, size, parts = [], 0, []
        for s in new:
            if self.cut and 32 < s[-1] < 127 and SPACE not in s:
                joined.append(s)
                size += len(s)
                if size >= JOINED:
                    parts.append(joined)
                    joined, size = [], 0
            else:
                parts.append([s])
        parts += [joined] if joined else []
        texts = [b"".join(part).decode() for part in parts]
        for part, text, a, b in zip(parts, texts, self.encode_a(texts), self.encode_b([t[1:] for t in texts]), strict=True):
            same = b"".join(map(self.bytes_a.__getitem__, a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, b))
            if same or len(part) == 1:
                yield (part, a, b) if same else (part, [], [])
            else:
                for s in part:
                    yield from self._tokens([s])

    def _add(self, new: list[bytes]) -> None:
        good, a, b = [], [], []
        for part, x, y in self._tokens(new):
            if x:
                good += part
                a.append(x), b.append(y)
            else:
                self.known[part[0]] = 0, 0, 0, 0, b"", b""
        if not good:
            return
        a, b = (np.fromiter(chain.from_iterable(xs), np.int64, sum(map(len, xs))) for xs in (a, b))
        end_a, end_b, ends = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b]), np.cumsum([len(s) for s in good])  # both have tokens that end with each stretch
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b, to_group = (np.searchsorted(x, ends, "right") for x in (end_a, end_b, cuts))
        n_a, n_b, n_groups = (np.diff(x, prepend=0).tolist() for x in (to_a, to_b, to_group))
        pairs, groups = links(a, b, end_a, end_b).tobytes(), self.names.groups(a, b, end_a, end_b, cuts).encode().split(b";")
        to_link = to_a + to_b - to_group  # a link for each different end
        n_links = np.diff(to_link, prepend=0).tolist()
        for s, x, y, g, n, i, j in zip(good, n_a, n_b, n_groups, n_links, to_group.tolist(), to_link.tolist(), strict=True):
            self.known[s] = x, y, g, n, b";".join(groups[i - g : i]), pairs[8 * (j - n) : 8 * j]


def _aligned(file_a: bytes, file_b: bytes, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches(file_a, file_b, cut)

        def rows(texts: list[bytes]) -> Iterator[tuple]:
            """Of texts that aren't empty, a space before each."""
            data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            starts = stretch_starts(np.frombuffer(data, np.uint8), ends, cut)
            offsets = np.append(starts, len(data)).astype(np.int64)
            stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            code, found = np.asarray(stretches.indices), known.of(stretches.dictionary.to_pylist())
            counts, groups = np.array([f[:4] for f in found], np.int64), np.array([f[4] for f in found], object)
            pairs, n_links = np.frombuffer(b"".join(f[5] for f in found), np.int64), counts[:, 3]
            first = np.searchsorted(starts, np.append(0, ends))  # of each text, the first stretch
            to_link = np.append(0, np.cumsum(n_links[code]))
            pairs = pairs[np.arange(to_link[-1]) + np.repeat((np.cumsum(n_links) - n_links)[code] - to_link[:-1], n_links[code])]
            sums, whole = np.add.reduceat(counts[code], first[:-1]).tolist(), np.minimum.reduceat(counts[code, 2], first[:-1]) > 0
            for i, (n, ok) in enumerate(zip(sums, whole.tolist(), strict=True)):
                if ok:
                    keys, times = np.unique(pairs[to_link[first[i]] : to_link[first[i + 1]]], return_counts=True)
                    yield *n, hashlib.sha256(b";".join(groups[code[first[i] : first[i + 1]]])).hexdigest(), keys.tobytes(), times.astype(np.int32).tobytes()
                else:
                    yield NONE

        def encoded(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            some = rows([b" " + t for t in texts if t]) if any(texts) else iter(())
            out = [(i, *(next(some) if t else NONE)) for i, t in zip(ids, texts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])

        for batch in batches:
            ids, texts, first, size = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), 0, 0
            for i, n in enumerate(batch.column("n_chars").to_pylist()):
                size += n
                if size >= CALL or i + 1 == len(ids):
                    yield encoded(ids[first : i + 1], texts.slice(first, i + 1 - first).to_pylist())
                    first, size = i + 1, 0

    return run


NONE = 0, 0, 0, 0, "", b"", b""
TYPES = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): documents of this task that hold the pair; a key may come again after MERGED distinct ones."""
    none = np.zeros(0, np.int64)
    keys, n, waiting, size = none, none, [], 0

    def passed() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)]), pa.array(n[i : i + (1 << 17)])], names=["key", "n"])

    for column in chain(*(batch.columns for batch in batches)):
        for value in column:
            waiting.append(np.frombuffer(value.as_buffer() or b"", np.int64))
            size += len(waiting[-1])
            if size >= MERGED:
                keys, n = merged(np.concatenate([keys, *waiting]), np.concatenate([n, np.ones(size, np.int64)]))
                waiting, size = [], 0
                if len(keys) >= MERGED:
                    yield from passed()
                    keys, n = none, none
    keys, n = merged(np.concatenate([keys, *waiting]), np.concatenate([n, np.ones(size, np.int64)]))
    yield from passed()


def _shards(path: str):
    """Sums the runs of equal keys of a sorted range, and writes its shard: keys and counts, and the highest count of each A id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, last = [], None, None

        def add(keys: np.ndarray, n: np.ndarray) -> None:
            starts = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
            for file, values in zip(out, (keys, n, keys[starts] >> 32, np.maximum.reduceat(n, starts)), strict=True):
                file.add(values)

        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first, out = batch.column("key")[0].as_py(), [Writer(path, name) for name in ("keys", "counts", "ids", "best")]
            keys, n = (np.asarray(batch.column(c)) for c in ("key", "n"))
            keys, n = (keys, n) if last is None else (np.append(last[0], keys), np.append(last[1], n))
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, n = keys[starts], np.add.reduceat(n, starts)
            last = keys[-1], n[-1]  # its run may go on
            if len(keys) > 1:
                add(keys[:-1], n[:-1])
        if first is not None:
            add(np.array(last[:1]), np.array(last[1:]))
            yield pa.RecordBatch.from_pylist([{"first": first} | dict(zip(("keys", "counts", "ids", "best"), (f.close() for f in out), strict=True))])

    return run


class Counts:
    """The count of each pair and the highest of each A id, from shards."""

    def __init__(self, shards: list[tuple]):
        shards = sorted(shards)
        self.first = np.array([s[0] for s in shards], np.int64)
        self.keys, self.n = ([mapped(s[i]) for s in shards] for i in (1, 2))
        ids = [mapped(s[3]) for s in shards]
        self.best = np.zeros(1 + max((int(x.max()) for x in ids), default=0), np.int64)
        for x, s in zip(ids, shards, strict=True):
            np.maximum.at(self.best, x, mapped(s[4]))

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, where = np.zeros(len(keys), np.int64), np.searchsorted(self.first, keys, "right") - 1
        for s in np.unique(where):
            own = where == s
            out[own] = self.n[s][np.searchsorted(self.keys[s], keys[own])]
        return out


def _scored(shards: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shards)

        def scored(part: pa.RecordBatch, n_keys: np.ndarray) -> pa.RecordBatch:
            keys, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("keys", np.int64), ("times", np.int32)))
            n, ends = counts.of(keys), np.append(0, np.cumsum(n_keys))
            best = n == counts.best[keys >> 32]
            sums = {c: pa.array(np.diff(np.append(0, np.cumsum(x * times))[ends])) for c, x in (("n_best", best), ("count_sum", n))}
            return pa.RecordBatch.from_arrays([sums.get(c) or part.column(c) for c in (x.split()[0] for x in SCORES.split(", "))], names=[x.split()[0] for x in SCORES.split(", ")])

        for batch in batches:
            n_keys, first = np.asarray(pc.binary_length(batch.column("keys"))) // 8, 0
            while first < batch.num_rows:
                last = first + max(1, int(np.searchsorted(np.cumsum(n_keys[first:]), MERGED, "right")))
                yield scored(batch.slice(first, last - first), n_keys[first:last])
                first = last

    return run


def aligned(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times), a row for each of docs, written: a and b name a byte-level tokenizer and a piece
    tokenizer that puts a space before the text; keys and times are the packed pairs that the row links, and how often."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("n_chars"))
    files = tokenizer_file(a), tokenizer_file(b)
    return written(rows.mapInArrow(_aligned(*files, whole_words(*files)), ROWS), "aligned", "zstd")


def pair_shards(rows: DataFrame) -> list[tuple]:
    """The manifest of the sorted count shards of aligned() rows: (first key, the files of keys, counts, A ids and their highest counts), one for each range."""
    spark = rows.sparkSession
    counts = rows.select("keys").mapInArrow(_partial_counts, "key long, n long")
    ranges = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return [tuple(r) for r in ranges.mapInArrow(_shards(folder(spark, "pairs")), SHARD).collect()]


def alignment_scores(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs: tokens, groups, links, links whose
    pair has its A id's highest count in the corpus, and the sum of the links' counts."""
    rows = aligned(docs, a, b, id_col, text_col)
    return rows.mapInArrow(_scored(pair_shards(rows)), SCORES)


def op11_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
