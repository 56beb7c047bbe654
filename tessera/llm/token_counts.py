"""Token counts with a digest cache.

The cache is a Parquet table (digest, version, n_tokens): SHA-256 of the
normalised content and of the tokenizer file. Normalised means that a null text
is empty; anything more could change a count. Contents are joined to the cache by
digest, each distinct miss is encoded once, wherever its copies are (equal rows too), and appended; then
all rows take their counts from the cache. A second run over the same texts encodes nothing
and shuffles no text: up to MAX_MISSES missing digests, a bound that is counted, are broadcast to the texts;
beyond it, texts meet their digests in a shuffle, of which each task sends a text once.
If two runs append the same digest, both rows say the same and one is read.

Empty texts have 0 tokens. Long texts are encoded whole. Repeated rows stay rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import shared_dir, written

TOKENIZER, LIMIT = "piece_bpe_32k.model", 4096
CACHE = "digest binary, version string, n_tokens long"
#: Characters that one call of the tokenizer encodes, but for a longer single text.
CALL = 1 << 20
#: Missing digests that are broadcast, of 32 bytes each.
MAX_MISSES = 20_000


def tokenizer_file(name: str = TOKENIZER) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def counter(name: str, file: bytes):
    """A function from texts to their token counts."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(file)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=file)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def _encoded(name: str, file: bytes, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name, file)
        for batch in batches:
            texts, done, call, size = batch.column("text").to_pylist(), [], [], 0
            for text in texts:
                call.append(text)
                size += len(text)
                if size >= CALL:
                    done += count(call)
                    call, size = [], 0
            done += count(call) if call else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(done), pa.string()), pa.array(done, pa.int64())], names=["digest", "version", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, cache: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs, then its columns in carry.
    cache: the table's path, in storage that the cluster shares; it may not exist yet."""
    spark, file = docs.sparkSession, tokenizer_file(tokenizer)
    version = hashlib.sha256(file).hexdigest()
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carry)
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", *carry), "keys")
    misses = keys.select("digest").distinct()
    try:
        misses = misses.join(known(), "digest", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    misses = written(misses, "misses")
    n = misses.count()
    if n <= MAX_MISSES:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    if n:
        new = texts.groupBy("digest").agg(F.first("text").alias("text"))
        new = new if n <= MAX_MISSES else new.join(misses, "digest", "left_semi")
        new.select("digest", "text").mapInArrow(_encoded(tokenizer, file, version), CACHE).write.mode("append").parquet(cache)
    elif not keys.head(1):
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    # written first, so that this join has a shuffle of its own and Spark can split a frequent text in it
    counts = written(known(), "counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *carry)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
