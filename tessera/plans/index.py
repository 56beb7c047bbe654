"""A chunk-and-vector table in versioned directories with numbered manifests.

A table has BUCKETS parts by a hash of the key; a manifest names the directory of each. A commit writes the parts
that it touches as new directories beside the old ones, reads them back and checks them, and
then moves a manifest to the next number, which must be free: of two writers one gets it, and the other merges
anew with what the first one left. So readers see whole versions only, no write is lost, a commit
that fails at any step leaves the last version, and no lock has to be broken. Works in any storage that Spark reads
and that moves a file whole and not over another one (as HDFS; a local disk looks first and moves then). Batches of a stream are remembered by the last number of each
checkpoint, others by name, the last KNOWN_BATCHES of them.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, KNOWN_BATCHES, TRIES = 32, 1000, 20
EMPTY = {"number": 0, "parts": {}, "schema": None, "streams": {}, "batches": [], "ids": 0}


class ContractError(ValueError):
    """Rows that must not be published."""


class IndexTable:
    """root/manifest-N.json with the greatest N is in use; root/v-* hold the parts."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", dim: int | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.dim, self.buckets = spark, root.rstrip("/"), key, dim, buckets

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d{10})\.json", n)))

    def manifest(self, number: int | None = None) -> dict:
        """The manifest in use, or the one with this number."""
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return dict(EMPTY)
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest-{number:010d}.json", wholetext=True).collect()))

    def _publish(self, base: dict, manifest: dict) -> bool:
        """Makes manifest the one after base; False if another writer was first."""
        jvm, number = self.spark.sparkContext._jvm, base["number"] + 1
        fs, new = self._fs(f"new-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(manifest | {"number": number}).encode()))
        out.close()
        _, path = self._fs(f"manifest-{number:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(path), none)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        paths = sorted(p for b, p in manifest["parts"].items() if parts is None or int(b) in parts)
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*(f"{self.root}/{p}" for p in paths))

    def read(self) -> DataFrame | None:
        return self._read(self.manifest())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _checked(self, new: DataFrame, expected: int | None) -> dict[int, int]:
        """Rows of each bucket of what was written, if ids and vectors keep the contract."""
        checks = [F.count("*").alias("n"), F.count_distinct(self.key).alias("ids")]
        if self.dim is not None:
            finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            checks.append(F.count_if(~F.coalesce((F.size("vector") == self.dim) & finite, F.lit(False))).alias("bad"))
        found = new.groupBy("_bucket").agg(*checks).collect()
        n = sum(r.n for r in found)
        if any(r.n != r.ids or r.asDict().get("bad") for r in found) or expected not in (None, n):
            raise ContractError(f"not published: {n} rows, {sum(r.ids for r in found)} ids, {sum(r.asDict().get('bad') or 0 for r in found)} bad vectors")
        return {r["_bucket"]: r.n for r in found}

    def _known(self, base: dict, batch: str | None) -> bool:
        stream, _, epoch = (batch or "").rpartition("#")
        return bool(batch) and (int(epoch) <= base["streams"].get(stream, -1) if stream and epoch.isdigit() else batch in base["batches"])

    def _commit(self, base: dict, rows: DataFrame, touched: list[int], batch: str | None) -> bool:
        """rows become all rows of the touched buckets."""
        version = f"v-{uuid.uuid4().hex}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{version}")
        fs, path = self._fs(version)
        written = any(s.isDirectory() for s in fs.listStatus(path))
        sizes = self._checked(self.spark.read.schema(f"{schema}, _bucket int").parquet(f"{self.root}/{version}"), None) if written else {}
        parts = {b: p for b, p in base["parts"].items() if int(b) not in touched} | {str(b): f"{version}/_bucket={b}" for b in sizes}
        stream, _, epoch = (batch or "").rpartition("#")
        streams, batches = dict(base["streams"]), list(base["batches"])
        if stream and epoch.isdigit():
            streams[stream] = int(epoch)
        elif batch:
            batches = [*batches, batch][-KNOWN_BATCHES:]
        return self._publish(base, {"base": base["number"], "parts": parts, "schema": schema, "streams": streams, "batches": batches})

    def _applied(self, change, batch: str | None = None) -> bool:
        """Tries until no other writer comes between: change(base) gives (rows, touched buckets), or None for nothing to do."""
        for _ in range(TRIES):
            base = self.manifest()
            if self._known(base, batch):
                return False
            if (todo := change(base)) is None:
                return False
            if self._commit(base, *todo, batch):
                return True
        raise OSError(f"other writers were first {TRIES} times")

    def rebuild(self, rows: DataFrame, batch: str | None = None) -> None:
        """rows becomes the table, unless ids or vectors break its contract."""
        self._applied(lambda base: (rows, list(range(self.buckets))), batch)

    commit = rebuild

    def upsert(self, rows: DataFrame, batch: str | None = None) -> bool:
        """The last write of a key wins; only the buckets of the rows' keys are written anew. A batch that was applied is not applied again."""
        touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # BUCKETS at most
        def change(base: dict):
            return merged(self._read(base, touched), rows, self.key), touched
        return self._applied(change, batch)

    def delete(self, ids: DataFrame) -> None:
        ids = ids.select(self.key)
        touched = [r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect()]
        def change(base: dict):
            old = self._read(base, touched)
            return None if old is None or not touched else (old.join(ids, self.key, "left_anti"), touched)
        self._applied(change)

    def rollback(self) -> bool:
        """The version that the last commit was made on is published again, with the batches it knew: one that is undone can come again. False if there is
        none, or vacuum has deleted it."""
        last = self.manifest()
        if last.get("base") not in self._numbers():
            return False
        return self._publish(last, self.manifest(last["base"]))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last ``keep`` and the one that a rollback would publish, and the versions that none of these names; for when no commit is going on."""
        numbers = self._numbers()
        kept = set(numbers[-keep:])
        kept |= {self.manifest().get("base")} & set(numbers)
        held = {p.split("/")[0] for n in kept for p in self.manifest(n)["parts"].values()}
        fs, path = self._fs()
        gone = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in held] if numbers else []
        for name in [*gone, *(f"manifest-{n:010d}.json" for n in numbers if n not in kept)]:
            fs.delete(self._fs(name)[1], True)
        return gone


def merged(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new)
