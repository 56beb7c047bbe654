"""Arrays that tasks write to the shared folder and other tasks map into memory.

A task writes each array as a file of its own name, so a task that runs again leaves the first
attempt's file unread; what counts is the manifest, a row for each task that ended well. Files of a local or
mounted folder are mapped where they lie, others are fetched to an unlinked temporary file first.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from tessera.llm import shared


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which shared.clear deletes."""
    path = f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    shared._made.append(path)
    return path


class Writer:
    """A file that grows by arrays of one type."""

    def __init__(self, path: str, name: str):
        self.uri = f"{path}/{name}-{uuid.uuid4().hex}"
        store, where = fs.FileSystem.from_uri(self.uri)
        store.create_dir(where.rpartition("/")[0], recursive=True)
        self.file = store.open_output_stream(where)

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values).tobytes())

    def close(self) -> str:
        self.file.close()
        return self.uri


def mapped(uri: str, dtype=np.int64) -> np.ndarray:
    store, where = fs.FileSystem.from_uri(uri)
    if not store.get_file_info(where).size:
        return np.zeros(0, dtype)
    if urlsplit(uri).scheme in ("", "file"):
        return np.memmap(where, dtype, "r")
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(where) as source:
        while part := source.read(1 << 22):
            copy.write(part)
        copy.flush()
        return np.memmap(copy.name, dtype, "r")
