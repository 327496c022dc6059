"""Binary files that tasks write to the shared folder and read back, on any store pyarrow reaches.

A task writes under a name of its own and moves the file into place when it is whole, so a task that is lost and run again, or run twice,
leaves one whole file. Names come from the partition, and equal input gives equal files.
"""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from loadwarden.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, named by spark.checkpoint.dir."""
    folder = scratch_path(spark, name)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return folder


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A stream whose content appears under `uri` at the end, all at once."""
    store, path = _store(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None) as out:
        yield out
    store.move(own, path)


def reading(uri: str):
    """A seekable stream of a file."""
    store, path = _store(uri)
    return store.open_input_file(path)
