"""Files that tasks write and read themselves, on storage that all executors share.

Spark has no sink for files of bytes, so tasks use Arrow's file systems (local and mounted folders,
HDFS, S3, GCS). A file is written under a name of its own and renamed when it is whole: a task that is
lost, or done twice, leaves no half file under the final name.
"""

from __future__ import annotations

import contextlib
import re
import uuid

import pyarrow.fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@contextlib.contextmanager
def new_file(path: str):
    """A stream to a new file, which replaces the file of that name when the block ends well."""
    store, name = place(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(draft, compression=None) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(draft)
        raise
    store.move(draft, name)
