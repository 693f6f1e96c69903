"""Binary files in a folder that driver and executors share, by URI (file, hdfs, s3, ...)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A stream for writing; the file appears under its name when the block ends without error.

    Each task attempt writes under a name of its own, so a lost or repeated attempt
    never leaves half a file.
    """
    store, path = store_of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)


@contextmanager
def opened(uri: str):
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        yield f
