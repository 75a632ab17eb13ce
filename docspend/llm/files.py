"""Writing plain files from tasks into the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def filesystem(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def atomic(uri: str):
    """A binary stream whose file appears under its name only when it is whole.

    A task that runs again after a lost executor writes the same name with the same bytes.
    """
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def make_dir(uri: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path, recursive=True)
