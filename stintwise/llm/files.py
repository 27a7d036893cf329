"""Opening files from tasks, by the URI of a shared folder."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path behind a file: URI or a plain path; None for another store."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return None


def open_new(uri: str):
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


def open_old(uri: str):
    """For reading, with `seek`."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)
