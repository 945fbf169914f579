"""Plain files in the shared folder, read and written by executors; a path may be any URI pyarrow.fs knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a repeated or lost attempt leaves no half file."""
    f, path = _open(uri)
    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with f.open_output_stream(tmp) as out:
        out.write(data)
    f.move(tmp, path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    f, path = _open(uri)
    with f.open_input_file(path) as src:
        return src.read_at(length, offset)
