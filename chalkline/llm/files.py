"""Reading and writing plain files in the shared folder from tasks, by URI."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; a bare path is local."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def create_folder(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


def open_output(uri: str):
    system, path = place(uri)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)


def write_bytes(uri: str, data: bytes) -> None:
    with open_output(uri) as f:
        f.write(data)


def read_bytes(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()
