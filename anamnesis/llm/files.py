"""Files of shared folders from tasks: local ones, or any store that pyarrow's file systems know."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or plain path, and the path in it."""
    url = urlparse(path)
    return (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def opened(path: str):
    """A seekable binary file."""
    system, inner = store(path)
    return system.open_input_file(inner)
