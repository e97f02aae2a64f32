"""Files of any store that pyarrow knows, for data sources whose tasks open them themselves."""

from __future__ import annotations

import os

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def parts(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the visible files of a folder by name."""
    store, at = locate(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [x for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.base_name)]
