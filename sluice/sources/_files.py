"""Files of a shared store, from the driver and from tasks alike: plain paths and the URIs that Arrow opens (file, hdfs, s3, gs)."""

from __future__ import annotations

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, suffix: str) -> list[str]:
    """Files below a folder with a suffix, or the file itself, by name."""
    store, at = locate(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        return []
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.endswith(suffix))


def put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file under a temporary name, then move it: readers see it whole or not at all."""
    with store.open_output_stream(f"{path}.tmp") as f:
        f.write(data)
    store.move(f"{path}.tmp", path)
