"""Files by ranges in any store that a URI names: local paths and file:, s3:, gs:, abfs:, and through the Hadoop client
library hdfs: and viewfs:. Driver and tasks use the same few calls; nothing here keeps a connection."""

from __future__ import annotations

import os

from pyarrow import fs


def of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_in(path: str):
    """A file to read ranges of (seek and read)."""
    store, inside = of(path)
    return store.open_input_file(inside)


def open_out(path: str):
    """A file to write in sequence; its folder is made."""
    store, inside = of(path)
    store.create_dir(os.path.dirname(inside), recursive=True)
    return store.open_output_stream(inside, compression=None)


def read(path: str) -> bytes:
    with open_in(path) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    with open_out(path) as f:
        f.write(data)


def kind(path: str) -> str:
    """file, folder or nothing."""
    store, inside = of(path)
    found = store.get_file_info(inside).type
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(found, "nothing")


def size(path: str) -> int:
    store, inside = of(path)
    return store.get_file_info(inside).size


def listing(folder: str, suffix: str = "") -> list[str]:
    """Paths of the files of a folder, by name."""
    store, inside = of(folder)
    names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(inside)) if i.type == fs.FileType.File)
    return [f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(suffix) and not n.startswith((".", "_"))]


def move(source: str, target: str) -> None:
    store, inside = of(source)
    store.move(inside, of(target)[1])


def delete(path: str) -> None:
    """Delete a file or a folder, if there is one."""
    store, inside = of(path)
    found = kind(path)
    if found == "file":
        store.delete_file(inside)
    elif found == "folder":
        store.delete_dir(inside)
