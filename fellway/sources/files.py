"""Opening single files from tasks, on any file system that Arrow knows."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there; ``file:/x`` as Spark writes it is a local one."""
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)


def reading(path: str):
    """A file that can be read anywhere in it."""
    system, inner = located(path)
    return system.open_input_file(inner)


def writing(path: str):
    """A new file; its folder is made."""
    system, inner = located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def exists(path: str) -> bool:
    system, inner = located(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound
