"""Files opened in tasks: local paths, and what Arrow's file systems open (hdfs:, s3:, gs: where their libraries are)."""

from __future__ import annotations

import re

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("file:", path):
        path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_from(path: str):
    system, p = at(path)
    return system.open_input_file(p)


def write_to(path: str):
    system, p = at(path)
    folder = p.rpartition("/")[0]
    if folder:
        system.create_dir(folder, recursive=True)
    return system.open_output_stream(p, compression=None)  # bytes as they are, whatever the suffix


def is_file(path: str) -> bool:
    system, p = at(path)
    return system.get_file_info(p).type == fs.FileType.File


def is_there(path: str) -> bool:
    system, p = at(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def names(path: str) -> list[str]:
    system, p = at(path)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(p, allow_not_found=True)))


def delete(path: str) -> None:
    system, p = at(path)
    if system.get_file_info(p).type == fs.FileType.File:
        system.delete_file(p)


def replace(path: str, data: bytes) -> None:
    """A small file, whole or not at all: written beside and moved."""
    system, p = at(path)
    with write_to(path + ".tmp") as out:
        out.write(data)
    system.move(p + ".tmp", p)
