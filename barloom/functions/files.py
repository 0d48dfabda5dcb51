"""Small files beside tables: pointers and lists that the driver reads and writes."""

from __future__ import annotations

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that pyarrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    where, at = place(path)
    return where.get_file_info(at).type != fs.FileType.NotFound


def names(path: str) -> list[str]:
    """What a folder holds, in order; nothing if it isn't there."""
    where, at = place(path)
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def put(path: str, data: bytes) -> None:
    """Write a file that is whole once it can be seen."""
    where, at = place(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at + ".part") as out:
        out.write(data)
    where.move(at + ".part", at)


def get(path: str) -> bytes:
    where, at = place(path)
    with where.open_input_stream(at) as f:
        return f.read()


def remove(path: str) -> None:
    where, at = place(path)
    where.delete_dir(at)
