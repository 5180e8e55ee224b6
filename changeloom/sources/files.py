"""Files of a folder, given as a path or as a URI of a store that Arrow can open."""

from __future__ import annotations

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(path: str, suffix: str) -> dict[str, int]:
    """Bytes of the files whose names end so, in order of name; names that begin with ``_`` or ``.`` are not there yet."""
    system, top = store(path)
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return dict(sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "_."))


def names(path: str, suffix: str) -> list[str]:
    """Names of such files, in order."""
    return [*sizes(path, suffix)]


def opened(path: str, name: str):
    """One file for reading, buffered."""
    system, top = store(path)
    return system.open_input_stream(f"{top}/{name}")
