"""Where message files lie: one name for every file, however its folder was given, and one way to look at it.

Local files are named by their absolute path, others by their URI.  As for Spark's paths, ``%`` in a name stands for itself.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

#: Folders that are listed one after the other before the walk below them is dealt out, files of one folder that a
#: task takes, and tasks that one folder is dealt to at most: each reads all of its names.
SPREAD, SHARE, SHARES = 256, 5_000, 64
#: Files that a walk hands on at a time.
ROWS = 10_000
ENDING = ".eml"


def plain_name(path: str | os.PathLike) -> str:
    """The one name of a file or folder: ``/mail``, ``/mail/``, ``file:/mail`` and ``file:///mail`` are the same."""
    path = str(path)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    elif re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return path.rstrip("/")
    return os.path.abspath(path)


def folder_of(directory: str):
    """The file system of a folder, its path there, and what makes a full name of one."""
    from pyarrow import fs

    directory = plain_name(directory)
    if directory.startswith("/"):
        return fs.LocalFileSystem(), directory, lambda p: p
    store, path = fs.FileSystem.from_uri(directory)
    head = directory[: len(directory) - len(path.strip("/"))].rstrip("/") + "/"
    return store, path, lambda p: head + p.lstrip("/")


def look_up(path: str):
    """What is there under a name: its kind, size and time of change."""
    store, place, _ = folder_of(path)
    return store.get_file_info(place)


def parent_of(path: str) -> str:
    return plain_name(path).rpartition("/")[0] or "/"


def children(store, folder: str) -> Iterator[tuple[str, bool, Callable[[], tuple[int | None, int]]]]:
    """Folders and message files in a folder, one after the other: path, whether it is a folder, and a look at its time of change
    (nanoseconds) and size; hidden ones, and what can't be read, are left out.  Local folders are never held as a whole."""
    from pyarrow import fs

    try:
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as found:
                for e in found:
                    if not e.name.startswith(".") and (e.is_dir() or (e.name.endswith(ENDING) and e.is_file())):
                        yield e.path, e.is_dir(), lambda e=e: (lambda s: (s.st_mtime_ns, s.st_size))(e.stat())
            return
        seen = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return
    for i in seen:
        if not i.base_name.startswith(".") and (i.type == fs.FileType.Directory or (i.type == fs.FileType.File and i.base_name.endswith(ENDING))):
            yield i.path, i.type == fs.FileType.Directory, lambda i=i: (i.mtime_ns, i.size)


def planned(directory: str, spread: int = SPREAD, share: int = SHARE) -> list[tuple[str, bool, int, int]]:
    """Pieces of a walk: (folder, whether what is below it belongs to it, one of how many shares of its files, how many).

    The topmost folders are listed here, breadth first; a flat folder of many files is dealt out in shares by a hash of
    the names, so that no task has to take all of them.  What is below is walked by the pieces.
    """
    store, top, _ = folder_of(directory)
    level, pieces = [top], []
    while level and len(level) + len(pieces) < spread:
        below = []
        for folder in level:
            files = 0
            for path, deep, _ in children(store, folder):
                if deep:
                    below.append(path)
                else:
                    files += 1
            n = min(SHARES, -(-files // share))
            pieces += [(folder, False, i, n) for i in range(n)]
        level = below
    return pieces + [(f, True, 0, 1) for f in level]


def walked(directory: str, piece: tuple[str, bool, int, int], wanted: Callable[[str, float, int], bool] | None = None) -> Iterator[list[tuple[str, float, int]]]:
    """(name, time of change in seconds, size) of a piece's message files, some at a time.  Times are whole milliseconds, as
    Spark's own file sources have them."""
    store, _, full_name = folder_of(directory)
    folder, deep, share, shares = piece
    left, rows = [folder], []
    while left:
        for path, is_folder, look in children(store, left.pop()):
            if is_folder:
                if deep:
                    left.append(path)
                continue
            if shares > 1 and zlib.crc32(path.rpartition("/")[2].encode()) % shares != share:
                continue
            try:
                changed, size = look()
            except OSError:  # gone meanwhile
                continue
            if changed is not None and (wanted is None or wanted(full_name(path), changed // 1_000_000 / 1000, size)):
                rows.append((full_name(path), changed // 1_000_000 / 1000, size))
            if len(rows) == ROWS:
                yield rows
                rows = []
    yield rows
