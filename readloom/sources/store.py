"""Files by path or URI: listing, random access, and publishing under a name at once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. file: and no scheme at all are folders that every machine mounts."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _whole(path: str, inside: str) -> str:
    """A listed path with the scheme and host that path has."""
    return path[: path.index("://") + 3] + inside if "://" in path and not path.startswith("file:") else inside


def _pattern(glob: str) -> re.Pattern:
    parts = re.findall(r"\*|\?|\[[^\]]+\]|[^*?\[]+|\[", glob)
    return re.compile("".join("[^/]*" if p == "*" else "[^/]" if p == "?" else p if p[0] == "[" and len(p) > 1 else re.escape(p) for p in parts))


def listed(paths: str | Iterable[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files: those named, those of a folder that aren't hidden, and those that a pattern (*, ?, []) fits; by name within each path given.

    Raises FileNotFoundError where a path gives no file.
    """
    out: list[tuple[str, int]] = []
    for path in [paths] if isinstance(paths, str) else paths:
        system, inside = located(path)
        info = system.get_file_info(inside)
        if info.type == pafs.FileType.File:
            found = [info]
        elif info.type == pafs.FileType.Directory:
            found = [x for x in system.get_file_info(pafs.FileSelector(inside)) if not x.base_name.startswith((".", "_"))]
        elif re.search(r"[*?\[]", inside):
            base = inside[: re.search(r"[*?\[]", inside).start()].rpartition("/")[0] or "/"
            deep = "/" in inside[len(base) + 1 :]
            fits = _pattern(inside)
            found = [x for x in system.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=deep)) if fits.fullmatch(x.path)]
        else:
            found = []
        found = sorted((x for x in found if x.type == pafs.FileType.File), key=lambda x: x.path)
        if not found:
            raise FileNotFoundError(f"{path} holds no file")
        out += [(_whole(path, x.path), x.size) for x in found]
    return out


def beside(target: str, job: str, attempt: str = "") -> str:
    """The hidden name under which a job writes a file before it is published."""
    folder, _, name = target.rpartition("/")
    return f"{folder}/.{name}.{job}{attempt and '-'}{attempt}.tmp"


#: What beside() makes.
OWN = re.compile(r"\..+\.(?P<job>[0-9a-f]{32})(-[0-9]+)?\.tmp")


def leftovers(root: str, job: str | None = None) -> Iterator[str]:
    """Files under root that a job (any, if none is named) has written and not published; names of another form are never meant."""
    system, inside = located(root)
    for x in system.get_file_info(pafs.FileSelector(inside, allow_not_found=True, recursive=True)):
        m = OWN.fullmatch(x.base_name)
        if m and x.type == pafs.FileType.File and job in (None, m["job"]):
            yield _whole(root, x.path)


def clean(root: str, job: str | None = None) -> int:
    """Remove leftovers; how many there were. Without a job: of all of them, for a folder that nothing is being written to."""
    found = list(leftovers(root, job))
    for path in found:
        remove(path)
    return len(found)


def remove(path: str) -> None:
    system, inside = located(path)
    if system.get_file_info(inside).type != pafs.FileType.NotFound:
        system.delete_file(inside)


def publish(made: str, target: str) -> None:
    """Give a complete file its name: readers see the whole file or none."""
    system, inside = located(made)
    system.move(inside, located(target)[1])


def folder(path: str) -> None:
    system, inside = located(path)
    system.create_dir(inside, recursive=True)
