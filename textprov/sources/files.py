"""Files as data sources see them: listing and random access by URI, in any Python process.

Plain paths and ``file:`` URIs are local or mounted folders; other schemes go through Arrow's file systems.
"""

from __future__ import annotations

import fnmatch
import posixpath

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), posixpath.normpath(uri)
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, suffix: str) -> list[tuple[str, str, int]]:
    """(URI, path relative to the parent of the folder, bytes) of the files under a folder, or of a glob in its last part."""
    system, path = resolve(uri)
    prefix = uri[:len(uri) - len(path)] if uri.endswith(path) else ""
    pattern = posixpath.basename(path)
    if any(c in pattern for c in "*?["):
        root, recursive = posixpath.dirname(path), False
        base = posixpath.join(root, "")
    else:
        root, recursive, pattern = path, True, "*" + suffix
        base = posixpath.join(posixpath.dirname(path), "")
    if system.get_file_info(root).type == fs.FileType.File:
        return [(prefix + root, posixpath.basename(root), system.get_file_info(root).size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=recursive))
    return sorted((prefix + f.path, f.path[len(base):], f.size) for f in found
                  if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and not f.base_name.startswith((".", "_")))


def opened(uri: str):
    """A seekable binary file that reads what is asked for and no more."""
    system, path = resolve(uri)
    return system.open_input_file(path)
