"""File access inside tasks, through the filesystem a URI names."""

from __future__ import annotations

import re


def filesystem_of(path: str, opened: dict | None = None):
    """Arrow filesystem of a Spark path, and the path inside it.

    ``opened`` keeps the filesystems a task has already connected to.
    """
    from pyarrow import fs

    opened = {} if opened is None else opened
    parts = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]+)/(.*)", path, re.DOTALL)
    if parts is None:  # file:/a, file:///a or /a
        local = "/" + re.sub(r"^file:", "", path).lstrip("/")
        if "file" not in opened:
            opened["file"] = fs.LocalFileSystem()
        return opened["file"], local
    scheme, authority, inner = parts.groups()
    root = f"{'s3' if scheme == 's3a' else scheme}://{authority}/"
    if root not in opened:
        opened[root] = fs.FileSystem.from_uri(root)
    filesystem, base = opened[root]
    return filesystem, f"{base.rstrip('/')}/{inner}"


def literal(path: str) -> str:
    """The path with the characters escaped that Spark would read as a glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
