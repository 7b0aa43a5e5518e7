"""Files in folders that driver and workers share, on any file system that a URI names."""

from __future__ import annotations

import os

from pyarrow import fs


def absolute(path: str) -> str:
    """A path with its scheme; one without is a local path made absolute."""
    return path if "://" in path else "file://" + os.path.abspath(path)


def write_text(folder: str, name: str, text: str) -> None:
    """Write one file below ``folder``, with the folders above it."""
    with open_text(folder, name) as f:
        f.write(text.encode("utf-8"))


def open_text(folder: str, name: str):
    """A stream for bytes into one file below ``folder``."""
    system, base = fs.FileSystem.from_uri(absolute(folder))
    path = f"{base.rstrip('/')}/{name}"
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)
