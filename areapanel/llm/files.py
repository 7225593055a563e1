"""Binary files in the shared folder, written by tasks and named by a manifest.

A task writes under a name of its own; only files that a committed manifest row names are ever
read, so a lost or repeated attempt leaves at most an unread file. Works on every file system
that Arrow can open by its address.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs as arrow_fs


def _open(address: str):
    return arrow_fs.FileSystem.from_uri(address)


def write_new(folder: str, kind: str, parts: list[bytes]) -> str:
    """Write the parts to a new file of the folder and return its address."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.{kind}"
    with system.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)
    return f"{folder.rstrip('/')}/{name}"


def mapped(address: str) -> np.ndarray:
    """The file's bytes: memory-mapped where the folder is a mounted one, else fetched."""
    system, path = _open(address)
    if isinstance(system, arrow_fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)
