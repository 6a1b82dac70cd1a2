"""Whole files on a shared store, written by workers: a repeated attempt replaces a file whole."""

from __future__ import annotations

import os
import uuid


def put(folder: str, name: str, data: bytes) -> None:
    """``folder`` is a path that all executors see, or a URI of a store that Arrow opens."""
    if "://" in folder and not folder.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        part = f"{inner}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{inner}/{name}")
        return
    at = "/" + folder.split(":", 1)[1].lstrip("/") if folder.startswith("file:") else folder
    os.makedirs(at, exist_ok=True)
    part = os.path.join(at, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(at, name))
