"""Binary files in the shared folder, opened where the tasks run."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file; without a scheme it is a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, stem: str) -> str:
    """A file name that no other attempt of a task uses."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}"


def create(uri: str):
    fs, path = locate(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_random(uri: str):
    fs, path = locate(uri)
    return fs.open_input_file(path)
