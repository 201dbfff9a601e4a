"""Files that tasks write and read themselves, in the shared folder."""

from __future__ import annotations

import re

import pyarrow.fs


def filesystem(url: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """For file: paths, and any scheme that pyarrow knows (hdfs, s3, gs, ...)."""
    if "://" not in url and not url.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", url)
    return pyarrow.fs.FileSystem.from_uri(url)
