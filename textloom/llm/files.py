"""Files in a folder that all executors reach, read and written inside tasks.

A path is a URI whose scheme the Arrow file systems know (``file``, ``hdfs``,
``s3``, ``gs``) or a plain local path. A task writes under a name of its own
attempt and reports it with its rows; a table of these names lists exactly the
files of the attempts that counted.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def attempt_path(folder: str, n: int, suffix: str) -> str:
    """A path no other task, attempt or earlier file has used."""
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{n:04d}-{uuid.uuid4().hex}{suffix}"


def create(path: str):
    """An output stream; makes the folder."""
    system, own = located(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    return system.open_output_stream(own, compression=None)  # not by the name


def open_input(path: str):
    system, own = located(path)
    return system.open_input_file(own)
