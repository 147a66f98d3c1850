"""Files by path or URI, wherever they are: local folders, or any store that Arrow's file systems reach."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path within it; the file system fits into a closure by its URI alone."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str = "") -> list[str]:
    """Non-empty files below ``path`` that end in ``suffix``, in the order of their paths."""
    system, base = opened(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [base]
    if info.type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.size and x.path.endswith(suffix))


def exists(spark, path: str) -> bool:
    """Whether Spark's file systems have something at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
