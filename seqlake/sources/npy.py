"""NumPy array files inside tasks, and as a Spark data source (``format("npy")``)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib import format as layout
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .files import listed, opened

_ARRAY = StructType([StructField("shape", ArrayType(IntegerType())), StructField("tokens", ArrayType(IntegerType()))])


def array_of(raw: bytes) -> tuple[list[int], list[int]] | tuple[None, None]:
    """Shape and values in row order; what is no such file gives nulls."""
    try:
        a = np.load(io.BytesIO(raw), allow_pickle=False)
    except (ValueError, OSError, EOFError):
        return None, None
    return list(a.shape), a.ravel().astype(np.int64).tolist()


@pandas_udf(_ARRAY)
def decode(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([array_of(bytes(x)) for x in content], columns=["shape", "tokens"])


def encoded(values, shape=None) -> bytes:
    """The bytes of an array file of 32-bit integers."""
    out = io.BytesIO()
    a = np.asarray(values, np.int32)
    np.save(out, a.reshape(shape) if shape is not None else a)
    return out.getvalue()


@pandas_udf(BinaryType())
def encode(tokens: pd.Series) -> pd.Series:
    """Token arrays as the content of array files, codes (an array of arrays) as two-dimensional ones; null stays null."""
    return pd.Series([None if t is None else encoded(np.stack(t) if len(t) and isinstance(t[0], (list, np.ndarray)) else t) for t in tokens])


def header_of(file) -> tuple[tuple[int, ...], bool, np.dtype] | None:
    """Shape, whether in Fortran order, and item type, from a file's first bytes alone; None for what is no array file.

    The magic and the length come first; exactly the header that they announce
    is read, whatever its version and length, and nothing behind it.
    """
    try:
        version = layout.read_magic(file)
        if version not in ((1, 0), (2, 0), (3, 0)):
            return None
        return (layout.read_array_header_1_0 if version == (1, 0) else layout.read_array_header_2_0)(file)
    except (ValueError, OSError, EOFError, UnicodeDecodeError):
        return None


class NpySource(DataSource):
    """One row per file: path, shape, tokens; or of ``schema(...)`` those asked for of path, stem, shape, dtype, fortran, steps, tokens.

    ``steps`` is the time dimension: the second of two, else the first. The
    content of a file is read only if ``tokens`` is asked for; without it a
    partition reads the headers of its files. What is no array file has nulls.
    ``path`` is a folder, searched below, or a file, as a local path or a URI.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, shape array<int>, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema.fieldNames(), int(self.options.get("partitions", "64")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], most: int):
        self.path, self.columns, self.most = path, columns, most
        unknown = set(columns) - {"path", "stem", "shape", "dtype", "fortran", "steps", "tokens"}
        if unknown:
            raise ValueError(f"an array file has no column {sorted(unknown)}")

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, ".npy")
        size = max(1, -(-len(files) // self.most))
        return [InputPartition(files[i : i + size]) for i in range(0, len(files), size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.value:
            row = {"path": path, "stem": path.rpartition("/")[2].removesuffix(".npy")}
            with system.open_input_file(path) as f:
                if "tokens" in self.columns:
                    row["shape"], row["tokens"] = array_of(f.read())
                    f.seek(0)
                head = header_of(f)
            if head is not None:
                shape, row["fortran"], kind = head
                row |= {"shape": list(shape), "dtype": kind.str, "steps": shape[1] if len(shape) == 2 else shape[0] if shape else None}
            yield tuple(row.get(c) for c in self.columns)
