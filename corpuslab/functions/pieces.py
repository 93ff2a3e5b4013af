"""Batches turned over a few rows at a time, so that Python's objects of a whole batch are never held at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS = 128


def in_pieces(of: Callable, kind: T.DataType, *columns: pa.Array) -> pa.Array:
    """``of`` each row's values, as one array; objects are made for ``ROWS`` rows at most, the rest is in Arrow's memory."""
    into = to_arrow_type(kind)
    pieces = (zip(*(c.slice(k, ROWS).to_pylist() for c in columns)) for k in range(0, len(columns[0]), ROWS))
    return pa.concat_arrays([pa.array([], into), *(pa.array([of(*row) for row in rows], into) for rows in pieces)])
