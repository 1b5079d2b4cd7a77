"""Nested Arrow arrays from Python tuples, a column at a time."""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Rows that are Python objects at a time, however many a batch has.
ROWS_AT_ONCE = 500


def build(values: list, kind: pa.DataType) -> pa.Array:
    """Tuples for structs, lists for arrays, lists of pairs for maps, None for null; other types as pyarrow takes them."""
    if pa.types.is_struct(kind):
        missing = [v is None for v in values]
        if any(missing):
            gap = (None,) * kind.num_fields
            columns = zip(*[gap if v is None else v for v in values])
        else:
            columns = zip(*values)
        parts = [build(list(c), kind.field(i).type) for i, c in enumerate(columns)] or [build([], f.type) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array(missing) if any(missing) else None)
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        ends = list(accumulate((len(v) if v is not None else 0 for v in values), initial=0))
        offsets = pa.array([None if v is None else at for v, at in zip(values, ends)] + ends[-1:], pa.int32())
        flat = list(chain.from_iterable(v for v in values if v is not None))
        if pa.types.is_map(kind):
            keys, items = build([k for k, _ in flat], kind.key_type), build([i for _, i in flat], kind.item_type)
            return pa.MapArray.from_arrays(offsets, keys, items)
        return pa.ListArray.from_arrays(offsets, build(flat, kind.value_type), type=kind)
    return pa.array(values, kind)


def values(array: pa.Array) -> list:
    """Python values; much faster than ``to_pylist`` where there are no nulls or nulls need no other type."""
    if array.null_count and not (pa.types.is_string(array.type) or pa.types.is_decimal(array.type)):
        return array.to_pylist()
    return array.to_numpy(zero_copy_only=False).tolist()


def fields(array: pa.ListArray, *names: str) -> list[list[tuple] | None]:
    """The named fields (dots lead into structs) of an array of structs, as tuples per row."""
    flat = array.flatten()
    columns = []
    for name in names:
        column = flat
        for part in name.split("."):
            column = column.flatten()[column.type.get_field_index(part)]  # flatten hands a struct's nulls on
        columns.append(values(column))
    rows = list(zip(*columns))
    out, at = [], 0
    for n in array.value_lengths().to_pylist():
        out.append(None if n is None else rows[at:at + n])
        at += n or 0
    return out


def column(work, kind: pa.DataType, *inputs):
    """The column that ``work`` makes of input columns: it gets Arrow arrays of some rows and returns a list of ``kind``.

    Computed once a row: filters stay above it.
    """

    def run(*arrays: pa.Array) -> pa.Array:
        parts = [build(work(*[a.slice(at, ROWS_AT_ONCE) for a in arrays]), kind) for at in range(0, len(arrays[0]), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else build([], kind)

    return F.arrow_udf(run, from_arrow_type(kind)).asNondeterministic()(*inputs)
