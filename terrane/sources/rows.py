"""Entities as Arrow batches and back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, islice, pairwise

import pyarrow as pa
import pyarrow.compute as pc

_tag = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_member = pa.list_(pa.struct([("type", pa.string()), ("id", pa.int64()), ("role", pa.string())]))
SCHEMAS = {
    "nodes": pa.schema([("id", pa.int64()), ("fixed_lat", pa.int32()), ("fixed_lon", pa.int32()), ("tags", _tag)]),
    "ways": pa.schema([("id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("tags", _tag)]),
    "relations": pa.schema([("id", pa.int64()), ("members", _member), ("tags", _tag)]),
}


def _lists(values: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of tuples as lists of structs, from a column for each field."""
    flat, fields = [x for v in values for x in v], list(kind.value_type)
    inner = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], f.type) for k, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()), inner)


def _tuples(column: pa.ListArray) -> list[list[tuple]]:
    """And back; a list that is null is empty."""
    flat = column.flatten()
    flat = list(zip(*(x.to_pylist() for x in flat.flatten())))
    ends = list(accumulate((n or 0 for n in pc.list_value_length(column).to_pylist()), initial=0))
    return [flat[a:b] for a, b in pairwise(ends)]


def to_batches(kind: str, entities: Iterable[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    rest, schema = iter(entities), SCHEMAS[kind]
    while chunk := list(islice(rest, size)):
        cols = [list(c) for c in zip(*chunk)]
        structs = {len(cols) - 1, 1} if kind == "relations" else {len(cols) - 1}
        yield pa.RecordBatch.from_arrays([_lists(c, f.type) if k in structs else pa.array(c, f.type) for k, (c, f) in enumerate(zip(cols, schema))], schema=schema)


def from_batch(kind: str, batch: pa.RecordBatch) -> Iterator[tuple]:
    last = batch.num_columns - 1
    cols = [_tuples(batch.column(i)) if i == last or kind == "relations" and i == 1 else batch.column(i).to_pylist() for i in range(last + 1)]
    if kind == "ways":
        cols[1] = [v or [] for v in cols[1]]
    yield from zip(*cols)
