"""JSON cells of any depth: their numbers by path, their canonical form, and the change between two of them.

A cell is walked once, in Arrow batches, with a stack of its own, so its depth and the order of its keys don't matter.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parsed(cell: str | None, **options):
    """(True, value) of a cell, or (False, None) if it is null or isn't JSON."""
    if cell is None:
        return False, None
    try:
        return True, json.loads(cell, **options)
    except (ValueError, RecursionError):
        return False, None


def _number(value: int | float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def numbers_of(value) -> dict[str, float]:
    """The numbers in a parsed value by path: keys joined by dots, places in lists as [0]. Booleans, strings and nulls aren't numbers.

    Where two paths are spelt alike, the later one in the cell counts.
    """
    found: dict[str, float] = {}
    waiting = [("", value)]
    while waiting:
        path, here = waiting.pop()
        if isinstance(here, dict):
            waiting += [(f"{path}.{key}" if path else key, item) for key, item in reversed(here.items())]
        elif isinstance(here, list):
            waiting += [(f"{path}[{i}]", item) for i, item in reversed(list(enumerate(here)))]
        elif isinstance(here, (int, float)) and not isinstance(here, bool):
            found[path] = _number(here)
    return found


def json_numbers(c: Column | str) -> Column:
    """map<string,double> of a JSON cell's numbers by path (see numbers_of()); empty if it has none, null if it is null or isn't JSON."""

    def run(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells.to_pylist():
            known, value = _parsed(cell)
            out.append(list(numbers_of(value).items()) if known else None)
        return pa.array(out, pa.map_(pa.string(), pa.float64()))

    return F.arrow_udf(run, "map<string,double>")(_text(c))


def _refuse(said: str):
    raise ValueError(said)


def canonical_json(c: Column | str) -> Column:
    """The cell with sorted keys and without white space, nulls kept, letters as they are; null if it isn't JSON or has NaN or an infinity."""

    def run(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells.to_pylist():
            known, value = _parsed(cell, parse_constant=_refuse)
            try:
                out.append(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) if known else None)
            except (ValueError, RecursionError):  # 1e999 parses as an infinity
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(_text(c))


def largest_change(before: Column, after: Column) -> Column:
    """The largest difference between two columns made by json_numbers(); null if they have no numbers or unlike paths."""
    keys = lambda m: F.array_sort(F.map_keys(m))
    changes = F.transform(F.map_keys(before), lambda k: F.abs(F.element_at(before, k) - F.element_at(after, k)))
    return F.when(keys(before) == keys(after), F.array_max(changes))
