"""Shapes of JSON documents, and where a document departs from one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


def text(pattern: str | None = None, least: int = 0):
    def check(value: Any) -> str | None:
        if not isinstance(value, str):
            return f"{value!r} is not a string"
        if len(value) < least:
            return f"{value!r} is too short"
        return f"{value!r} does not match {pattern}" if pattern and not re.search(pattern, value) else None

    return check


def number(kind: str, low: float | None = None, high: float | None = None):
    def check(value: Any) -> str | None:
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        if isinstance(value, bool) or not isinstance(value, (int, float)) or kind == "integer" and not whole:
            return f"{value!r} is not {'an' if kind == 'integer' else 'a'} {kind}"
        if low is not None and value < low:
            return f"{value!r} is less than {low}"
        return f"{value!r} is greater than {high}" if high is not None and value > high else None

    return check


def one_of(*allowed: Any):
    return lambda value: None if value in allowed and isinstance(value, str) else f"{value!r} is not one of {list(allowed)}"


def text_or_null(value: Any) -> str | None:
    return None if value is None else text()(value)


@dataclass(frozen=True)
class Many:
    item: Any
    least: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class Fields:
    required: dict[str, Any]
    optional: dict[str, Any]
    some_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Chosen:
    """A shape that depends on the value."""

    by: Callable[[Any], Fields]


def scalar(value: Any) -> str | None:
    return None if isinstance(value, (str, int, float)) and not isinstance(value, bool) else f"{value!r} is not a string or number"


NAME, COLUMN = text(r"^[a-z][a-z0-9_]*$"), text(r"^[A-Za-z_][A-Za-z0-9_]*$")


def problems(value: Any, shape: Any, place: str = "") -> list[str]:
    """Where and how ``value`` differs from ``shape``, in the order of places."""
    if isinstance(shape, Chosen):
        shape = shape.by(value)
    if isinstance(shape, Fields):
        if not isinstance(value, dict):
            return [f"{place or '/'}: {value!r} is not an object"]
        known = shape.required | shape.optional
        out = [f"{place or '/'}: '{k}' is a required property" for k in shape.required if k not in value]
        out += [f"{place or '/'}: unexpected property '{k}'" for k in value if k not in known]
        if shape.some_of and not any(k in value for k in shape.some_of):
            out.append(f"{place or '/'}: needs {' or '.join(shape.some_of)}")
        for k in value:
            if k in known:
                out += problems(value[k], known[k], f"{place}/{k}")
        return out
    if isinstance(shape, Many):
        if not isinstance(value, list):
            return [f"{place}: {value!r} is not an array"]
        out = [f"{place}: needs {shape.least} item(s) or more"] if len(value) < shape.least else []
        if shape.distinct and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{place}: items are not unique")
        for i, item in enumerate(value):
            out += problems(item, shape.item, f"{place}/{i}")
        return out
    fault = shape(value)
    return [f"{place}: {fault}"] if fault else []
