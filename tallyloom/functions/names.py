"""Names of features: ``<code>/code``, ``<code>/value``, ``<code>/static/present``, ``<code>/static/first``.

A code may hold slashes itself, so names are always read from their end. Each rule comes for one
name on the driver and, where data needs it, for a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.schema import KINDS

_ENDS = r"/(code|value|static/present|static/first)$"


def split_name(name: str) -> tuple[str, str]:
    """(code, kind) of a feature name; ValueError if it ends in no known kind."""
    for kind in KINDS:
        if name.endswith("/" + kind):
            return name[: -len(kind) - 1], kind
    raise ValueError(f"{name!r} is no feature name: it should end in one of {', '.join(KINDS)}")


def bare_code(name: Column) -> Column:
    """The code of a feature name; a name without a known kind stays as it is."""
    return F.regexp_replace(name, _ENDS, "")


def kind_column(name: Column) -> Column:
    """The kind of a feature name, null if it has none."""
    kind = F.regexp_extract(name, _ENDS, 1)
    return F.when(kind != "", kind)


def without_last_part(name: str) -> str:
    """``a/b/c`` -> ``a/b``; empty if there is one part only."""
    return name.rpartition("/")[0]


def without_last_part_column(name: Column) -> Column:
    return F.regexp_replace(name, r"/?[^/]*$", "")


def parse_static(name: str) -> tuple[str, str, str]:
    """(code, 'static', aggregation) of a static feature's name; ValueError with fewer than three parts."""
    parts = name.rsplit("/", 2)
    if len(parts) < 3:
        raise ValueError(f"{name!r} has fewer than three parts")
    return parts[0], parts[1], parts[2]


def column_name(feature: str, agg: str, window: str | None) -> str:
    """Name of a matrix column: ``<code>/<agg>`` and the window, if there is one."""
    code, _ = split_name(feature)
    return f"{code}/{agg}" if window is None else f"{code}/{agg}/{window}"
