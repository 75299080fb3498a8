"""Every registered query with, where SQL can express it, its twin in ANSI SQL."""

from __future__ import annotations

from rowfield.plans import exports, measuring, plantings, routes, scalars, signals, spatial, streams
from rowfield.sources.driver import LAYERS_SQL

FLAGSHIP = "measurements_levels"


def twin(select: str) -> str:
    """A statement over the layers: its own table expressions follow theirs."""
    head, body = "WITH ", select.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{LAYERS_SQL.strip()},\n{body.removeprefix(start)}"
    return f"{head}{LAYERS_SQL.strip()}\n{body}"


_EVERY = {k: v for module in (measuring, scalars, spatial, signals, routes, streams, exports, plantings) for k, v in module.QUERIES.items()}
QUERIES = {k: run for k, (run, _) in _EVERY.items()}
ORACLES = {k: twin(sql) for k, (_, sql) in _EVERY.items() if sql}
