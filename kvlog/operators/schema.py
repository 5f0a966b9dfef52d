"""Which columns of a table play which part in a version log."""

from __future__ import annotations

from dataclasses import dataclass

#: Operations of a log row.
PUT, DELETE, SINGLE_DELETE, MERGE = "put", "delete", "single_delete", "merge"


@dataclass(frozen=True)
class Log:
    """Columns of a version log: key columns, sequence, values; operation and timestamp where there are any."""

    key: tuple[str, ...]
    seq: str
    value: tuple[str, ...] = ()
    op: str | None = None
    ts: str | None = None
