"""Column roles of a table, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """Which columns are numbers, which of them are long-tailed, which are categories, which are left out, and the label."""

    numeric: tuple[str, ...] = ()
    log_numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    label: str | None = None
    positive: str | None = None
    missing_token: str = "Unknown"

    def __post_init__(self) -> None:
        if not set(self.log_numeric) <= set(self.numeric):
            raise ValueError("log_numeric columns must be numeric")

    def without(self, *columns: str) -> TableSpec:
        """The same roles without some columns, for ablations."""
        keep = lambda names: tuple(c for c in names if c not in columns)
        return TableSpec(keep(self.numeric), keep(self.log_numeric), keep(self.categorical), (*self.dropped, *columns), self.label, self.positive, self.missing_token)
