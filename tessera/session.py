"""A workspace: fact tables pinned at a revision, and requests answered from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Workspace:
    """Opens tables, keeps what is computed for a revision, and gives it up on refresh."""

    spark: SparkSession
    load: Callable[[], dict[str, DataFrame]]
    revision: int = 1
    closed: bool = False
    dirty: bool = False
    memo: dict[tuple[str, int], DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if self.closed:
            raise RuntimeError("WORKSPACE_CLOSED")
        if self.dirty:
            self.refresh()
        if (name, self.revision) not in self.memo:
            self.memo[name, self.revision] = self.load()[name].cache()
        return self.memo[name, self.revision]

    def mark_dirty(self) -> None:
        """Any number of marks make one refresh, before the next read."""
        self.dirty = True

    def refresh(self) -> int:
        for df in self.memo.values():
            df.unpersist()
        self.memo, self.dirty, self.revision = {}, False, self.revision + 1
        return self.revision

    def close(self) -> None:
        if not self.closed:
            self.refresh()
        self.closed = True

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
