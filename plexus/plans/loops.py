"""Driver loops over tables in shared storage: append-only levels and replaced states."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.plans.tables import materialize, release, remove, shared_root


class Levels:
    """A table that grows by one part per round; each part is written once."""

    def __init__(self, like: DataFrame, name: str) -> None:
        self.spark, self.schema, self.n = like.sparkSession, like.schema, 0
        self.root = f"{shared_root(self.spark)}/plexus-{name}-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> DataFrame:
        """Write the rows as the next level and return a scan of that level alone."""
        path = f"{self.root}/{self.n}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def merged(self, how: Callable[[DataFrame], DataFrame]) -> Levels:
        """A table of one level that holds ``how`` of all; the old levels are deleted."""
        out = Levels(self.all(), "merged")
        out.append(how(self.all()))
        remove(self.spark, self.root)
        return out

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{k}" for k in range(self.n)])


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, int], bool],
            max_rounds: int, name: str = "state") -> tuple[DataFrame, int, bool]:
    """Replace ``state`` by ``step(state, round)`` until ``done(state, round)``.

    Returns the last state, the rounds run and whether it settled.  Each state is written to shared
    storage before the one it came from is deleted, so the plan never grows.
    """
    now = materialize(state, name)
    for k in range(1, max_rounds + 1):
        after = materialize(step(now, k), name)
        release(now)
        now = after
        if done(now, k):
            return now, k, True
    return now, max_rounds, False
