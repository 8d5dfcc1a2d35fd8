"""How long the steps of an analysis ran, and over how many rows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import written


@dataclass
class Steps:
    """Measured times by step, in milliseconds, and the rows that the step's tables got.

    Spark runs what one table needs as one job, so steps that meet in a table share its time; ``together`` says which.
    Blocks may not be nested, so all times together are at most the time that passed. Of the steps that a block names
    only those of ``planned`` count, if it is given.
    """

    planned: list[str] | None = None
    ms: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    together: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _counted(self, names: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(n for n in names if self.planned is None or n in self.planned)

    @contextmanager
    def timed(self, *names: str) -> Iterator[None]:
        """What runs in the block is done for the steps ``names``; a step may have several blocks."""
        started = time.perf_counter()
        yield
        names = self._counted(names)
        share = (time.perf_counter() - started) * 1000 / max(len(names), 1)
        for n in names:
            self.ms[n] = self.ms.get(n, 0.0) + share
            self.together[n] = tuple(dict.fromkeys((*self.together.get(n, ()), *(o for o in names if o != n))))

    def written(self, df: DataFrame, name: str, *names: str) -> DataFrame:
        """storage.written(), timed for ``names``; its rows are counted as they are written, without another job."""
        seen = Observation()
        with self.timed(*names):
            made = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        for n in self._counted(names):
            self.rows[n] = int(seen.get["rows"])
        return made

    def summary(self, step: str) -> str:
        """What was measured, in words; empty for a step that was not."""
        told = [f"{self.rows[step]} rows"] if step in self.rows else []
        if self.together.get(step):
            told.append("in one job with " + ", ".join(o.removeprefix("step_").replace("_", " ") for o in self.together[step]))
        return "; ".join(told)
