"""What a run was: its seed, code, machine and time, and what came out, counted by the
plan that writes the rows."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import failure_budget
from .sim import ConvergenceError


def commit(folder: str = ".") -> str:
    """The commit that the working tree at `folder` is at; "unknown" where it cannot be read."""
    git = Path(folder) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        ref = head.removeprefix("ref: ")
        if (git / ref).exists():
            return (git / ref).read_text().strip()
        packed = dict(line.split(" ", 1)[::-1] for line in (git / "packed-refs").read_text().splitlines() if " " in line and line[0] not in "#^")
        return packed.get(ref, "unknown")
    except OSError:
        return "unknown"


_RECORD = "run string, seed long, commit string, cores int, started_utc timestamp, elapsed_ms long, rows long, failures long, budget long, status string"


@dataclass
class Run:
    """A run's context; `write` writes rows and counts them on the way."""

    seed: int
    commit: str = field(default_factory=commit)
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    started: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))
    clock: float = field(default_factory=time.monotonic)
    record: dict = field(default_factory=dict)

    def elapsed_ms(self) -> int:
        return int((time.monotonic() - self.clock) * 1000)

    def write(self, rows: DataFrame, path: str, failed: Column | None = None) -> DataFrame:
        """Writes `rows` to `path` as Parquet and returns the written table.  How many
        there are and how many of them failed comes from that same job; with more
        failures than the budget allows the record says so and ConvergenceError is raised,
        the rows staying where they are."""
        seen, spark = Observation(f"run-{self.run}"), rows.sparkSession
        bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(True))
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("failures")).write.mode("overwrite").parquet(path)
        got = seen.get
        budget = failure_budget(got["rows"])
        status = "FAILED" if failed is not None and got["failures"] > budget else "OK"
        self.record = {"run": self.run, "seed": self.seed, "commit": self.commit, "cores": spark.sparkContext.defaultParallelism, "started_utc": self.started, "elapsed_ms": self.elapsed_ms(), "rows": got["rows"], "failures": got["failures"], "budget": budget, "status": status}
        if status == "FAILED":
            raise ConvergenceError(f"{got['failures']} of {got['rows']} members failed; the budget is {budget}")
        return spark.read.schema(rows.schema).parquet(path)

    def table(self, spark: SparkSession) -> DataFrame:
        """The run's record, one row."""
        return spark.createDataFrame([tuple(self.record[f.split()[0]] for f in _RECORD.split(", "))], _RECORD)
