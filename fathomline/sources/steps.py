"""A source of forecast steps: one input partition a step, the newest model run that has it, bounds pushed into its files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Columns that a step's file may lack; what it lacks is null.
VALUES = ("u10", "v10", "precip")
#: Comparisons that go into a file's scan.
PUSHED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Step(InputPartition):
    step_h: int


class Steps(DataSource):
    """Option `path`: a folder of runs that all executors see, each with files <step>.parquet of lat, lon and VALUES. `runs`: names, newest first,
    comma-separated. `last` and `every`: the last step and hours between steps (72 and 3).

    A step that no run has, or whose files are all broken, gives one row with its step and nulls, so that a bad download fails no query.
    With option `pushdown`, which needs spark.sql.python.filterPushdown.enabled, bounds of lat and lon reach the files; Spark applies them otherwise.
    """

    @classmethod
    def name(cls) -> str:
        return "forecast_steps"

    def schema(self) -> str:
        return "step_h int, run string, lat double, lon double, " + ", ".join(f"{c} double" for c in VALUES)

    def reader(self, schema) -> "StepReader":
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return (BoundedStepReader if pushed else StepReader)(self.options)


class StepReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.runs = options["path"].rstrip("/"), [r.strip() for r in options["runs"].split(",")]
        self.steps = list(range(0, int(options.get("last", 72)) + 1, int(options.get("every", 3))))
        self.bounds: list[tuple[str, str, float]] = []

    def partitions(self) -> list[Step]:
        return [Step(s) for s in self.steps]

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        names = ["step_h", "run", "lat", "lon", *VALUES]
        for run in self.runs:
            try:
                found = pq.read_table(f"{self.path}/{run}/{partition.step_h}.parquet", filters=self.bounds or None)
                columns = [found[c].cast(pa.float64()) if c in found.column_names else pa.nulls(len(found), pa.float64()) for c in ("lat", "lon", *VALUES)]
            except (OSError, pa.ArrowInvalid):  # not there, or not what it should be: the run before may have it
                continue
            whole = pa.table([pa.array([partition.step_h] * len(found), pa.int32()), pa.array([run] * len(found), pa.string()), *columns], names=names)
            yield from whole.to_batches()
            return
        if not self.bounds:
            none = [pa.nulls(1, pa.float64())] * (2 + len(VALUES))
            yield pa.RecordBatch.from_arrays([pa.array([partition.step_h], pa.int32()), pa.array([None], pa.string()), *none], names=names)


class BoundedStepReader(StepReader):
    """A reader that takes bounds of lat and lon into its files' scans."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in PUSHED and f.attribute in (("lat",), ("lon",)):
                self.bounds.append((f.attribute[0], PUSHED[type(f)], float(f.value)))
            else:
                yield f
