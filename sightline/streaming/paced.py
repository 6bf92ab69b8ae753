"""A stream that plays a recorded table at a frame rate, as a live picture comes: format ``paced``.

Each row of the Parquet files is a frame, in the order of the files. Options:

* ``path``: a file or folder that all machines can read
* ``fps``, ``max_fps``: the recording's rate and the most that is asked for; of every ``round(fps / max_fps)`` frames one is given
* ``laps``: how often the recording is played (0: for ever)
* ``started``: when it began (seconds since 1970). The frames up to now are there. Without it all laps are there at once
* ``most``: frames of a batch; a reader that is slower misses the older ones. Without it nothing is missed

An offset is the number of frames played. It follows from the clock alone, so a query that starts again from its checkpoint
goes on where it was: nothing is lost or comes twice.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

#: Frames that a task reads.
TASK_FRAMES = 200_000


def _dataset(path: str):
    import pyarrow.dataset as ds

    return ds.dataset(path.removeprefix("file://"), format="parquet")


class PacedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = from_arrow_schema(_dataset(self.options["path"]).schema)
        return StructType([*found.fields]).add("frame_no", LongType()).add("lap", IntegerType()).add("looped", BooleanType())

    def streamReader(self, schema: StructType) -> PacedReader:
        return PacedReader(self.options, schema)


class Frames(InputPartition):
    """Frames ``first`` to ``last - 1`` of one lap."""

    def __init__(self, lap: int, first: int, last: int):
        self.lap, self.first, self.last = lap, first, last


class PacedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        fps, most = float(options.get("fps", 25)), float(options.get("max_fps", 24))
        self.fps, self.skip = fps, max(1, round(fps / min(fps, most)))
        self.laps, self.most = int(options.get("laps", 1)), int(options.get("most", 0))
        self.started = float(options["started"]) if "started" in options else None
        if not self.laps and self.started is None:
            raise ValueError("a recording that is played for ever needs the time when it started")
        self.total = _dataset(self.path).count_rows()

    def initialOffset(self) -> dict:
        return {"played": 0}

    def latestOffset(self) -> dict:
        end = self.total * self.laps if self.laps else None
        now = end if self.started is None else int(max(0.0, time.time() - self.started) * self.fps)
        return {"played": now if end is None else min(now, end)}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        a, b = start["played"], end["played"]
        if self.most:
            a = max(a, b - self.most)
        out = []
        while a < b:
            lap, first = divmod(a, max(1, self.total))
            last = min(self.total, first + TASK_FRAMES, first + b - a)
            out.append(Frames(lap, first, last))
            a += last - first
        return out

    def read(self, partition: Frames) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        # Frames count from 1; those that are not asked for are dropped as they are read. A task reads only the row groups of its
        # frames, some rows at a time, however large these and the files are.
        first, last, before = partition.first + 1, partition.last, 0
        columns = [name for name in self.names if name not in ("frame_no", "lap", "looped")]
        for fragment in _dataset(self.path).get_fragments():
            n = fragment.count_rows()
            if before < last and before + n >= first:
                groups, at, start = [], before, None
                for group in fragment.row_groups:
                    if at < last and at + group.num_rows >= first:
                        start = at if start is None else start
                        groups.append(group.id)
                    at += group.num_rows
                with fragment.open() as file:
                    for batch in pq.ParquetFile(file, buffer_size=1 << 20, pre_buffer=False).iter_batches(10_000, groups, columns, use_threads=False):
                        numbers = np.arange(start + 1, start + batch.num_rows + 1)
                        start += batch.num_rows
                        own = np.flatnonzero((numbers % self.skip == 0) & (numbers >= first) & (numbers <= last))
                        if len(own):
                            part = numbers[own]
                            table = pa.Table.from_batches([batch]).take(own)
                            more = {"frame_no": part, "lap": np.full(len(part), partition.lap, np.int32), "looped": (part <= self.skip) & (partition.lap > 0)}
                            for name, values in more.items():
                                table = table.append_column(name, pa.array(values))
                            yield from table.select(self.names).to_batches()
                        if start >= last:
                            break
            before += n

    def commit(self, end: dict) -> None: ...
