"""A database table of tasks as a stream with offsets: a Python data source over any DB-API module.

    spark.dataSource.register(polled.PolledTasks)
    spark.readStream.format("polled").option("module", "sqlite3").option("database", path).load()

Offsets are (modified, id), so a restart goes on where the last committed batch ended and each version of a row comes
once. A row that is modified comes again under its new time. Rows that are written with a time before the offset are
missed: let the database set `modified` when it commits.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

COLUMNS = "id long, tid string, type int, status int, analysis_status int, duration int, master_tid string, modified string"


@dataclass
class Range(InputPartition):
    """Rows after `after`, up to and with `to`: each (modified, id)."""

    after: tuple[str, int]
    to: tuple[str, int]


class Reader(DataSourceStreamReader):
    """Options: module (of the DB-API), database (what its connect() takes), table, per_trigger (rows), tasks (per batch)."""

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.module, self.database = options["module"], options["database"]
        self.table, self.names = options.get("table", "tasks"), names
        self.per_trigger, self.tasks = int(options.get("per_trigger", 1000)), int(options.get("tasks", 4))
        if not self.table.replace(".", "").replace("_", "").isalnum():
            raise ValueError("the table's name has to be letters, digits, dots and underscores")
        self.last: tuple[str, int] | None = None

    def rows(self, what: str, rest: str, *values) -> list[tuple]:
        module = importlib.import_module(self.module)
        mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}[module.paramstyle]
        connection = module.connect(self.database)
        try:
            cursor = connection.cursor()
            cursor.execute(f"select {what} from {self.table} where {rest}".replace("?", mark), values)
            return cursor.fetchall()
        finally:
            connection.close()

    AFTER = "(modified > ? or (modified = ? and id > ?))"
    UP_TO = "(modified < ? or (modified = ? and id <= ?))"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": "", "id": -(1 << 63)}

    def latestOffset(self) -> dict:  # noqa: N802
        """per_trigger rows beyond the last batch's end, or the last row. A new reader begins at what it is told first."""
        if self.last is None:
            found = self.rows("modified, id", "1 = 1 order by modified desc, id desc limit 1")
            return {"modified": found[0][0], "id": found[0][1]} if found else self.initialOffset()
        m, i = self.last
        ahead = self.rows("modified, id", f"{self.AFTER} order by modified, id limit ?", m, m, i, self.per_trigger)
        m, i = ahead[-1] if ahead else self.last
        return {"modified": m, "id": i}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Ranges of about equal rows, cut at rows that the database names."""
        a, b = (start["modified"], start["id"]), (end["modified"], end["id"])
        self.last = b
        if a == b:
            return []
        inside, bounds = f"{self.AFTER} and {self.UP_TO}", (a[0], *a, b[0], *b)
        n = self.rows("count(*)", inside, *bounds)[0][0]
        step, cuts = -(-n // self.tasks), [a]
        for k in range(1, self.tasks):
            if step and k * step < n:
                cuts.append(self.rows("modified, id", f"{inside} order by modified, id limit 1 offset ?", *bounds, k * step - 1)[0])
        return [Range(tuple(x), tuple(y)) for x, y in zip(cuts, [*cuts[1:], b], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        a, b = partition.after, partition.to
        yield from self.rows(", ".join(self.names), f"{self.AFTER} and {self.UP_TO}", a[0], *a, b[0], *b)

    def commit(self, end: dict) -> None:
        self.last = (end["modified"], end["id"])


class PolledTasks(DataSource):
    """format("polled"): rows of a table with the columns of COLUMNS, or those of the schema given."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return Reader(dict(self.options), schema.names)
