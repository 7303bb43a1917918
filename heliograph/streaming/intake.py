"""Streams of tasks: folders where posted tasks land, a database that is polled, a message queue; one union of all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .tasks import pending

TASK_SCHEMA = "id long, tid string, type int, status int, analysis_status int, duration int, master_tid string"
#: Bytes of a posted task at most.
MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class Source:
    """A source of tasks: its kind, a name, and options as text, each read with a default."""

    kind: str
    name: str
    options: dict[str, str] = field(default_factory=dict)
    enabled: bool = True

    def text(self, key: str, otherwise: str = "") -> str:
        return self.options.get(key, otherwise)

    def number(self, key: str, otherwise: int) -> int:
        try:
            return int(self.options.get(key, otherwise))
        except ValueError:
            return otherwise

    def flag(self, key: str, otherwise: bool = False) -> bool:
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(str(self.options.get(key, "")).lower(), otherwise)


def landing(spark: SparkSession, source: Source) -> DataFrame:
    """Tasks that land as JSON in the folder `path`."""
    return spark.readStream.schema(TASK_SCHEMA).option("maxFilesPerTrigger", source.number("per_trigger", 100)).json(source.text("path"))


def messages(spark: SparkSession, source: Source) -> DataFrame:
    """Tasks of a message queue's topic; the connector's jar has to be with Spark."""
    options = {"kafka.bootstrap.servers": source.text("servers"), "subscribe": source.text("topic"), "startingOffsets": source.text("from", "latest"), "maxOffsetsPerTrigger": source.text("per_trigger", "1000")}
    return of_messages(spark.readStream.format("kafka").options(**options).load())


def of_messages(rows: DataFrame) -> DataFrame:
    """Tasks of (value binary) rows; those that hold no task are left out."""
    return rows.select(F.from_json(F.col("value").cast("string"), TASK_SCHEMA).alias("t")).where("t.tid is not null").select("t.*")


#: Kinds of streams by name. Add more.
SOURCES: dict[str, Callable[[SparkSession, Source], DataFrame]] = {"http": landing, "landing": landing, "kafka": messages}


def intake(spark: SparkSession, sources: list[Source | str]) -> DataFrame:
    """One stream of all enabled sources' tasks, each with the name of its source; a text is a landing folder."""
    out = None
    for s in sources:
        s = Source("landing", s, {"path": s}) if isinstance(s, str) else s
        if not s.enabled:
            continue
        if s.kind not in SOURCES:
            raise ValueError(f"no source of kind {s.kind}; there are {', '.join(sorted(SOURCES))}")
        rows = SOURCES[s.kind](spark, s).withColumn("source", F.lit(s.name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source is enabled")
    return out


def answer(method: Column | str, body: Column | str, room: Column | bool = True) -> Column:
    """The HTTP answer to a posted task: 405 unless POST, 413 for more than MOST_BYTES, 400 for no task, 503 without room, else 202."""
    method, body = (F.col(x) if isinstance(x, str) else x for x in (method, body))
    task = F.from_json(body, TASK_SCHEMA)
    return (
        F.when(F.coalesce(method, F.lit("")) != "POST", 405).when(F.octet_length(body) > MOST_BYTES, 413).when(body.isNull() | task.isNull() | task["tid"].isNull() | (task["tid"] == ""), 400)
        .when(~(F.lit(room) if isinstance(room, bool) else room), 503).otherwise(202)
    )


def accepted(posts: DataFrame, method: str = "method", body: str = "body") -> DataFrame:
    """Tasks of the posts (method, body) that are answered with 202, to be written to a landing folder."""
    return posts.where(answer(method, body) == 202).select(F.from_json(F.col(body), TASK_SCHEMA).alias("t")).select("t.*")


def table(spark: SparkSession, source: Source) -> DataFrame:
    """Tasks of a database's table, over JDBC: options url, table, driver, user, password."""
    reader = spark.read.format("jdbc").option("url", source.text("url")).option("dbtable", source.text("table", "tasks"))
    for key in ("driver", "user", "password"):
        if source.text(key):
            reader = reader.option(key, source.text(key))
    return reader.load()


def polled(spark: SparkSession, read: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 2, n: int = 10) -> DataStreamWriter:
    """A writer that every few seconds hands the n newest pending tasks that read() gives to handle().

    handle() has to set the tasks' status, or they are handed over again: delivery is at least once. A clock of one
    row a second drives the polls; read() is called anew for each, so Spark reads the table as it is then.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, number: handle(pending(read(), n), number)).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint)
