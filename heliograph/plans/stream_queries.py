"""Registered queries that run as streams over tables of the test data, with state, saved batches and rules read anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import intake, masters, tasks
from . import saved
from . import standins as st
from .profile_queries import register
from .storage import shared_dir

T = st.TASKS


def _stream(spark: SparkSession, rows: DataFrame, parts: int, schema: str) -> tuple[DataFrame, str]:
    """rows as a stream of `parts` files, one a micro-batch, and a folder for what the stream keeps."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(parts, "id").drop("id").write.json(f"{root}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{root}/in"), root


def _masters(spark: SparkSession, d: str) -> DataFrame:
    """Every sub-task in two versions, the first one open; updates go to a store, of which the last row of each master counts."""
    some = F.when(F.col("id") % 2 == 0, "look").otherwise(" ")
    said = F.array(F.struct(F.lit("f").alias("func"), some.alias("suggestion"))).cast("array<struct<func:string,suggestion:string>>")
    rows = st.tasks(spark, d).select("id", "master_tid", "tid", F.explode(F.expr("array(1L, 2L)")).alias("seq"), "status", "analysis_status", said.alias("suggestions"))
    rows = rows.withColumn("analysis_status", F.when(F.col("seq") == 1, 0).otherwise(F.col("analysis_status")))
    stream, root = _stream(spark, rows, 4, masters.UPDATE)
    writer = masters.rolled_up(stream).writeStream.outputMode("update").foreachBatch(lambda batch, n: saved.save({"masters": batch}, root, n))
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = saved.load(spark, root, "masters", masters.MASTER, ("master_tid",))
    return found.select("master_tid", "sub_tasks", "complete", F.concat_ws(",", "groups.tid").alias("groups"))


register(
    "S11_B11_masters_with_state",
    f"with {T} select master_tid, count(*) as sub_tasks, count(case when analysis_status <= 1 and status <> 3 then 1 end) = 0 as complete, coalesce(string_agg(case when analysis_status = 2 and id % 2 = 0 then tid end, ',' order by tid), '') as groups from tasks group by 1",
)(_masters)

_SHARES = "shares as (select 't' || l_orderkey as tid, l_returnflag || '.' || l_linestatus as func, sum(l_quantity) as n from lineitem group by all), functions as (select tid, func, cast(n / sum(n) over (partition by tid) * 100 as double) as self_pct from shares)"


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    """Tasks arrive in four batches; shares of their lines by flag are their functions, and a table of regions is the rules."""
    func = F.concat_ws(".", "l_returnflag", "l_linestatus")
    shares = st.table(spark, d, "lineitem").groupBy(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("tid"), func.alias("func")).agg(F.sum("l_quantity").alias("n"))
    whole = shares.groupBy("tid").agg(F.sum("n").alias("whole"))
    functions = shares.join(whole, "tid").select("tid", "func", (F.col("n") / F.col("whole") * 100).cast("double").alias("self_pct"))
    stream, root = _stream(spark, st.tasks(spark, d), 4, "tid string, status int, analysis_status int, master_tid string")

    def rules() -> DataFrame:
        """A rule for each region's name's first letter; those of later regions are deleted."""
        part, deleted = F.upper(F.substring("r_name", 1, 1)), F.when(F.col("r_regionkey") > 2, "2024-01-01")
        return st.table(spark, d, "region").select(F.concat(F.lit("X"), F.col("r_regionkey").cast("string")).alias("rule"), part.alias("part"), F.lit(60.0).alias("above"), deleted.alias("deleted"))

    tasks.analysed(stream, lambda ready: functions.join(ready.select("tid"), "tid"), rules, root, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    suggestions = tasks.of_store(spark, root, "suggestions").select("tid", "rule", "func", F.round("value", 6).alias("value"))
    status = tasks.of_store(spark, root, "status").select("tid", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("func"), F.col("analysis_status").cast("double").alias("value"))
    return suggestions.unionByName(status)


register(
    "S07_S09_B11_analysed_tasks",
    f"with {T}, {_SHARES}, ready as (select distinct tid from tasks where status = 2 and analysis_status = 0 and tid is not null), rules as (select 'X' || r_regionkey as rule, upper(left(r_name, 1)) as part from region where r_regionkey <= 2) select tid, rule, func, round(self_pct, 6) as value from functions join ready using (tid) join rules on contains(func, part) where self_pct > 60 union all select tid, null, null, case when exists (select 1 from functions f where f.tid = ready.tid) then 2.0 else 3.0 end from ready",
)(_analysed)


def _taken_in(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that land in two folders, and a source that is switched off, as one stream; each with its source's name."""
    rows, root = st.tasks(spark, d), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for name, odd in (("even", 0), ("odd", 1)):
        rows.where(F.col("id") % 2 == odd).write.json(f"{root}/{name}")
    sources = [f"{root}/even", intake.Source("http", "posted", {"path": f"{root}/odd", "per_trigger": "3"}), intake.Source("kafka", "off", {}, enabled=False)]
    stream = intake.intake(spark, sources).withColumn("source", F.when(F.col("source") == "posted", "posted").otherwise("landing"))
    writer = stream.writeStream.foreachBatch(lambda batch, n: saved.save({"tasks": batch}, root, n)).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return saved.load(spark, root, "tasks", f"{intake.TASK_SCHEMA}, source string").select("source", "id", "tid", "master_tid")


register("S02_S04_H06_intake", f"with {T} select case when id % 2 = 0 then 'landing' else 'posted' end as source, id, tid, master_tid from tasks")(_taken_in)
