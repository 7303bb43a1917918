"""Collapsed (folded) stacks: lines `thread;frame;...;frame count` read as samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fn

LINE = r"(?s)^(.*) ([^ ]*)$"
SNIFF = r"^[^;]+(;[^;]+)*\s\d+$"
#: Names under which the reader is known.
FORMATS = ("collapsed", "folded")


@dataclass(frozen=True)
class Options:
    top: int = 15
    min_sample_percent: float = 0.01
    strict: bool = False
    include_idle: bool = False


def looks_collapsed(line: Column | str) -> Column:
    return fn._col(line).rlike(SNIFF)


def parse_lines(lines: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """The other columns of lines, and thread_name, tid, stack, value of every line that holds a sample.

    The count stands behind the last space. The first frame is the thread; a marker of digits before it and an
    agent's second thread frame are dropped, so are empty frames and `[]`; modules are cut off. Blank lines hold no
    sample. Other lines without an integer count are left out, or raise an error if strict.
    """
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    count = F.regexp_extract("__text", LINE, 2)
    value = F.when(count.rlike("^[+-]?[0-9]+$"), count.try_cast("bigint"))
    rest = [c for c in lines.columns if c != line]
    rows = lines.withColumn("__text", text).where(F.length("__text") > 0).withColumn("value", value)
    if strict:
        rows = rows.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("not a sample: "), F.col("__text")))).otherwise(F.col("value")))
    parts = F.split(F.regexp_extract("__text", LINE, 1), ";")
    marked = F.when(fn.is_invalid_marker(F.get("__p", F.lit(0))) & (F.size("__p") > 1), F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0)))).otherwise(F.col("__p"))
    frames = F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0)))
    agent = F.get("__s", F.lit(0)).rlike(fn.APM_THREAD) & fn._col("__t").rlike(fn.APM_THREAD)
    return (
        rows.where(F.col("value").isNotNull())
        .withColumn("__p", parts)
        .withColumn("__p", marked)
        .withColumns({"__t": F.get("__p", F.lit(0)), "__s": frames})
        .withColumn("__s", F.when(agent, F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0)))).otherwise(F.col("__s")))
        .select(
            *rest,
            fn.thread_name("__t").alias("thread_name"),
            fn.thread_id("__t").alias("tid"),
            F.transform(F.filter("__s", lambda x: (x != "") & (x != "[]")), fn.frame_function).alias("stack"),
            "value",
        )
    )


def read(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """samples (profile_id, sample_id, thread_name, tid, stack, value): a profile a file.

    sample_id follows the order of lines within a file's split; a file that Spark splits has ascending splits.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("profile_id"), F.monotonically_increasing_id().alias("sample_id"), F.col("value").alias("line"))
    samples = parse_lines(lines, strict=options.strict)
    return samples.select("profile_id", "sample_id", "thread_name", "tid", "stack", "value")
