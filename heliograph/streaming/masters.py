"""The roll-up of sub-tasks to their master tasks as a stream with state: a sub-task changes its own part only.

A master's state is its sub-tasks' last versions, and two counts. Up to PACKED sub-tasks are one value, read and written
once a batch; more are a map from sub-task to version. So a batch touches the sub-tasks that it has, however many a
master has, few masters' sub-tasks cost no call each, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tasks import COMPLETED

FAILED = 3
#: Sub-tasks of a master that are kept as one value.
PACKED = 256
#: What the stream has to hold: a version of a sub-task; the greatest seq counts.
UPDATE = "master_tid string, tid string, seq long, status int, analysis_status int, suggestions array<struct<func string, suggestion string>>"
GROUPS = "array<struct<tid string, items array<struct<func string, suggestion string>>>>"
MASTER = f"master_tid string, sub_tasks long, complete boolean, groups {GROUPS}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def said(suggestions) -> list[tuple[str, str]]:
    """(func, suggestion) that say something, in order."""
    pairs = [(x["func"], x["suggestion"]) for x in (suggestions if suggestions is not None else ()) if (x["suggestion"] or "").strip(" ")]
    return sorted(pairs, key=lambda p: (p[0] is not None, p[0] or "", p[1]))


class Masters(StatefulProcessor):
    """Rolls up one master's sub-tasks; gives the master's row whenever one of them changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", "tid string", "seq long, open boolean, said long, items string")
        self.counts = handle.getValueState("counts", "sub_tasks long, open long, packed string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for row in self.changed(key, (x for batch in rows for x in batch.sort_values("seq", kind="stable").to_dict("records"))):
            yield pd.DataFrame({name: [value] for name, value in row.items()})

    def changed(self, key, updates: Iterable) -> Iterator[dict]:
        """The master's row if any of the updates, by field names, changes it."""
        sub_tasks, still_open, packed = self.counts.get() or (0, 0, "{}")
        known = None if packed is None else json.loads(packed)
        changed = False
        for x in updates:
            task = (x["tid"],)
            seq, was_open, said_at, items = (self.tasks.getValue(task) if known is None else known.get(x["tid"])) or (None, False, None, "[]")
            new = said(x["suggestions"]) if x["analysis_status"] == COMPLETED else []
            # Status is the last version's, suggestions are those of the last version that has any.
            fresh, speaks = seq is None or x["seq"] > seq, bool(new) and (said_at is None or x["seq"] > said_at)
            if not fresh and not speaks:
                continue
            is_open = bool(x["analysis_status"] <= 1 and x["status"] != FAILED) if fresh else was_open
            said_at, items = (int(x["seq"]), json.dumps(new)) if speaks else (said_at, items)
            version = (int(x["seq"]) if fresh else seq, is_open, said_at, items)
            if known is None:
                self.tasks.updateValue(task, version)
            else:
                known[x["tid"]] = version
            if known is not None and len(known) > PACKED:
                for tid, v in known.items():
                    self.tasks.updateValue((tid,), tuple(v))
                known = None
            sub_tasks += seq is None
            still_open += int(is_open) - int(was_open)
            changed = True
        if changed:
            self.counts.update((int(sub_tasks), int(still_open), None if known is None else json.dumps(known)))
            versions = ((task[0], v) for task, v in self.tasks.iterator()) if known is None else known.items()
            groups = [{"tid": tid, "items": [{"func": f, "suggestion": s} for f, s in json.loads(v[3])]} for tid, v in versions if v[3] != "[]"]
            yield {"master_tid": key[0], "sub_tasks": int(sub_tasks), "complete": still_open == 0, "groups": sorted(groups, key=lambda g: g["tid"])}

    def close(self) -> None:
        pass


class RowMasters(Masters):
    """Masters over rows: most masters have a few updates a batch, for which a pandas frame each costs more than the roll-up."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in self.changed(key, sorted(rows, key=lambda x: x["seq"])):
            groups = [Row(tid=g["tid"], items=[Row(**i) for i in g["items"]]) for g in row["groups"]]
            yield Row(**{**row, "groups": groups})


def rolled_up(updates: DataFrame) -> DataFrame:
    """MASTER rows of a stream of UPDATE rows: of each master that a batch changes, as it is then. Output mode is update.

    A sub-task's status is that of its greatest seq, its group that of its greatest seq that says something, in
    whatever order they come; a repeated row is harmless. Rows without a sub-task's or master's name or a seq are left out.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    named = updates.where("master_tid is not null and tid is not null and seq is not null")
    named = named.fillna({"status": 0, "analysis_status": 0})
    return named.groupBy("master_tid").transformWithState(RowMasters(), MASTER, "update", "none")
