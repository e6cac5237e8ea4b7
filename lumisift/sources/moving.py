"""Moving disqualified photos aside, by a plan whose targets are each claimed by one photo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.sources.listing import file_system
from lumisift.sources.tables import shuffle_partitions, written

OUTCOMES = "path string, target string, status string, error string, now boolean"


def move_aside(plan: DataFrame) -> DataFrame:
    """(path, target, status, error, now) for each row of plan_disqualify()'s plan, whose photos are moved by tasks.

    status is moved or failed. A target that is there is never written over: the move fails. Of a photo that is gone
    while its target is there an earlier attempt of the task, or an earlier run, has moved it: it counts as moved, and `now`
    says that this attempt did not do it. So a task that is run again, or a job, does no harm. The outcomes are written, so that
    reading them moves nothing.
    """

    def moved(frames):
        from pyarrow import fs

        for frame in frames:
            out = []
            for path, target, status, error in zip(frame["path"], frame["target"], frame["status"], frame["error"], strict=True):
                now = False
                if status == "moved":
                    try:
                        files, here = file_system(path)
                        _, there = file_system(target)
                        files.create_dir(there.rsplit("/", 1)[0])
                        source, goal = (files.get_file_info(p).type != fs.FileType.NotFound for p in (here, there))
                        if source and goal:
                            status, error = "failed", "target exists"
                        elif source:
                            files.move(here, there)
                            now = True
                        elif not goal:
                            status, error = "failed", "photo is gone"
                    except (OSError, ValueError) as e:
                        status, error = "failed", str(e)
                out.append((path, target, status, error, now))
            yield pd.DataFrame(out, columns=["path", "target", "status", "error", "now"])

    rows = plan.select("path", "target", "status", "error").repartition(shuffle_partitions(plan.sparkSession))
    return written(rows.mapInPandas(moved, OUTCOMES))


def left_after(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """results without the photos that have been moved."""
    return results.join(outcomes.filter(F.col("status") == "moved").select("path"), "path", "left_anti")
