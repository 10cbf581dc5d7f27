"""Ledgers of jobs and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States in which a job doesn't change any more.
TERMINAL = ("completed", "error", "terminated")


def by_state(jobs: DataFrame, *states: str) -> DataFrame:
    return jobs.where(F.col("state").isin(*states)).orderBy(F.desc("created_at"), "job_id")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("state").isin(*TERMINAL)).orderBy(F.desc("created_at"), "job_id")


def by_workspace(jobs: DataFrame, workspace: int) -> DataFrame:
    return jobs.where(F.col("workspace_id") == workspace).orderBy(F.desc("created_at"), "job_id")


def pipelines(table: DataFrame, status: str | None = None, project: str | None = None, since=None, limit: int | None = None) -> DataFrame:
    out = table
    if status is not None:
        out = out.where(F.col("status") == status)
    if project is not None:
        out = out.where(F.col("project") == project)
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    out = out.orderBy(F.desc("created_at"), "pipeline_id")
    return out.limit(limit) if limit is not None else out


def expired(jobs: DataFrame, now, ttl_seconds: int = 172_800) -> DataFrame:
    """Ids of terminal jobs that ended more than ttl_seconds before now."""
    cut = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return jobs.where(F.col("state").isin(*TERMINAL) & F.col("end_ts").isNotNull() & (F.col("end_ts") < cut)).select("job_id")


def swept(jobs: DataFrame, now, ttl_seconds: int = 172_800) -> DataFrame:
    return jobs.join(expired(jobs, now, ttl_seconds), "job_id", "left_anti")


def older(jobs: DataFrame, now, days: int = 30, terminal_only: bool = True) -> DataFrame:
    """Jobs not updated for `days`."""
    out = jobs.where(F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    return out.where(F.col("state").isin(*TERMINAL)) if terminal_only else out


def summary(jobs: DataFrame) -> DataFrame:
    """Jobs per state, and all of them as state null."""
    return jobs.rollup("state").agg(F.count("*").alias("n")).orderBy(F.col("state").asc_nulls_last())


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("updated_at"), "job_id").limit(limit)


def claim(jobs: DataFrame) -> DataFrame:
    """The job that has been queued longest."""
    return jobs.where("state = 'queued'").orderBy("submit_ts", "job_id").limit(1)


def advanced(pipelines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pipelines after a look at their current step's job: done steps lead to the next or to the end, failures to the end."""
    state = jobs.select("pipeline_id", F.col("step").alias("current_step"), "state")
    joined = pipelines.join(state, ["pipeline_id", "current_step"], "left")
    last = F.col("current_step") + 1 >= F.col("total_steps")
    done, failed = F.col("state") == "completed", F.col("state").isin("error", "terminated")
    return joined.select(
        "pipeline_id",
        F.when(done & ~last, F.col("current_step") + 1).otherwise(F.col("current_step")).alias("current_step"),
        F.when(done & last, "completed").when(failed, "failed").otherwise(F.col("status")).alias("status"),
        F.coalesce(done & ~last, F.lit(False)).alias("submit_next"),
    )


def accounting(batches: DataFrame) -> DataFrame:
    """Successful and failed batches and what went wrong."""
    return batches.agg(F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.array_sort(F.collect_set("error")).alias("errors"))
