"""Operational tables: batch runs and ingestion jobs as folds of their events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DONE = ["succeeded", "failed"]
#: Moves that a state machine allows: fixed values.
MOVES = [("", "pending"), ("pending", "running"), ("running", "succeeded"), ("running", "failed"), ("running", "interrupted"), ("failed", "pending"), ("interrupted", "pending")]


def run_listing(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts of each run's questions by status; runs without questions have zeros."""
    count = lambda s: F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(f"n_{s}")
    return runs.join(questions, "run_id", "left").groupBy("run_id").agg(F.count("status").alias("n_questions"), *map(count, ("pending", "running", *DONE)))


def finalizable(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Runs without a question that is pending or running."""
    return runs.join(questions.where(F.col("status").isin("pending", "running")).select("run_id"), "run_id", "left_anti")


def current_attempt(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    return jobs.join(attempts, (jobs["job_id"] == attempts["job_id"]) & (jobs["attempt_count"] == attempts["attempt_no"])).drop(attempts["job_id"])


def recovery_actions(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a restart does with each job that isn't done: by its attempt's commit state."""
    a = attempts.select(F.col("job_id").alias("a_job"), "attempt_no", "commit_state")
    rows = jobs.where(~F.col("status").isin(*DONE)).join(a, (F.col("job_id") == F.col("a_job")) & (F.col("attempt_count") == F.col("attempt_no")), "left")
    act = F.when(F.col("commit_state") == "committed", "mark_succeeded").when(F.col("commit_state") == "prepared", "roll_back").when(F.col("attempt_no").isNull(), "requeue").otherwise("interrupt")
    return rows.select("job_id", act.alias("action"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")


def recent(events: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The latest n events, oldest first."""
    return events.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def violations(events: DataFrame, key: str, order: list[str], moves: list[tuple[str, str]] = MOVES) -> DataFrame:
    """Events (key, status) that no allowed move leads to from the one before."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    allowed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves]
    return events.withColumn("before", before).where(~F.array_contains(F.array(*allowed), F.struct(F.col("before").alias("a"), F.col("status").alias("b"))))


def numbered(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


#: What a full log may give up, and what a progress event becomes there: fixed values.
PROGRESS, COMPACTED, LOG_CAP = ["item_running", "item_completed"], "progress_compacted", 2000


def compacted(events: DataFrame, key: list[str], order: list[str], cap: int = LOG_CAP, progress: list[str] = PROGRESS) -> DataFrame:
    """A bounded log: (key, sequence, order columns, event_type, merged, latest_type) of events (key, order, event_type).
    In a log of cap events a progress event joins the compacted one, or makes the last progress event one; any other
    takes the place of the oldest of these, and is left out if there is none. Each step depends on
    the log before, so a key's events pass in order through one task, which holds its log of cap rows only."""
    columns = [*key, *order]
    rows = events.select(*columns, "event_type").repartition(*key).sortWithinPartitions(*columns)
    fields = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*columns, "sequence", "event_type", "merged", "latest_type"]
        held, log, waiting, mark = None, {}, deque(), None

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*row[0], n, *row[1:]) for n, row in log.items()], columns=names)

        for batch in batches:
            for row in batch.itertuples(index=False):
                own = tuple(None if x != x else x for x in tuple(row)[: len(key)])
                if own != held:
                    if log:
                        yield out()
                    held, log, waiting, mark = own, {}, deque(), None
                at, kind = tuple(row)[:-1], row.event_type
                fits = kind in progress
                if len(log) >= cap:
                    if fits and (mark is not None or waiting):
                        if mark is None:
                            mark = waiting.pop()
                        log[mark] = (log[mark][0], COMPACTED, log[mark][2] + 1, kind)
                        continue
                    oldest = min((n for n in (waiting[0] if waiting else None, mark) if n is not None), default=None)
                    if oldest is None:
                        continue
                    if oldest == mark:
                        mark = None
                    else:
                        waiting.popleft()
                    del log[oldest]
                n = max(next(reversed(log), 0), 0) + 1
                log[n] = (at, kind, 1, kind)
                if fits:
                    waiting.append(n)
        if log:
            yield out()

    return rows.mapInPandas(run, f"{fields}, sequence long, event_type string, merged long, latest_type string")
