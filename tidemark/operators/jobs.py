"""The queue of jobs: states, recovery and what is due.

A job has (job, kind, image, state, priority, created, not_before, attempts); states are waiting, running, finished and
failed. Functions give the table after the event; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.notices import MOST_ATTEMPTS, WAITS

#: Seconds to wait after each failed attempt; the last one repeats.
WAIT_SECONDS = tuple(w // 1_000_000 for w in WAITS)


def next_wake(jobs: DataFrame, now: int) -> DataFrame:
    """(at): the earliest time after now at which a waiting job may run; null if none waits for a time."""
    later = F.when((F.col("state") == "waiting") & (F.col("not_before") > now), F.col("not_before"))
    return jobs.agg(F.min(later).alias("at"))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a crash: what ran waits again, its attempts as they were."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "waiting").otherwise(F.col("state")))


def after_run(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """After running jobs reported (job, outcome, at).

    ``success`` finishes a job; ``transient`` counts an attempt and waits, or fails at the last one; ``permanent`` fails at
    once; ``unavailable`` (the server was down) waits without a time, its attempts as they were. Reports of jobs that
    do not run, and other outcomes, change nothing.
    """
    told = jobs.join(results.select("job", F.col("outcome").alias("_outcome"), F.col("at").alias("_at")), "job", "left")
    said = F.when(F.col("state") == "running", F.col("_outcome"))
    failed = F.col("attempts") + 1
    wait = F.element_at(F.array(*map(F.lit, WAIT_SECONDS)), F.least(failed, F.lit(len(WAIT_SECONDS))).cast("int"))
    over = (said == "permanent") | ((said == "transient") & (failed >= MOST_ATTEMPTS))
    state = F.when(said == "success", "finished").when(over, "failed").when(said.isin("transient", "unavailable"), "waiting").otherwise(F.col("state"))
    later = F.when((said == "transient") & ~over, F.col("_at") + wait).when(said == "unavailable", None).otherwise(F.col("not_before"))
    tried = F.when(said == "transient", failed).otherwise(F.col("attempts"))
    changed = {"state": state, "not_before": later, "attempts": tried}
    return told.select(*[changed[c].cast(jobs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def retried(jobs: DataFrame) -> DataFrame:
    """All failed jobs wait again from the start."""
    failed = F.col("state") == "failed"
    return (
        jobs.withColumn("attempts", F.when(failed, 0).otherwise(F.col("attempts")))
        .withColumn("not_before", F.when(~failed, F.col("not_before")))
        .withColumn("state", F.when(failed, "waiting").otherwise(F.col("state")))
    )


def cleared(jobs: DataFrame) -> DataFrame:
    return jobs.where("state <> 'finished'")


def pending(jobs: DataFrame, kinds: tuple[str, ...] = ("analyse", "force", "reread")) -> DataFrame:
    """(image): pictures with an analysis waiting or running."""
    return jobs.where(F.col("kind").isin(*kinds) & F.col("state").isin("waiting", "running")).select("image").distinct()


def backlog(images: DataFrame, analysed: DataFrame, jobs: DataFrame) -> DataFrame:
    """(image, captured): stored pictures neither analysed nor pending, the oldest first."""
    left = images.where("stored").join(analysed.select("image").distinct(), "image", "left_anti").join(pending(jobs), "image", "left_anti")
    return left.select("image", "captured").orderBy("captured", "image")


def to_reread(images: DataFrame, analysed: DataFrame, jobs: DataFrame, version: int) -> DataFrame:
    """(image, captured): stored pictures analysed by an older version and not pending, the newest first."""
    old = analysed.groupBy("image").agg(F.max("version").alias("v")).where(F.col("v") < version).select("image")
    left = images.where("stored").join(old, "image", "left_semi").join(pending(jobs), "image", "left_anti")
    return left.select("image", "captured").orderBy(F.col("captured").desc(), "image")


def trailing(changes: DataFrame, quiet: int, key: str = "key") -> DataFrame:
    """(key, at, changes): a run ``quiet`` after the last of changes that follow each other within ``quiet``.

    Gaps make the runs: each change knows the one before it, a running sum numbers the runs.
    """
    order = Window.partitionBy(key).orderBy("at")
    fresh = (F.col("at") - F.lag("at").over(order) > quiet).cast("int")
    runs = changes.withColumn("_run", F.sum(F.coalesce(fresh, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg((F.max("at") + quiet).alias("at"), F.count("*").alias("changes")).drop("_run")


def progress(counts: DataFrame, key: str = "key") -> DataFrame:
    """(key, at, waiting, running): what a reader of the queue is told: the first state, then each change once."""
    order = Window.partitionBy(key).orderBy("at")
    same = F.lag("waiting").over(order).eqNullSafe(F.col("waiting")) & F.lag("running").over(order).eqNullSafe(F.col("running")) & (F.row_number().over(order) > 1)
    return counts.withColumn("_same", same).where(~F.col("_same")).select(key, "at", "waiting", "running")


def answer_limit(lines: Column, thinking: Column, least: int = 3072, most: int = 16384, each: int = 20, thought: int = 4096) -> Column:
    """Tokens an answer may take: by the lines read, more if the model thinks."""
    return F.least(F.lit(most), F.greatest(F.lit(least), each * lines) + F.when(thinking, thought).otherwise(0))


def trial_jobs(trial: int, analysed: DataFrame, stored: DataFrame) -> DataFrame:
    """(trial, image, state): a new trial's pictures: all that were analysed, waiting, or skipped where the picture is gone."""
    there = stored.select("image", F.lit(True).alias("_there")).distinct()
    return analysed.select("image").distinct().join(there, "image", "left").select(F.lit(trial).alias("trial"), "image", F.when(F.col("_there"), "waiting").otherwise("skipped").alias("state"))


def trial_cancelled(rows: DataFrame) -> DataFrame:
    """A cancelled trial keeps what it has; what waited is skipped."""
    return rows.withColumn("state", F.when(F.col("state") == "waiting", "skipped").otherwise(F.col("state")))


def trial_marked(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Pictures get their (trial, image, result), but only those that waited."""
    told = rows.join(results, ["trial", "image"], "left")
    return told.withColumn("state", F.when(F.col("state") == "waiting", F.coalesce("result", "state")).otherwise(F.col("state"))).select(*rows.columns)


def out_of_date(analysed: DataFrame, model: str, versions: tuple[str, ...]) -> DataFrame:
    """(n): pictures read by another model or by prompts that are not among the current ones."""
    return analysed.agg(F.count(F.when(~F.col("model").eqNullSafe(F.lit(model)) | ~F.coalesce(F.col("prompt").isin(*versions), F.lit(False)), 1)).alias("n"))
