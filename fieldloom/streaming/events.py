"""Event streams: tail with a cursor, throttled progress, latest snapshots, log lines to progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Seconds and share between two emitted progress events.
EVERY_SECONDS, EVERY_SHARE = 0.1, 0.0025
PAGE = 200


def page(events: DataFrame, since: int, **equal: str) -> DataFrame:
    """Up to 200 events behind the cursor, in order of id; a negative cursor starts behind the newest."""
    start = events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if since < 0 else since
    for column, value in equal.items():
        events = events.where(F.col(column) == value)
    return events.where(F.col("id") > start).orderBy("id").limit(PAGE)


def tail(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, **equal: str):
    """Follows event files; the checkpoint is the cursor, so a restart goes on where it stopped. Ends when all files are read, unless started again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).json(folder)
    for column, value in equal.items():
        stream = stream.where(F.col(column) == value)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(events: DataFrame, by: list[str], ident: str = "id") -> DataFrame:
    """Per group the latest event and the latest with a number; batch or streaming (update mode)."""
    rows = [c for c in events.columns if c not in by]
    number = F.when(F.col("progress").isNotNull(), F.col(ident))
    return events.groupBy(*by).agg(F.max_by(F.struct(*rows), ident).alias("activity"), F.max_by("progress", number).alias("progress"))


def admitted(rows: list[tuple[float, float | None, str]], last: dict) -> list[tuple[float, float | None, str]]:
    """Which of (time, progress, kind) are emitted, given the state of what was; `last` is changed.

    The number, which any kind may have, must not leave 0 to 1 nor fall by more than 1e-9. Kinds other than progress always
    pass. Progress with a number passes when 0.1 s have gone by since the last such and 0.25 % since the last number emitted, or at 1; progress without
    one is activity and passes every 0.1 s."""
    out, never = [], float("-inf")
    for t, p, kind in rows:
        numeric = p is not None and p == p
        if numeric:
            if not 0 <= p <= 1 or p < last.get("seen", 0.0) - 1e-9:
                raise ValueError(f"progress {p} after {last.get('seen', 0.0)}")
            last["seen"] = p
        if kind == "progress":
            if not numeric and t - last.get("a", never) < EVERY_SECONDS:
                continue
            if numeric and p < 1 and (t - last.get("t", never) < EVERY_SECONDS or p - last.get("p", never) < EVERY_SHARE):
                continue
            last["t" if numeric else "a"] = t
        out.append((t, p, kind))
        if numeric:
            last["p"] = p
    return out


def throttled(stream: DataFrame) -> DataFrame:
    """job, t (seconds), progress, kind of the events that pass. The clock is the column t, so a replay gives the same."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = ("seen", "p", "t", "a")
        last = {k: v for k, v in zip(names, state.get, strict=True) if v is not None} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = admitted(list(rows[["t", "progress", "kind"]].itertuples(index=False, name=None)), last)
        state.update(tuple(last.get(k) for k in names))
        yield pd.DataFrame({"job": [key[0]] * len(out), "t": [r[0] for r in out], "progress": [r[1] for r in out], "kind": [r[2] for r in out]})

    return stream.select("job", "t", "progress", "kind").groupBy("job").applyInPandasWithState(step, "job string, t double, progress double, kind string", "seen double, p double, t double, a double", "append", GroupStateTimeout.NoTimeout)


def span(progress, start: float, stop: float):
    """A part's progress as that of the whole."""
    return start + (stop - start) * progress


def log_progress(lines: DataFrame, total: str = "total") -> DataFrame:
    """Log lines with the image they register and the share of all: value, image, done, share."""
    image = F.regexp_extract("value", r"(?i)registering image #(\d+)", 1)
    done = F.regexp_extract("value", r"\((\d+)\)", 1)
    hit = lines.where(F.col("value").rlike(r"(?i)registering image #\d+"))
    return hit.select("value", image.cast("int").alias("image"), F.nullif(done, F.lit("")).cast("int").alias("done"), total).withColumn("share", F.least(F.lit(1.0), F.col("done") / F.col(total)))


def console(events: DataFrame, levels: list[str], text: str) -> DataFrame:
    """Events of these levels whose message holds the text, in any case."""
    return events.where(F.col("level").isin(levels) & F.contains(F.lower("message"), F.lit(text.lower())))


def current_only(events: DataFrame, runs: DataFrame, stage: str = "stage", job: str = "job_id") -> DataFrame:
    """Events of the job that a stage is bound to now; those of earlier jobs are ignored."""
    return events.join(runs.select(stage, job).distinct(), [stage, job], "left_semi")
