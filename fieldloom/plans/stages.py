"""Stages over named tables: order, what depends on what, fingerprints, caching, invalidation.

A stage is a function from tables to tables. Its results are Parquet folders under the run's folder, each with a
manifest row; all paths go through Spark's file systems, so the folder may be on any of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """make: (inputs by name, parameters) to a table. version changes with the code."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[dict[str, DataFrame], dict], DataFrame]
    version: int = 1
    defaults: dict = field(default_factory=dict, hash=False)


def digest(value) -> str:
    """SHA-256 of the value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


class Plan:
    """Registered stages and the tables they come from."""

    def __init__(self, stages: list[Stage]):
        self.stages = {s.name: s for s in stages}
        self.order = self._ordered()

    def _ordered(self) -> list[str]:
        out: list[str] = []
        rest = list(self.stages.values())
        while rest:
            ready = [s for s in rest if all(n not in self.stages or n in out for n in s.needs)]
            if not ready:
                raise ValueError(f"stages depend on each other: {sorted(s.name for s in rest)}")
            out += [s.name for s in ready]
            rest = [s for s in rest if s.name not in out]
        return out

    def edges(self) -> list[tuple[str, str]]:
        return [(n, s.name) for s in self.stages.values() for n in s.needs]

    def downstream(self, name: str) -> list[str]:
        """All stages that use the stage's result, at any remove, in order."""
        found = {name}
        for s in self.order:
            if found & set(self.stages[s].needs):
                found.add(s)
        return [s for s in self.order if s in found and s != name]

    def prerequisites(self, name: str) -> list[str]:
        found = {name}
        for s in reversed(self.order):
            if s in found:
                found |= set(self.stages[s].needs)
        return [s for s in self.order if s in found and s != name]


class Run:
    """Runs a plan into a folder. A stage is skipped while its version, parameters, inputs and output are what the manifest says."""

    def __init__(self, spark: SparkSession, plan: Plan, folder: str, sources: dict[str, DataFrame]):
        self.spark, self.plan, self.folder, self.sources = spark, plan, folder.rstrip("/"), sources
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self, name: str) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}.manifest", wholetext=True).first()[0]) if self._fs.exists(self._path(f"{name}.manifest")) else None

    def _source_digest(self, name: str) -> str:
        files = self.sources[name].inputFiles()
        stat = lambda f: self._fs_of(f).getFileStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f))
        return digest(sorted([f, s.getLen(), s.getModificationTime()] for f in files for s in [stat(f)]) or self.sources[name].schema.json())

    def _fs_of(self, file: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(file).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def fingerprint(self, name: str, params: dict) -> dict:
        s = self.plan.stages[name]
        inputs = {n: (self.manifest(n) or {}).get("output") if n in self.plan.stages else self._source_digest(n) for n in s.needs}
        return {"version": s.version, "params": digest(s.defaults | params), "inputs": digest(inputs)}

    def fresh(self, name: str, params: dict | None = None) -> bool:
        m = self.manifest(name)
        return bool(m) and self._fs.exists(self._path(f"{name}/_SUCCESS")) and {k: m[k] for k in ("version", "params", "inputs")} == self.fingerprint(name, params or {})

    def stage(self, name: str, params: dict | None = None) -> str:
        """cached or made. The result is written aside, the old one is moved aside and the new one into place; only then the old one goes.

        Should the move fail, the old result is put back; a crash in between leaves it under its other name, where `restored` finds it."""
        params = params or {}
        if self.fresh(name, params):
            return "cached"
        s, mark = self.plan.stages[name], self.fingerprint(name, params)
        made = s.make({n: self.table(n) for n in s.needs}, s.defaults | params)
        made.write.mode("overwrite").parquet(f"{self.folder}/{name}.pending")
        self.restored(name)
        had = self._fs.exists(self._path(name))
        if had and not self._fs.rename(self._path(name), self._path(f"{name}.old")):
            raise OSError(f"{name} could not be moved aside")
        if not self._fs.rename(self._path(f"{name}.pending"), self._path(name)):
            if had:
                self._fs.rename(self._path(f"{name}.old"), self._path(name))
            raise OSError(f"{name} could not be published")
        self._fs.delete(self._path(f"{name}.manifest"), True)
        self._fs.delete(self._path(f"{name}.old"), True)
        for d in self.plan.downstream(name):
            self._fs.delete(self._path(f"{d}.manifest"), True)
        out = self._fs.create(self._path(f"{name}.manifest"), True)
        out.write(bytearray(json.dumps(mark | {"output": digest([mark, name])}).encode()))
        out.close()
        return "made"

    def restored(self, name: str) -> None:
        """Puts back a result that a crash left moved aside; where a new one is in place, what was moved aside goes."""
        old, now = self._path(f"{name}.old"), self._path(name)
        if self._fs.exists(old):
            self._fs.delete(old, True) if self._fs.exists(now) else self._fs.rename(old, now)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}") if name in self.plan.stages else self.sources[name]

    def all(self, params: dict[str, dict] | None = None, skip: set[str] = frozenset()) -> dict[str, str]:
        """What became of each stage, in order."""
        return {n: "skipped" if n in skip else self.stage(n, (params or {}).get(n)) for n in self.plan.order}

    def state(self) -> str | None:
        """The last stage, in order, whose result is there."""
        return next((n for n in reversed(self.plan.order) if self.manifest(n)), None)


def lineage(edges: DataFrame) -> DataFrame:
    """All pairs (stage, uses_it) of a graph of edges (src, dst), at any remove."""
    return edges.sparkSession.sql("""WITH RECURSIVE reach(stage, uses_it) AS (SELECT src, dst FROM {edges} UNION ALL
        SELECT reach.stage, e.dst FROM reach JOIN {edges} e ON reach.uses_it = e.src) SELECT DISTINCT * FROM reach""", edges=edges.select("src", "dst"))


def stage_status(runs: DataFrame) -> DataFrame:
    """status of each run: what runs, waits or failed says so; a stale one is stale; success without an output is nothing."""
    s = F.col("status")
    return runs.withColumn("shown", F.when(s.isin("running", "queued", "failed"), s).when(F.col("stale"), "stale").when((s == "succeeded") & ~F.col("has_output"), F.lit(None).cast("string")).otherwise(s))


def latest_runs(runs: DataFrame, requests: DataFrame, by: list[str]) -> DataFrame:
    """The newest run of each stage with its request, which may be missing."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(requests, "job_id", "left")


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was running or queued has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "queued"), "failed").otherwise(F.col("status")))
