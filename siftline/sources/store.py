"""A versioned table store over plain Parquet: snapshots for readers, one writer at a time, guarded commits.

A table is a folder of numbered version folders and a pointer file that names
the current one.  A commit reads the current version under the lock, writes a
new version beside it and then moves the pointer with an atomic rename; readers
take the pointer once and are never blocked.  The driver alone handles lock and
pointer, so the root must be a path that the driver can open (a mounted shared
folder on a cluster).
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import shutil
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.maintain import guarded_upsert

POLL_S, WAIT_S = 0.05, 30.0
WAIT_VARIABLE = "SIFTLINE_LOCK_WAIT"


class LockTimeout(TimeoutError):
    """The lock stayed with another writer for the whole wait."""


def effective_wait(wait: float | str | None = None) -> float:
    """Argument, else environment, else 30 s; what is no number or below zero is refused."""
    found = wait if wait is not None else os.environ.get(WAIT_VARIABLE, WAIT_S)
    try:
        seconds = float(found)
    except (TypeError, ValueError):
        raise ValueError(f"a lock wait is a number of seconds, not {found!r}") from None
    if not seconds >= 0:
        raise ValueError("a lock wait is not below zero")
    return seconds


@contextlib.contextmanager
def locked(path: str | Path, wait: float | str | None = None) -> Iterator[None]:
    """Exclusive advisory lock beside `path`; its file stays, so that no two writers hold different files."""
    until = time.monotonic() + effective_wait(wait)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "a") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= until:
                    raise LockTimeout(str(path)) from None
                time.sleep(POLL_S)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def write_atomically(path: str | Path, text: str) -> None:
    """A whole new file or the old one, never a part; the mode of an old file is kept."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}.{time.monotonic_ns()}")
    try:
        with beside.open("w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if path.exists():
            os.chmod(beside, path.stat().st_mode & 0o7777)
        os.replace(beside, path)
    finally:
        beside.unlink(missing_ok=True)


class TableStore:
    """One versioned table; `root` is created by the first commit."""

    def __init__(self, spark: SparkSession, root: str | Path, keep: int = 3):
        self.spark, self.root, self.keep = spark, Path(root), keep

    @property
    def version(self) -> int | None:
        """Number of the current version, None before the first commit; a damaged pointer is an error, never an empty table."""
        pointer = self.root / "current"
        if not pointer.exists():
            return None
        text = pointer.read_text()
        if not re.fullmatch(r"\d+\n?", text):
            raise ValueError(f"{pointer} names no version")
        return int(text)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The current or a given version; None before the first commit."""
        version = self.version if version is None else version
        return None if version is None else self.spark.read.parquet(str(self.root / f"v{version}"))

    def commit(self, change: Callable[[DataFrame | None], DataFrame | None], wait: float | None = None) -> int | None:
        """Writes what `change` makes of the version current under the lock; None means no change and writes nothing."""
        with locked(self.root / "table", wait):
            now = self.version
            new = change(self.read(now))
            if new is None:
                return now
            n = (now or 0) + 1
            shutil.rmtree(self.root / f"v{n}", ignore_errors=True)  # left over from a writer that died before its pointer
            new.write.parquet(str(self.root / f"v{n}"))
            write_atomically(self.root / "current", f"{n}\n")
            for old in range(max(1, n - 2 * self.keep), n - self.keep + 1):
                shutil.rmtree(self.root / f"v{old}", ignore_errors=True)
            return n

    def upsert(self, work: DataFrame, key: str, protected: str, gone: DataFrame | None = None, wait: float | None = None) -> dict[str, int]:
        """Guarded upsert of a working set, and removal of the `gone` keys, in one commit; rows protected on disk win.

        Both meet the version that is current under the lock: rows that another
        writer has committed since the working set was made stay.  Gives the
        counts of the commit.
        """
        report: dict[str, int] = {}
        held: list[DataFrame] = []

        def change(disk: DataFrame | None) -> DataFrame | None:
            base = work.limit(0) if disk is None else disk
            merged = guarded_upsert(base, work.select(*base.columns), key, protected)
            if gone is not None:
                out = gone.select(key, F.lit(True).alias("__gone")).distinct()
                left = F.coalesce("__gone", F.lit(False)) & (F.col("outcome") == "untouched") & ~F.coalesce(protected, F.lit(False))
                merged = merged.join(out, key, "left").withColumn("outcome", F.when(left, "removed").otherwise(F.col("outcome"))).drop("__gone")
            held.append(merged.cache())
            counts = {r[0]: r[1] for r in merged.groupBy("outcome").count().collect()}  # five outcomes
            removed = counts.pop("removed", 0)
            report.update(written=counts.get("inserted", 0) + counts.get("updated", 0), skipped_protected=counts.get("skipped_protected", 0), total_records=sum(counts.values()), **({} if gone is None else {"removed": removed}))
            return merged.where(F.col("outcome") != "removed").drop("outcome") if report["written"] or removed else None

        try:
            self.commit(change, wait)
        finally:
            for df in held:
                df.unpersist()
        return report


STAGE = re.compile(r"^[a-z0-9][a-z0-9_-]*$")


class RunState:
    """Resumable stages of one day's run: a manifest and one Parquet folder per finished stage."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)

    def _manifest(self) -> dict | None:
        try:
            found = json.loads((self.root / "manifest.json").read_text())
        except (OSError, ValueError):
            return None
        ok = isinstance(found, dict) and found.get("schema_version") == 1 and isinstance(found.get("completed"), list)
        return found if ok else None

    def _write(self, run_date: str, completed: list[str]) -> None:
        write_atomically(self.root / "manifest.json", json.dumps({"schema_version": 1, "run_date": run_date, "completed": completed}))

    def begin(self, run_date: str) -> list[str]:
        """Stages to resume after, none for a new day or a manifest that can't be trusted."""
        found = self._manifest()
        if found and found["run_date"] == run_date:
            return [s for s in found["completed"] if isinstance(s, str) and STAGE.match(s)]
        shutil.rmtree(self.root, ignore_errors=True)
        self._write(run_date, [])
        return []

    def save(self, stage: str, df: DataFrame, run_date: str = "") -> None:
        """A stage's rows; listed as completed once."""
        if not STAGE.match(stage):
            raise ValueError(f"{stage!r} is no stage name")
        found = self._manifest() or {"run_date": run_date, "completed": []}
        df.write.mode("overwrite").parquet(str(self.root / stage))
        done = [s for s in found["completed"] if isinstance(s, str)]
        self._write(found["run_date"], done if stage in done else [*done, stage])

    def load(self, stage: str) -> DataFrame:
        found = self._manifest()
        if not found or stage not in found["completed"]:
            raise LookupError(f"stage {stage!r} is not completed")
        return self.spark.read.parquet(str(self.root / stage))

    def invalidate(self, *stages: str) -> list[str]:
        """Drops the earliest named stage and everything after it; gives what is left."""
        found = self._manifest()
        if not found:
            return []
        done = [s for s in found["completed"] if isinstance(s, str)]
        cut = min((done.index(s) for s in stages if s in done), default=len(done))
        self._write(found["run_date"], done[:cut])
        for s in done[cut:]:
            if STAGE.match(s):
                shutil.rmtree(self.root / s, ignore_errors=True)
        return done[:cut]

    def done(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)


def cut_at(stages: DataFrame, named: list[str]) -> DataFrame:
    """(run, pos, stage) rows before the earliest named stage of their run; all rows of a run that has none."""
    first = stages.where(F.col("stage").isin(named)).groupBy("run").agg(F.min("pos").alias("__cut"))
    return stages.join(first, "run", "left").where(F.col("__cut").isNull() | (F.col("pos") < F.col("__cut"))).drop("__cut")
