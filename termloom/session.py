"""Session settings and materialisation.

The library never assumes it owns the session: ``local_session`` is for tests and the
bench, everything else works with whatever session it is handed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("termloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites of columns are looked up for error texts; plans are built faster without
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="termloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where a later step must see exactly the rows an earlier step saw, and to keep a table
    from being computed again. Cuts the lineage like ``DataFrame.checkpoint``, survives the
    loss of executors, and is read back by column, with a size Spark knows when it chooses a
    join.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table a job writes and reads back. It belongs to the innermost open scope."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].hold(path)
    return path


class Scope:
    """The tables of a job. A table may have several holders, and goes when the last one lets go of it."""

    holders: Counter[str] = Counter()

    def __init__(self, spark: SparkSession, outer: Scope | None):
        self.spark, self.outer, self.paths = spark, outer, set()

    def hold(self, path: str) -> None:
        if path not in self.paths:
            self.paths.add(path)
            Scope.holders[path] += 1

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` outlives this scope: its tables pass to the scope around it, or to nobody if there is none."""
        read = {self._top(f) for f in df.inputFiles()}
        for path in [p for p in self.paths if self._top(p) in read]:
            if self.outer is not None:
                self.outer.hold(path)
                self._drop(path)
            else:
                self.paths.discard(path)
                del Scope.holders[path]
        return df

    def release(self, df: DataFrame) -> None:
        """The tables of this scope that ``df`` reads are not needed any more, and go now."""
        read = {self._top(f) for f in df.inputFiles()}
        for path in [p for p in self.paths if self._top(p) in read]:
            self._drop(path)

    def _top(self, path: str) -> str:
        """The scratch table's own name in a path of one of its files."""
        root = re.sub(r"^\w+:/*", "/", checkpoint_dir(self.spark)).rstrip("/")
        return re.sub(r"^\w+:/*", "/", path).removeprefix(root).lstrip("/").partition("/")[0]

    def _drop(self, path: str) -> None:
        self.paths.discard(path)
        Scope.holders[path] -= 1
        if Scope.holders[path] <= 0:
            del Scope.holders[path]
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        for path in list(self.paths):
            self._drop(path)


_scopes: list[Scope] = []


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables written inside are removed at the end, also after an error.

    What is returned must be written or collected inside, or passed to ``keep``. Scopes may be nested: a table then
    goes with the innermost scope it was written in. Without any scope nothing is removed, as before.
    """
    scope = Scope(spark, _scopes[-1] if _scopes else None)
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        scope.close()


#: Whether Spark removes the shuffle files of a statement when it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written or collected inside go at once, not when the driver happens to clean up."""
    before = spark.conf.get(_SHUFFLES_GO)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
