"""Session settings, the shared folder, and checked broadcasts."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast table may hold when its bound is checked at run time.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

# Folders made for local sessions that name none, by application.
_OWN_DIRS: dict[str, str] = {}

# Tables written within the ``scratch`` blocks that are open.
_SCRATCH: list[list[str]] = []

_SHIPPED: set[str] = set()

# Spark's setting by which a finished write drops its shuffle files.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings the plans are written for. Sizes are left to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "pairforge", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session's ``spark.checkpoint.dir`` names it.

    A folder of our own is made only when that setting is absent, and then only
    in local mode, where driver and executors share one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIRS:
        _OWN_DIRS[application] = tempfile.mkdtemp(prefix="pairforge-")
    return _OWN_DIRS[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return os.path.join(shared_dir(spark), "pairforge", f"{name}-{uuid.uuid4().hex}")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and freezes values that a
    re-run could change (row positions within a scan). Columnar, so later passes
    over a few narrow columns stay cheap. The table stays until its folder is removed,
    or until the end of the job when written within ``scratch``. What was shuffled for it is
    not needed once it is there, and goes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``durable`` wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        system, place = _file_system(df.sparkSession, os.path.dirname(files[0]))
        system.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store Spark writes to. Starts no job."""
    system, place = _file_system(spark, path)
    return system.exists(place)


MARKERS = ("_MANIFEST", "_SUCCESS")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written ``path`` to its end: a folder with a mark of that, or a file."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return False
    if system.getFileStatus(place).isFile():
        return True
    return any(exists(spark, f"{path.rstrip('/')}/{mark}") for mark in MARKERS)


def write_whole(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> bool:
    """Let ``write`` put ``df`` into a folder that shows under ``path`` only when it is whole.

    The folder is written beside ``path``, gets a manifest of its rows and files, and is
    renamed once. Rows are counted in the same pass. A finished output is left alone, and no job is
    started for it (False). What a killed job left is replaced: a staging folder is ours
    and deleted; an unfinished ``path`` is not, and is renamed.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    if finished(spark, path):
        return False
    staging = f"{path}.staging"
    system, place = _file_system(spark, staging)
    _, target = _file_system(spark, path)
    if system.exists(place):
        system.delete(place, True)
    counted = Observation()
    write(df.observe(counted, F.count(F.lit(1)).alias("rows")), staging)
    files, found = [], system.listFiles(place, True)
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString().partition(f"{place.getName()}/")[2]
        if not name.rpartition("/")[2].startswith(("_", ".")):
            files.append({"name": name, "bytes": status.getLen()})
    manifest = {"rows": counted.get["rows"], "files": sorted(files, key=lambda f: f["name"])}
    out = system.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "_MANIFEST"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if system.exists(target):
        aside = _file_system(spark, f"{path}.partial-{uuid.uuid4().hex}")[1]
        if not system.rename(target, aside):
            raise OSError(f"an unfinished {path} is in the way")
    if not system.rename(place, target):
        raise OSError(f"{staging} could not be renamed to {path}")
    return True


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The rows and files of a folder that ``write_whole`` wrote."""
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    system, place = _file_system(spark, f"{path.rstrip('/')}/_MANIFEST")
    stream = system.open(place)
    try:
        return json.loads(text(stream, "UTF-8"))
    finally:
        stream.close()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, through Spark."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="pairforge-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of a job, the tables that ``durable`` wrote within it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            system, place = _file_system(spark, path)
            system.delete(place, True)


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after counting rows and characters of a table against bounds."""
    size = F.lit(8 * len(df.columns)) + sum(
        (F.coalesce(F.length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"),
        F.lit(0),
    )
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Spread an input with fewer splits than there are cores.

    A large input has more splits than cores and is returned untouched, so this
    only ever shuffles inputs too small to fill the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
