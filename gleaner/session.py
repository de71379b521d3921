"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on.  Sizes are left to the cluster; AQE
# coalesces shuffle partitions upwards and splits skewed ones.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the expressions depend on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "gleaner", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediate tables.

    It lies below the folder named in ``spark.checkpoint.dir``, so that a lost
    executor loses no data, and is deleted when the application ends.  Where that
    is unset a single-process session (tests) gets a folder of its own; a cluster
    is refused, because its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_root()
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@functools.cache
def _own_root() -> str:
    root = tempfile.mkdtemp(prefix="gleaner-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``shared_folder`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def point_to(spark: SparkSession, pointer: str, target: str) -> None:
    """Make the small file ``pointer`` name ``target``, in one step for whoever reads it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path, draft = hadoop.Path(pointer), hadoop.Path(f"{pointer}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    stream = draft.getFileSystem(conf).create(draft, True)
    stream.write(bytearray(target.encode()))
    stream.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf).rename(draft, path, options)


def pointed_to(spark: SparkSession, pointer: str) -> str | None:
    """What a pointer names; nothing if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(pointer, wholetext=True).first()[0]


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where several later steps need the same costly result: it is computed
    once, its lineage ends here, and it survives the loss of executors.
    """
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
