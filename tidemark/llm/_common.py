"""What the operators of this subpackage share: inputs, the shared folder, shipped code."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own
    temporary one where neither it nor a checkpoint folder is set (tests, local runs)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
        root = f"file://{own}"
    return root.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: what this process has written; deleted when it ends, since lazy results may read it until then
_owned: list[tuple] = []


def _delete(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(p, True)


@atexit.register
def _clean() -> None:
    for sc, path in _owned:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(sc, path)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = path or fresh(df.sparkSession, tag)
    _owned.append((df.sparkSession.sparkContext, path))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``written`` wrote; only once nothing reads it any more."""
    _delete(df.sparkSession.sparkContext, df._tidemark_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what nothing refers to any more. It does so when
    the driver's JVM collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(os.path.join(top, "tidemark")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    sc.addPyFile(path)
    sc._tidemark_shipped = True
