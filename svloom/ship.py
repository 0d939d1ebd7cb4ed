"""Makes this package importable on the executors, and tables shared among them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a session; grouped functions import it there."""
    sc = spark.sparkContext
    if not getattr(sc, "_svloom_shipped", False):
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="svloom-")) / "svloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        sc.addPyFile(str(target))
        sc._svloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests on one machine) a temporary folder is set once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_svloom_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="svloom-")
        spark.sparkContext._svloom_dir = folder
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths that ``written`` made since ``settled`` began; None outside.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here."""
    spark = ship(df.sparkSession)
    path = f"{shared_dir(spark)}/svloom/{tag}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes folders of the shared storage, whichever file system it is; missing ones are passed over."""
    sc = spark.sparkContext
    for p in map(sc._jvm.org.apache.hadoop.fs.Path, paths):
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> tuple[DataFrame, str]:
    """What ``make`` returns as a written table, and its path; the tables that ``make`` wrote on the way are removed, also when it fails."""
    outer, kept = _made.get(), None
    token = _made.set(made := [])
    try:
        out = written(make(), tag)
        kept = made[-1]
    finally:
        _made.reset(token)
        removed(spark, [p for p in made if p != kept])
    if outer is not None:
        outer.append(kept)
    return out, kept
