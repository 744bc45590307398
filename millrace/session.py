"""Sessions, durable lineage cuts and column classes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def session(name: str = "millrace", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, which removes checkpoints that nothing refers to; conf adds or overrides settings."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may have none: it gets a
    temporary one, which is removed at its end; a cluster without one is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="shared-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def store(uri: str) -> tuple[FileSystem, str]:
    """The file system, for tasks, of a path as Spark writes it (file:/a, hdfs://..., s3://..., or plain), and the path in it."""
    return FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, so that a lost executor costs no recomputation and several readers see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def column_classes(df: DataFrame) -> dict[str, str]:
    """datetime, boolean, numeric or else categorical for every column, tested in this order."""
    kind = lambda t: "datetime" if isinstance(t, DATETIME) else "boolean" if isinstance(t, T.BooleanType) else "numeric" if isinstance(t, NUMERIC) else "categorical"
    return {f.name: kind(f.dataType) for f in df.schema}


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [c for c, k in column_classes(df).items() if k == kind]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value: null from here on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
