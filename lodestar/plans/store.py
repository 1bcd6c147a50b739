"""Tables that a plan writes once and reads several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As stored(), in compressed columns: for large tables of which a plan reads few columns or rows."""
    folder = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def stamp(df: DataFrame) -> str | None:
    """What tells two versions of a table of files apart: its plan and its files' sizes and times; None for other tables."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    parts = [df.sparkSession.sparkContext.applicationId, str(df.semanticHash())]
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        parts.append(f"{f}:{status.getLen()}:{status.getModificationTime()}")
    return "|".join(parts)
