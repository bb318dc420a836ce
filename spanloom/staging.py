"""Tables written once and read by several branches of a plan."""

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Unset, a local session gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spanloom-")
    return _own_folders[app]


def stage(df: DataFrame) -> DataFrame:
    """Write the rows as parquet and read them back: computed once, safe from lost executors, with fresh statistics.

    Runs a job. The files stay until the folder is cleared.
    """
    path = f"{staging_folder(df.sparkSession)}/spanloom-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compute_once(df: DataFrame, struct: Column) -> DataFrame:
    """Add the fields of a struct expression as columns.

    As a generated row it is evaluated once, where a plain column would be inlined into every filter and column
    that uses it.
    """
    return df.select("*", F.inline(F.array(struct)))
