"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


@atexit.register
def _remove_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def build_session(app: str = "verdigrade", master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew splitting on and time in UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session once, so that it needn't be installed or on their path."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_verdigrade_shipped", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="verdigrade-")
    _OWN.append(folder)
    archive = f"{folder}/verdigrade.zip"  # served from here by the driver to all executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(archive)
    context._verdigrade_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made, but only in local mode: on a cluster no
    folder of one machine would do, so the missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    made = tempfile.mkdtemp(prefix="verdigrade-")
    _OWN.append(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def own_folder(spark: SparkSession) -> str:
    """This application's folder within the shared one."""
    return f"{shared_dir(spark)}/verdigrade/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has materialized; results that still read it must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step", partitions: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a cut of lineage that outlives executors.

    Unlike a cache the rows are on shared storage, so the loss of any executor costs no recomputation;
    unlike checkpoint() the files are columnar, so later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
