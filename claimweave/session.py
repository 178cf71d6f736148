"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folders of the cuts that are still there, by session folder.
_LIVE: dict[str, list[str]] = {}


def build_session(app: str = "claimweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` keys use `__` for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the directory `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(master: str) -> str:
    """A folder of this machine, for a master that runs everything on it."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share: a folder of this machine is no use to those of {master}")
    return "file://" + tempfile.mkdtemp(prefix="claimweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset a local master gets
    a temporary folder; any other master raises."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = _own_folder(spark.sparkContext.master)
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it again, so that a lost executor
    costs no recomputation and later plans start from a columnar table of known size.

    The table stays until `drop_cuts` names it, or until the `scratch` it was made in is left."""
    base = shared_folder(df.sparkSession)
    path = f"{base}/claimweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LIVE.setdefault(base, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cuts(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind frames made by `cut` that no later plan reads."""
    live = _LIVE.get(shared_folder(spark), [])
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/claimweave/" in folder:
                _delete(spark, folder)
                name = folder.rsplit("/", 1)[1]
                live[:] = [p for p in live if not p.endswith(name)]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All cuts made inside are deleted on leaving, so write the result inside:

        with scratch(spark):
            fill_claims(claims).write.parquet(target)
    """
    live = _LIVE.setdefault(shared_folder(spark), [])
    before = len(live)
    try:
        yield
    finally:
        for path in live[before:]:
            _delete(spark, path)
        del live[before:]
