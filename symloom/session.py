"""Session helpers: reading tables, the shared scratch folder, cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none (tests in local mode) an own temporary folder is used.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="symloom-")
    return f"file://{_own_dir}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back, so that its lineage ends there.

    The table survives the loss of executors. `drop` is an earlier result of cut() that is no longer needed;
    its files are deleted once the new table is written. What is left is deleted when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symloom/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._symloom_path = path
    if drop is not None:
        discard(drop)
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Results of cut() of one schema as a single scan, however many they are."""
    first = tables[0]
    if len(tables) == 1:
        return first
    return first.sparkSession.read.schema(first.schema).parquet(*[t._symloom_path for t in tables])


class scratch:
    """`with scratch():` deletes, at its end, all tables that cut() wrote inside; results that are still wanted are to be read or written before."""

    def __enter__(self) -> scratch:
        self.before = len(_written)
        return self

    def __exit__(self, *_: object) -> None:
        for spark, path in _written[self.before :]:
            _delete(spark, path)
        del _written[self.before :]


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of cut()."""
    path = getattr(df, "_symloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
