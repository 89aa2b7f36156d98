"""Cutting lineage with tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    A folder of our own, deleted at exit, is used only where the setting is
    absent and all tasks run in the driver's process (tests, local runs); on a
    cluster its absence is an error, as executors share no local folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="recollex-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back, so later stages never recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(df: DataFrame, key: str, judge: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """What ``judge`` makes of tables that hold all rows of many keys, rows of a key together; for groups that are many and small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_rows is None else pa.concat_tables([open_rows, table])
            keys = table.column(key)
            last = keys[len(keys) - 1].as_py() if len(keys) else None
            at = len(keys)
            while at and keys[at - 1].as_py() == last:
                at -= 1
            if at:
                yield from judge(table.slice(0, at).combine_chunks()).to_batches()
            open_rows = table.slice(at)
        if open_rows is not None and len(open_rows):
            yield from judge(open_rows.combine_chunks()).to_batches()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
