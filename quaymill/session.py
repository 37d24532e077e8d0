"""Session, shared folder and the two plan helpers that every operator uses.

``cut`` writes a step as a table in the cluster's shared folder, so that a lost
executor costs a re-read and never a recomputation of the whole lineage.
``attach`` broadcasts a side only after its rows were counted.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast. Callers project to a few narrow columns first, so this is some 10 MB.
BROADCAST_ROWS = 100_000


def get_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides any of them."""
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(master).appName("quaymill").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one of a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quaymill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


#: Tables that ``cut`` has written since the last mark, in order.
_written: list[str] = []


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quaymill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Deletes, on any file system, the tables that ``cut`` writes inside the block: read or write a query's result before the block ends."""
    mark = len(_written)
    try:
        yield
    finally:
        mine = _written[mark:]
        del _written[mark:]
        _delete(spark, mine)


def release(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` has written in this folder. Call it when no result of a query is still to be read; the end of the session does it for local and mounted folders."""
    _written.clear()
    _delete(spark, [f"{shared_dir(spark)}/quaymill"])


def attach(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows; beyond that the join
    shuffles, and adaptive execution splits its skewed partitions."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= limit else small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
