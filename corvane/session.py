"""Session defaults and the two ways a long lineage is cut: checkpoint() or a written table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "corvane", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table whose size the optimizer knows, so that it is folded into plans and broadcast.

    Rows given to createDataFrame as they are become an RDD of unknown size, which is shuffled.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if the cluster names one.

    Only where that setting is absent on a local master (one-machine tests) a temporary folder is made and removed
    at exit; a cluster without it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir("file://" + made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as parquet in the shared folder and read it back.

    The result no longer depends on df's lineage, survives lost executors, and is columnar
    and compressed, so later stages read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The shuffle width of the session, at least `least`."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
