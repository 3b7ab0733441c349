"""Spark session helpers: local session for tests/bench, checkpoint directory, size guards."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Above this many rows or bytes a "small" side (keyword list, centroid table, ...) is joined with a
# shuffle instead of being broadcast.  The guard is applied by `broadcast_if_small`.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loomtext") -> SparkSession:
    """Session used by tests and bench: AQE on, UI off, Arrow on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared `spark.checkpoint.dir`; only a local-mode session
    (tests, bench) without that setting gets a fresh scratch directory."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="loomtext-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """`cut_lineage` for a table that the next round of a loop is computed from: written as Parquet to the shared
    checkpoint folder and read back.  A checkpoint keeps the estimated size of its plan, and a join's estimate is the
    product of its sides, so over rounds of self joins the estimate becomes a number of millions of digits that fills
    the driver.  A table that is read has the size of its files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(field) -> "Column":
    """About the bytes of a value: long enough strings and arrays count by their length."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        return F.greatest(F.size(c), F.lit(0)) * (8 if isinstance(inner, T.NumericType) else 64) + 24
    return F.lit(8 if isinstance(kind, (T.NumericType, T.BooleanType)) else 64)


def _fits(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    from pyspark.sql import functions as F

    size = F.lit(0)
    for field in df.schema.fields:
        size = size + _width(field)
    n, width = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and width <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a check of rows and bytes; larger sides are left to AQE."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if _fits(df, max_rows, max_bytes) else df


def share_if_small(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 16 << 20):
    """The rows of a checkpointed table of flat columns and arrays of numbers as a broadcast variable
    {corpus: [row, ..]} for functions over Arrow batches, so that a join need not copy them into every row;
    None where the table is larger (check of rows and bytes), then it is to be joined."""
    if not _fits(df, max_rows, max_bytes):
        return None
    rows: dict = {}
    for r in df.collect():  # within the bound
        rows.setdefault(r["corpus"], []).append(r)
    return df.sparkSession.sparkContext.broadcast(rows)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application (once), so that Arrow functions can
    import it wherever the driver was started."""
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_loomtext_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="loomtext-ship-"), "loomtext.zip")  # read by the driver's file server only
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._loomtext_shipped = True
