"""Table access and session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    with tempfile.NamedTemporaryFile(prefix="ctilake-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((root / "ctilake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f.name)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure a checkpoint directory is set and return it.

    The folder named by ``spark.checkpoint.dir`` is used. Only a local session (tests)
    falls back to a folder of its own; a cluster without the setting is an error, as a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ctilake-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


MOST_BYTES = 64 << 20  # of a side that is broadcast


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only when ``df`` has at most ``max_rows`` rows of at most MOST_BYTES together.

    The size is checked by reading no more than ``max_rows + 1`` rows; texts count with their length,
    any other column with eight bytes. A larger side keeps whatever join the planner picks for it.
    """
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    other = [F.coalesce(F.size(f"`{f.name}`") * 16, F.lit(0)) for f in df.schema.fields if f.dataType.simpleString().startswith("array")]
    size = sum([*texts, *other], F.lit(8 * len(df.columns)))
    n, total = df.limit(max_rows + 1).select(size.cast("bigint").alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= MOST_BYTES else df


def collected_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` computed once and hinted for broadcast when it has at most ``max_rows`` rows, else ``df`` itself."""
    rows = df.limit(max_rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= max_rows else df
