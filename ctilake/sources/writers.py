"""Sinks: line-delimited JSON, CSV, partitioned tables, result logs and manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ctilake.sources.tables import cut


def jsonl(df: DataFrame, path: str, gzip: bool = False) -> int:
    """Write one JSON object a line, nulls included, and return the number of rows, counted while writing."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").option("ignoreNullFields", False)
    (out.option("compression", "gzip") if gzip else out).json(path)
    return seen.get["n"]


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header in the declared order; missing columns and nulls are empty."""
    columns = columns or df.columns
    have = set(df.columns)
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns]).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder for every value of ``key``, each written by the tasks that hold its rows."""
    df.write.mode("errorifexists").partitionBy(key).parquet(path)


def append_results(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys the result log does not hold yet, and return those rows: a restart skips what is done."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df = cut(df)  # not a cache: writing to the path would make it read the log again
    df.write.mode("append").parquet(path)
    return df


def manifest(df: DataFrame, source: str, extra: dict | None = None) -> str:
    """JSON of row counts by source, with a digest of all rows that does not depend on their order."""
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}  # a dimension
    digest = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    return json.dumps({"rows": sum(counts.values()), "by_source": dict(sorted((str(k), v) for k, v in counts.items())), "digest": str(digest)} | (extra or {}), sort_keys=True)


def file_digests(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small result table as Markdown."""
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows]])


def replace(df: DataFrame, path: str) -> None:
    """Rewrite ``path``: the new table is whole in a folder beside it before the old one gives way, also when ``df`` reads it."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    system = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(jpath(path)) and not system.rename(jpath(path), jpath(old)):
        raise OSError(f"cannot move {path}")
    if not system.rename(jpath(new), jpath(path)):
        raise OSError(f"cannot move {new}")
    system.delete(jpath(old), True)


def digested_jsonl(df: DataFrame, path: str) -> tuple[int, DataFrame]:
    """Gzipped JSON lines with the number of rows and the SHA-256 of every file written."""
    return jsonl(df, path, gzip=True), file_digests(df.sparkSession, path).filter(F.col("path").endswith(".gz"))


def grouped_summary(rows: list[dict], category: str, name: str, value: str, order: list[str], latex: bool = False) -> str:
    """A text or LaTeX table of a small result, grouped by category in the given order, with a total for each."""
    places = {c: i for i, c in enumerate(order)}
    out = []
    for c in sorted({r[category] for r in rows}, key=lambda c: (places.get(c, len(order)), str(c))):
        mine = sorted((r for r in rows if r[category] == c), key=lambda r: (-r[value], str(r[name])))
        if latex:
            out += [rf"\\multicolumn{{2}}{{l}}{{\\textbf{{{c}}}}} \\\\", *[f"{r[name]} & {r[value]:,} \\\\" for r in mine], rf"\\midrule Total & {sum(r[value] for r in mine):,} \\\\"]
        else:
            out += [str(c), *[f"  {r[name]:<40}{r[value]:>14,}" for r in mine], f"  {'total':<40}{sum(r[value] for r in mine):>14,}"]
    return "\n".join(out)


def per_query(df: DataFrame, path: str, run: str) -> None:
    """Ranks of one run, one row a query, under a folder of its own beside those of other runs."""
    df.withColumn("run", F.lit(run)).write.mode("errorifexists").partitionBy("run").parquet(f"{path.rstrip('/')}/{run}")
