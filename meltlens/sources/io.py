"""Sources and sinks (S1-S18): directories of Parquet / CSV / JSON.

Scratch output always goes under the session's shared checkpoint directory
(``spark.checkpoint.dir``), never a machine-local temporary folder.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import config
from ..session import ensure_checkpoint_dir

NULL_MARKER = "\\N"  # explicit NULL marker so empty strings survive a CSV round trip
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "meltlens-io", f"{name}-{uuid.uuid4().hex[:12]}")


def read_all_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Raw log scan, every field a string (no inference)."""
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("nullValue", NULL_MARKER))
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType(), True) for c in columns]))
    return reader.csv(path)


def read_typed(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Typed scan with a frozen schema."""
    return spark.read.schema(schema).format(fmt).option("header", True).load(path)


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """S3: format chosen by the file suffix."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = FORMATS.get(ext, "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_available(spark: SparkSession, candidates: Sequence[str], require: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """First existing source (optionally holding ``require`` columns and
    at least one row -- a bounded ``limit(1)`` probe)."""
    for path in candidates:
        if not path_exists(spark, path):
            continue
        df = read_by_extension(spark, path)
        if not set(require) <= set(df.columns):
            continue
        if require and df.limit(1).count() == 0:
            continue
        return df, path
    raise FileNotFoundError("no usable source among candidates")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Sink (one directory per table)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "parquet":
        w = w.option("compression", "zstd")  # report texts take less than half of what the default leaves
    if fmt == "csv":  # keep raw strings byte-exact (padding, empty vs NULL)
        w = (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False).option("nullValue", NULL_MARKER))
    w.save(path)
    return path


def store_rows(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as compressed columns and read again, and where: a checkpoint's rows take
    several times the disk."""
    path = scratch_path(df.sparkSession, name)
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.option("compression", "zstd").parquet(path)  # any header will do
    return df.sparkSession.read.parquet(path).toDF(*df.columns), path


def remove_rows(spark: SparkSession, path: str) -> None:
    """Delete what :func:`store_rows` wrote, once no frame reads it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def export_capped(df: DataFrame, order: Sequence[str], n: int, path: str, fmt: str = "csv") -> str:
    """First ``n`` rows by a total order (the cap is the feature)."""
    return write_table(df.orderBy(*order).limit(n), path, fmt)


COMMITS = "version string, name string, committed_at long"


def new_version(base: str) -> str:
    """A folder below ``base`` that no reader sees before :func:`commit_version`."""
    return f"{base.rstrip('/')}/version-{uuid.uuid4().hex}"


def commit_version(spark: SparkSession, base: str, version: str, name: str) -> None:
    """Append the version's row to the commit table: readers see a whole version or the one before."""
    row = spark.createDataFrame([(version, name, time.time_ns())], COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/commits")


def latest_version(spark: SparkSession, base: str) -> tuple[str, str] | None:
    """(folder, name) of the version committed last; None before the first."""
    if not path_exists(spark, f"{base.rstrip('/')}/commits"):
        return None
    row = spark.read.schema(COMMITS).parquet(f"{base.rstrip('/')}/commits").orderBy(F.desc("committed_at")).head()
    return None if row is None else (row["version"], row["name"])


def write_frames(frames: dict[str, DataFrame | Callable], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Named report frames, one directory per frame, committed together once all are written.

    A frame given as a function is made from the frames written before it; the first one is a frame."""
    spark, version = next(iter(frames.values())).sparkSession, new_version(base)
    paths: dict[str, str] = {}
    done: dict[str, DataFrame] = {}
    for name, frame in frames.items():
        paths[name] = write_table(frame(done) if callable(frame) else frame, f"{version}/{name}", fmt)
        done[name] = spark.read.format(fmt).load(paths[name])
    commit_version(spark, base, version, ",".join(frames))
    return paths


def read_frames(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The frames of the report committed last; empty before the first."""
    found = latest_version(spark, base)
    return {} if found is None else {name: spark.read.parquet(f"{found[0]}/{name}") for name in found[1].split(",")}


def sectioned_union(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames with different columns stacked with a ``section`` column."""
    out = None
    for name, df in frames.items():
        d = df.select(F.lit(name).alias("section"), *[F.col(c).cast("string").alias(c) for c in df.columns])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def metrics_frame(spark: SparkSession, rows: Sequence[tuple[str, str, object]]) -> DataFrame:
    """``(section, item, value)`` report rows."""
    return spark.createDataFrame([(s, i, None if v is None else str(v)) for s, i, v in rows],
                                 "section string, item string, value string")


def save_feature_schema(spark: SparkSession, names: Sequence[str], path: str, engineered_prefix: str = "feat_") -> str:
    """Ordered feature schema as a JSON table ``(ordinal, name, engineered)``."""
    rows = [(i, n, n.startswith(engineered_prefix)) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "ordinal int, name string, engineered boolean")
    return write_table(df.coalesce(1), path, "json")


def load_feature_schema(spark: SparkSession, path: str) -> list[str]:
    df = spark.read.schema("ordinal int, name string, engineered boolean").json(path)
    return [r["name"] for r in df.orderBy("ordinal").collect()]  # metadata: one row per feature


def publish_schema(spark: SparkSession, names: Sequence[str], base: str, name: str) -> str:
    """A new version of a feature contract, seen by readers once it is whole."""
    version = new_version(base)
    save_feature_schema(spark, names, f"{version}/features")
    commit_version(spark, base, version, name)
    return version


def published_schema(spark: SparkSession, base: str) -> list[str]:
    """The names of the contract published last."""
    found = latest_version(spark, base)
    if found is None:
        raise FileNotFoundError(f"no feature contract published below {base}")
    return load_feature_schema(spark, f"{found[0]}/features")


def save_fill_values(spark: SparkSession, fills: dict[str, float], path: str) -> str:
    """Training fill values as a one-row table."""
    df = spark.createDataFrame([tuple(float(v) for v in fills.values())],
                               ", ".join(f"`{k}` double" for k in fills))
    return write_table(df, path, "json")


def load_fill_values(spark: SparkSession, path: str) -> dict[str, float]:
    row = spark.read.json(path).first()
    return {k: float(v) for k, v in row.asDict().items()} if row else {}


def template_rows(stats_row: DataFrame, overrides: dict[str, dict[str, float]]) -> DataFrame:
    """One template row per scenario: medians plus literal overrides."""
    out = None
    for name, ov in overrides.items():
        d = stats_row.select(F.lit(name).alias("template"), *[
            (F.lit(float(ov[c])) if c in ov else F.col(c)).alias(c) for c in stats_row.columns])
        out = d if out is None else out.unionByName(d)
    return out


def sample_template(stats_row: DataFrame, features: Sequence[str], defect: int = 0) -> DataFrame:
    """One example batch: the fixed sample values, else the training median of ``stats_row``, else 0."""
    def value(name: str) -> Column:
        if name in config.SAMPLE_FEATURE_VALUES:
            return F.lit(float(config.SAMPLE_FEATURE_VALUES[name]))
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in stats_row.columns else F.lit(0.0)

    return stats_row.select(*[value(n).alias(n) for n in features if n != "defect"], F.lit(defect).alias("defect"))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Header-only read of a template file (schema, no data scan)."""
    return spark.read.option("header", True).csv(path).columns


def to_json_text(obj) -> str:
    return json.dumps(obj, sort_keys=True)
