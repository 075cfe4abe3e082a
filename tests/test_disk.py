"""What jobs leave in the shared folder."""

import os

from pyspark.sql import functions as F

from meltlens.operators import upload as U
from meltlens.session import ensure_checkpoint_dir
from meltlens.sources import io as IO


def test_stored_rows_keep_headers_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, " - ", None), (1, " - ", None), (2, "", 1.5)], "`Heat No.` long, `a, b;` string, `x=(y)` double")
    kept, path = IO.store_rows(df, "rows")
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert any(f.endswith(".zstd.parquet") for f in os.listdir(path.removeprefix("file:")))
    IO.remove_rows(spark, path)
    assert not IO.path_exists(spark, path)


def test_upload_leaves_one_compressed_copy(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(U, "store_rows", lambda df, name: paths.append(IO.store_rows(df, name)) or paths[-1])
    raw = spark.range(50).select("id", F.lit("3.4").alias("Carbon"), F.when(F.col("id") % 2 == 0, "1").otherwise("0").alias("DEFECTED"),
                                 F.lit(None).cast("string").alias("Remarks"))
    out = U.prepare_upload(raw.unionByName(raw.where("id < 5")), keys=["id"])
    assert out.count() == 50
    # the first copy went when the second stood
    assert [IO.path_exists(spark, path) for _df, path in paths] == [False, True]


def test_report_frames_are_compressed(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), "report-compressed")
    paths = IO.write_frames({"a": spark.range(100)}, base)
    assert any(f.endswith(".zstd.parquet") for f in os.listdir(paths["a"].removeprefix("file:")))
