"""Structured Streaming scoring with frozen artefacts.

The decision layer is row-local once the cluster history and the Mg median
are frozen, so the same column expressions run on a streaming DataFrame:
``readStream`` (parquet files as they land) -> heats projection -> features
-> decision -> ``foreachBatch`` into a table under the shared checkpoint
directory.  Each epoch overwrites its own folder, so a batch that is replayed
after a crash does not duplicate rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import decisions as D
from ..operators import features as FE
from ..plans.lookup import materialize_if_small
from ..sources import io as IO
from ..sources.fixtures import HEAT_KEY, heats, heats_of
from ..sources.tables import read_table, table_path


def frozen_artefacts(spark: SparkSession, sf_dir: str):
    """Training statistics computed once in batch: cluster history + Mg median."""
    base = heats(spark, sf_dir)
    frozen, _ = materialize_if_small(D.cluster_stats(base))
    mg = FE.mg_median_row(base).first()["med_mg_recovery_"]
    return frozen, mg


def score_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the streaming scorer over the lineitem files available now
    (``availableNow`` trigger) and return the appended decision table."""
    stats, mg = frozen_artefacts(spark, sf_dir)
    schema = read_table(spark, sf_dir, "lineitem").schema
    src = (spark.readStream.schema(schema)
           .option("pathGlobFilter", os.path.basename(table_path(sf_dir, "lineitem")))
           .parquet(sf_dir))
    scored = D.unified_decisions(FE.engineer_features(heats_of(src), mg_median=mg), stats=stats)
    out_path = IO.scratch_path(spark, "stream-decisions")
    ckpt = IO.scratch_path(spark, "stream-checkpoint")

    def sink(batch: DataFrame, epoch: int) -> None:
        # each epoch has its own folder: a replayed batch replaces what it wrote before
        scored_rows = batch.select(*HEAT_KEY, "risk_level", "recommendation", "final_risk_score")
        scored_rows.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = scored.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out_path).drop("epoch")
