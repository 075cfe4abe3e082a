"""Fixture views mapped onto the driver's parquet tables.

Each fixture exists twice: as a lazy Spark DataFrame (what the operators
consume) and as SQL text (the DuckDB oracle runs it as a CTE).  The two
definitions are kept side by side so they cannot drift apart.

Row key of ``heats``: ``(l_orderkey, l_linenumber, l_partkey, l_suppkey)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

HEAT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _mod_d(c: str, m: int) -> Column:
    return (F.col(c) % m).cast("double")


# ---------------------------------------------------------------------------
# heats: clean batches with signals
# ---------------------------------------------------------------------------
def heats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heats_of(read_table(spark, sf_dir, "lineitem"))


def heats_of(li: DataFrame) -> DataFrame:
    """The fixture's projection over any lineitem source, batch or stream."""
    pk, sk, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    return li.select(
        *HEAT_KEY,
        "l_shipdate",
        F.when(pk % 10 < F.col("l_linenumber"), 1).otherwise(0).alias("defect"),
        (F.col("l_linenumber").cast("int") - 1).alias("cluster"),
        F.col("l_linestatus").alias("furnace"),
        (F.lit(3.3) + F.lit(0.7) * (q - 1.0) / 49.0).alias("c_"),
        (F.lit(1.5) + F.lit(15.0) * F.col("l_discount")).alias("si_"),
        (F.lit(5e-3) + F.lit(0.3) * F.col("l_tax")).alias("s_"),
        (_mod_d("l_partkey", 50) / 1e2 + 2e-2).alias("mn_"),
        (_mod_d("l_suppkey", 10) / 5e2 + 2e-2).alias("p__"),
        (_mod_d("l_partkey", 23) / 2e3).alias("n__"),
        (_mod_d("l_suppkey", 7) / 2e2).alias("al__"),
        (_mod_d("l_partkey", 9) / 1e2).alias("mg_"),
        (_mod_d("l_suppkey", 6) / 2e1).alias("cr_"),
        (((pk + sk) % 12).cast("double") / 2e1 + 2e-1).alias("mg_recovery_"),
        (F.lit(1.38e3) + F.lit(2.0) * q).alias("tapping_temp"),
        (F.lit(1.37e3) + F.lit(2.0) * q - _mod_d("l_partkey", 95)).alias("pouring_temp"),
        _mod_d("l_partkey", 80).alias("crca"),
        _mod_d("l_partkey", 15).alias("fsmaddition_mt"),
        _mod_d("l_suppkey", 9).alias("heel"),
        _mod_d("l_partkey", 12).alias("tapped_wt_"),
        (((pk * 37 + sk * 11) % 101).cast("double") / 1e2).alias("defect_prob"),
        (((pk * 53 + F.col("l_linenumber") * 17) % 101).cast("double") / 1e2).alias("anomaly_score"),
    )


HEATS_SQL = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  case when l_partkey % 10 < l_linenumber then 1 else 0 end as defect,
  cast(l_linenumber as int) - 1 as cluster,
  l_linestatus as furnace,
  3.3e0 + 7e-1*(l_quantity-1e0)/49e0 as c_,
  1.5e0 + 1.5e1*l_discount as si_,
  5e-3 + 3e-1*l_tax as s_,
  cast(l_partkey % 50 as double)/1e2 + 2e-2 as mn_,
  cast(l_suppkey % 10 as double)/5e2 + 2e-2 as p__,
  cast(l_partkey % 23 as double)/2e3 as n__,
  cast(l_suppkey % 7 as double)/2e2 as al__,
  cast(l_partkey % 9 as double)/1e2 as mg_,
  cast(l_suppkey % 6 as double)/2e1 as cr_,
  cast((l_partkey + l_suppkey) % 12 as double)/2e1 + 2e-1 as mg_recovery_,
  1.38e3 + 2e0*l_quantity as tapping_temp,
  1.37e3 + 2e0*l_quantity - cast(l_partkey % 95 as double) as pouring_temp,
  cast(l_partkey % 80 as double) as crca,
  cast(l_partkey % 15 as double) as fsmaddition_mt,
  cast(l_suppkey % 9 as double) as heel,
  cast(l_partkey % 12 as double) as tapped_wt_,
  cast((l_partkey*37 + l_suppkey*11) % 101 as double)/1e2 as defect_prob,
  cast((l_partkey*53 + l_linenumber*17) % 101 as double)/1e2 as anomaly_score
from lineitem"""


# ---------------------------------------------------------------------------
# heats_raw: dirty strings for the cleaning operators
# ---------------------------------------------------------------------------
def heats_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    qi = F.col("l_quantity").cast("int")
    return li.select(
        *HEAT_KEY,
        F.when(pk % 17 == 0, F.lit(" - ")).when(pk % 19 == 0, F.lit("N/A"))
        .when(pk % 23 == 0, F.lit("")).otherwise((F.lit(1380) + 2 * qi).cast("string"))
        .alias("tapping_temp"),
        F.when(pk % 29 == 0, (F.lit(1000) + pk % 100).cast("string"))
        .when(sk % 11 == 0, F.lit("null"))
        .otherwise((F.lit(1370) + 2 * qi - (pk % 95).cast("int")).cast("string"))
        .alias("pouring_temp"),
        F.when(pk % 4 < 3, F.concat((F.lit(25) + sk % 30).cast("string"), F.lit("%")))
        .otherwise((F.lit(25) + sk % 30).cast("string")).alias("mg_recovery"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .otherwise(F.col("l_linestatus")).alias("furnace"),
        F.lit(None).cast("string").alias("empty_col"),
        F.when(pk % 13 == 0, F.lit(None).cast("string"))
        .when(pk % 10 < F.col("l_linenumber"), F.lit("1")).otherwise(F.lit("0")).alias("defected"),
    )


HEATS_RAW_SQL = """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_partkey % 17 = 0 then ' - ' when l_partkey % 19 = 0 then 'N/A'
       when l_partkey % 23 = 0 then ''
       else cast(1380 + 2*cast(l_quantity as int) as string) end as tapping_temp,
  case when l_partkey % 29 = 0 then cast(1000 + l_partkey % 100 as string)
       when l_suppkey % 11 = 0 then 'null'
       else cast(1370 + 2*cast(l_quantity as int) - cast(l_partkey % 95 as int) as string) end as pouring_temp,
  case when l_partkey % 4 < 3 then concat(cast(25 + l_suppkey % 30 as string), '%')
       else cast(25 + l_suppkey % 30 as string) end as mg_recovery,
  case when l_linenumber = 7 then null else l_linestatus end as furnace,
  cast(null as string) as empty_col,
  case when l_partkey % 13 = 0 then null
       when l_partkey % 10 < l_linenumber then '1' else '0' end as defected
from lineitem"""


# ---------------------------------------------------------------------------
# heat_events: totally ordered stream of batches (trends)
# ---------------------------------------------------------------------------
def heat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("furnace_id"),
        "ts",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("defect"),
        "value",
    )


HEAT_EVENTS_SQL = """select event_id as seq, user_id as furnace_id, ts,
  case when event_type = 'error' then 1 else 0 end as defect, value
from events"""


# ---------------------------------------------------------------------------
# points5, points3: every embedding folded to block sums, for neighbour operators
# ---------------------------------------------------------------------------
_BLOCKS5 = ((1, 13), (14, 26), (27, 39), (40, 52), (53, 64))
_BLOCKS3 = ((1, 21), (22, 42), (43, 64))


def _folded(spark: SparkSession, sf_dir: str, blocks, prefix: str) -> DataFrame:
    total = lambda a, b: F.aggregate(
        F.slice("embedding", a, b - a + 1), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[total(a, b).alias(f"{prefix}{i + 1}") for i, (a, b) in enumerate(blocks)])


def _folded_sql(blocks, prefix: str) -> str:
    return "select vec_id, label, " + ", ".join(
        f"list_sum(list_transform(embedding[{a}:{b}], lambda x: cast(x as double))) as {prefix}{i + 1}"
        for i, (a, b) in enumerate(blocks)) + " from embeddings"


def points5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, _BLOCKS5, "x")


def points3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir, _BLOCKS3, "b")


def embedding_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension of the embeddings as a column e1..e64; missing ones are NULL."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(EMBEDDING_DIMS)])


EMBEDDING_DIMS = [f"e{i}" for i in range(1, 65)]
POINTS5_SQL = _folded_sql(_BLOCKS5, "x")
POINTS3_SQL = _folded_sql(_BLOCKS3, "b")


# ---------------------------------------------------------------------------
# preds: (y, p, yhat) for evaluation operators; many tied scores by design
# ---------------------------------------------------------------------------
def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = heats(spark, sf_dir)
    return h.select(
        *HEAT_KEY,
        F.col("defect").alias("y"),
        F.col("defect_prob").alias("p"),
        F.when(F.col("defect_prob") >= 0.5, 1).otherwise(0).alias("yhat"),
    )


PREDS_SQL = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, defect as y,
  defect_prob as p, case when defect_prob >= 5e-1 then 1 else 0 end as yhat from heats"""


FIXTURE_SQL = {
    "heats": HEATS_SQL,
    "heats_raw": HEATS_RAW_SQL,
    "heat_events": HEAT_EVENTS_SQL,
    "points5": POINTS5_SQL,
    "points3": POINTS3_SQL,
    "preds": PREDS_SQL,
}
FIXTURE_DEPS = {"preds": ["heats"]}

FIXTURES = {
    "heats": heats,
    "heats_raw": heats_raw,
    "heat_events": heat_events,
    "points5": points5,
    "points3": points3,
    "preds": preds,
}


def with_fixtures(sql: str, *names: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named fixtures (dependencies first),
    followed by any extra named CTEs given in ``ctes`` (in order)."""
    ordered: list[str] = []
    for n in names:
        for dep in FIXTURE_DEPS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    parts = [f"{n} as ({FIXTURE_SQL[n]})" for n in ordered]
    parts += [f"{n} as ({body})" for n, body in (ctes or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + sql
