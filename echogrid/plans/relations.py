"""Rasters, series and targets derived from the given tables, in Spark and as SQL.

``slc``: each vector is an image line of 32 complex cells; ``sec`` is the same image one line
up; ``img`` a real image of 64 columns; ``pol`` the four polarisations; ``mask`` and ``swath``
digit masks and valid intervals by line; ``survey``, ``pulse``, ``tie``, ``target`` and
``channel`` come from events, line items, suppliers and parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Frame = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("v"))


def slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda k: F.struct(k.alias("col"), F.get("embedding", 2 * k).cast("double").alias("re"), F.get("embedding", 2 * k + 1).cast("double").alias("im"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(31)), cell)))


def sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slc(spark, sf_dir).select((F.col("row") - 1).alias("row"), "col", "re", "im")


def pol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slc(spark, sf_dir).select(F.floor(F.col("row") / 4).alias("row"), "col", (F.col("row") % 4).cast("int").alias("p"), "re", "im")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("label")
    m = 10 * (k % 2) + (k % 3 == 0).cast("int") + 100 * (k % 5 == 0).cast("int")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("col"), m.alias("m"))


def swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("label")
    two = F.array(F.struct(F.lit(1).alias("s"), k.alias("start"), (k + 20).alias("stop")), F.struct(F.lit(2).alias("s"), F.lit(40).alias("start"), F.lit(60).alias("stop")))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.inline(two))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), F.col("ts").alias("survey_date"), k.bitwiseAND(31).alias("validity"), F.col("value").alias("az"))


def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("x"))


def tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), c("l_orderkey").alias("scene"), c("l_partkey").cast("double").alias("line"), c("l_suppkey").cast("double").alias("pixel"), c("l_discount").alias("dl"), c("l_tax").alias("dp"), (c("l_quantity") / 50).alias("corr"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37) % 360 - 180 + 0.25).cast("double").alias("lon"), ((k * 53) % 160 - 80 + 0.5).cast("double").alias("lat"), (F.lit(1.0) + F.abs(F.col("c_acctbal")) / 1000).alias("side"), F.col("c_acctbal").alias("h"))


def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    freq, kind = F.when(c("p_partkey") % 2 == 0, "A").otherwise("B"), (c("p_partkey") % 4).cast("int")
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.floor(c("p_partkey") / 8).alias("scene"), freq.alias("freq"), kind.alias("pol"), (1200.0 + c("p_size")).alias("center"), (5.0 + c("p_partkey") % 40).cast("double").alias("width"))


#: The same relations as SQL.
SQL: dict[str, str] = {
    "img": "img AS (SELECT vec_id AS row, CAST(k AS INT) AS col, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(k))",
    "slc": "slc AS (SELECT vec_id AS row, CAST(k AS INT) AS col, CAST(embedding[2 * k + 1] AS DOUBLE) AS re, CAST(embedding[2 * k + 2] AS DOUBLE) AS im FROM embeddings, range(0, 32) t(k))",
    "sec": "sec AS (SELECT row - 1 AS row, col, re, im FROM slc)",
    "pol": "pol AS (SELECT CAST(floor(row / 4) AS BIGINT) AS row, col, CAST(row % 4 AS INT) AS p, re, im FROM slc)",
    "mask": "mask AS (SELECT vec_id AS row, CAST(k AS INT) AS col, 10 * (label % 2) + CAST(label % 3 = 0 AS INT) + 100 * CAST(label % 5 = 0 AS INT) AS m FROM embeddings, range(0, 32) t(k))",
    "swath": "swath AS (SELECT vec_id AS row, 1 AS s, label AS start, label + 20 AS stop FROM embeddings UNION ALL SELECT vec_id, 2, 40, 60 FROM embeddings)",
    "survey": "survey AS (SELECT event_id, user_id AS id, ts AS survey_date, CAST(json_extract(props, '$.k') AS INT) & 31 AS validity, value AS az FROM events)",
    "pulse": "pulse AS (SELECT event_id AS i, epoch_us(ts) / 1000000.0 AS t, event_type AS kind, value AS x FROM events)",
    "tie": "tie AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS scene, CAST(l_partkey AS DOUBLE) AS line, CAST(l_suppkey AS DOUBLE) AS pixel, l_discount AS dl, l_tax AS dp, l_quantity / 50 AS corr FROM lineitem)",
    "target": "target AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 360 - 180 + 0.25 AS DOUBLE) AS lon, CAST((c_custkey * 53) % 160 - 80 + 0.5 AS DOUBLE) AS lat, 1.0 + abs(c_acctbal) / 1000 AS side, c_acctbal AS h FROM customer)",
    "channel": "channel AS (SELECT p_partkey AS id, CAST(floor(p_partkey / 8) AS BIGINT) AS scene, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS freq, CAST(p_partkey % 4 AS INT) AS pol, CAST(1200.0 + p_size AS DOUBLE) AS center, CAST(5.0 + p_partkey % 40 AS DOUBLE) AS width FROM part)",
}
NEEDS = {"sec": ("slc",), "pol": ("slc",)}


def with_relations(names: str, body: str) -> str:
    """A query over some of the relations; ``body`` may go on with more of its own after a comma."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    head = ", ".join(SQL[n] for n in order)
    return f"WITH {head}{body if body.startswith(',') else ' ' + body}"
