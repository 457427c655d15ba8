"""Readers, writers and adapters from tables to (alerts, transactions)."""

from __future__ import annotations

import hashlib
import json
import pathlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALERT_SCHEMA = T.StructType([T.StructField("alert_id", T.StringType()), T.StructField("alert_date", T.DateType()), T.StructField("label", T.IntegerType())])


def read_alerts_csv(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Alerts with the id as text and the date as the moment 00:00:00."""
    schema = ALERT_SCHEMA if labelled else T.StructType(ALERT_SCHEMA.fields[:2])
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path).withColumn("alert_date", F.col("alert_date").cast("timestamp_ntz"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ledger(spark: SparkSession, path: str, key: str = "name", order: str = "ts") -> DataFrame:
    """JSON lines, of which the last of each name counts."""
    rows = spark.read.json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _one_file(lines: DataFrame, path: str) -> None:
    """Write a table of one text column, in its order, as a single file of that name with line feeds and no mark; it replaces one that is there."""
    folder = f"{path}.{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(folder, lineSep="\n")
    hadoop = lines.sparkSession._jvm.org.apache.hadoop.fs
    place = hadoop.Path(folder)
    fs = place.getFileSystem(lines.sparkSession._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-"))
    target, old = hadoop.Path(path), hadoop.Path(f"{folder}/old")
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        fs.delete(place, True)
        raise IsADirectoryError(path)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(part, target):
        fs.rename(old, target)
        raise OSError(f"could not write {path}")
    fs.delete(place, True)


def write_scores_csv(scores: DataFrame, path: str, order: str, id_column: str = "alert_id", score_column: str = "score") -> None:
    """One CSV file: header, eight decimals, rows in ``order``. Submissions have a row an alert, so one file is bounded by them."""
    lines = scores.select(F.lit(1).alias("k"), F.col(order).alias("o"), F.concat_ws(",", F.col(id_column).cast("string"), F.format_string("%.8f", score_column)).alias("line"))
    head = scores.sparkSession.createDataFrame([(0, f"{id_column},{score_column}")], "k int, line string").select("k", F.lit(None).cast(scores.schema[order].dataType).alias("o"), "line")
    _one_file(head.unionByName(lines).orderBy("k", "o").select("line"), path)


def read_scores_csv(spark: SparkSession, path: str, id_column: str = "alert_id", score_column: str = "score") -> DataFrame:
    return spark.read.schema(f"`{id_column}` string, `{score_column}` double").option("header", True).csv(path)


def read_importance_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, gain double").option("header", True).csv(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, or a YAML file where that library is installed."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def write_json(spark: SparkSession, facts: dict, path: str) -> None:
    _one_file(spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "line string"), path)


def misaligned(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """The values of ``order`` at which two tables don't hold the same key; each has a position once."""
    left, right = (x.select(F.col(order).alias(order), F.col(key).alias(name)) for x, name in ((a, "_a"), (b, "_b")))
    return left.join(right, order, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(order)


def fingerprint(df: DataFrame) -> str:
    """The schema, the number of rows and the sum of their hashes: the same for the same rows in any order."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{df.schema.simpleString()} {facts['n']} {facts['h']}"


def cached_features(spark: SparkSession, folder: str, config: object, inputs: list[DataFrame], build) -> DataFrame:
    """The features of ``build()``, kept as Parquet under a hash of ``config`` (with the families), of all rows of ``inputs`` (with the reference statistics), and of the package's code."""
    root = pathlib.Path(__file__).parents[1]
    code = [p.read_bytes() for part in ("operators", "plans", "functions") for p in sorted((root / part).glob("*.py"))] if root.is_dir() else []
    key = hashlib.md5(repr((config, [fingerprint(df) for df in inputs], [hashlib.md5(c).hexdigest() for c in code])).encode()).hexdigest()
    path = f"{folder}/features-{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def assert_private(df: DataFrame, pattern: str) -> None:
    """Fail if a text column of an output holds an id."""
    texts = [F.coalesce(F.col(f"`{f.name}`"), F.lit("")).rlike(pattern) for f in df.schema if isinstance(f.dataType, T.StringType)]
    if texts and df.where(F.greatest(*(t.cast("int") for t in texts), F.lit(0)) == 1).limit(1).count():
        raise ValueError("an id is in the output")


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as alerts, their events as transactions."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    tx = rows.select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("tx_id"), F.col("ts").alias("tx_ts"), F.when(k < 50, "in").otherwise("out").alias("direction"), F.col("event_type").alias("tx_type"), (F.ln(1 + F.col("value")) - 3).alias("amount"))
    alerts = rows.select(F.col("user_id").alias("alert_id")).distinct()
    return alerts.withColumn("alert_date", F.expr("timestamp_ntz'2024-01-20 00:00:00' + make_dt_interval(cast(alert_id % 10 as int))")), tx


def lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as alerts, the lines of their orders as transactions."""
    lines, orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    tx = joined.select(F.col("o_custkey").alias("alert_id"), F.lit(None).cast("long").alias("tx_id"), F.col("l_shipdate").alias("tx_ts"), F.when(F.col("l_linestatus") == "F", "in").otherwise("out").alias("direction"), F.col("l_returnflag").alias("tx_type"), (F.ln("l_extendedprice") - 10).alias("amount"))
    return customers.select(F.col("c_custkey").alias("alert_id")).distinct().withColumn("alert_date", F.expr("timestamp_ntz'2000-01-01 00:00:00'")), tx
