"""Sinks: validated releases, accepted and rejected logs, cached indexes, publication with a count check, cards and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.contract import violations
from quern.plans.staging import stage
from quern.sources.readers import exists


def conflicting_payloads(df: DataFrame, scene: str, digest: str) -> DataFrame:
    """Scenes for which rows carry different payload digests; such a scene is refused, equal repeats are written once."""
    x = df.where(F.col(scene).isNotNull() & F.col(digest).isNotNull()).groupBy(scene).agg(F.countDistinct(digest).alias("versions"))
    return x.where("versions > 1")


def write_release(samples: DataFrame, split: DataFrame, rules: dict[str, Column], folder: str, key: str = "sample_id", scene: str = "scene_id", digest: str | None = None) -> None:
    """Write the manifest of valid, unique samples with the side of their scene, partitioned by side; nothing is written if any
    sample breaks a rule, repeats a key, has no side, or a scene carries two payloads."""
    placed = samples.drop("split").join(split.select(scene, "split"), scene, "left")
    checked = stage(placed.withColumn("_bad", violations({**rules, "no_side": F.col("split").isNull()})), "release")
    if bad := checked.where(F.size("_bad") > 0).select(key, "_bad").limit(3).collect():
        raise ValueError(f"broken rules: {[(r[0], list(r[1])) for r in bad]}")
    if twice := checked.groupBy(key).count().where("count > 1").limit(3).collect():
        raise ValueError(f"repeated keys: {[r[0] for r in twice]}")
    if digest and (torn := conflicting_payloads(checked, scene, digest).limit(3).collect()):
        raise ValueError(f"scenes with several payloads: {[r[0] for r in torn]}")
    checked.drop("_bad").write.mode("errorifexists").partitionBy("split").parquet(folder)


def write_log(df: DataFrame, reason: str, folder: str) -> None:
    """Append accepted (reason null) and rejected rows to one JSONL log, with status and reason."""
    status = F.when(F.col(reason).isNull(), "ok").otherwise("rejected")
    df.withColumn("status", status).withColumnRenamed(reason, "reason").write.mode("append").json(folder)


def write_ledger(df: DataFrame, columns: list[str], folder: str) -> None:
    df.select(*columns).write.mode("append").json(folder)


def cached(df: DataFrame, folder: str, version: str) -> DataFrame:
    """df, written once under its version and read from there later; the committer makes the table appear whole or not at all."""
    spark, path = df.sparkSession, f"{folder}/v={version}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, folder: str, by: str, rows_per_file: int = 2000, allow_existing: bool = False) -> DataFrame:
    """Write df by ``by`` in files of at most rows_per_file rows, refuse a folder that isn't empty unless allowed, and give for
    each part the rows sent, found there afterwards and there before; whole where nothing but the sent rows came."""
    spark = df.sparkSession
    full = exists(spark, f"{folder}/*")
    if full and not allow_existing:
        raise ValueError(f"not empty: {folder}")

    def counts(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("part")).agg(F.count(F.lit(1)).alias(name))

    whole = stage(df, "publish")
    before = stage(counts(spark.read.parquet(folder), "before"), "before") if full else spark.createDataFrame([], "part string, before bigint")
    whole.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(folder)
    j = counts(whole, "sent").join(counts(spark.read.parquet(folder), "found"), "part", "full").join(before, "part", "left").na.fill(0, ["sent", "found", "before"])
    return j.select("part", "sent", "found", "before", (F.col("sent") == F.col("found") - F.col("before")).alias("whole"))


def card(df: DataFrame, title: str, measures: dict[str, Column]) -> str:
    """A dataset card from measured values only: one aggregate row, a line for each measure."""
    row = df.agg(*[c.alias(n) for n, c in measures.items()]).first()
    return "\n".join([f"# {title}", "", "| measure | value |", "| --- | --- |", *[f"| {n} | {'n/d' if row[n] is None else row[n]} |" for n in measures]]) + "\n"


def markdown(df: DataFrame, order: list[str | Column], rows: int = 1000) -> str:
    """A small result as a markdown table, ordered; at most ``rows`` rows, an error beyond."""
    got = df.orderBy(*order).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    line = lambda xs: "| " + " | ".join("n/d" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in got]]) + "\n"


def write_subset(df: DataFrame, keys: DataFrame, key: str, folder: str) -> None:
    """Write the rows whose key is listed: a staged subset."""
    df.join(keys.select(key).distinct(), key, "left_semi").write.mode("errorifexists").parquet(folder)


def disk_budget(df: DataFrame, scene: str, sample_bytes: int, scene_bytes: int) -> DataFrame:
    """One row: samples, scenes and the bytes a release of them takes."""
    one = df.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct(scene).alias("scenes"))
    return one.withColumn("bytes_needed", F.col("samples") * sample_bytes + F.col("scenes") * scene_bytes)
