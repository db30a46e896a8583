"""Sources: JSONL logs, directories of documents, image mirrors, file trees, panels, and the lookups built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import first_of, image_type, truthy
from quern.operators.contract import positive, require_columns
from quern.plans.staging import broadcast_checked, stage


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Rows of JSONL files. Blank lines are skipped, a missing path is an empty table. A malformed line is an error that names
    its file, or dropped with strict=False."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def completed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sample_id with status ok of a rejection log; rejected ones are to be tried again, malformed lines are skipped."""
    log = read_jsonl(spark, path, "sample_id string, status string", strict=False)
    return log.where("status = 'ok' and sample_id is not null").select("sample_id").distinct()


def read_documents(spark: SparkSession, folder: str, schema: StructType | str, key_from_path: str | None = None) -> DataFrame:
    """One row for each *.json file below folder, with its file name; key_from_path: a pattern whose first group becomes
    ``path_key`` (such as the split directory)."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    out = df.select("*", F.col("_metadata.file_path").alias("file_path"))
    return out if key_from_path is None else out.withColumn("path_key", F.regexp_extract("file_path", key_from_path, 1))


def mirror_index(spark: SparkSession, folder: str, name: str = "file_name_base") -> DataFrame:
    """(name, shard, row_no) of a parquet mirror, reading that one column; a name in two places is an error."""
    idx = stage(spark.read.parquet(folder).select(F.col(name).alias("name"), F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row_no")), "index")
    if twice := idx.groupBy("name").count().where("count > 1").limit(1).collect():
        raise ValueError(f"name in several places of the mirror: {twice[0]['name']}")
    return idx


def mirror_cells(spark: SparkSession, folder: str, wanted: DataFrame, column: str, name: str = "file_name_base") -> DataFrame:
    """wanted (name, ...) with the bytes of their cell in ``column``, their type, SHA-256 and size; null where there is none.

    The scan meets the wanted names, broadcast up to a bound, before anything is shuffled, so that only cells that are wanted
    leave it; wanted rows without a cell are added by a second join with these few.
    """
    cells = spark.read.parquet(folder).select(F.col(name).alias("name"), F.col(f"{column}.bytes").alias("bytes"))
    hits = cells.join(broadcast_checked(wanted.select("name").distinct()), "name", "left_semi")
    out = wanted.join(stage(hits, "cells"), "name", "left")
    return out.withColumns({"kind": image_type(F.col("bytes")), "sha256": F.sha2("bytes", 256), "n_bytes": F.length("bytes")})


def enumerate_files(spark: SparkSession, folder: str, suffixes: list[str], measure=None) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected): files below folder by suffix, with size and SHA-256, and optionally measure(content).

    Of files with the same content the first by path is a candidate; later ones are rejected as duplicate_content with the
    first's path, files that measure gives null for, and empty ones, as unreadable. Other files aren't opened; a suffix is
    matched in lower and in upper case.
    """
    names = "{" + ",".join(f"*.{x}" for s in suffixes for x in sorted({s.lstrip(".").lower(), s.lstrip(".").upper()})) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    cols = {"sha256": F.sha2("content", 256)} | ({} if measure is None else {"measure": measure(F.col("content"))})
    files = stage(raw.withColumns(cols).drop("content"), "files")
    w = Window.partitionBy("sha256").orderBy("path")
    seen = files.withColumn("first_path", F.first("path").over(w)).withColumn("_rn", F.row_number().over(w))
    unread = (F.col("length") == 0) if measure is None else (F.col("length") == 0) | F.col("measure").isNull()
    reason = F.when(unread, "unreadable").when(F.col("_rn") > 1, "duplicate_content")
    seen = seen.withColumn("reason", reason).drop("_rn")
    return seen.where("reason is null").drop("reason", "first_path"), seen.where("reason is not null")


def file_tree(spark: SparkSession, folder: str, pattern: str, names: list[str]) -> DataFrame:
    """One row for each file whose path below folder fits the pattern, with its groups as columns; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return raw.where(F.col("path").rlike(pattern)).select("path", "length", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def union_sources(sources: dict[str, DataFrame], required: list[str], keep: list[str]) -> DataFrame:
    """The sources one after another on the kept columns that all of them have, with ``source``; a missing required column is an error."""
    for df in sources.values():
        require_columns(df, required)
    common = [c for c in keep if all(c in df.columns for df in sources.values())]
    out = None
    for name, df in sources.items():
        one = df.select(*common, F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


def local_folder(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """Rows of a local source's JSONL: rows with an error or without a file are dropped, of repeated idx the last line counts."""
    schema = "idx bigint, stem string, file string, k double, s1 double, error string"
    log = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_pos"))
    ok = log.where("error is null and file is not null and idx is not null")
    last = ok.withColumn("_rn", F.row_number().over(Window.partitionBy("idx").orderBy(F.col("_f").desc(), F.col("_pos").desc()))).where("_rn = 1").drop("_rn", "_f", "_pos")
    return last if max_samples is None else last.orderBy("idx").limit(max_samples)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do: those whose key isn't among the done ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def experiment_results(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every (origin, arm, seed) directory, whatever columns each has, with its label's parts; one row a directory."""
    from quern.functions.text import label_parts

    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "test_metrics.json").json(folder)
    df = raw.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/test_metrics\.json$", 1).alias("label"))
    return df.select("*", *[c.alias(n) for n, c in label_parts(F.col("label")).items()])


def missing_from_grid(spark: SparkSession, results: DataFrame, arms: list[str], seeds: list[int]) -> DataFrame:
    """(arm, seed) expected but absent."""
    grid = spark.createDataFrame([(a, s) for a in arms for s in seeds], "arm string, seed int")
    return grid.join(results.select("arm", "seed").distinct(), ["arm", "seed"], "left_anti")


def reviewed_panel(spark: SparkSession, path: str, score: str = "calibration_ssim", verdict: str = "acceptable_for_control") -> DataFrame:
    """(score, good) of a reviewed CSV; rows whose score isn't a number are dropped, the verdict is read tolerantly."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(score).try_cast("double").alias("score"), truthy(F.col(verdict)).alias("good")).where("score is not null")


def optics_rows(df: DataFrame, doc: str = "exif") -> DataFrame:
    """df with focal_mm, f_number and focal_35mm from a JSON document with varying keys, and the slug of the first that is
    missing or not a positive number."""
    keys = {"focal_mm": ("$.FocalLength", "$.focal_length"), "f_number": ("$.FNumber", "$.f_number"), "focal_35mm": ("$.FocalLengthIn35mmFilm", "$.focal_length_35")}
    slugs = {"focal_mm": "exif_focal_length_missing", "f_number": "exif_f_number_missing", "focal_35mm": "sensor_width_unresolvable"}
    got = {n: positive(first_of(F.col(doc), *p), slugs[n]) for n, p in keys.items()}
    return df.withColumns({n: v for n, (v, _) in got.items()} | {"optics_error": F.coalesce(*[e for _, e in got.values()])})


def resolve_pixels(rows: DataFrame, generated: DataFrame, sources: DataFrame, mirror: DataFrame) -> DataFrame:
    """rows with origin and expected digest of their pixels: generated (by sample_id; its digest isn't checked: null), else
    source (by sample_id, then scene_id), else mirror (by source_sample_id), else none. Each table is (key, sha256), a row a key."""
    t = lambda df, n: df.where(F.col("key").isNotNull()).select(F.col("key").alias(f"_k_{n}"), F.col("sha256").alias(f"_s_{n}"))
    j = rows.join(t(generated, "g"), F.col("sample_id") == F.col("_k_g"), "left").join(t(sources, "s"), F.col("sample_id") == F.col("_k_s"), "left")
    j = j.join(t(sources, "c"), F.col("scene_id") == F.col("_k_c"), "left").join(t(mirror, "m"), F.col("source_sample_id") == F.col("_k_m"), "left")
    has = lambda n: F.col(f"_k_{n}").isNotNull()
    origin = F.when(has("g"), "generated").when(has("s") | has("c"), "source").when(has("m"), "mirror").otherwise("none")
    want = F.when(has("g"), None).when(has("s"), F.col("_s_s")).when(has("c"), F.col("_s_c")).otherwise(F.col("_s_m"))
    return j.select(*rows.columns, origin.alias("origin"), want.alias("expected_sha256"))


def with_side(rows: DataFrame, split: DataFrame, scene: str = "scene_id") -> DataFrame:
    """rows with the side of their scene (J: lookup); split is (scene, side), broadcast only where its size allows."""
    return rows.join(broadcast_checked(split), scene, "left")


def parsed(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """df with the given columns beside its own; a clash keeps df's under its name and adds the part as <name>_part."""
    return df.select("*", *[c.alias(f"{n}_part" if n in df.columns else n) for n, c in parts.items()])
