"""The pN_ queries of the operators for training data, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.keys import K, record_name
from quern.llm import chunking, cutoff, leaks, mixing, scores, splits, tokens, topn
from quern.operators.skew import salted_join
from quern.plans.staging import broadcast_checked, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_K = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_RECORD = _K.format(r"regexp_replace(regexp_replace(trim(source_sample_id, E' \t\r\n'), '^(?s:.*)/', ''), '\.(jpe?g|png|tif|webp)$', '', 'i')")
_SCORES = """scores AS (SELECT image_id, laplacian_variance AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id
  ORDER BY measured_at DESC NULLS LAST, measurement_id DESC) rn FROM sharpness
  WHERE image_id IS NOT NULL AND NOT isnan(laplacian_variance) AND laplacian_variance >= 0 AND laplacian_variance < 'infinity'::DOUBLE) WHERE rn = 1)"""


def _scored(spark: SparkSession, d: str, *columns: str | F.Column) -> DataFrame:
    images = table(spark, d, "aif_images").select("image_id", *columns)
    return images.join(scores.latest_scores(table(spark, d, "sharpness")), "image_id")


@query(f"""WITH {_SCORES}, ranked AS (SELECT image_id, {_K.format('scene_id')} AS scene, sha256, score,
  row_number() OVER (PARTITION BY {_K.format('scene_id')} ORDER BY score DESC, sha256 ASC NULLS LAST, image_id ASC) AS rank_no
  FROM aif_images JOIN scores USING (image_id) WHERE scene_id IS NOT NULL)
SELECT image_id, CAST(rank_no AS INTEGER) AS rank_no FROM ranked WHERE rank_no <= 3""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_top(spark, d).select("image_id", "rank_no")


@query(f"""WITH {_SCORES}, ranked AS (SELECT {_K.format('scene_id')} AS scene, image_id, sha256, score,
  row_number() OVER (PARTITION BY {_K.format('scene_id')} ORDER BY score DESC, sha256 ASC NULLS LAST, image_id ASC) AS rank_no
  FROM aif_images JOIN scores USING (image_id) WHERE scene_id IS NOT NULL)
SELECT scene, image_id, sha256, score, CAST(rank_no AS INTEGER) AS rank_no FROM ranked WHERE rank_no <= 3""")
def p1_top(spark: SparkSession, d: str) -> DataFrame:
    rows = stage(_scored(spark, d, K("scene_id").alias("scene"), "sha256").where(F.col("scene").isNotNull()), "scored")
    order = [F.col("score").desc(), F.col("sha256").asc_nulls_last(), F.col("image_id").asc()]
    return topn.top_n_per_group(rows, "scene", order, 3).select("scene", "image_id", "sha256", "score", "rank_no")


_CUT = f"""WITH {_SCORES}, wanted AS (SELECT {_K.format('source_dataset')} AS source, max(keep_fraction) AS keep_fraction FROM source_targets GROUP BY 1),
images AS (SELECT image_id, {_K.format('source_dataset')} AS source, score FROM aif_images JOIN scores USING (image_id)),
ranked AS (SELECT source, score, keep_fraction, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY score DESC) AS r FROM images JOIN wanted USING (source)),
cut AS (SELECT source, keep_fraction, n, CAST(ceil(keep_fraction * n) AS BIGINT) AS k, score AS cutoff FROM ranked WHERE r = ceil(keep_fraction * n))
"""


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "source_targets").select(K("source_dataset").alias("source"), "keep_fraction")
    images = stage(_scored(spark, d, K("source_dataset").alias("source")).where(F.col("source").isNotNull()), "scored")
    return images, cutoff.fraction_cutoffs(images, targets)


@query(_CUT + "SELECT image_id FROM images JOIN cut USING (source) WHERE score >= cutoff")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    images, cut = _p6(spark, d)
    return cutoff.keep_above(images, stage(cut, "cutoffs")).select("image_id")


@query(_CUT + "SELECT source, keep_fraction, n, k, cutoff, (SELECT count(*) FROM images i WHERE i.source = cut.source AND i.score >= cut.cutoff) AS kept FROM cut")
def p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)[1].select("source", "keep_fraction", "n", "k", "cutoff", "kept")


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = F.concat(F.lit("#"), F.col("image_id").cast("string"))
    source = K("source_dataset")
    tie = F.concat(source, F.lit("|"), record_name("source_sample_id"))
    rows = table(spark, d, "aif_images").select("image_id", F.coalesce(K("scene_id"), own).alias("node"), tie.alias("tie"), source.alias("label"))
    rows = stage(rows, "images")
    targets = [(r["side"], r["fraction"]) for r in table(spark, d, "split_targets").collect()]
    return rows, *splits.group_split(rows, targets)


_TIES = f"""WITH RECURSIVE e AS (SELECT DISTINCT {_K.format('source_dataset')} || '|' || {_RECORD} AS r,
  {_K.format('scene_id')} AS s FROM aif_images WHERE scene_id IS NOT NULL AND source_dataset IS NOT NULL AND source_sample_id IS NOT NULL),
t AS (SELECT DISTINCT a.s AS x, b.s AS y FROM e a JOIN e b USING (r) WHERE a.s <> b.s),
reach AS (SELECT x, y FROM t UNION SELECT reach.x, t.y FROM reach JOIN t ON reach.y = t.x)
"""


@query(_TIES + "SELECT x AS scene_a, y AS scene_b FROM reach WHERE x < y")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tied = _p2(spark, d)[2].where(~F.col("node").startswith("#"))
    a, b = tied.withColumnRenamed("node", "scene_a"), tied.withColumnRenamed("node", "scene_b")
    return salted_join(stage(a, "tied"), b, ["component", "side"]).where("scene_a < scene_b").select("scene_a", "scene_b")


@query()
def p2_split(spark: SparkSession, d: str) -> DataFrame:
    rows, nodes, _ = _p2(spark, d)
    return salted_join(rows, nodes, ["node"]).select("image_id", "component", "side")


@query()
def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    got = p2_split(spark, d).groupBy("side").agg(F.count(F.lit(1)).alias("images"), F.countDistinct("component").alias("components"))
    all_of = got.agg(F.sum("images").alias("total"))
    wanted = table(spark, d, "split_targets")
    return wanted.join(got, "side", "left").join(F.broadcast(all_of)).select("side", "fraction", "images", "components", (F.col("images") / F.col("total")).alias("share"))


def _p4_rows(spark: SparkSession, d: str) -> DataFrame:
    form = r"\A[^#]+#([^\[\]]+)\[[0-9]+\]\.(?s:.+)\z"
    ref = F.col("aif_ref")
    split = F.when(F.coalesce(ref.rlike(form), F.lit(False)), F.regexp_extract(ref, form, 1)).otherwise(F.col("source_split"))
    names = table(spark, d, "split_names").where("spelling is not null and side is not null").groupBy("spelling").agg(F.min("side").alias("side"))
    images = table(spark, d, "aif_images").withColumn("spelling", F.lower(F.btrim(split, F.lit(" \t\r\n"))))
    rows = images.join(broadcast_checked(names), "spelling", "left")
    return stage(rows.select(F.col("image_id").alias("id"), "side", "sha256", "thumb", K("source_dataset").alias("source"), K("scene_id").alias("scene")), "sides")


_PAIRS = r"""WITH n AS (SELECT DISTINCT spelling, side FROM split_names), i AS (SELECT image_id, sha256, thumb, source_dataset, scene_id, side FROM (SELECT *, lower(trim(CASE
  WHEN regexp_full_match(aif_ref, '[^#]+#[^\[\]]+\[[0-9]+\]\..+') THEN regexp_extract(aif_ref, '#([^\[\]]+)\[', 1) ELSE source_split END, E' \t\r\n')) AS spelling FROM aif_images) JOIN n USING (spelling)),
a AS (FROM i WHERE side <> 'train'), b AS (FROM i WHERE side = 'train'), pairs AS (
SELECT a.image_id AS x, b.image_id AS y, a.image_id AS e, true AS same FROM a JOIN b USING (sha256)
UNION SELECT a.image_id, b.image_id, a.image_id, coalesce(a.sha256 = b.sha256, false) FROM a JOIN b ON abs(list_sum(a.thumb) - list_sum(b.thumb)) <= 256 AND list_sum(list_transform(list_zip(a.thumb, b.thumb), lambda z: abs(z[1] - z[2]))) <= 256)
"""
#: The same chunks as content_chunks cuts, by their values.
_CHUNKS = """, q AS (SELECT image_id, side, list_transform(thumb, lambda v: v // 16) AS q FROM i WHERE thumb IS NOT NULL),
cut AS (SELECT image_id, side, q, list_reduce(list_transform(list_prepend(0, list_filter(range(4, 64), lambda i: (q[i] + 17 * q[i - 1] + 289 * q[i - 2] + 4913 * q[i - 3]) * 2654435761 % 4294967296 < 536870912)), lambda i: [i]),
  lambda s, i: CASE WHEN i[1] - s[len(s)] >= 4 THEN list_concat(s, i) ELSE s END) AS cuts FROM q),
chunk AS (SELECT image_id, side, q[k + 1 : coalesce(cuts[j + 1], 64)] AS c FROM (SELECT *, unnest(cuts) AS k, generate_subscripts(cuts, 1) AS j FROM cut)),
over AS (SELECT image_id, sum(CASE WHEN c IN (SELECT c FROM chunk WHERE side = 'train') THEN len(c) ELSE 0 END) AS shared, sum(len(c)) AS cells FROM chunk WHERE side <> 'train' GROUP BY 1)
"""


@query(_PAIRS + "SELECT least(x, y) AS image_a, greatest(x, y) AS image_b FROM pairs")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = leaks.cross_split_pairs(_p4_rows(spark, d))
    return pairs.select(F.least("eval_id", "train_id").alias("image_a"), F.greatest("eval_id", "train_id").alias("image_b")).distinct()


@query(_PAIRS + _CHUNKS + f""", per AS (SELECT e, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS near FROM pairs GROUP BY 1)
SELECT side, {_K.format('source_dataset')} AS source, {_K.format('scene_id')} AS scene, count(*) AS images, count(e) AS leaked, CAST(coalesce(sum(same), 0) AS BIGINT) AS same_pairs, CAST(coalesce(sum(near), 0) AS BIGINT) AS near_pairs,
  round(sum(shared) / sum(cells), 9) AS overlap FROM a LEFT JOIN per ON e = image_id LEFT JOIN over USING (image_id) GROUP BY 1, 2, 3 HAVING count(e) > 0""")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation images with partners in training, per side, source and scene; overlap: the share of their cells in chunks that training has."""
    rows = _p4_rows(spark, d)
    e, r = rows.where(F.col("side").isNotNull() & (F.col("side") != "train")), rows.where(F.col("side") == "train")
    cells = lambda df: df.select("id", F.col("thumb").alias("cells"))
    hit = leaks.cross_split_counts(rows).withColumn("hit", F.lit(1))
    j = e.join(hit, "id", "left").join(leaks.chunk_overlaps(cells(e), cells(r)), "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = j.groupBy("side", "source", "scene").agg(F.count(F.lit(1)).alias("images"), F.count("hit").alias("leaked"), total("same").alias("same_pairs"), total("near").alias("near_pairs"), F.round(F.try_divide(F.sum("shared"), F.sum("cells")), 9).alias("overlap"))
    return out.where("leaked > 0")


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    coded = tokens.encode_texts(table(spark, d, "documents").select("doc_id", "source", "text"))
    docs = stage(coded.select(F.col("doc_id").alias("id"), "source", F.size("ids").alias("n_tokens")), "sizes")
    targets = [(r["source"], r["weight"], r["max_repeats"]) for r in table(spark, d, "mix_targets").collect()]
    return mixing.mix_sources(docs, targets)


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0].withColumnRenamed("id", "doc_id")


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1]


@query()
def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r["limit_id"], r["max_tokens"], r["overlap_tokens"]) for r in table(spark, d, "chunk_limits").orderBy("limit_id").collect()]
    return chunking.split_long(table(spark, d, "documents").select("doc_id", "text"), limits)
