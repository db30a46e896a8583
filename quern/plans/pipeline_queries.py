"""Queries of the general operators for training data: quality profile (p3), orphan references (p5), schema drift (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import drift, orphans, quality
from quern.plans.registry import Registry, table
from quern.plans.staging import broadcast_checked, stage

R = Registry()

#: A structured sample name, the ranges of the measures, and the least changes that are reported.
NAME = r"[a-z]{2}_[a-z_]+_f_[0-9]+_level_[1-9][0-9]*_(?:aligned|misaligned|shift_[0-9]+\.[0-9]px)"
NULLS_BY, SSIM_BY, K_BY = 0.12, 0.08, 1.7


def _in_range(name, v):
    return F.when(name == "calibration_ssim", v.between(0, 1)).otherwise((v > 0) & (v <= 200))


def _p3(spark: SparkSession, d: str) -> DataFrame:
    rows, runs = table(spark, d, "route_c"), table(spark, d, "route_c_stats")
    values = quality.unpivot(rows, "run_id", {"calibration_ssim": "calibration_ssim", "source_sample_id": "source_sample_id"}).unionByName(quality.unpivot(runs, "run_id", {"k_values": "k_values"}))
    previous = stage(runs.where("run_id is not null and prev_run_id is not null").groupBy(F.col("run_id").alias("load")).agg(F.max("prev_run_id").alias("prev_load")), "runs")
    numbers = quality.profile(quality.frequencies(values), previous, _in_range, NAME)
    both = stage(numbers, "profile").join(broadcast_checked(previous), "load", "left")
    old = both.select(F.col("load").alias("prev_load"), "column_name", (F.col("nulls") / F.col("rows")).alias("prev_null_share"), F.col("q_50").alias("prev_median"))
    return both.join(old, ["prev_load", "column_name"], "left").withColumn("null_share", F.col("nulls") / F.col("rows"))


_P3 = rf"""WITH v AS (SELECT run_id, 'calibration_ssim' AS column_name, calibration_ssim AS v FROM route_c WHERE run_id IS NOT NULL
  UNION ALL SELECT run_id, 'k_values', unnest(k_values) FROM route_c_stats),
f AS (SELECT *, v IS NOT NULL AND NOT isnan(v) AND CASE column_name WHEN 'calibration_ssim' THEN v >= 0 AND v <= 1 ELSE v > 0 AND v <= 200 END AS ok FROM v),
num AS (SELECT run_id, column_name, count(*) AS n, count(*) - count(v) AS nulls, count(DISTINCT v) AS dist,
  count(*) FILTER (v IS NOT NULL AND NOT ok) AS outside, CAST(quantile_cont(v, 0.5) FILTER (ok) AS DOUBLE) AS med, 0 AS breaches FROM f GROUP BY 1, 2),
str AS (SELECT run_id, 'source_sample_id' AS column_name, count(*) AS n, count(*) - count(source_sample_id) AS nulls, count(DISTINCT source_sample_id) AS dist,
  0 AS outside, NULL::DOUBLE AS med, count(*) FILTER (source_sample_id IS NOT NULL AND NOT regexp_full_match(source_sample_id, '{NAME}')) AS breaches
  FROM route_c WHERE run_id IS NOT NULL GROUP BY 1),
p AS (FROM num UNION ALL FROM str),
prev AS (SELECT run_id, max(prev_run_id) AS prev_run_id FROM route_c_stats WHERE prev_run_id IS NOT NULL GROUP BY 1),
x AS (SELECT p.*, o.nulls / o.n AS old_nulls, o.med AS old_med FROM p LEFT JOIN prev USING (run_id) LEFT JOIN p o ON o.run_id = prev.prev_run_id AND o.column_name = p.column_name)
"""


@R.query(_P3 + """SELECT run_id, column_name, 'range' AS issue FROM x WHERE outside > 0
UNION ALL SELECT run_id, column_name, 'pattern' FROM x WHERE breaches > 0
UNION ALL SELECT run_id, column_name, 'distinct' FROM x WHERE column_name <> 'source_sample_id' AND n > nulls AND 2 * dist <= n - nulls
UNION ALL SELECT run_id, column_name, 'nulls' FROM x WHERE nulls / n - old_nulls > 0.12
UNION ALL SELECT run_id, column_name, 'shift' FROM x WHERE CASE column_name WHEN 'calibration_ssim' THEN abs(med - old_med) > 0.08 WHEN 'k_values' THEN greatest(med / old_med, old_med / med) > 1.7 END""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = _p3(spark, d)
    number = F.col("column_name") != "source_sample_id"
    ratio = F.greatest(F.try_divide("q_50", "prev_median"), F.try_divide("prev_median", "q_50"))
    moved = F.when(F.col("column_name") == "calibration_ssim", F.abs(F.col("q_50") - F.col("prev_median")) > SSIM_BY).when(F.col("column_name") == "k_values", ratio > K_BY)
    tests = {
        "range": F.col("outside") > 0,
        "pattern": F.col("breaches") > 0,
        "distinct": number & (F.col("rows") > F.col("nulls")) & (2 * F.col("distincts") <= F.col("rows") - F.col("nulls")),
        "nulls": F.col("null_share") - F.col("prev_null_share") > NULLS_BY,
        "shift": moved,
    }
    issue = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))
    return p.select(F.col("load").alias("run_id"), "column_name", issue.alias("issue"))


@R.query(_P3 + "SELECT run_id, column_name, n AS rows_in, nulls, dist AS distincts, round(med, 9) AS median FROM p")
def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).select(F.col("load").alias("run_id"), "column_name", F.col("rows").alias("rows_in"), "nulls", "distincts", F.round("q_50", 9).alias("median"))


@R.query(_P3 + """, ends AS (SELECT run_id, column_name, min(v) FILTER (NOT isnan(v)) AS least, max(v) FILTER (NOT isnan(v)) AS most FROM f GROUP BY 1, 2)
SELECT p.run_id, p.column_name, least, most, CASE WHEN p.column_name <> 'source_sample_id' THEN outside END AS outside, CASE WHEN p.column_name = 'source_sample_id' THEN breaches END AS breaches
FROM p LEFT JOIN ends ON ends.run_id = p.run_id AND ends.column_name = p.column_name""")
def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges and pattern of p3_profile's rows; null where a column has none."""
    return _p3(spark, d).select(F.col("load").alias("run_id"), "column_name", "least", "most", "outside", "breaches")


@R.query("""WITH v AS (SELECT run_id, 'calibration_ssim' AS column_name, calibration_ssim AS v FROM route_c UNION ALL SELECT run_id, 'k_values', unnest(k_values) FROM route_c_stats),
f AS (SELECT * FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND abs(v) < 'infinity'::DOUBLE), prev AS (SELECT run_id, prev_run_id FROM route_c_stats WHERE prev_run_id IS NOT NULL),
m AS (SELECT f.run_id, column_name, v, 1 AS a, 0 AS b FROM f JOIN prev USING (run_id) UNION ALL SELECT prev.run_id, column_name, v, 0, 1 FROM f JOIN prev ON f.run_id = prev.prev_run_id),
g AS (SELECT run_id, column_name, v, sum(a) AS a, sum(b) AS b FROM m GROUP BY ALL),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER z AS na, sum(b) OVER z AS nb FROM g WINDOW w AS (PARTITION BY run_id, column_name ORDER BY v), z AS (PARTITION BY run_id, column_name))
SELECT run_id, column_name, round(max(abs(ca / na - cb / nb)), 9) AS ks FROM c GROUP BY 1, 2 HAVING max(na) > 0 AND max(nb) > 0""")
def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).where("ks is not null").select(F.col("load").alias("run_id"), "column_name", F.round("ks", 9).alias("ks"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.lower(F.btrim(F.col(c), F.lit(" \t")))
    ledger = table(spark, d, "generated_images")
    names = {"sample_id": ("manifest", "sample_id", "written_at"), "aif_ref": ("aif_images", "aif_ref", "enumerated_at"), "depth_sha256": ("depth_encodings", "sha256", "recorded_at")}
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), key(c).alias("key")) for c in names]))
    refs = ledger.select(F.col("ledger_id").alias("id"), F.col("recorded_at").alias("at"), pair.alias("p")).select("id", "at", "p.column_name", "p.key")
    parents = None
    for c, (t, k, since) in names.items():
        one = table(spark, d, t).select(F.lit(c).alias("column_name"), key(k).alias("key"), F.col(since).alias("since"), F.col("deleted_at").alias("until"))
        parents = one if parents is None else parents.unionByName(one)
    return orphans.orphan_references(refs, parents)


_P5 = r"""WITH r AS (SELECT ledger_id, recorded_at, unnest([{'c': 'sample_id', 'k': sample_id}, {'c': 'aif_ref', 'k': aif_ref}, {'c': 'depth_sha256', 'k': depth_sha256}], recursive := true) FROM generated_images),
q AS (SELECT ledger_id, recorded_at, c AS column_name, lower(trim(k, E' \t')) AS k FROM r WHERE k IS NOT NULL),
t AS (SELECT 'sample_id' AS column_name, lower(trim(sample_id, E' \t')) AS k, written_at AS s, deleted_at AS e FROM manifest
  UNION ALL SELECT 'aif_ref', lower(trim(aif_ref, E' \t')), enumerated_at, deleted_at FROM aif_images
  UNION ALL SELECT 'depth_sha256', lower(trim(sha256, E' \t')), recorded_at, deleted_at FROM depth_encodings),
x AS (SELECT q.ledger_id, q.column_name, any_value(q.recorded_at) AS recorded_at, count(t.k) AS rows_of, coalesce(bool_or(t.s <= q.recorded_at), false) AS begun,
  coalesce(bool_or(t.s <= q.recorded_at AND (t.e IS NULL OR t.e > q.recorded_at)), false) AS live FROM q LEFT JOIN t ON t.column_name = q.column_name AND t.k = q.k GROUP BY 1, 2),
o AS (SELECT ledger_id, column_name, recorded_at, CASE WHEN rows_of = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS ref_state FROM x WHERE NOT live)
"""


@R.query(_P5 + "SELECT ledger_id, column_name, ref_state FROM o")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select(F.col("id").alias("ledger_id"), "column_name", "ref_state")


@R.query(_P5 + "SELECT column_name, date_trunc('month', recorded_at)::TIMESTAMP AS month, ref_state, count(*) AS refs FROM o GROUP BY ALL")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).groupBy("column_name", F.date_trunc("month", "at").cast("timestamp_ntz").alias("month"), "ref_state").agg(F.count(F.lit(1)).alias("refs"))


#: The target schema of release metadata, and the keys under which an object holds the value of a scalar field.
META = {"sample_id": "string", "route": "string", "control_version": "string", "depth_layout": "string", "depth_backend": "string", "k_value": "double", "focus_disparity": "double",
        "image_h": "int", "image_w": "int", "is_k_censored": "boolean", "calibration_ssim": "double", "focus_source": "string"}
UNWRAP = ("v", "kind")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return stage(drift.ingest(table(spark, d, "release_meta_raw"), META), "rescue")


_P7 = r"""WITH RECURSIVE j AS (SELECT file_id, release_name, seq_no, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS p FROM release_meta_raw WHERE file_id IS NOT NULL AND release_name IS NOT NULL AND seq_no IS NOT NULL),
files AS (SELECT DISTINCT file_id, release_name, seq_no FROM j),
links AS (SELECT file_id AS f, lag(file_id) OVER (PARTITION BY release_name ORDER BY seq_no, file_id) AS p FROM files),
keys AS (SELECT file_id AS f, p, unnest(json_keys(p)) AS field FROM j WHERE p IS NOT NULL),
vals AS (SELECT DISTINCT f, field, CASE json_type(x) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind,
  CASE WHEN json_type(x) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') AND length(regexp_replace(x::VARCHAR, '[^0-9]', '', 'g')) < 16 THEN x::DOUBLE::VARCHAR WHEN json_type(x) <> 'NULL' THEN x::VARCHAR END AS v
  FROM (SELECT f, field, json_extract(p, '$."' || field || '"') AS x FROM keys)),
fields AS (SELECT f, field, list_sort(coalesce(list(DISTINCT kind) FILTER (kind IS NOT NULL), [])) AS kinds FROM vals GROUP BY 1, 2),
pair AS (SELECT coalesce(n.f, o.f) AS f, coalesce(n.p, o.p) AS p, coalesce(n.field, o.field) AS field, n.kinds AS kinds, o.kinds AS old_kinds
  FROM (SELECT l.f, l.p, field, kinds FROM links l JOIN fields ON fields.f = l.f WHERE l.p IS NOT NULL) n FULL JOIN (SELECT l.f, l.p, field, kinds FROM links l JOIN fields ON fields.f = l.p) o ON n.f = o.f AND n.field = o.field),
shared AS (SELECT DISTINCT a.f, a.field, b.field AS old FROM pair a JOIN vals x ON x.f = a.f AND x.field = a.field JOIN pair b ON b.f = a.f JOIN vals y ON y.f = b.p AND y.field = b.field AND y.kind = x.kind AND y.v = x.v
  WHERE a.old_kinds IS NULL AND b.kinds IS NULL)
"""
_META = ", ".join(f"('{f}', '{k}')" for f, k in META.items())
_NUMBER = r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,15})?$"


@R.query(_P7 + """SELECT DISTINCT f AS file_id, field AS field_name, 'renamed' AS change_kind FROM shared
UNION ALL SELECT f, field, 'added' FROM pair WHERE old_kinds IS NULL AND (f, field) NOT IN (SELECT (f, field) FROM shared)
UNION ALL SELECT f, field, 'removed' FROM pair WHERE kinds IS NULL AND (f, field) NOT IN (SELECT (f, old) FROM shared)
UNION ALL SELECT f, field, 'retyped' FROM pair WHERE len(kinds) > 0 AND len(old_kinds) > 0 AND kinds <> old_kinds""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.table_changes(_p7(spark, d), META)


@R.query()
def p7_table(spark: SparkSession, d: str) -> DataFrame:
    rescued = _p7(spark, d)
    return drift.replay(rescued, META, *drift.approve(rescued, META), UNWRAP)


@R.query(_P7 + rf""", meta(field, kind) AS (VALUES {_META}),
edges AS (SELECT field AS a, old AS b FROM shared UNION SELECT old, field FROM shared),
reach(target, name) AS (SELECT field, field FROM meta UNION SELECT r.target, e.b FROM reach r JOIN edges e ON e.a = r.name WHERE e.b NOT IN (SELECT field FROM meta)),
every AS (SELECT raw_id, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS p FROM release_meta_raw),
cells AS (SELECT raw_id, field, x, json_type(x) AS t, x ->> '$' AS said FROM (SELECT raw_id, field, json_extract(p, '$."' || field || '"') AS x FROM (SELECT raw_id, p, unnest(json_keys(p)) AS field FROM every WHERE p IS NOT NULL))),
types AS (SELECT field, CASE WHEN bool_and(t = 'VARCHAR') THEN 'string' WHEN bool_and(CASE WHEN t = 'VARCHAR' THEN regexp_matches(said, '{_NUMBER}') ELSE t IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') AND NOT regexp_matches(said, '^-?[0-9]{{16,}}$') END) THEN 'double'
  WHEN bool_and(CASE WHEN t = 'VARCHAR' THEN said IN ('true', 'false') ELSE t = 'BOOLEAN' END) THEN 'boolean' ELSE 'json' END AS kind FROM cells WHERE t <> 'NULL' GROUP BY 1),
wanted AS (SELECT name AS source, target, meta.kind FROM reach JOIN meta ON meta.field = reach.target UNION ALL SELECT field, field, coalesce(kind, 'json') FROM (SELECT DISTINCT field FROM cells) LEFT JOIN types USING (field) WHERE field NOT IN (SELECT name FROM reach)),
held AS (SELECT raw_id, w.*, x AS whole, t AS whole_t, CASE WHEN t = 'OBJECT' AND kind <> 'json' THEN coalesce(x -> '$.v', x -> '$.kind', x) ELSE x END AS x FROM cells JOIN wanted w ON w.source = cells.field WHERE t <> 'NULL'),
said AS (SELECT *, json_type(x) AS t, x ->> '$' AS said FROM held),
read AS (SELECT *, CASE WHEN kind IN ('double', 'int') AND (t IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') OR t = 'VARCHAR' AND regexp_matches(said, '{_NUMBER}')) AND NOT regexp_matches(said, '^-?[0-9]{{16,}}$') THEN try_cast(said AS DOUBLE) END AS d,
  CASE WHEN kind = 'json' THEN x::VARCHAR WHEN kind = 'string' AND t IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN regexp_replace(regexp_replace(said, '(\.[0-9]*?)0+$', '\1'), '\.$', '') WHEN kind = 'string' AND t NOT IN ('OBJECT', 'ARRAY') THEN said WHEN kind = 'boolean' AND t IN ('BOOLEAN', 'VARCHAR') THEN try_cast(said AS BOOLEAN)::VARCHAR WHEN kind = 'boolean' AND said IN ('0', '1') THEN (said = '1')::VARCHAR END AS s FROM said),
cast_as AS (SELECT raw_id, source, target, kind, whole_t, s AS text_value, CASE WHEN kind = 'double' OR d = floor(d) THEN d END AS number_value FROM read),
won AS (SELECT *, row_number() OVER (PARTITION BY raw_id, target ORDER BY source <> target, source) AS rn FROM cast_as WHERE text_value IS NOT NULL OR number_value IS NOT NULL),
gone AS (SELECT raw_id, source FROM won WHERE rn = 1 AND (kind = 'json' OR whole_t <> 'OBJECT') UNION SELECT raw_id, field FROM cells WHERE t = 'NULL')
SELECT raw_id, target AS field, text_value, number_value FROM won WHERE rn = 1
UNION ALL SELECT raw_id, 'rescued', NULL, count(*)::DOUBLE FROM cells WHERE (raw_id, field) NOT IN (SELECT (raw_id, source) FROM gone) GROUP BY 1
UNION ALL SELECT raw_id, 'rescued', payload, 1.0 FROM every WHERE p IS NULL AND payload IS NOT NULL""")
def p7_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of p7_table, a row for each: raw_id, field and its text or number; under rescued, how many fields stayed there,
    or a line that is no JSON object."""
    t, own = stage(p7_table(spark, d), "table"), table(spark, d, "release_meta_raw").columns
    none = {"text_value": F.lit(None).cast("string"), "number_value": F.lit(None).cast("double")}

    def cell(name: str, kind: str) -> F.Column:
        value = {"number_value": F.col(name).cast("double")} if kind in ("double", "int") else {"text_value": F.col(name).cast("string")}
        return F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("field"), *[c.alias(n) for n, c in {**none, **value}.items()]))

    line = F.get_json_object("rescued", "$._line")
    left = F.struct(F.lit("rescued").alias("field"), line.alias("text_value"), F.size(F.json_object_keys("rescued")).cast("double").alias("number_value"))
    cells = [cell(n, k) for n, k in t.dtypes if n not in own and n != "rescued"]
    return t.select("raw_id", F.explode(F.array_compact(F.array(*cells, F.when(F.col("rescued").isNotNull(), left)))).alias("c")).select("raw_id", "c.*")
