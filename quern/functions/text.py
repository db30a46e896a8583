"""Names, references and nested text: grammars as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammars of structured sample names and of table references.
NAME = r"\A([A-Za-z]+)_([A-Za-z_]+)_f_([0-9]+)_level_([0-9]+)_(aligned|misaligned|shift_([0-9]+(?:\.[0-9]+)?)px)\z"
REFERENCE = r"\A([^#]+)#([^\[\]]+)\[([0-9]+)\]\.((?s:.+))\z"
TRUE_WORDS = ["1", "true", "yes", "y", "sim", "s"]


def parse_name(c: Column | str) -> dict[str, Column]:
    """prefix, split, scene_no, level, alignment, shift_px and valid (the grammar holds and the level is at least 1); the parts
    are null for other names."""
    c = F.col(c) if isinstance(c, str) else c
    ok = F.coalesce(c.rlike(NAME), F.lit(False)) & F.coalesce(F.regexp_extract(c, NAME, 4).try_cast("int") >= 1, F.lit(False))
    part = lambda i: F.when(ok, F.nullif(F.regexp_extract(c, NAME, i), F.lit("")))
    return {
        "prefix": part(1),
        "split": part(2),
        "scene_no": part(3).try_cast("bigint"),
        "level": part(4).try_cast("int"),
        "alignment": F.when(part(5).startswith("shift_"), "shift").otherwise(part(5)),
        "shift_px": part(6).try_cast("double"),
        "valid": ok,
    }


def parse_reference(c: Column | str) -> dict[str, Column]:
    """kind and parts of a pixel reference: 'row' (repo#split[row].column), 'path' (holds a slash), 'column' (a bare name), or
    'malformed' (blank, or a # that doesn't fit); null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    row = c.rlike(REFERENCE)
    kind = F.when(c.isNull(), None).when(row, "row").when(c.contains("#") | (F.btrim(c) == ""), "malformed").when(c.contains("/"), "path").otherwise("column")
    part = lambda i: F.when(row, F.regexp_extract(c, REFERENCE, i))
    return {"kind": kind, "repo": part(1), "split": part(2), "row_no": part(3).try_cast("bigint"), "column_name": F.when(row, part(4)).when(kind == "column", c)}


def scene_of_image(c: Column) -> Column:
    """Scene of an image id: without _k<n>_d<n>, without _level_<n> and what follows, without the alignment."""
    c = F.regexp_replace(c, r"_k[0-9]+_d[0-9]+\z", "")
    c = F.regexp_replace(c, r"(?s)_level_[0-9]+.*\z", "")
    return F.regexp_replace(c, r"_(aligned|misaligned|shift_[0-9.]+px)\z", "")


def scene_of_key(c: Column) -> Column:
    """Scene of a key: what stands before "__"; else the first three parts of one that starts with ai_; else all of it."""
    parts = F.split(c, "_")
    return F.when(c.contains("__"), F.substring_index(c, "__", 1)).when(c.startswith("ai_") & (F.size(parts) >= 3), F.concat_ws("_", F.slice(parts, 1, 3))).otherwise(c)


def file_safe(c: Column) -> Column:
    """Whether a scene id can be a file name as it is: letters, digits, dot, dash and underscore, not starting with a dot."""
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9_-][A-Za-z0-9._-]*\z"), F.lit(False))


def depth_path(scene: Column, sample: Column, layout: Column) -> Column:
    """Path of a depth map by layout: per_scene or per_sample; null for any other."""
    return F.when(layout == "per_scene", F.format_string("depth/%s.png", scene)).when(layout == "per_sample", F.format_string("depth/%s/%s.png", scene, sample))


def sample_id(*parts: Column) -> Column:
    """Surrogate key of its parts; null if any is null."""
    ok = parts[0].isNotNull()
    for p in parts[1:]:
        ok = ok & p.isNotNull()
    return F.when(ok, F.concat_ws("_", *[p.cast("string") for p in parts]))


def label_parts(c: Column) -> dict[str, Column]:
    """origin, arm and seed of "origin__arm__seed_N"."""
    parts = F.split(c, "__")
    return {"origin": F.try_element_at(parts, F.lit(1)), "arm": F.try_element_at(parts, F.lit(2)), "seed": F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), r"\Aseed_([0-9]+)\z", 1).try_cast("int")}


def training_step(c: Column) -> Column:
    """Steps named by "-<n>k-" in a run's name, in ones; null without."""
    return F.regexp_extract(c, r"-([0-9]+)k-", 1).try_cast("int") * 1000


def first_of(doc: Column, *paths: str) -> Column:
    """The first of several JSON paths that a document has, as text."""
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


def truthy(c: Column) -> Column:
    """Whether a text means yes; null or anything else doesn't."""
    return F.coalesce(F.lower(F.btrim(c)).isin(TRUE_WORDS), F.lit(False))


def image_type(b: Column) -> Column:
    """png, jpeg, webp or bin by the first bytes of a binary."""
    head = F.hex(F.substring(b, 1, 4))
    return F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").when(head == "52494646", "webp").otherwise("bin")


def png_complete(b: Column) -> Column:
    """Whether a binary starts with PNG's signature and ends with its closing chunk."""
    return F.coalesce((F.hex(F.substring(b, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(b, -12, 12)) == "0000000049454E44AE426082"), F.lit(False))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the JSON of the given columns, with their names and order."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def local_number(c: Column, decimals: int) -> Column:
    """A number with dots between thousands and a comma before decimals."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def named_pairs(c: Column) -> Column:
    """map of the NAME=value pairs of a comma-separated text."""
    return F.str_to_map(c, F.lit(","), F.lit("="))


def chosen(c: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a text holds any of the one substrings (or there are none to hold) and none of the others; null doesn't."""
    held = lambda words: F.coalesce(*[F.nullif(F.contains(c, F.lit(w)), F.lit(False)) for w in words], F.lit(False))
    return c.isNotNull() & (held(include) if include else F.lit(True)) & ~held(exclude)


def first_substring(c: Column, labels: dict[str, str]) -> Column:
    """The label of the first of the substrings, in their order, that a text holds; null if none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(s)), label) for s, label in labels.items()])


def metadata_json(parts: dict[str, Column]) -> Column:
    """A JSON object of the parts in the order of their names, nulls kept; NaN and infinite numbers come as texts."""
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})


def known_prefix(df, name: str, ids, id_column: str):
    """df with the longest known id that is the name itself or the name without some of its last _parts; null if none is."""
    cand = F.transform(F.sequence(F.lit(1), F.size(F.split(name, "_"))), lambda k: F.concat_ws("_", F.slice(F.split(name, "_"), 1, k)))
    each = df.where(F.col(name).isNotNull()).select(name).distinct().withColumn("_c", F.explode(cand))
    hit = each.join(ids.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_c")).distinct(), "_c").groupBy(name).agg(F.max_by("_c", F.length("_c")).alias("known_id"))
    return df.join(hit, name, "left")


def longest_label(df, name: str, labels, prefix: str, label: str):
    """df with the label of the longest prefix that its name starts with. labels is a dimension of a few rows."""
    from quern.plans.staging import broadcast_checked

    dim = broadcast_checked(labels.select(F.col(prefix).alias("_p"), F.col(label).alias("_l")), 10_000)
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("_n")).distinct()
    hit = names.join(dim, F.col("_n").startswith(F.col("_p"))).groupBy("_n").agg(F.max_by("_l", F.struct(F.length("_p"), F.col("_p"))).alias("label"))
    return df.join(hit, df[name] == F.col("_n"), "left").drop("_n")
