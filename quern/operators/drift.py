"""Records whose fields drift from file to file: one typed table with a rescue column, and the changes between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.staging import spread, stage

#: Type of a promoted field that no scalar type holds: a string column of JSON texts.
JSON = "json"
#: Strings that hold a number, and whole numbers that a double may not give back.
_NUMBER, _LONG = r"\A-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,15})?\z", r"\A-?[0-9]{16,}\z"
#: Lines that may hold a number out of the range or precision of doubles and decimals.
_ODD = r"[0-9]{36}|[0-9][eE][+-]?[0-9]{3}"


def _with_texts(df: DataFrame, json: str, name: str) -> DataFrame:
    """df with the fields of a JSON object as a map of field -> JSON text; null if json isn't an object."""
    plain = lambda k, x: F.to_json(x)
    size = lambda x: F.try_variant_get(x, "$", "double")
    odd = lambda k, x: F.when(F.schema_of_variant(x) != "DOUBLE", F.to_json(x)).when(size(x) == float("inf"), "1e999").when(size(x) == float("-inf"), "-1e999").otherwise(F.to_json(x))
    parsed = df.withColumn(name, F.try_parse_json(F.col(json)))
    parsed = parsed.withColumn(name, F.when(F.schema_of_variant(name).startswith("OBJECT"), F.col(name)).cast("map<string,variant>"))
    return parsed.withColumn(name, F.when(F.col(json).rlike(_ODD), F.transform_values(name, odd)).otherwise(F.transform_values(name, plain)))


def _object(fields: Column) -> Column:
    """The JSON object of a map of name -> JSON text, null if it is empty."""
    quoted = lambda k: F.when(k.rlike(r"\A[\w .-]*\z"), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.regexp_extract(F.to_json(F.array(k)), r"(?s)\A\[(.*)\]\z", 1))
    parts = F.transform(F.map_entries(fields), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.when(F.size(fields) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def _kind(text: Column) -> Column:
    """JSON type of a JSON text: string, number, boolean, object, array, or null for a JSON null."""
    first = F.substring(text, 1, 1)
    return (
        F.when(text == "null", F.lit(None).cast("string"))
        .when(first == '"', "string")
        .when(text.isin("true", "false"), "boolean")
        .when(first == "{", "object")
        .when(first == "[", "array")
        .otherwise("number")
    )


def _unquoted(text: Column) -> Column:
    escaped = F.contains(text, F.lit("\\"))
    return F.when(escaped, F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def _spelled(number: Column) -> Column:
    """One spelling for each number: 1, 1.0 and 1e0 are equal."""
    return F.regexp_replace(number.cast("string"), r"\.0\z", "")


def _finite(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when((F.abs(x) < float("inf")) & ~text.rlike(_LONG), x)


def _whole(x: Column, kind: str) -> Column:
    return F.when((x == F.floor(x)) & (F.abs(x) < float(1 << 31 if kind == "int" else 1 << 53)), x)


def _strict(text: Column, kind: str) -> Column:
    """The value of a JSON text of the very type; null otherwise."""
    is_a = _kind(text)
    if kind == "string":
        return F.when(is_a == "string", _unquoted(text))
    if kind == "boolean":
        return F.when(is_a == "boolean", text == "true")
    x = F.when(is_a == "number", _finite(text))
    return (_whole(x, kind) if kind != "double" else x).cast(kind)


def _free(name: str, ending: str, taken: set[str]) -> str:
    """name, or name with an ending that makes it differ from all taken names by more than case; it is taken from then on."""
    free, n = name, 2
    while free.lower() in taken:
        free, n = (name if "{}" in ending else free) + ending.format(n), n + 1
    taken.add(free.lower())
    return free


def _names(fields: list[str], own: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Column names of the fields and of the table's own columns: of fields that differ in case only the first keeps its name,
    the others end in _2 and so on; an own column named like a field, or like a rescue column, ends in _in."""
    taken = {"rescued", "rescued_line"}
    return {f: _free(f or "_", "_{}", taken) for f in fields}, {c: _free(c, "_in", taken) for c in own}


def ingest(df: DataFrame, schema: dict[str, str], payload: str = "payload") -> DataFrame:
    """The rescue table: the columns of df but payload, a typed column for each field of schema, ``rescued`` and ``rescued_line``.

    schema: field -> type (string, double, int, bigint or boolean), which is enforced: a value of another type, one that the
    type doesn't hold, a JSON null, and every field that schema doesn't name, goes to ``rescued``, a JSON object. A line that
    isn't a JSON object, or that may hold a number beyond doubles and decimals, is kept whole in ``rescued_line``. No value
    is lost, no field of a record is forgotten; write the table, and replay() can promote fields of it at any later time.

    A null line gives nulls. A column of df named like a field or like these two is called "<name>_in".
    """
    fields, own = _names(list(schema), [c for c in df.columns if c != payload])
    base = spread(df.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(payload).alias("__line")))
    base = _with_texts(base, "__line", "__m")
    base = base.select("*", *[F.try_element_at("__m", F.lit(f)).alias(f"__x{i}") for i, f in enumerate(schema)])
    base = base.select("*", *[_strict(F.col(f"__x{i}"), k).alias(f"__t{i}") for i, k in enumerate(schema.values())])
    held = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"__t{i}").isNotNull(), F.lit(f)) for i, f in enumerate(schema)]))
    left = F.map_filter("__m", lambda k, v: ~F.array_contains(held, k))
    line = F.when(F.col("__m").isNull() | F.col("__line").rlike(_ODD), F.col("__line"))
    return base.select(*own.values(), *[F.col(f"__t{i}").alias(n) for i, n in enumerate(fields.values())], _object(left).alias("rescued"), line.alias("rescued_line"))


def field_values(table: DataFrame, schema: dict[str, str], keep: list[str]) -> DataFrame:
    """keep, field, kind and value: a row for each field of each record of a rescue table, kept and rescued ones.

    value is the JSON text, of a string the string itself, null for a JSON null; numbers come in one spelling, so that 1 and
    1.0 are equal. Lines that aren't JSON objects give no row.
    """
    names, _ = _names(list(schema), [])
    kinds = {"string": "string", "boolean": "boolean"}
    one = lambda field, kind, text: F.struct(F.lit(field).alias("field"), F.lit(kind).cast("string").alias("is_a"), text.alias("text"))
    kept = [F.when(F.col(names[f]).isNotNull(), one(f, kinds.get(k, "number"), F.col(names[f]).cast("string"))) for f, k in schema.items()]
    none = F.array().cast("array<struct<field:string,is_a:string,text:string>>")
    rest = F.transform(F.map_entries("__m"), lambda e: F.struct(e["key"].alias("field"), F.lit(None).cast("string").alias("is_a"), e["value"].alias("text")))
    each = F.explode(F.concat(F.array_compact(F.array(*kept)) if kept else none, F.coalesce(rest, none))).alias("__e")
    flat = _with_texts(table, "rescued", "__m").select(*keep, each).select(*keep, "__e.*").withColumn("kind", F.coalesce("is_a", _kind(F.col("text"))))
    text, kind = F.col("text"), F.col("kind")
    number = F.when(text.rlike(_LONG), text).otherwise(_spelled(F.coalesce(text.try_cast("double").cast("string"), text)))
    value = F.when(kind == "string", F.when(F.col("is_a").isNull(), _unquoted(text)).otherwise(text)).when(kind == "number", number).when(kind.isNotNull(), text)
    return flat.select(*keep, "field", "kind", value.alias("value"))


def _presence(table: DataFrame, schema: dict[str, str], group: str, order: str, file: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of each file against the one before: fields come, fields gone, all fields with their types, and the pairs of a field
    come and a field gone that share a value; and all distinct values. table: a rescue table, staged."""
    own = _names(list(schema), [group, order, file])[1]
    named = F.col(own[file]).isNotNull() & F.col(own[group]).isNotNull() & F.col(own[order]).isNotNull()
    table = table.withColumn("f", F.when(named, F.col(own[file])))
    files = table.where("f is not null").select("f", F.col(own[group]).alias("g"), F.col(own[order]).alias("o")).distinct()
    links = stage(files.select("f", F.lag("f").over(Window.partitionBy("g").orderBy("o", "f")).alias("p")), "files").where("p is not null")
    values = stage(field_values(table, schema, ["f"]).distinct(), "fields")
    fields = stage(values.where("f is not null").groupBy("f", "field").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), "kinds")
    now = links.join(fields, "f")
    before = links.join(fields.select(F.col("f").alias("p"), F.col("field"), F.col("kinds").alias("old_kinds")), "p")
    both = stage(now.join(before, ["f", "p", "field"], "full"), "both")
    come, gone = both.where("old_kinds is null").select("f", "p", "field"), both.where("kinds is null").select("f", "p", F.col("field").alias("old"))
    known = values.where("value is not null").select("f", "field", "kind", "value")
    new_values = come.join(known, ["f", "field"]).distinct()
    old_values = gone.join(known.select(F.col("f").alias("p"), F.col("field").alias("old"), "kind", "value"), ["p", "old"]).distinct()
    return come, gone, both, stage(new_values.join(old_values, ["f", "p", "kind", "value"]).select("f", "field", "old").distinct(), "shared"), values


def table_changes(table: DataFrame, schema: dict[str, str], group: str = "release_name", order: str = "seq_no", file: str = "file_id") -> DataFrame:
    """(file, field_name, change_kind): each file's changes against the file of its group with the next smaller order number,
    of the fields of a rescue table (see ingest), staged.

    A file has a field if any of its records has the key. A field gone and a new one that share a non-null value are
    ``renamed``, under the new name; other new ones are ``added``, others gone ``removed``. ``retyped``: in both files with
    non-null values, of different sets of JSON types. The first file of a group has no changes. Lines that aren't JSON
    objects are ignored, though their file counts; a file without any object has no fields. Files with a null group, order
    or file are left out; of files with one order number the smaller id comes first. Repeated lines change nothing.

    The records are aggregated to distinct (file, field, type, value), and files compared by their fields and, for fields
    that came or went only, by values; no step holds a file in one task.
    """
    come, gone, both, shared, _ = _presence(table, schema, group, order, file)
    renamed = shared.select("f", "field").distinct().withColumn("change_kind", F.lit("renamed"))
    added = come.join(shared, ["f", "field"], "left_anti").select("f", "field", F.lit("added").alias("change_kind"))
    removed = gone.join(shared, ["f", "old"], "left_anti").select("f", F.col("old").alias("field"), F.lit("removed").alias("change_kind"))
    retyped = both.where("size(kinds) > 0 and size(old_kinds) > 0 and kinds <> old_kinds").select("f", "field", F.lit("retyped").alias("change_kind"))
    out = renamed.unionByName(added).unionByName(removed).unionByName(retyped)
    return out.select(F.col("f").alias(file), F.col("field").alias("field_name"), "change_kind")


def schema_changes(df: DataFrame, group: str = "release_name", order: str = "seq_no", file: str = "file_id", payload: str = "payload", schema: dict[str, str] | None = None) -> DataFrame:
    """table_changes of the records of df, ingested and staged first."""
    return table_changes(stage(ingest(df, schema or {}, payload), "rescue"), schema or {}, group, order, file)


def approve(table: DataFrame, schema: dict[str, str], group: str = "release_name", order: str = "seq_no", file: str = "file_id", max_fields: int = 500) -> tuple[dict[str, str], dict[str, str]]:
    """(promoted, aliases) for replay, from a rescue table, staged: other names of a schema field, as found by renames over any
    number of files, are its aliases; all other fields are promoted: with a scalar type if it holds all their values, those
    that came as strings among them, else as JSON.

    Only names, their types and their renames reach the driver. More than max_fields names are an error: one table can't have a
    column for each.
    """
    *_, shared, values = _presence(table, schema, group, order, file)
    is_text = F.col("kind") == "string"
    fits = {
        "string": is_text,
        "double": F.when(is_text, F.col("value").rlike(_NUMBER)).otherwise((F.col("kind") == "number") & ~F.col("value").rlike(_LONG) & (F.abs(F.col("value").try_cast("double")) < float("inf"))),
        "boolean": F.when(is_text, F.col("value").isin("true", "false")).otherwise(F.col("kind") == "boolean"),
    }
    types = [F.when(F.bool_and(ok), kind) for kind, ok in fits.items()]  # a field of strings only is a string, whatever they look like
    known = values.groupBy("field").agg(F.coalesce(*types, F.lit(JSON)).alias("type"))
    fields = {r["field"]: r["type"] for r in known.limit(max_fields + 1).collect()}
    if len(fields) > max_fields:
        raise ValueError(f"more than {max_fields} field names")
    pairs = [(r["field"], r["old"]) for r in shared.groupBy("field", "old").count().orderBy(F.desc("count"), "field", "old").collect()]
    target, before = {f: f for f in schema}, -1
    while before < len(target):  # until no rename reaches another name
        before = len(target)
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x in target and y not in target:
                    target[y] = target[x]
    aliases = {f: t for f, t in target.items() if f not in schema and f in fields}
    promoted = {f: k for f, k in fields.items() if f not in target}
    return dict(sorted(promoted.items())), dict(sorted(aliases.items()))


def approve_fields(df: DataFrame, schema: dict[str, str], group: str = "release_name", order: str = "seq_no", file: str = "file_id", payload: str = "payload", max_fields: int = 500) -> tuple[dict[str, str], dict[str, str]]:
    """approve for the records of df, ingested and staged first."""
    return approve(stage(ingest(df, schema, payload), "rescue"), schema, group, order, file, max_fields)


def replay(table: DataFrame, schema: dict[str, str], promoted: dict[str, str], aliases: dict[str, str], unwrap: tuple[str, ...] = ()) -> DataFrame:
    """A rescue table (see ingest) with a typed column for each field of promoted too, filled from what it stored in ``rescued``.

    A field of promoted becomes a column of its type; a rescued value of a schema field, or of a field of aliases (other name
    -> target field), fills its target where that is null, the field's own name first, then its aliases in their order. A
    number or boolean that came as a string is cast once more, as are 0 and 1 to booleans, and the scalar that an object holds
    under a key of unwrap. What is replayed leaves ``rescued``, as do JSON nulls of these fields; an object read as a scalar
    stays, and so does the loser of two values for one column. ``rescued`` is null if nothing is left; a line that was kept
    whole is its entry "_line". No value is lost.

    A number that fills a string column comes in its shortest spelling (2, not 2.0). A field of promoted with the type JSON
    becomes a string column of its values' JSON texts. Types are string, double, int,
    bigint, boolean and JSON. The records' lines aren't read again, so that fields can be approved long after the ingestion.
    """
    wanted = {**schema, **promoted}
    fields, before = _names(list(wanted), [])[0], _names(list(schema), [])[0]
    own = [c for c in table.columns if c not in [*before.values(), "rescued", "rescued_line"]]
    own_as = _names(list(wanted), own)[1]
    sources = {f: [f, *[a for a, t in aliases.items() if t == f and a not in wanted]] for f in wanted}
    kinds = {s: wanted[f] for f, names in sources.items() for s in names}
    lookup = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.create_map().cast("map<string,string>")

    def inner(text: Column) -> Column:
        held = F.coalesce(*[F.to_json(F.try_variant_get(F.try_parse_json(text), f'$["{u}"]', "variant")) for u in unwrap])
        return F.when(F.startswith(text, F.lit("{")), F.coalesce(held, text)).otherwise(text)

    def said(text: Column) -> Column:
        is_a = _kind(text)
        return F.struct(is_a.alias("is_a"), F.when(is_a == "string", _unquoted(text)).when(is_a.isin("number", "boolean"), text).alias("said"), text.alias("text"))

    def cast(x: Column, kind: Column) -> Column:
        is_a, text = x["is_a"], x["said"]
        true = F.when(is_a == "number", F.when(text.isin("0", "1"), text == "1")).otherwise(text.try_cast("boolean"))
        number = F.when(kind.isin("double", "int", "bigint") & ((is_a == "number") | ((is_a == "string") & text.rlike(_NUMBER))), _finite(text))
        return F.struct(F.when(kind == "string", text).when(kind == JSON, x["text"]).alias("s"), number.alias("d"), F.when(kind == "boolean", true).alias("b"))

    base = table.select(*[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(own)], *[F.col(f"`{n}`").alias(f"__t{i}") for i, n in enumerate(before.values())], F.col("rescued_line").alias("__line"), F.col("rescued").alias("__rescued"))
    base = _with_texts(base, "__rescued", "__m")
    known = F.array(*[F.lit(s) for s in kinds] or [F.lit(None).cast("string")])
    asked = F.map_filter("__m", lambda k, v: F.array_contains(known, k) & (v != "null"))
    base = base.withColumn("__c", F.transform_values(asked, lambda k, v: F.when(F.try_element_at(lookup, k) == JSON, v).otherwise(inner(v))) if unwrap else asked)
    base = base.withColumn("__c", F.transform_values("__c", lambda k, v: said(v)))
    base = base.withColumn("__c", F.transform_values("__c", lambda k, v: cast(v, F.try_element_at(lookup, k))))
    cell = lambda s: F.try_element_at("__c", F.lit(s))
    part = lambda s, kind: {"string": cell(s)["s"], JSON: cell(s)["s"], "boolean": cell(s)["b"], "double": cell(s)["d"]}.get(kind, _whole(cell(s)["d"], kind))
    base = base.select("*", *[part(s, kind).alias(f"__v{i}") for i, (s, kind) in enumerate(kinds.items())])
    value = {s: F.col(f"__v{i}") for i, s in enumerate(kinds)}
    typed, used = {}, []
    for f, kind in wanted.items():
        tries = [F.col(f"__t{list(schema).index(f)}")] if f in schema else []
        for s in sources[f]:
            free = [x.isNull() for x in tries]
            won = value[s].isNotNull()
            for x in free:
                won = won & x
            if kind != JSON:
                won = won & ~F.startswith(F.try_element_at("__m", F.lit(s)), F.lit("{"))
            used.append(F.when(won | (F.try_element_at("__m", F.lit(s)) == "null"), F.lit(s)))
            tries.append(value[s].cast({JSON: "string"}.get(kind, kind)))
        typed[f] = F.coalesce(*tries)
    gone = F.array_compact(F.array(F.lit(None).cast("string"), *used))
    left = F.map_filter("__m", lambda k, v: ~F.array_contains(gone, k))
    line = F.create_map(F.lit("_line"), F.regexp_extract(F.to_json(F.array("__line")), r"(?s)\A\[(.*)\]\z", 1))
    rest = F.when(F.col("__line").isNull(), left).when(F.col("__m").isNull(), line).otherwise(F.map_concat(F.map_filter(left, lambda k, v: k != "_line"), line))
    return base.select(*[F.col(f"__o{i}").alias(own_as[c]) for i, c in enumerate(own)], *[typed[f].alias(n) for f, n in fields.items()], _object(rest).alias("rescued"))


def rescue_ingest(df: DataFrame, schema: dict[str, str], promoted: dict[str, str], aliases: dict[str, str], payload: str = "payload", unwrap: tuple[str, ...] = ()) -> DataFrame:
    """ingest, written to the shared folder, and replay of what it stored."""
    return replay(stage(ingest(df, schema, payload), "rescue"), schema, promoted, aliases, unwrap)
