"""Orphan references and schema drift against brute force; every kind of row at least once."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import drift, orphans

T0 = datetime(2025, 1, 1)


@pytest.mark.parametrize("max_bits", [64, 1 << 20])
def test_orphans_against_brute_force(spark, max_bits):
    random.seed(13)
    day = lambda: T0 + timedelta(days=random.randint(0, 20))
    parents, refs = [], []
    for _ in range(900):
        k = random.choice([f"k{random.randint(0, 60)}", "hot", "hot", "ended", None])
        since = random.choice([day(), day(), None])
        until = day() if k == "ended" or random.random() < 0.4 else None
        parents.append((random.choice("pq"), k, since, until, "extra"))
    for i in range(1500):
        refs.append((i // 2 if i % 50 == 0 else i, random.choice("pqr"), random.choice([f"k{random.randint(0, 90)}", "hot", "ended", "", None]), random.choice([day(), None]), "mine", 1))
    want = []
    for r in refs:
        if r[2] is None:
            continue
        rows = [p for p in parents if (p[0], p[1]) == (r[1], r[2])]
        begun = [p for p in rows if r[3] and p[2] and p[2] <= r[3]]
        if any(p[3] is None or p[3] > r[3] for p in begun):
            continue
        want.append((r[0], r[1], r[2], r[3], "missing" if not rows else "deleted" if begun else "late"))
    a = spark.createDataFrame(refs, "id int, column_name string, key string, at timestamp_ntz, ref_state string, since int")
    b = spark.createDataFrame(parents, "column_name string, key string, since timestamp_ntz, until timestamp_ntz, other string")
    got = orphans.orphan_references(a, b, max_bits=max_bits)
    order = lambda x: tuple(map(str, x))
    assert sorted([(r["id"], r["column_name"], r["key"], r["at"], r["ref_state"]) for r in got.collect()], key=order) == sorted(want, key=order)
    assert {w[4] for w in want} == {"missing", "deleted", "late"}


@pytest.mark.parametrize("max_bits", [64, 1 << 24])
def test_filter_lets_every_key_and_few_others_through(spark, max_bits):
    """The share is the same for a filter that is broadcast and one ten times and more over the bound."""
    keys = spark.range(40_000).selectExpr("if(id % 2 = 0, 'p', 'q') as column_name", "concat('k', id) as key", "id")
    other = spark.range(40_000, 80_000).selectExpr("if(id % 2 = 0, 'p', 'q') as column_name", "concat('k', id) as key", "id").unionByName(keys.selectExpr("if(column_name = 'p', 'q', 'p') as column_name", "key", "id"))
    assert orphans.with_filter(keys, keys, 40_000, max_bits).where("__may").count() == 40_000
    assert orphans.with_filter(other, keys, 40_000, max_bits).where("__may").count() < 0.03 * 80_000


def test_orphans_of_empty_tables(spark):
    a = spark.createDataFrame([(1, "p", "x", T0)], "id int, column_name string, key string, at timestamp_ntz")
    b = spark.createDataFrame([], "column_name string, key string, since timestamp_ntz, until timestamp_ntz")
    assert [r["ref_state"] for r in orphans.orphan_references(a, b).collect()] == ["missing"]
    assert orphans.orphan_references(a.limit(0), b).count() == 0


RAW = "raw_id int, file_id int, release_name string, seq_no int, payload string, k_value string, rescued int"


def _raw(spark, files):
    rows, i = [], 0
    for fid, (rel, seq, docs) in files.items():
        for x in docs:
            rows.append((i, fid, rel, seq, x if isinstance(x, str) or x is None else json.dumps(x), "mine", 5))
            i += 1
    return spark.createDataFrame(rows, RAW)


FILES = {
    1: ("r", 1, [{"a": 1, "b": "x", "s": "u1"}, {"a": None, "b": "y", "s": "u2"}, "not json", None, "[]", "null", '{"a": 1, "b'],),
    2: ("r", 4, [{"a": "1", "c": "x", "s": "u3"}, {"c": "z", "d": True, "s": "u4"}],),
    3: ("r", 5, [{"a": 2.0, "c": {"v": 1}, "s": "u5", "e": None}],),
    4: ("q", 1, [{"z": 1}],),
    5: ("q", 2, ["# only a comment"],),
    6: (None, 1, [{"z": 1}],),
}


def test_schema_changes(spark):
    got = {tuple(r) for r in drift.schema_changes(_raw(spark, FILES)).collect()}
    assert got == {(2, "a", "retyped"), (2, "c", "renamed"), (2, "d", "added"), (3, "a", "retyped"), (3, "c", "retyped"), (3, "d", "removed"), (3, "e", "added"), (5, "z", "removed")}
    assert drift.schema_changes(_raw(spark, {})).count() == 0


def test_numbers_match_across_spellings(spark):
    files = {1: ("r", 1, ['{"old": 1.50, "t": 1}']), 2: ("r", 2, ['{"new": 1.5, "t": 2}']), 3: ("r", 3, ['{"newer": "1.5", "t": 3}'])}
    assert {tuple(r) for r in drift.schema_changes(_raw(spark, files)).collect()} == {(2, "new", "renamed"), (3, "newer", "added"), (3, "new", "removed")}


def test_rescue_ingest_loses_nothing(spark):
    docs = [
        {"k_value": 1.5, "n": 3, "flag": True, "name": "a", "extra": [1, 2]},
        {"k_value": "2.5", "n": 3.5, "flag": "yes", "nick": "b"},
        {"k_value": {"v": 4, "unit": "px"}, "n": "7", "flag": 0, "name": None, "Unknown": {"x": None}},
        "oops",
        None,
    ]
    raw = _raw(spark, {1: ("r", 1, docs)})
    df = drift.rescue_ingest(raw, {"k_value": "double", "n": "int", "flag": "boolean", "name": "string"}, {"size": "double"}, {"nick": "name"}, unwrap=("v", "kind"))
    assert "k_value_in" in df.columns and "rescued_in" in df.columns
    rows = df.orderBy("raw_id").collect()
    assert [r["k_value"] for r in rows] == [1.5, 2.5, 4.0, None, None]
    assert [r["n"] for r in rows] == [3, None, 7, None, None]
    assert [r["flag"] for r in rows] == [True, True, False, None, None]
    assert [r["name"] for r in rows] == ["a", "b", None, None, None]
    assert json.loads(rows[0]["rescued"]) == {"extra": [1, 2]}
    assert json.loads(rows[1]["rescued"]) == {"n": 3.5}
    assert json.loads(rows[2]["rescued"]) == {"k_value": {"v": 4, "unit": "px"}, "Unknown": {"x": None}}
    assert json.loads(rows[3]["rescued"]) == {"_line": "oops"} and rows[4]["rescued"] is None
    assert {r["k_value_in"] for r in rows} == {"mine"}


def test_aliases_come_from_renames(spark):
    files = {1: ("r", 1, [{"backend": "x1"}]), 2: ("r", 2, [{"engine": "x1", "more": 2}]), 3: ("r", 3, [{"motor": "x1", "more": 3}])}
    promoted, aliases = drift.approve_fields(_raw(spark, files), {"backend": "string"})
    assert aliases == {"engine": "backend", "motor": "backend"} and promoted == {"more": "double"}


def test_field_values_of_nested_nulls(spark):
    rows = drift.field_values(drift.ingest(_raw(spark, {1: ("r", 1, [{"a": None, "b": [None], "c": 10}])}), {}), {}, ["file_id"]).collect()
    got = defaultdict(tuple, {r["field"]: (r["kind"], r["value"]) for r in rows})
    assert got == {"a": (None, None), "b": ("array", "[null]"), "c": ("number", "10")}
    assert F is not None


def test_every_field_gets_a_column(spark, tmp_path):
    docs = [
        {"id": "a", "notes": ["blur", None], "stray": "x", "num": 1, "flag": True, "code": "1", "big": 7, "obj": {"v": 1, "w": 2}, "Case": 1, "rescued": "r", 'q"t': 3, "nil": None},
        {"id": "b", "notes": None, "stray": 5, "num": "2.5", "flag": "false", "code": "02", "big": "9007199254740993", "case": "z", "raw_id": "own", "lead": "007"},
        {"id": "c", "notes": [], "stray": {"k": None}, "num": None, "flag": None, "lead": 7, 'q"t': 4, "mix": True},
        {"id": "d", "mix": 1, "stray": "y"},
        "oops",
    ]
    raw = _raw(spark, {1: ("r", 1, docs)})
    promoted, aliases = drift.approve_fields(raw, {"id": "string"})
    assert not aliases and set(promoted) == {f for x in docs[:4] for f in x} - {"id"}
    assert {f: promoted[f] for f in ("num", "flag", "code", 'q"t', "Case", "case")} == {"num": "double", "flag": "boolean", "code": "string", 'q"t': "double", "Case": "double", "case": "string"}
    assert {promoted[f] for f in ("notes", "stray", "big", "obj", "nil", "lead", "mix")} == {drift.JSON}
    drift.rescue_ingest(raw, {"id": "string"}, promoted, aliases).write.parquet(out := str(tmp_path / "t"))
    rows = spark.read.parquet(out).orderBy("raw_id_in").collect()
    column = lambda name: [r[name] for r in rows[:4]]
    assert column("notes") == ['["blur",null]', None, "[]", None] and column("stray") == ['"x"', "5", '{"k":null}', '"y"']
    assert column("num") == [1.0, 2.5, None, None] and column("flag") == [True, False, None, None] and column("code") == ["1", "02", None, None]
    assert column("big") == ["7", '"9007199254740993"', None, None] and column("lead") == [None, '"007"', "7", None] and column("mix") == [None, None, "true", "1"]
    assert json.loads(rows[0]["obj"]) == {"v": 1, "w": 2} and column("nil") == [None] * 4 and column('q"t') == [3.0, None, 4.0, None]
    assert column("Case") == [1.0, None, None, None] and column("case_2") == [None, "z", None, None]
    assert column("rescued_2") == ["r", None, None, None] and column("raw_id") == [None, "own", None, None]
    assert column("rescued") == [None] * 4 and json.loads(rows[4]["rescued"]) == {"_line": "oops"}


def test_all_renames_count_and_too_many_names_are_an_error(spark):
    old, new = [f"a{i}" for i in range(9)], [f"b{i}" for i in range(9)]
    raw = _raw(spark, {1: ("r", 1, [dict.fromkeys(old, "x")]), 2: ("r", 2, [dict.fromkeys(new, "x")])})
    promoted, aliases = drift.approve_fields(raw, {"a0": "string"}, max_fields=18)
    assert not promoted and aliases == dict.fromkeys(old[1:] + new, "a0")
    with pytest.raises(ValueError, match="more than 17"):
        drift.approve_fields(raw, {"a0": "string"}, max_fields=17)


def test_profile_has_ranges_and_pattern(spark):
    from quern.plans import catalog

    rows = catalog.queries()["p3_ranges"](spark, "/root/testdata/sf0.01").collect()
    numbers, names = [r for r in rows if r["column_name"] != "source_sample_id"], [r for r in rows if r["column_name"] == "source_sample_id"]
    assert any(r["outside"] > 0 for r in numbers) and all(r["breaches"] is None for r in numbers) and any(r["least"] < r["most"] for r in numbers if r["least"] is not None)
    assert any(r["breaches"] > 0 for r in names) and all(r["least"] is r["most"] is r["outside"] is None for r in names)


def test_whole_tables_are_drawn_and_combined(spark):
    from quern.plans import catalog

    d = "/root/testdata/sf0.001"
    assert catalog.queries()["weighted_draws"](spark, d).count() == spark.read.parquet(f"{d}/part.parquet").count() == 200
    assert catalog.queries()["combinatorial_configs"](spark, d).count() == 25 + 300 + 2300


def test_stored_rescue_is_replayed_later(spark, tmp_path):
    """A field approved after the table was written is filled from what the table stored; numbers beyond doubles keep their line."""
    docs = [{"k": 1, "new": 5}, {"k": "2", "newer": 6}, {"k": None, "new": 7, "newer": 8}, "oops", '{"k": 1e400, "new": 123456789012345678901234567890123456789012345}', {"k": {"v": 3}}]
    schema = {"k": "double"}
    drift.ingest(_raw(spark, {1: ("r", 1, docs)}), schema).write.parquet(out := str(tmp_path / "t"))
    stored = spark.read.parquet(out)
    assert [json.loads(r["rescued"]) if r["rescued"] else None for r in stored.orderBy("raw_id").collect()][:4] == [{"new": 5}, {"k": "2", "newer": 6}, {"k": None, "new": 7, "newer": 8}, None]
    early = drift.replay(stored, schema, {}, {}).orderBy("raw_id").collect()
    assert [r["k"] for r in early] == [1.0, 2.0, None, None, None, None] and json.loads(early[0]["rescued"]) == {"new": 5}
    late = drift.replay(stored, schema, {"new": "bigint"}, {"newer": "new"}, unwrap=("v",)).orderBy("raw_id").collect()
    assert [r["k"] for r in late] == [1.0, 2.0, None, None, None, 3.0] and [r["new"] for r in late] == [5, 6, 7, None, None, None]
    rests = [json.loads(r["rescued"]) if r["rescued"] else None for r in late]
    assert rests[:4] == [None, None, {"newer": 8}, {"_line": "oops"}] and rests[4]["_line"] == docs[4] and rests[5] == {"k": {"v": 3}}
