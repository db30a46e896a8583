"""Sources, sinks and streams on folders made by the tests."""

import json
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import contract
from quern.sources import images, readers, writers
from quern.streaming import streams

c = F.col


def test_jsonl_strict_permissive_and_missing(spark, tmp_path):
    f = tmp_path / "log.jsonl"
    f.write_text('{"sample_id": "a", "status": "ok"}\n\n{"sample_id": "b", "status": "rejected"}\n{"sample_id": "a", "status": "ok"}\n')
    schema = "sample_id string, status string"
    assert readers.read_jsonl(spark, str(f), schema).count() == 3
    assert readers.read_jsonl(spark, str(tmp_path / "none*"), schema).count() == 0
    assert [r[0] for r in readers.completed_ids(spark, str(f)).collect()] == ["a"]
    f.write_text('{"sample_id": "a", "status": "ok"}\n{"sample_id": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(f), schema).collect()
    assert [r[0] for r in readers.completed_ids(spark, str(f)).collect()] == ["a"]


def test_documents_and_experiments(spark, tmp_path):
    for split, name in (("train", "s1"), ("val", "s1"), ("val", "s2")):
        os.makedirs(tmp_path / "docs" / split, exist_ok=True)
        (tmp_path / "docs" / split / f"{name}.json").write_text(json.dumps({"id": name}, indent=1))
    docs = readers.read_documents(spark, str(tmp_path / "docs"), "id string", r"/docs/([^/]+)/").collect()
    assert sorted((r["path_key"], r["id"]) for r in docs) == [("train", "s1"), ("val", "s1"), ("val", "s2")]
    for label, metrics in (("o__a__seed_1", {"f": 1.0}), ("o__a__seed_2", {"f": 2.0, "g": 3.0})):
        os.makedirs(tmp_path / "runs" / label)
        (tmp_path / "runs" / label / "test_metrics.json").write_text(json.dumps(metrics))
    got = readers.experiment_results(spark, str(tmp_path / "runs"))
    assert {(r["arm"], r["seed"], r["g"]) for r in got.collect()} == {("a", 1, None), ("a", 2, 3.0)}
    assert [tuple(r) for r in readers.missing_from_grid(spark, got, ["a"], [1, 2, 3]).collect()] == [("a", 3)]


def test_mirror_index_and_cells(spark, tmp_path):
    png = images.encode_png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    cell = "struct<bytes:binary,path:string>"
    df = spark.createDataFrame([("n1", (png, "x")), ("n2", (b"", "y"))], f"file_name_base string, image_focus {cell}")
    df.write.parquet(str(tmp_path / "m"))
    idx = readers.mirror_index(spark, str(tmp_path / "m"))
    assert {r["name"] for r in idx.collect()} == {"n1", "n2"} and idx.where("row_no >= 0").count() == 2
    want = spark.createDataFrame([("n1",), ("n9",)], "name string")
    got = {r["name"]: r for r in readers.mirror_cells(spark, str(tmp_path / "m"), want, "image_focus").collect()}
    assert got["n1"]["kind"] == "png" and got["n1"]["n_bytes"] == len(png) and got["n9"]["bytes"] is None
    df.write.mode("append").parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        readers.mirror_index(spark, str(tmp_path / "m"))


def test_files_are_deduplicated_by_content(spark, tmp_path):
    for name, body in (("b/2.png", b"same"), ("a/1.png", b"same"), ("c.PNG", b"other"), ("d.txt", b"no"), ("e.png", b"broken"), ("f.png", b"")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body)
    ok, bad = readers.enumerate_files(spark, str(tmp_path), [".png"], lambda b: F.when(b.cast("string") != "broken", F.length(b)))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in ok.collect()) == ["1.png", "c.PNG"]
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()} == {("2.png", "duplicate_content"), ("e.png", "unreadable")}
    tree = readers.file_tree(spark, str(tmp_path), r"/([a-z])/([0-9])\.png$", ["scene", "no"])
    assert {(r["scene"], r["no"]) for r in tree.collect()} == {("a", "1"), ("b", "2")}


def test_local_folder_last_line_wins(spark, tmp_path):
    lines = [{"idx": 1, "stem": "a", "file": "old", "k": 1.0}, {"idx": 2, "stem": "b", "file": None, "error": "boom"}, {"idx": 1, "stem": "a", "file": "new", "k": 2.0}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [(r["idx"], r["file"]) for r in readers.local_folder(spark, str(tmp_path / "x.jsonl")).collect()] == [(1, "new")]


def test_panel_and_optics(spark, tmp_path):
    (tmp_path / "p.csv").write_text("calibration_ssim,acceptable_for_control\n0.9, Sim \nx,1\n0.5,no\n")
    assert sorted(map(tuple, readers.reviewed_panel(spark, str(tmp_path / "p.csv")).collect())) == [(0.5, False), (0.9, True)]
    df = spark.createDataFrame([('{"FocalLength": 26, "f_number": "2.8", "FocalLengthIn35mmFilm": 52}',), ('{"FocalLength": "x"}',)], "exif string")
    rows = readers.optics_rows(df).collect()
    assert rows[0]["f_number"] == 2.8 and rows[0]["optics_error"] is None and rows[1]["optics_error"] == "exif_focal_length_missing"


def test_png_round_trip(spark):
    rng = np.random.default_rng(1)
    for a in (rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8), rng.integers(0, 65536, (6, 5), np.uint16)):
        assert (images.decode_png(images.encode_png(a)).reshape(a.shape) == a).all()
    good = images.encode_png(rng.integers(0, 256, (2, 2), np.uint8))
    rows = spark.createDataFrame([(bytearray(good),), (bytearray(good[:-6]),), (bytearray(b"junk"),), (None,)], "b binary").select(images.png_cells("b").alias("p")).select("p.*").collect()
    assert (rows[0]["h"], rows[0]["w"], len(rows[0]["data"])) == (2, 2, 4) and all(r["error"] for r in rows[1:])


def test_release_is_written_whole_or_not(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1", "h1"), ("b", "s1", "h1"), ("c", "s2", "h2")], "sample_id string, scene_id string, digest string")
    split = spark.createDataFrame([("s1", "train"), ("s2", "val")], "scene_id string, split string")
    rules = {"no_id": c("sample_id").isNull()}
    out = str(tmp_path / "rel")
    for bad, s in ((rows.union(rows.limit(1)), split), (rows, split.limit(1)), (rows.union(spark.createDataFrame([(None, "s1", "h1")], rows.schema)), split), (rows.union(spark.createDataFrame([("d", "s1", "h9")], rows.schema)), split)):
        with pytest.raises(ValueError):
            writers.write_release(bad, s, rules, out, digest="digest")
        assert not os.path.exists(out)
    writers.write_release(rows, split, rules, out, digest="digest")
    assert spark.read.parquet(out).groupBy("split").count().count() == 2
    got = writers.publish(rows, str(tmp_path / "hub"), "scene_id")
    assert all(r["whole"] for r in got.collect())
    with pytest.raises(ValueError):
        writers.publish(rows, str(tmp_path / "hub"), "scene_id")


def test_cards_tables_cache_subset(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert "| n | 2 |" in writers.card(df, "T", {"n": F.count(F.lit(1)), "none": F.max(F.lit(None))}) and "| none | n/d |" in writers.card(df, "T", {"none": F.max(F.lit(None).cast("int"))})
    assert writers.markdown(df, ["k"]).splitlines()[2:] == ["| a | 1 |", "| b | n/d |"]
    assert writers.cached(df, str(tmp_path / "c"), "1").count() == 2 and writers.cached(df.limit(0), str(tmp_path / "c"), "1").count() == 2
    writers.write_subset(df, df.limit(1), "k", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert contract.violations({"x": F.lit(True)}) is not None


def test_log_resume_stream(spark, tmp_path):
    inbox, log, mark = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    inbox.mkdir()
    tries = []

    def process(batch):
        tries.append(sorted(r["sample_id"] for r in batch.collect()))
        return batch.select("sample_id", F.when(c("sample_id").startswith("bad"), "broken").alias("reason"))

    for n, ids in enumerate((["x", "x", "bad1"], ["x", "bad1", "y"])):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps({"sample_id": i}) for i in ids))
        streams.resume_log(spark, streams.follow_files(spark, str(inbox), "sample_id string"), log, mark, process)
    assert tries == [["bad1", "x"], ["bad1", "y"]]
    assert sorted(r[0] for r in readers.completed_ids(spark, log).collect()) == ["x", "y"]


def test_stream_windows_equal_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, "abc"[i % 2], float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, event_type string, value double")
    src = str(tmp_path / "ev")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = []
    streams.run_available(streams.windowed_counts(stream, "1 hour"), str(tmp_path / "cp"), lambda b, _: out.extend(b.collect()), "complete")
    batch = streams.windowed_counts(df, "1 hour").collect()
    assert sorted(map(str, out)) == sorted(map(str, batch)) and sum(r["n"] for r in batch) == 80
    assert sum(r["n"] for r in streams.sessions(df, "user_id", "30 minutes").collect()) == 80
    dup = spark.readStream.schema(df.schema).parquet(src)
    seen = []
    streams.run_available(streams.deduplicated(dup, ["user_id"]), str(tmp_path / "cp2"), lambda b, _: seen.extend(b.collect()))
    assert len(seen) == 3
    streams.register_metric(spark, "twice", lambda s: s * 2)
    assert spark.sql("select twice(2.0D)").first()[0] == 4.0


def test_publish_counts_what_came(spark, tmp_path):
    from quern.sources import writers

    hub, part = str(tmp_path / "hub"), lambda n: spark.createDataFrame([("s", i) for i in range(n)] + [(None, -1)], "scene_id string, i int")
    writers.publish(part(3), hub, "scene_id")
    got = {r["part"]: r for r in writers.publish(part(2), hub, "scene_id", allow_existing=True).collect()}
    assert (got["s"]["sent"], got["s"]["found"], got["s"]["before"]) == (2, 5, 3) and all(r["whole"] for r in got.values()) and len(got) == 2


def test_filtered_png_rows():
    import struct
    import zlib

    import numpy as np

    from quern.sources import images

    rng = np.random.default_rng(3)
    for c, colour in ((1, 0), (3, 2)):
        want = rng.integers(0, 256, (7, 9, c)).astype(np.uint8)
        flat, rows = want.reshape(7, -1).astype(int), b""
        for y in range(7):
            how, row = y % 5, []
            for x in range(9 * c):
                a, b = flat[y, x - c] if x >= c else 0, flat[y - 1, x] if y else 0
                k = flat[y - 1, x - c] if y and x >= c else 0
                near = [0, a, b, (a + b) // 2, min((a, b, k), key=lambda v: abs(a + b - k - v))][how]
                row.append((flat[y, x] - near) % 256)
            rows += bytes([how, *row])
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        png = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
        assert (images.decode_png(png) == want).all()


def test_unknown_sides_and_routes_are_errors(spark):
    from quern.operators import sampling

    df = spark.createDataFrame([("a", " Train "), ("x", "who")], "route string, split string")
    names = {"train": "train"}
    assert [r[0] for r in df.select(sampling.side_from_source(F.col("split"), names)).collect()] == ["train", None]
    with pytest.raises(Exception, match="no side for split who"):
        df.select(sampling.side_from_source(F.col("split"), names, strict=True)).collect()
    with pytest.raises(ValueError, match="no weight for route x"):
        sampling.route_weights(df, "route", {"a": 1.0}, strict=True)


def test_texts_and_labels(spark):
    from quern.functions import text

    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.training_step(F.lit("run-60k-b"))) == 60_000 and get(text.training_step(F.lit("run"))) is None
    assert get(text.named_pairs(F.lit("a=1,b=x"))) == {"a": "1", "b": "x"}
    assert get(text.content_hash(F.lit(1).alias("a"), F.lit(None).alias("b"))) == get(F.sha2(F.lit('{"a":1,"b":null}'), 256))
    assert get(text.chosen(F.lit("abc"), ["b"], ["x"])) and not get(text.chosen(F.lit("abc"), [], ["c"])) and not get(text.chosen(F.lit(None).cast("string"), [], []))
    assert get(text.first_substring(F.lit("xyab"), {"ab": "one", "xy": "two"})) == "one"
