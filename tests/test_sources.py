import json

import pytest
from pyspark.sql import functions as F

from lamina.plans.manifest import Manifest, ManifestError, contract_faults, run_stages
from lamina.sources import files, writers


def test_discovery_and_manifest(spark, tmp_path):
    for n in ("b_patches.h5", "a.h5"):
        (tmp_path / n).write_bytes(b"x")
    got = files.discovered(spark, [str(tmp_path)])
    assert [r.slide_id for r in got.collect()] == ["a", "b"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a_coords.h5").write_bytes(b"x")
    with pytest.raises(files.SourceError):
        files.discovered(spark, [str(tmp_path)])
    (tmp_path / "m.csv").write_text("wsi_id,file_name,path\n,s1,x/1.svs\nk2,,/abs/2.svs\n")
    rows = {r.wsi_key: r.wsi_path for r in files.wsi_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"s1": f"{tmp_path}/x/1.svs", "k2": "/abs/2.svs"}


def test_prompt_formats(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# note\n\none \n")
    (tmp_path / "p.jsonl").write_text(json.dumps({"prompt_id": "a", "text": "two"}) + "\n" + json.dumps({"prompt": " "}) + "\n")
    (tmp_path / "p.csv").write_text("id,prompt\nc,three\n")
    assert [r.prompt for r in files.prompts(spark, str(tmp_path / "p.txt")).collect()] == ["one"]
    assert [tuple(r) for r in files.prompts(spark, str(tmp_path / "p.jsonl")).collect()] == [("a", "two")]
    assert [tuple(r) for r in files.prompts(spark, str(tmp_path / "p.csv")).collect()] == [("c", "three")]


def test_shards(spark):
    rows = spark.createDataFrame([(40, "b", "s2", 3, 8, 40, 20), (40, "a", "s1", 2, 8, 40, 40), (40, "c", "s3", 4, 8, 40, 0), (40, "d", "s4", 0, 8, 40, 0)], "mag int, path string, slide_id string, n_tiles long, feature_dim int, target_magnification int, level0_magnification int")
    kept, out = files.shards(rows)
    assert [r.slide_id for r in out.collect()] == ["s2"]
    assert {r.slide_id: r.row_start for r in files.checked_shards(kept).collect()} == {"s1": 0, "s3": 2}
    assert files.gaps(files.checked_shards(kept)).count() == 0
    assert files.gaps(files.checked_shards(kept).withColumn("row_start", F.col("row_start") + 1)).count() == 1


def test_dataset_reference():
    assert files.dataset_reference("Tiles:root=/a:split=TRAIN") == ("Tiles", {"root": "/a", "split": "TRAIN"})
    with pytest.raises(files.SourceError):
        files.dataset_reference("Tiles:color=red")


def test_image_entries(spark):
    paths = spark.createDataFrame([("/d/n01/n01_7.JPEG",), ("/d/n02/n02_3.JPEG",)], "path string")
    labels = spark.createDataFrame([("n01", "cat"), ("n02", "dog")], "class_id string, class_name string")
    assert {(r.class_id, r.actual_index, r.class_index, r.class_name) for r in files.image_entries(paths, labels).collect()} == {("n01", 7, 0, "cat"), ("n02", 3, 1, "dog")}


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([(5, 1, 10), (10, 2, 11)], "magnification int, x int, packed_row_index long")
    writers.partitioned(t, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["mag_partition=10x", "mag_partition=5x"]
    writers.staged(t, str(tmp_path / "s"))
    writers.staged(t, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    writers.exclusive(t, str(tmp_path / "c"))
    with pytest.raises(Exception, match="exists"):
        writers.exclusive(t, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        writers.json_atomic(str(tmp_path / "x.json"), float("nan"))
    assert "&lt;b&gt;" in writers.report("<b>", {"t": (["a"], [(None,)])})


def test_manifest(tmp_path):
    path, made = str(tmp_path / "m.json"), set()
    new = lambda config=None: Manifest(path, ["a", "b"], config or {"profile": "production"}, "f")
    work = {"a": lambda: made.add("A"), "b": lambda: made.add("B")}
    outputs = {"a": ["A"], "b": ["B"]}
    go = lambda m, **o: run_stages(m, work, outputs, made.__contains__, made.discard, **o)
    assert go(new()) == ["a", "b"] and go(new()) == []
    assert go(new(), first="a", last="a", overwrite=True) == ["a"]
    with pytest.raises(ManifestError):
        go(new())  # b's output is there, its record is gone
    made.discard("B")
    assert go(new()) == ["b"]
    with pytest.raises(ManifestError):
        new({"profile": "smoke"})
    m = new()
    assert m.approve(True, True, False) is False and m.approve(True, True, True) is True
    work["b"] = lambda: 1 / 0
    with pytest.raises(ZeroDivisionError):
        go(new(), first="b", overwrite=True)
    assert json.loads(open(path).read())["stages"]["b"]["status"] == "failed"


def test_contract():
    good = {"version": 1, "model": "m"}
    assert contract_faults(good, dict(good), good, True) == []
    assert contract_faults(good | {"fixture_only": True}, good, good, True) == ["fixture_only differs", "fixture in production"]
