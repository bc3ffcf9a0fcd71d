import json

import pytest
from conftest import rows

from marlstone.session import Config, Workspace
from marlstone.sources import images, jsonl, staging, storage
from marlstone.streaming.ingest import clean_new_files


def test_jsonl(spark, tmp_path):
    lines = ["{bad json", '{"title":"b","price":"from 14.99"}', '{"parent_asin":"P","details":{"Brand":"Z","n":1},"images":[{"thumb":"u"}],"other":1}', "{}"]
    (tmp_path / "items.jsonl").write_text("\n".join(lines))
    got = jsonl.read_items(spark, str(tmp_path / "items.jsonl"))
    assert got.columns == jsonl.ITEMS.fieldNames() and got.count() == 4
    assert rows(got.where("title = 'b'"), "title", "price") == [("b", None)]
    assert rows(got.where("parent_asin = 'P'"), "details", "images") == [('{"Brand":"Z","n":1}', ['{"thumb":"u"}'])]
    assert jsonl.read_reviews(spark, str(tmp_path / "items.jsonl")).columns == jsonl.REVIEWS.fieldNames()


def test_storage(spark, tmp_path):
    df, config, made = spark.range(3).select("id"), Config(table_root=str(tmp_path)), []
    make = lambda: made.append(1) or df
    for refresh in (False, False, True):
        assert storage.materialize(spark, "t", make, refresh, config).count() == 3
    assert len(made) == 2
    storage.write_path(df.withColumn("p", df["id"] % 2), str(tmp_path / "parted"), partition_by=("p",))
    assert storage.read_path(spark, str(tmp_path / "parted")).where("p = 1").count() == 1
    storage.create_schema(spark, "marl")
    storage.write_table(df, "marl.t")
    assert storage.list_tables(spark, "marl") == ["t"] and storage.read_table(spark, "marl.t").count() == 3
    spark.sql("drop schema marl cascade")
    other = df.withColumn("x", df["id"])
    assert storage.union_all(df, df, df).count() == 9 and storage.union_all(df, other, allow_missing=True).columns == ["id", "x"]


def test_workspace_leaves_a_given_session_running(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MARLSTONE_RAW", "/raw")
    assert Config().raw("a.jsonl") == "/raw/a.jsonl"
    storage.write_path(spark.range(5), str(tmp_path / "t"))
    with Workspace(spark, Config(table_root=str(tmp_path))) as w:
        assert [r[0] for r in w.sample("t", 2, "id").collect()] == [0, 1]
    assert spark.range(1).count() == 1


def test_images(spark):
    data = [(1, ['{"thumb": "ok", "large": "gone", "variant": "MAIN"}', None, "zz", "[]", '{"hi_res": null}', '{"a": {"b": 1}, "thumb": "slow"}']), (2, None), (3, [])]
    entries = images.image_entries(spark.createDataFrame(data, "parent_asin int, images array<string>"))
    assert rows(entries) == [(1, "hi_res", None, None), (1, "large", "MAIN", "gone"), (1, "thumb", None, "slow"), (1, "thumb", "MAIN", "ok")]

    def fetch(url):
        if url == "slow":
            raise TimeoutError
        return b"bytes" if url == "ok" else None

    got = {r["url"]: r["data"] for r in images.fetch_images(entries, fetch).collect()}
    assert got == {"ok": bytearray(b"bytes"), "gone": None, "slow": None, None: None}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: clean_new_files(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (folder / "1.jsonl").write_text(json.dumps({"text": "a &amp; <b>b</b>", "rating": 5}))
    run()
    (folder / "2.jsonl").write_text(json.dumps({"text": None}))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "text") == [(None,), ("a & b",)]


def test_staging(spark):
    import os

    a, b = staging.stage(spark.range(5).select("id"), "a"), staging.stage(spark.range(0).select("id"), "b")
    assert a.count() == 5 and b.count() == 0
    folder = a._staged_in.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    staging.unstage(a)
    assert not os.path.isdir(folder)
    staging.clear_staged(spark)
    assert not os.path.isdir(b._staged_in.removeprefix("file://").removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return ""

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(RuntimeError):
        staging.shared_dir(Cluster())


def test_a_half_written_table_is_made_again(spark, tmp_path):
    config = Config(table_root=str(tmp_path))
    (tmp_path / "t").mkdir()
    assert storage.materialize(spark, "t", lambda: spark.range(3), config=config).count() == 3
