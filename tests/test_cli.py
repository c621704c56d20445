import json

from pyspark.sql import functions as F

from noteforge import cli
from noteforge.sources import store


def run(spark, capsys, *args):
    capsys.readouterr()
    code = cli.main(list(args), spark)
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_index_search_status_and_runs(spark, tmp_path, capsys):
    at = (tmp_path / "store").as_uri()
    rows = [("a", "Alpha plans", "The red fox. See [[Beta notes]].", "f1"), ("b", "Beta notes", "Blue whales and red foxes.", "f2"), ("c", "Gamma", "Nothing.", None)]
    spark.createDataFrame(rows, "note_id string, title string, body string, parent_id string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/notes")
    spark.createDataFrame([("f1", None), ("f2", "f1")], "id string, parent_id string").write.parquet(f"{tmp_path}/folders")
    notes, folders = f"{tmp_path}/notes", f"{tmp_path}/folders"
    assert run(spark, capsys, "runs", "--store", at) == (0, [])
    code, out = run(spark, capsys, "index", "--store", at, "--notes", notes, "--folders", folders, "--folder", "f1")
    assert code == 0 and (out[0]["processed"], out[0]["skipped"]) == (2, 0)
    code, out = run(spark, capsys, "index", "--store", at, "--notes", notes, "--all")
    assert code == 0 and (out[0]["processed"], out[0]["skipped"]) == (1, 2)
    code, out = run(spark, capsys, "search", "--store", at, "red", "--retrievers", "bm25,tfidf", "--limit", "1")
    assert code == 0 and len(out) == 1 and out[0]["place"] == 1 and out[0]["retrievers"] == "bm25,tfidf" and "red" in out[0]["chunk_text"]
    code, out = run(spark, capsys, "search", "--store", at, "Alpha")
    assert code == 0 and out[0]["note_id"] == "a" and {"note_id", "title", "chunk_text", "score"} <= set(out[0])
    code, out = run(spark, capsys, "status", "--store", at)
    assert out[0]["tables"]["snapshot"] == 3 and out[0]["states"] == {"success": 3} and out[0]["last_run"]["status"] == "success"
    code, log = run(spark, capsys, "runs", "--store", at, "--status", "success")
    assert len(log) == 2 and run(spark, capsys, "runs", "--store", at, "--id", log[0]["id"])[1] == log[:1]
    assert run(spark, capsys, "index", "--store", at, "--notes", notes, "--note", "none")[0] == 1
    assert run(spark, capsys, "runs", "--store", at, "--status", "failed")[1][0]["errors"] == "no note none"
    assert [run(spark, capsys, *a)[0] for a in (("search", "--store", at, " "), ("search", "--store", at, "x", "--retrievers", "nope"), ("index", "--store", at, "--notes", notes), ("dance",), ("runs", "--store", at, "--id", "nope"))] == [2, 2, 2, 2, 1]


def test_store_keeps_whole_versions(spark, tmp_path):
    at = tmp_path.as_uri()
    assert store.load(spark, at) == {}
    first = store.save(spark, at, {"x": spark.range(3), "y": spark.range(1)})
    before = store.load(spark, at)["x"]
    second = store.save(spark, at, {"x": spark.range(5)})
    assert first != second == store.current(spark, at) and before.count() == 3
    now = store.load(spark, at)
    assert (now["x"].count(), now["y"].count()) == (5, 1)
    store.save(spark, at, {"x": spark.range(6)})
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("v-")]) == 2
