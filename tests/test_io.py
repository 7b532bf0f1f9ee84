"""Scans and sinks round trips."""
import json

from placerank.sources import io


def test_jsonl_and_wrapped_json(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text('{"business_id": "a", "categories": "Food", "stars": 4.5}\n{"business_id": "b"}\n')
    df = io.read_jsonl(spark, str(p), "business_id string, categories string, stars double")
    assert df.count() == 2
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"restaurants": [{"business_id": "a"}, {"business_id": "b"}]}))
    assert io.read_wrapped_json(spark, str(w), "business_id string").count() == 2
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps([{"business_id": "a"}]))
    assert io.read_wrapped_json(spark, str(bare), "business_id string").count() == 1


def test_csv_multiline_text(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('review_id,text\n1,"line one\nline two"\n2,plain\n')
    df = io.read_csv(spark, str(p), "review_id string, text string")
    assert df.count() == 2 and "\n" in df.filter("review_id = '1'").first().text


def test_id_list(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text("user_id\n  u2 \n\nu1\nu2\n")
    assert sorted(r.user_id for r in io.read_id_list(spark, str(p)).collect()) == ["u1", "u2"]
    assert [r.user_id for r in io.read_id_list(spark, str(p), cap=1).collect()] == ["u1"]


def test_save_results_json_appends(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    out = str(tmp_path / "o")
    io.save_results(df, out, "json")
    io.save_results(df, out, "json")
    assert spark.read.json(out).count() == 2
    try:
        io.save_results(df, out, "xml")
    except ValueError:
        pass
    else:
        raise AssertionError("unknown format must fail")
