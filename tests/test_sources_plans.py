import json

import pytest
from pyspark.sql import functions as F

from lontar.operators.curation import ResearchConfig, candidate_rows, flatten_records, one_per_url
from lontar.operators.curation import SourceRules
from lontar.operators.lookup import location_scope
from lontar.operators import calibration
from lontar.plans import candidates, flagship, legacy, policy, training
from lontar.sources import readers, sinks
from lontar.streaming import scoring

CRAWL = {
    "meta": {"made": "2024"}, "queries": [{"query_id": "q1", "group": "g", "query": "panel", "status": "done"}],
    "records": [
        {"canonical_url": "https://a.id/1", "title": "Judul", "found_by": [{"query_id": "q1", "query_group": "", "query": None}], "content": {"status": "success", "text": "isi panel surya desa sera", "http_status": 200}},
        {"canonical_url": "https://a.id/1", "title": "Lagi", "found_by": [], "content": None},
    ],
}


def test_crawl_files_to_candidates(spark, tmp_path):
    (tmp_path / "url_1.json").write_text(json.dumps(CRAWL))
    files = readers.crawl_files(spark, str(tmp_path))
    assert readers.crawl_queries(files).first()["query_group"] == "g" and readers.crawl_meta(files).count() == 1
    records = flatten_records(files)
    assert records.count() == 2 and {r["query_group"] for r in records.collect()} == {"g", None}
    assert one_per_url(records, ["raw_title"]).first()["raw_title"] == "Judul"
    cfg = ResearchConfig.from_json({"url_required_keywords": ["panel"], "locations": ["Sera"], "issue_groups": {"masalah": ["padam"]}}, [("sera", "Sera", True)])
    row = candidate_rows(records.where("raw_title = 'Judul'"), cfg).first()
    assert (row["dataset_tier"], row["location"], row["is_specific_location"], row["aspect"], row["text"]) == ("A_candidate_core", "Sera", True, "general_shs", "Judul 1 isi panel surya desa sera")
    assert row["evidence_support_score"] == 0.9


def test_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes('id,text\n1,"baris satu\nbaris ""dua"""\n2,caf\xe9\n'.encode("latin-1"))
    rows = {r["id"]: r["text"] for r in readers.read_csv_any(spark, str(p)).collect()}
    assert rows == {"1": 'baris satu\nbaris "dua"', "2": "café"}
    df = spark.createDataFrame([(1, ["a"], "x")], "n int, l array<string>, t string")
    for name in ("t.parquet", "t.csv", "t.json"):
        back = readers.read_any(spark, sinks.save(df, str(tmp_path / name)))
        assert back.count() == 1 and set(back.columns) == {"n", "l", "t"}
    assert sinks.save_version(df, str(tmp_path), "tabel") != ""
    j = sinks.save_json({"a": 1}, tmp_path / "d" / "a.json")
    assert json.loads(j.read_text()) == {"a": 1} and len(sinks.file_sha256(j)) == 64
    assert sinks.manifest(df, str(j))["rows"] == 1 and sinks.config_snapshot()["SEED"] == 42
    (tmp_path / "w_candidate.csv").write_text("source_url\nhttps://a.id/1\n")
    assert readers.used_urls(spark, str(tmp_path)).count() == 0
    (tmp_path / "w_sentiment_labeling_output.json").write_text('[{"text_id": "a#1", "text_selected": "x", "sentiment": " Positif ", "location": null}]')
    assert readers.used_urls(spark, str(tmp_path)).count() == 1
    g = readers.golden_labels(spark, str(tmp_path)).first()
    assert (g["sentiment_label"], g["label_id"]) == ("positif", 2)


def test_encodings_of_csv(spark, tmp_path):
    cases = {"utf8": ("id,text\n1,a\ufffdb – é\n".encode(), "a\ufffdb – é"), "bom": ("\ufeffid,text\n1,é\n".encode(), "é"), "latin": ("id,text\n1,\xe9\n".encode("latin-1"), "é")}
    for name, (raw, text) in cases.items():
        p = tmp_path / f"{name}.csv"
        p.write_bytes(raw)
        df = readers.read_csv_any(spark, str(p))
        assert df.columns == ["id", "text"] and df.first()["text"] == text, name


def test_golden_labels_of_any_shape(spark, tmp_path):
    row = {"text_id": " a ", "text_selected": " ", "text": "dua kata ", "label": "positif"}
    for name, payload in (("a", [row, {"content": "isi", "sentiment": " "}]), ("b", {"data": [row]}), ("c", {"rows": [row]}), ("d", {"other": 1}), ("e", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    out = {(r["golden_file"], r["golden_row"]): tuple(r)[2:] for r in readers.golden_any(spark, str(tmp_path)).collect()}
    full = ("a", "positif", "(kosong)", "dua kata", 8, 2)
    assert out == {("a.json", 1): full, ("a.json", 2): ("", "(kosong)", "(kosong)", "isi", 3, 1), ("b.json", 1): full, ("c.json", 1): full}


def test_keyword_lists_and_frozen_policies(tmp_path):
    p = sinks.save_json({"a": [" Satu  Dua", "satu dua", ""], "b": ["x"], "c": "no list"}, tmp_path / "k.json")
    assert readers.keyword_lists(p, ["a", "b"]) == {"a": ("satu dua",), "b": ("x",)}
    for keys, error in ((["z"], KeyError), (["c"], ValueError)):
        with pytest.raises(error):
            readers.keyword_lists(p, keys)
    own = policy.Policy({"wc": 0.5, "wm": 0.3, "wd": 0.2}, 0.75, 0.6, 1.4)
    assert policy.Policy.load(own.save(tmp_path / "p.json")) == own
    assert calibration.load_temperature(calibration.save_temperature({"temperature": 1.5}, tmp_path / "t.json")) == 1.5
    for payload in ({"temperature": 0}, {"weights": {"wc": 1}}):
        with pytest.raises(ValueError):
            policy.Policy.load(sinks.save_json(payload, tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        calibration.load_temperature(sinks.save_json({}, tmp_path / "bad.json"))


def test_crawl_files_without_queries_stay(spark):
    files = spark.createDataFrame([("a.json", [("q", "g", "x", "s")]), ("b.json", None), ("c.json", [])], "source_file string, queries array<struct<query_id:string,group:string,query:string,status:string>>")
    assert sorted(r["source_file"] for r in readers.crawl_queries(files).collect()) == ["a.json", "b.json", "c.json"]


def runtime(spark):
    rows = [("1", "Lampu rusak!", "https://a.id/1?utm_source=x", "news", "S", 0.0, 0.0, 3.0), ("2", "lampu RUSAK!!", "https://www.a.id/1", "news", "S", 0.0, 0.0, 3.0), ("3", "", "u", "news", "S", 0.0, 0.0, 0.0), ("4", None, None, None, None, 1.0, 0.0, 0.0), ("5", "terang sekali", "https://a.id/2", "n", "", 0.0, 0.0, 3.0)]
    return spark.createDataFrame(rows, "text_id string, text string, source_url string, source_type string, location string, z0 double, z1 double, z2 double")


def test_flagship(spark):
    prepared = flagship.prepare(runtime(spark))
    assert sorted(r["text_id"] for r in prepared.collect()) == ["1", "5"]
    out = flagship.order_output(flagship.decide_rows(prepared, ["z0", "z1", "z2"]))
    assert out.columns[:5] == ["text_id", "text", "source_url", "source_type", "location"]
    assert {r["final_sentiment"] for r in out.collect()} == {"positif"}
    assert all(flagship.run_gates(out).first())


def test_training(spark):
    golden = readers.clean_golden(spark.createDataFrame([(f"t{k}#01", "teks", "positif", "S") for k in range(40)] + [("z#1", "t", "lain", None)], "text_id string, text_selected string, sentiment string, location string"))
    meta = spark.createDataFrame([(f"t{k}#01", f"https://a.id/{k // 2}", None, "news", "S") for k in range(40)], "text_id string, source_url string, normalized_source_url string, source_type string, location string")
    t = training.with_splits(training.training_table(golden.where("label_id IS NOT NULL"), meta))
    assert t.count() == 40 and t.where("split IS NULL").count() == 0
    assert t.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_legacy(spark):
    df = spark.createDataFrame([(k, "lampu padam lagi") for k in range(4)] + [(9, "harga")], "id int, text string").withColumn("part", F.lit(None).cast("string"))
    out = {r["id"]: r for r in legacy.legacy_decisions(df, "id", "text", "part").collect()}
    assert out[0]["cluster_id"] == 0 and out[9]["ambiguity_reason"].endswith("cluster_noise")


def test_stream_equals_batch(spark, tmp_path):
    rows = runtime(spark).withColumn("at", F.timestamp_seconds(F.col("text_id").cast("int")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scoring.read_rows(spark, str(tmp_path / "in"), rows.schema)
    decided = scoring.decide_stream(scoring.prepare_stream(stream, "at"), ["z0", "z1", "z2"])
    scoring.write_rows(decided, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r["processed_text"]: r["final_sentiment"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["processed_text"]: r["final_sentiment"] for r in flagship.decide_rows(flagship.prepare(runtime(spark)), ["z0", "z1", "z2"]).collect()}
    assert got == batch


def test_queries_have_matching_sql():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_candidate_frames(spark, tmp_path):
    rows = [(f"f{k % 2}.json", f"https://a.id/{k}", f"Berita {k}", "success", f"panel surya di desa sera nomor {k}. Warga senang sekali dengan lampu itu.") for k in range(6)]
    rows += [("f0.json", "https://toko.id/1", "Jual", "success", "panel surya desa sera"), ("f0.json", "https://a.id/9", "x", "error", None)]
    cols = "source_file string, canonical_url string, raw_title string, content_status string, content_text string"
    records = spark.createDataFrame(rows, cols)
    for c in ("url", "domain", "content_title", "snippet", "content_description", "query"):
        records = records.withColumn(c, F.lit(None).cast("string"))
    records = records.withColumn("content_text_length", F.length("content_text").cast("bigint"))
    cfg = ResearchConfig(relevant=["panel"], places=[("sera", "Sera", True)])
    out = candidates.candidate_frames(records, cfg, SourceRules(commercial_domains=["toko.id"]), per_bucket=3, sentences=True)
    assert out["candidates"].count() == 8 and out["audit"].count() == 1 and out["ready"].count() == 6
    assert out["sample"].count() == 6 and out["sample"].columns[-1] == "text" and out["sentences"].count() >= 6
    assert {r["text_id"] for r in out["candidates"].collect()} == {f"RAW-000{k}" for k in range(1, 9)}


def test_location_scope(spark):
    df = spark.createDataFrame([("KABUPATEN Sera",), ("borneo",), (" ",), (None,), ("lain",)], "l string")
    assert [r[0] for r in df.select(location_scope(F.col("l"), ["Sera"], ["Borneo"])).collect()] == ["specific", "province", "empty", "empty", "other"]


def test_training_history(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"log_history": [{"epoch": 1, "loss": 0.5, "note": "x", "ok": True}]}))
    assert readers.training_history(tmp_path / "s.json") == [{"epoch": 1, "loss": 0.5}] and readers.training_history(tmp_path / "no.json") == []


def test_latest_checkpoint(tmp_path):
    assert readers.latest_checkpoint(tmp_path) is None
    own = sinks.save_json({}, tmp_path / "trainer_state.json")
    assert readers.latest_checkpoint(tmp_path) == own
    for n in (90, 120, 7):
        sinks.save_json({"log_history": [{"loss": n, "name": "x"}]}, tmp_path / f"checkpoint-{n}" / "trainer_state.json")
    assert readers.training_history(readers.latest_checkpoint(tmp_path)) == [{"loss": 120}]
