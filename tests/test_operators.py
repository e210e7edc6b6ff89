import pytest
from pyspark.sql import functions as F

from lontar.config import LABELS
from lontar.operators import calibration, cluster, curation, evaluate, fusion, lookup, profile, providers, relational, sampling, topics
from lontar.operators.lexicon import Engine, Rules, score_texts, word_scores
from lontar.schemas import RULE_COLUMNS, check_domain, require_columns, schema_diff


def rules():
    words = [{"term": "bagus", "label": "positif", "weight": 1.2}, {"term": "rusak", "label": "negatif", "weight": 1.0}, {"term": "kajian", "label": "netral", "weight": 0}]
    phrases = [{"phrase": "tidak pernah rusak", "label": "positif", "weight": 1.5}, {"phrase": "pernah rusak", "label": "negatif", "weight": 1.0}]
    mods = {
        "negations": [{"term": "tidak", "scope": 4, "effect": "shift"}], "intensifiers": [{"term": "sangat", "multiplier": 1.25}, {"term": "sekali", "multiplier": 1.2}],
        "downtoners": [{"term": "agak", "multiplier": 0.5}], "irrealis_blockers": [{"term": "kalau", "scope": 3}], "contrast_markers": [{"term": "tetapi", "effect": "prefer_after_clause"}],
    }
    return Rules.of(words, phrases, mods)


@pytest.mark.parametrize(
    "text, score",
    [
        ("bagus", 1.2), ("tidak bagus", -0.6), ("tidak itu dan juga sangat x bagus", 1.2 * 1.25), ("bagus bagus", 1.8), ("tetapi rusak", -1.875), ("sangat bagus", 1.5), ("bagus sekali", 1.44),
        ("agak rusak", -0.75), ("kalau bagus", 0.0), ("tidak pernah rusak", 1.5), ("kajian", 0.0), ("", 0.0), (None, 0.0), ("tidak rusak", 0.6), ("BAGUS!", 1.2), ("rusakk", 0.0),
    ],
)
def test_rule_scores(text, score):
    assert Engine(rules()).analyze(text)["rule_score"] == pytest.approx(score)


def test_rule_contract():
    r = Engine(rules()).analyze("sangat bagus dan tidak pernah rusak, kajian")
    assert list(r) == [c for c, _ in RULE_COLUMNS]
    assert (r["rule_status"], r["rule_label"], r["rule_confidence"]) == ("detected", "positif", 1.0)
    assert r["rule_hits"] == "tidak pernah rusak, bagus" and r["rule_neutral_hits"] == "kajian" and r["rule_modifier_hits"] == "sangat"
    assert Engine(rules()).analyze("bagus")["rule_status"] == "weak" and Engine(rules()).analyze("x")["rule_explanation"].startswith("Tidak ada")
    assert Engine(rules()).analyze("bagus ya bagus nih bagus")["rule_evidence"][2]["repetition_weight"] == 0.3333


def test_bad_rules():
    for bad in ([{"term": "", "label": "positif", "weight": 1}], [{"term": "a", "label": "x", "weight": 1}], [{"term": "a", "label": "positif", "weight": 3}]):
        with pytest.raises(ValueError):
            Rules.of(bad, [], {})
    with pytest.raises(ValueError):
        Rules.of([], [], {"contrast_markers": [{"term": "a", "effect": "?"}]})


def test_lexicon_frames(spark):
    df = spark.createDataFrame([(1, "bagus bagus"), (2, None)], "id int, t string")
    out = {r["id"]: r for r in score_texts(df, "t", rules()).collect()}
    assert out[1]["rule_score"] == 1.8 and out[2]["rule_status"] == "unknown" and out[1]["rule_evidence"][0]["span"] == [0, 5]
    w = df.select(word_scores(F.col("t"), {"bagus": ("positif", 1.2)}).alias("w")).select("w.*").collect()
    assert [r["rule_score"] for r in w] == [1.8, 0.0]
    assert score_texts(df.limit(0), "t", rules()).count() == 0


def decision(spark, status, bert, rule, conf, score=0.0):
    df = spark.createDataFrame([(status, bert, rule, conf, score)], "rule_status string, bert_label string, rule_label string, bert_confidence double, routing_uncertainty_score double")
    return fusion.fuse(df).first()


def test_fusion(spark):
    assert decision(spark, "weak", "netral", "positif", 0.2)["fusion_action"] == "bert_only"
    assert decision(spark, "detected", "positif", "positif", 0.9)["fusion_action"] == "agreement"
    r = decision(spark, "detected", "negatif", "positif", 0.80)
    assert (r["fusion_action"], r["final_sentiment"], r["requires_llm"], r["needs_review"]) == ("conflict_both_confident", "negatif", True, True)
    r = decision(spark, "detected", "negatif", "positif", 0.79, 0.7)
    assert (r["fusion_action"], r["final_sentiment"], r["needs_review"]) == ("rule_confident", "positif", True)
    assert decision(spark, None, None, None, None)["final_sentiment"] == "netral"


def test_uncertainty(spark):
    df = spark.createDataFrame([("detected", "negatif", "positif", 0.9, 0.8)], "rule_status string, bert_label string, rule_label string, bert_confidence double, bert_margin double")
    assert fusion.add_uncertainty(df).first()["routing_uncertainty_score"] == 0.32


def labelled(spark):
    rows = [("positif", "positif"), ("positif", "negatif"), ("netral", "x"), ("negatif", "negatif"), ("lain", "positif"), (None, "netral")]
    return spark.createDataFrame(rows, "a string, p string")


def test_metrics(spark):
    m = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(labelled(spark), "a", "p").collect()}
    assert len(m) == 9 and m["netral", "netral"] == 1 and m["positif", "negatif"] == 1 and sum(m.values()) == 4
    o = evaluate.overall_metrics(labelled(spark), "a", "p").first()
    assert o["total"] == 6 and o["accuracy"] == round(2 / 6, 4) and o["balanced_accuracy"] == round((1 + 1 + 0.5) / 3, 4)
    w = {r["label"]: r["weight"] for r in evaluate.class_weights(labelled(spark), "a").collect()}
    assert w["positif"] == round(4 / 6, 6)
    assert evaluate.overall_metrics(labelled(spark).limit(0), "a", "p").first()["accuracy"] == 0.0


def test_thresholds_and_temperature(spark):
    df = spark.createDataFrame([("positif", "positif", 0.9, "detected"), ("negatif", "positif", 0.5, "weak"), ("netral", "netral", 0.0, "unknown")], "a string, rule_label string, rule_confidence double, rule_status string")
    sweep = {r["threshold"]: r for r in evaluate.threshold_sweep(df, "a", [0.4, 0.6]).collect()}
    assert sweep[0.6]["precision_on_detected"] == 1.0 and sweep[0.4]["detected_count"] == 2 and sweep[0.4]["coverage"] >= sweep[0.6]["coverage"]
    assert evaluate.select_threshold(evaluate.threshold_sweep(df, "a", [0.4, 0.6]), 0.9, 0.3).first()["threshold"] == 0.6
    z = spark.createDataFrame([("positif", 0.0, 0.0, 3.0), ("negatif", 0.0, 0.0, 1.0), ("netral", 0.0, 2.0, 1.0)], "a string, z0 double, z1 double, z2 double")
    fit = calibration.fit_temperature(z, "a", ["z0", "z1", "z2"])
    assert fit["argmax_unchanged"] and fit["after"]["nll"] <= fit["before"]["nll"] + 1e-6


def test_providers(spark):
    df = spark.createDataFrame([(1, "a", True), (2, None, True), (3, "b", False)], "id int, t string, requires_llm boolean").withColumn("final_sentiment", F.lit("netral"))
    out = {r["id"]: r for r in providers.adjudicate(df, "t", lambda xs: [f"Jawab: POSITIF {x}" for x in xs]).collect()}
    assert [out[k]["final_sentiment"] for k in (1, 2, 3)] == ["positif", "netral", "netral"] and out[3]["llm_label"] is None and out[2]["llm_label"] == "netral"
    b = providers.from_batches(df, "t", lambda xs: [[0.0, len(x), 0.0] for x in xs]).collect()
    assert {r["bert_label"] for r in b} == {"netral", "negatif"}


def test_relational(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, None, "y"), (4, None, "z")], "n int, k string, v string")
    assert sorted(r["n"] for r in relational.keep_first(df, ["k"], ["n"]).collect()) == [1, 2]
    assert relational.keep_first(relational.keep_first(df, ["k"], ["n"]), ["k"], ["n"]).count() == 2
    ids = {r["n"]: r["row_id"] for r in relational.row_ids(df, ["n"], "RAW-", 2).collect()}
    assert ids == {k: f"RAW-0{k}" for k in (1, 2, 3, 4)}
    assert relational.ordered_columns(df, ["v", "zz"], ["n"]).columns == ["v", "k", "n"]
    assert df.where(relational.not_in(F.col("k"), ["b"])).count() == 2
    with pytest.raises(ValueError):
        relational.head(df, 0, ["n"])
    assert relational.mode_first(df, [], "k", "n").first()["k"] == "a"
    assert [r["n"] for r in relational.top_n(df, [F.desc("n")], 2).collect()] == [4, 3]
    assert relational.unpivot_filled(df, ["k", "v"]).count() == 5


def test_profile_and_lookup(spark):
    df = spark.createDataFrame([("s", "a"), ("s", "a"), (None, " "), ("t", None)], "source string, text string")
    q = profile.quality(df, "text", "source").first()
    assert (q["null_text"], q["empty_text"], q["empty_source"], q["duplicates"], q["mean_length"]) == (1, 1, 1, 1, 1.0)
    assert profile.validate(df, ["id"])["missing_columns"] == ["id"] and not profile.validate(df, [])["is_valid"]
    p = {r["kolom"]: (r["filled"], r["unique"], r["percent"]) for r in profile.column_profile(df, ["source", "text"]).collect()}
    assert p == {"source": (3, 2, 75.0), "text": (2, 1, 50.0)}
    meta = spark.createDataFrame([("a#1", "u1"), ("a#1", "u0"), ("b#1", "u2")], "text_id string, source_url string")
    rows = spark.createDataFrame([("a#1",), ("b#9",), ("c",)], "text_id string")
    got = {r["text_id"]: (r["meta_source_url"], r["metadata_recovery_status"]) for r in lookup.recover_metadata(rows, meta, "text_id", ["source_url"], ["text_id", "source_url"]).collect()}
    assert got == {"a#1": ("u0", "matched_by_exact_text_id"), "b#9": ("u2", "matched_by_base_text_id"), "c": (None, "fallback_to_base_text_id")}


def test_contracts(spark):
    df = spark.createDataFrame([(" Positif ",)], "label string")
    assert check_domain(df, "label", LABELS).first()[0] == "positif"
    with pytest.raises(ValueError):
        check_domain(spark.createDataFrame([(None,)], "label string"), "label", LABELS)
    with pytest.raises(KeyError):
        require_columns(df, ["x"])
    assert schema_diff(df, ["label", "x"]) == {"missing": ["x"], "extra": [], "same_order": False}


def test_clusters(spark):
    v = spark.createDataFrame([(k, [1.0, 0.01 * k], "positif" if k % 3 else "negatif") for k in range(6)] + [(9, [0.0, 1.0], "netral"), (10, [], "netral")], "id int, v array<double>, label string").withColumn("part", F.lit("a"))
    out = {r["id"]: r for r in cluster.leader_clusters(v, "id", "v", "label", "part").collect()}
    assert out[0]["cluster_id"] == 0 and out[9]["cluster_id"] == -1 and out[9]["semantic_label"] == "netral" and out[0]["cluster_size"] == 6 and out[9]["cluster_size"] == 2
    assert out[3]["semantic_label"] == "positif" and out[0]["semantic_similarity"] > 0.99 and out[9]["semantic_similarity"] == 0.0


def test_leaders_equal_brute_force_in_each_group(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)], rng.choice("abc"), rng.choice([None, "x", "y"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label string, part string")
    got = {r["id"]: r["cluster_id"] for r in cluster.leader_clusters(df, "id", "v", "label", "part", smallest=1).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.dist(a, [0] * 3) / math.dist(b, [0] * 3)

    for part in (None, "x", "y"):
        sums, counts = [], []
        for i, v, _, g in rows:
            if g != part:
                continue
            near = [cos(v, [x / n for x in s]) for s, n in zip(sums, counts, strict=True)]
            at = max(range(len(near)), key=lambda k: near[k], default=-1)
            if at < 0 or near[at] < 0.72:
                at = len(sums)
                sums.append([0.0] * 3)
                counts.append(0)
            sums[at] = [a + b for a, b in zip(sums[at], v, strict=True)]
            counts[at] += 1
            assert got[i] == at


def test_unparsed_and_blank_answers_become_netral(spark):
    df = spark.createDataFrame([(1, "abc", True, "positif"), (2, " ", True, "positif"), (3, "abc", False, "positif"), (4, None, True, "negatif")], "id int, t string, requires_llm boolean, final_sentiment string")
    asked = []
    out = {r["id"]: (r["final_sentiment"], r["decision_source"], r["llm_parsed"]) for r in providers.adjudicate(df, "t", lambda xs: asked.extend(xs) or ["entah"] * len(xs)).collect()}
    assert out == {1: ("netral", "llm", False), 2: ("netral", "llm", False), 3: ("positif", "fusion", None), 4: ("netral", "llm", False)}


def test_embeddings_have_length_one(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    out = {r["id"]: r for r in providers.embed_batches(df, "t", lambda xs: [[3.0 * len(x), 4.0 * len(x)] for x in xs], "test").collect()}
    assert out[1]["embedding"] == [0.6, 0.8] and out[2]["embedding"] == [0.0, 0.0] and out[1]["embedding_backend"] == "test"


def test_numbering_keeps_no_cache(spark):
    df = spark.createDataFrame([(f"k{k:03}",) for k in range(200)], "k string")
    rows = sorted((r["k"], r["row_id"]) for r in relational.row_ids(df, ["k"], "R-", 4).collect())
    assert rows == [(f"k{k:03}", f"R-{k + 1:04}") for k in range(200)]


def test_report_column(spark):
    df = spark.createDataFrame([("x", None), ("y", "positif")], "bert_label string, sentiment_label string")
    out, name = profile.report_column(df, ["final_sentiment", "bert_label", "sentiment_label"], ["positif"], "-")
    assert name == "sentiment_label" and sorted(r["report_value"] for r in out.collect()) == ["-", "positif"]
    assert profile.report_column(df.select("bert_label"), ["none"], ["positif"], "-")[1] == "-"


def test_sampling(spark):
    rows = [(f"t{k}", "x" if k < 3 else "y", "p" if k % 2 else "q", float(k)) for k in range(12)]
    df = spark.createDataFrame(rows, "text_id string, source_type string, aspect string, s double")
    out = sampling.bucket_sample(df, "text_id", ["source_type", "aspect"], [-F.col("s")], 2).collect()
    assert len({r["text_id"] for r in out}) == len(out) == 8
    first = {r["text_id"] for r in out if r["labeling_bucket_value"] == "x"}
    assert first == {"t2", "t1"}
    g = spark.createDataFrame([(f"g{k % 20}", LABELS[k % 3]) for k in range(200)], "g string, label string")
    folds = sampling.group_folds(g, "g", "label", LABELS).collect()
    assert len(folds) == 20 and {r["fold"] for r in folds} == set(range(6))
    many = sampling.group_folds(g, "g", "label", LABELS, largest=5).collect()
    assert len(many) == 20
    with pytest.raises(ValueError):
        sampling.assign_split(g, spark.createDataFrame([("g1", 1), ("g1", 2)], "g string, f int"), "g")


def test_folds_are_balanced_beyond_the_largest_groups(spark, monkeypatch):
    rows = [(f"g{k}", LABELS[0] if k % 50 == 0 else LABELS[1 + k % 2]) for k in range(1800)] + [("big", LABELS[1])] * 7 + [(f"p{k}", x) for k in range(60) for x in (LABELS[0], LABELS[2])]
    g = spark.createDataFrame(rows, "g string, label string")
    for unit, singly in ((100_000, 400), (100, 120)):
        monkeypatch.setattr(sampling, "UNIT", unit)
        monkeypatch.setattr(sampling, "SINGLY", singly)
        got = {r["g"]: r["fold"] for r in sampling.group_folds(g, "g", "label", LABELS, folds=6, largest=5).collect()}
        assert len(got) == 1861
        for x in LABELS:
            n = [sum(got[i] == f for i, y in rows if y == x) for f in range(6)]
            assert max(n) - min(n) <= 2, (x, n)


def test_topics(spark):
    df = spark.createDataFrame([("tidak pernah rusak dan bagus", "positif", "A"), ("bagus", "positif", "B"), ("rusak", "negatif", "A"), ("pernah rusak", "negatif", None)], "t string, l string, loc string").withColumn("p", F.monotonically_increasing_id())
    got = [(r["sentiment_label"], r["keyword"], r["rank"], r["document_frequency"]) for r in topics.topic_keywords(df, "t", "l", rules()).orderBy("sentiment_label", "rank").collect()]
    # the word of the chosen phrase is left out
    assert got == [("negatif", "pernah rusak", 1, 1), ("positif", "tidak pernah rusak", 1, 1), ("positif", "bagus", 2, 2)]
    s = {r["sentiment_label"]: r for r in topics.class_summaries(df, "t", "l", "loc", "p", rules()).collect()}
    assert s["netral"]["n_documents"] == 0 and s["positif"]["keyword_count"] == 2 and len(s["positif"]["representative_docs"]) == 2
    assert topics.is_noise("sign up") and topics.is_noise("é") and not topics.is_noise("padam")


def test_curation(spark):
    src = curation.SourceRules(exact=["https://ex.id/x?utm_source=1"], commercial_domains=["toko.id"], outside_terms=["jawa"], local_terms=["sera"])
    df = spark.createDataFrame([("https://www.ex.id/x/", "a"), ("https://toko.id/1", "Jawa"), ("https://a.id/jawa", "desa sera"), ("https://a.id/jawa", ""), (None, None)], "source_url string, raw_title string")
    got = [(r["blacklist_status"], list(r["blacklist_reason_codes"])) for r in curation.classify_sources(df, src).orderBy(F.col("source_url").desc_nulls_last(), F.desc("raw_title")).collect()]
    assert got == [
        ("original_exact_blacklist", ["exact_url_match"]), ("discovered_pattern_blacklist", ["commercial_self_promotion", "explicit_outside_location_in_url_or_title"]),
        ("clear", []), ("discovered_pattern_blacklist", ["explicit_outside_location_in_url_or_title"]), ("clear", []),
    ]
    rows = spark.createDataFrame([("MANUAL-0007", "teks lama", "https://a.id/1", "")], "text_id string, text string, source_url string, raw_title string")
    out = curation.append_manual(rows, {"text": "teks baru", "source_url": "https://b.id/2"}, src)
    assert {r["text_id"] for r in out.collect()} == {"MANUAL-0007", "MANUAL-0008"}
    for bad in ({"text": " "}, {"text": "teks  lama"}, {"text": "x", "source_url": "https://toko.id/9"}, {"text": "x", "source_url": "http://www.a.id/1".replace("http:", "https:")}):
        with pytest.raises(ValueError):
            curation.append_manual(rows, bad, src)
