import random
from collections import Counter

import pytest

from lontar.llm.calibrated_sample import calibrated_margins, calibrated_sample, tilt
from lontar.llm.group_splits import bound_records, group_splits, key_of

TARGET = "target_id int, source_type string, aspect string, dataset_tier string, target_permille int, min_rows int, probability string"


def people(n=1000):
    rng = random.Random(1)
    return [(f"t{k}", rng.choice(["News", " news", "so-cial", "So Cial", None]), rng.choice(["a", "A "]), "T") for k in range(n)]


def test_counts_floors_and_gaps(spark):
    rows = people()
    df = spark.createDataFrame([(*r, 5) for r in rows + rows[:50]] + [(None, "news", "a", "t", 1)], "text_id string, source_type string, aspect string, dataset_tier string, target int")
    targets = spark.createDataFrame([(1, "NEWS", "a", "t", 500, 3, "x"), (2, "so_cial", "a", "t", 500, 900, "x"), (3, "none", "a", "t", 0, 0, "x"), (4, None, "a", "t", None, 2, "x")], TARGET)
    s = calibrated_sample(df, targets)
    rep = {r["target_id"]: r for r in s.report.collect()}
    news = sum(1 for r in rows if (r[1] or "").strip().lower() == "news")
    social = sum(1 for r in rows if (r[1] or "").lower().replace("-", "_").replace(" ", "_") == "so_cial")
    assert (rep[1]["available"], rep[1]["wanted"], rep[1]["gap"]) == (news, 100, 0)
    assert (rep[2]["available"], rep[2]["wanted"], rep[2]["gap"]) == (social, 900, 900 - social)
    assert rep[3]["gap"] == 0 and rep[4]["gap"] == 2
    drawn = s.sample.collect()
    assert Counter(r["target_id"] for r in drawn) == {1: 100, 2: social}
    assert len({r["id"] for r in drawn}) == len(drawn)
    again = {tuple(r) for r in calibrated_sample(df, targets).sample.collect()}
    assert again == {tuple(r) for r in drawn}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text_id string, source_type string, aspect string, dataset_tier string")
    targets = spark.createDataFrame([(1, "news", "a", "t", 500, 3, "x")], TARGET)
    s = calibrated_sample(df, targets)
    assert s.sample.count() == 0 and [r["gap"] for r in s.report.collect()] == [3]
    assert calibrated_sample(df, targets.limit(0)).report.count() == 0


def test_small_chunks_keep_whole_counts(spark, monkeypatch):
    import lontar.llm.calibrated_sample as m

    monkeypatch.setattr(m, "CHUNK", 37)
    df = spark.createDataFrame([(f"t{k}", "news", "a", "t") for k in range(1000)], "text_id string, source_type string, aspect string, dataset_tier string")
    targets = spark.createDataFrame([(1, "news", "a", "t", 1000, 0, "x")], TARGET)
    assert calibrated_sample(df, targets).sample.count() == 200


def test_tilt_meets_its_targets():
    p = tilt([1000, 50, 7, 0, 9], [[k] for k in range(5)], [3, 50, 6.5, 4, 20], 0.2)
    assert [round(n * x, 6) for n, x in zip([1000, 50, 7, 0, 9], p, strict=True)] == [3, 50, 6.5, 0, 9]


def test_tilt_meets_overlapping_margins():
    rng = random.Random(4)
    members = [[a, 4 + b, 7 + c] for a in range(4) for b in range(3) for c in range(2)]
    counts = [rng.randrange(1, 5000) for _ in members]
    share = [rng.choice([0.02, 0.4, 0.9]) for _ in members]
    goals = [sum(n * s for m, n, s in zip(members, counts, share, strict=True) if j in m) for j in range(9)]
    p = tilt(counts, members, goals, 0.2)
    assert all(0 < x <= 1 for x in p)
    for j in range(9):
        assert abs(sum(n * x for m, n, x in zip(members, counts, p, strict=True) if j in m) - goals[j]) < 1e-6 * goals[j]
    # the probabilities of cells that are not full are products of one factor for each margin
    free = {tuple(m): x for m, x in zip(members, p, strict=True)}
    for a in range(3):
        four = [free[(a, 4, 7)], free[(a + 1, 5, 7)], free[(a, 5, 7)], free[(a + 1, 4, 7)]]
        if max(four) < 1:
            assert abs(four[0] * four[1] / (four[2] * four[3]) - 1) < 1e-6


def test_margins(spark):
    df = spark.createDataFrame([(*r,) for r in people()], "text_id string, source_type string, aspect string, dataset_tier string")
    targets = spark.createDataFrame([(1, "NEWS", "a", "t", 500, 3, "x"), (2, "so_cial", "a", "t", 300, 90, "x"), (3, "none", "a", "t", 0, 5, "x")], TARGET)
    margins, cells = calibrated_margins(df, targets)
    got = {(r["category"], r["value"]): (r["wanted"], r["expected"]) for r in margins.collect()}
    assert got[("source_type", "news")] == (100, 100.0) and got[("source_type", "so_cial")] == (90, 90.0) and got[("aspect", "a")] == (190, 190.0) and got[("source_type", "none")] == (0, 0.0)
    assert cells.count() == 3 and calibrated_margins(df.limit(0), targets)[0].count() == 5 and calibrated_margins(df, targets.limit(0))[0].count() == 0


@pytest.mark.parametrize(
    "value, key",
    [
        (" HTTPS://WWW.A.example/Baca/1/?utm_source=x&b=2&a=1&fbclid=3#k ", "://a.example/Baca/1?a=1&b=2"),
        ("http://a.example/Baca/1?a=1&b=2", "://a.example/Baca/1?a=1&b=2"),
        ("https://a.example//", "://a.example"),
        ("RAW-1#02", "RAW-1"),
        (" RAW-1 ", "RAW-1"),
        ("N/A", None), ("-", None), (" Unknown", None), ("", None), (None, None), ("#x", None),
    ],
)
def test_key_forms(spark, value, key):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(key_of(df["v"])).first()[0] == key


def test_bound_records_and_splits(spark):
    rows = [("a", "g1", None, "b1"), ("b", "g1", "-", "b2"), ("c", None, "https://x.example/1", "b2#1"), ("d", "N/A", "http://www.x.example/1/", None), ("e", "u", "", ""), ("f", None, None, None), (None, "g1", None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text_id string, group_id string, normalized_source_url string, base_text_id string, root string, id int")
    labels, tree = bound_records(df)
    assert {r["node"]: r["root"] for r in labels.collect()} == {x: "a" for x in "abcd"}
    assert tree.count() == 3
    out = {r["id"]: (r["root"], r["split"]) for r in group_splits(df).collect()}
    assert set(out) == set("abcdef") and len({out[x] for x in "abcd"}) == 1


def test_shares_hold_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(f"r{k}", "hot" if k < 1000 else f"g{rng.randrange(900)}", None, None) for k in range(3000)]
    df = spark.createDataFrame(rows, "text_id string, group_id string, normalized_source_url string, base_text_id string")
    out = group_splits(df).collect()
    n = Counter(r["split"] for r in out)
    assert len(out) == 3000 and abs(n["train"] / 3000 - 0.66) < 0.02 and abs(n["test"] / 3000 - 0.17) < 0.02
    assert len({(r["root"], r["split"]) for r in out}) == len({r["root"] for r in out})


def test_no_rows(spark):
    df = spark.createDataFrame([], "text_id string, group_id string, normalized_source_url string, base_text_id string")
    assert group_splits(df).count() == 0 and bound_records(df)[0].count() == 0
