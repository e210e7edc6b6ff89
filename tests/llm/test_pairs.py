import random
import re

import pytest
from pyspark.sql import functions as F

from lontar.llm.near_duplicates import expanded, groups, near_duplicates
from lontar.llm.pigeonhole import parity
from lontar.llm.split_overlap import align, aligned, record_pairs, report, split_overlap

WORDS = [f"w{k}" for k in range(400)]


def edit(rng, words):
    words = list(words)
    for _ in range(rng.randrange(0, 7)):
        at = rng.randrange(len(words))
        kind = rng.randrange(4)
        if kind == 0:
            words[at] = rng.choice(WORDS)
        elif kind == 1:
            words.insert(at, rng.choice(WORDS))
        elif kind == 2 and len(words) > 4:
            del words[at]
        else:
            words = words[at:] + words[:at]
    return words


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [rng.choice(WORDS[: rng.choice([6, 50, 400])]) for _ in range(rng.randrange(6, 40))]
        for _ in range(rng.randrange(1, 5)):
            out.append(" ".join(edit(rng, base)).title() + rng.choice(["", ".", " !?"]))
    return out[:n]


def shingles(text, k):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, k, least):
    own = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(i for i, (_, n) in own.items() if n >= least)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = own[a][0], own[b][0]
            if p | q and 10 * len(p & q) >= 6 * len(p | q):
                out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = [(f"t{k:03}", t) for k, t in enumerate(texts(seed, 260))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text_id string, text string, rep string, key int")
    r = near_duplicates(df)
    got = {tuple(x) for x in expanded(r).collect()}
    assert got == brute(rows, 3, 12)
    g = {x["id"]: x for x in groups(r).collect()}
    assert all(g[a]["group_id"] == g[b]["group_id"] for a, b in got)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"kata{k % 5000}" for k in range(60_000))
    base = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas dua belas"
    rows = [("a", base), ("a", base), ("b", base.upper() + "!"), (None, base), ("c", None), ("d", ""), ("e", "pendek saja"), ("f", long), ("g", long + " ekor")]
    r = near_duplicates(spark.createDataFrame(rows, "text_id string, text string"))
    assert {tuple(x) for x in expanded(r).collect()} == {("a", "b"), ("f", "g")}
    empty = near_duplicates(spark.createDataFrame([], "text_id string, text string"))
    assert expanded(empty).count() == 0 and groups(empty).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_split_overlap_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"t{k:03}", t, rng.choice(["train", " Train", "TRAIN ", "test", "calibration", "Test ", None, "other"]), rng.choice(["News", "online-news", None])) for k, t in enumerate(texts(seed, 260))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "text_id string, processed_text string, split string, source_type string, source string")
    r = split_overlap(df)
    side = {i: (s or "").strip().lower() for i, _, s, _ in rows}
    expected = {(a, b) for a, b in brute([(i, t) for i, t, _, _ in rows], 2, 8) if {"train"} < {side[a], side[b]} and {side[a], side[b]} <= {"train", "test", "calibration"}}
    assert {tuple(sorted((x["train_id"], x["held_id"]))) for x in record_pairs(r).collect()} == expected
    rep = report(r).collect()
    held = {b if side[a] == "train" else a for a, b in expected}
    assert sum(x["overlapping"] for x in rep) == len(held) and sum(x["pairs"] for x in rep) == len(expected)
    assert all(0 < x["covered_a"] <= 1 and 0 < x["covered_b"] <= 1 for x in aligned(r).collect())


def test_split_overlap_odd_rows(spark):
    t = "satu dua tiga empat lima enam tujuh delapan"
    rows = [("a", t, "train", None), ("b", t, "test", None), ("b", t, "test", None), ("c", t, None, None), (None, t, "train", None), ("d", None, "train", None), ("e", "", "test", None)]
    r = split_overlap(spark.createDataFrame(rows, "text_id string, processed_text string, split string, source_type string"))
    assert [tuple(x)[:2] for x in record_pairs(r).collect()] == [("a", "b")]
    assert split_overlap(spark.createDataFrame([], "text_id string, processed_text string, split string, source_type string")).links.count() == 0


def test_align():
    a = "satu dua tiga empat lima enam tujuh delapan".split()
    assert align(a, a) == (8, 8, 8)
    assert align(a, a[:4] + ["x"] + a[4:]) == (8, 8, 4)
    assert align(a, list("abcdefgh")) == (0, 0, 0)
    assert align(["x"] * 3000, ["x"] * 2999)[1] == 2999  # repeated seeds stay linear


def test_sketch_never_exceeds_the_distance():
    import pyarrow as pa

    rng = random.Random(3)
    sets = [sorted({rng.getrandbits(63) * rng.choice([1, -1]) for _ in range(rng.randrange(0, 60))}) for _ in range(40)]
    sketch = parity(pa.array(sets, pa.list_(pa.int64())))
    for i in range(40):
        for j in range(40):
            bits = sum(bin((int(f[i]) ^ int(f[j])) & (2**64 - 1)).count("1") for f in sketch)
            assert bits <= len(set(sets[i]) ^ set(sets[j]))


@pytest.mark.parametrize("words", [3, 5, 10])
def test_split_blocks_lose_no_pair(spark, words):
    """Repetitive texts, whose elements are nearly all frequent, with every block above two pairs split."""
    rng = random.Random(words)
    rows = [(f"t{k:03}", " ".join(f"k{rng.randrange(words)}" for _ in range(rng.randrange(12, 30)))) for k in range(300)]
    rows += [(f"u{k:03}", t + rng.choice(["", " akhir"])) for k, (_, t) in enumerate(rows[:100])]
    df = spark.createDataFrame([(i, t, rng.choice(["train", "test"]), None) for i, t in rows], "text_id string, text string, split string, source_type string")
    expected = brute(rows, 3, 12)
    for hot in (2, 500_000):
        assert {tuple(x) for x in expanded(near_duplicates(df, hot=hot)).collect()} == expected
    side = {r["text_id"]: r["split"] for r in df.collect()}
    across = {(a, b) for a, b in brute(rows, 2, 8) if side[a] != side[b]}
    for hot in (2, 500_000):
        o = split_overlap(df, text_col="text", hot=hot)
        assert {tuple(sorted((x["train_id"], x["held_id"]))) for x in record_pairs(o).collect()} == across


def test_many_copies_stay_linear(spark):
    t, like = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas duabelas tigabelas empatbelas", "nol satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas duabelas tigabelas empatbelas"
    rows = [(f"c{k:02}", t, "train" if k < 30 else "test") for k in range(40)] + [("z1", like, "test"), ("z2", like, "train")]
    df = spark.createDataFrame(rows, "text_id string, text string, split string").withColumn("source_type", F.lit(None).cast("string"))
    r = near_duplicates(df)
    assert expanded(r).count() == 42 * 41 // 2
    few = {tuple(x) for x in expanded(r, copies=5).collect()}
    assert {x for p in few for x in p} == {i for i, _, _ in rows} and ("z1", "z2") in few and len(few) < 130
    o = split_overlap(df, text_col="text")
    assert record_pairs(o).count() == 31 * 11
    held = {(x["train_id"], x["held_id"]) for x in record_pairs(o, copies=5).collect()}
    assert {x for p in held for x in p} == {i for i, _, _ in rows} and ("z2", "z1") in held and len(held) < 90


def test_overlap_of_texts_that_repeat_their_words(spark):
    texts = [" ".join(f"k{n}" for n in t) for t in ((1, 1, 0, 3, 3, 0, 3, 1), (0, 3, 0, 1, 3, 3, 1, 1))]
    rows = [("a", texts[0], "train", "x"), ("b", texts[1], "test", "x")]
    df = spark.createDataFrame(rows, "text_id string, processed_text string, split string, source_type string")
    assert [(r["train_id"], r["held_id"]) for r in record_pairs(split_overlap(df)).collect()] == [("a", "b")]
