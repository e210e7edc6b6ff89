import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lontar.functions import match, numeric, text, urls
from lontar.functions.html import html_lines
from lontar.functions.numeric import hashed_vector
from lontar.functions.urls import normalize_one
from lontar.operators.spans import split_spans


def one(spark, expr, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [("Gak BANGET!!! http://x.id/a  dgn www.y.id listrik–padam", "tidak sangat! dengan listrik padam"), (None, ""), ("", ""), (" \t\n", ""), ("blm-tentu blm", "blm-tentu belum"), ("a..b,,c", "a.b,c")],
)
def test_clean_text(spark, value, expected):
    assert one(spark, lambda c: text.clean_text(c, {"banget": "sangat", "dgn": "dengan"}), value) == expected


def test_tokens_and_spans(spark):
    assert one(spark, text.tokens, "Anak-anak 12 Jum'at é") == ["anak-anak", "jum'at", "é"]
    got = one(spark, text.token_spans, "Di 3 Desa, anak-anak!")
    assert [(t["text"], t["start"], t["end"], t["index"]) for t in got] == [("di", 0, 2, 0), ("desa", 5, 9, 1), ("anak-anak", 11, 20, 2)]
    assert one(spark, text.token_spans, "123") == []


def test_small_text_functions(spark):
    assert one(spark, text.word_count, "  a b\tc ") == 3 and one(spark, text.word_count, " ") == 0
    assert one(spark, lambda c: text.preview(c, 10), "abcdef   ghijkl") == "abcdef..." and one(spark, lambda c: text.preview(c, 10), "abc") == "abc"
    assert one(spark, text.base_id, "RAW-1#02") == "RAW-1"
    assert one(spark, text.drop_repeated_lines, "a\na\n\nb\na") == "a\nb\na"
    assert one(spark, text.value_list, " a, ,b ") == ["a", "b"]
    assert one(spark, lambda c: text.unique_segments(c, F.lit(" HALO  dunia"), F.lit(None).cast("string"), F.lit("lain")), "Halo dunia") == "Halo dunia lain"


def test_matching(spark):
    assert one(spark, lambda c: match.has_phrase(c, "terang"), "éterang") is False
    assert one(spark, lambda c: match.count_phrase(c, "a.b"), "a.b axb, a.b") == 2
    assert one(spark, lambda c: match.find_terms(c, ["pulau", "desa", "desa"]), "Desa di Pulau") == ["desa", "pulau"]
    assert one(spark, lambda c: match.longest_term(c, ["sur", "surya", "x"]), "SURYA") == "surya"
    assert one(spark, lambda c: match.first_group(c, {"a": ["xx"], "b": ["yy"]}, "c"), "YY xx") == "a"


def test_first_place_prefers_specific_then_longer(spark):
    terms = [("borneo", "Borneo", False), ("sera", "Sera", True), ("sera baru", "Sera Baru", True)]
    both = lambda c: match.first_place([("text", c), ("query", F.lit("di sera baru"))], terms)
    assert tuple(one(spark, both, "Borneo raya")) == ("Sera Baru", "query", "sera baru", True)
    assert tuple(one(spark, both, "kota Sera.")) == ("Sera", "text", "sera", True)
    assert tuple(one(spark, lambda c: match.first_place([("t", c)], terms), "Seram")) == ("", "", "", False)


URLS = [
    ("https://WWW.Ex.com/a/?utm_source=x&b=2&a=1#f", "https://ex.com/a?a=1&b=2"), ("http://ex.com", "http://ex.com"), (None, ""), (" ", ""), ("HTTPS://ex.com/%41%20b/?hl=id&page=all&q=", "https://ex.com/A b?q="),
    ("https://ex.com/a?page=2&fbclid=9", "https://ex.com/a?page=2"),
]


@pytest.mark.parametrize("value, expected", URLS)
def test_normal_url(spark, value, expected):
    assert one(spark, urls.normal_url, value) == expected
    assert normalize_one(value, frozenset(urls.TRACKING)) == expected


def test_url_parts(spark):
    assert one(spark, urls.netloc, "https://www.A.id:80/x") == "www.a.id:80" and one(spark, urls.domain, "kata saja") == ""
    assert one(spark, urls.title_from_url, "https://a.id/x/berita_baru/panel-surya%20desa") == "berita baru panel surya desa"
    assert one(spark, urls.title_from_url, "https://www.tiktok.com/@u/video/12") == "@u 12" and one(spark, urls.title_from_url, "https://a.id/") == ""
    assert one(spark, lambda c: urls.blank_walls(c, F.lit("https://www.instagram.com/p/1")), "Log into Instagram now") == ""
    assert one(spark, lambda c: urls.blank_walls(c, F.lit("https://a.id/1")), " Log  into Instagram") == "Log into Instagram"


def test_html():
    page = "<html><script>x()</script><p>Satu &amp; dua<br>tiga</p><p>tiga</p><div> </div><ul><li>a<li>b</ul></html>"
    assert html_lines(page) == "Satu & dua\ntiga\na\nb" and html_lines(None) == "" and html_lines("teks") == "teks"


def test_probabilities(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, -5.0), (0.0, 1.0, 2.0)], "a double, b double, c double")
    z = [F.col(x) for x in "abc"]
    p = numeric.softmax(z, 2.0)
    rows = df.select(p.alias("p"), numeric.argmax_label(z).alias("l"), numeric.margin(z).alias("m")).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-12 for r in rows)
    assert [r["l"] for r in rows] == ["negatif", "positif"] and [r["m"] for r in rows] == [0.0, 1.0]
    third = F.lit(1 / 3)
    assert abs(df.select(numeric.entropy([third, third, third])).first()[0] - 1) < 1e-9
    assert df.select(numeric.row_entropy(F.lit(None).cast("double"), [F.lit(0.0)] * 3)).first()[0] == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(numeric.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]
    assert hashed_vector("", 8) == [0.0] * 8 and abs(sum(x * x for x in hashed_vector("panel surya desa", 64)) - 1) < 1e-4
    assert one(spark, lambda c: numeric.number(c), "abc") == 0.0 and one(spark, lambda c: numeric.clamp01(c), "7") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!?;,-1\n")), max_size=400), st.integers(0, 50), st.integers(50, 120))
def test_spans_keep_all_words(t, shortest, longest):
    spans = split_spans(t, shortest, longest)
    assert "".join("".join(s.split()) for s in spans) == "".join(t.split())
    assert all(len(s) <= longest for s in spans)


def test_span_boundaries():
    assert split_spans("Harga Rp1.500 naik. Lihat www.a.id. Kata Dr. Budi; sudah selesai!", 0, 0) == ["Harga Rp1.500 naik. Lihat www.a.id. Kata Dr. Budi;", "sudah selesai!"]
    assert split_spans("Satu kalimat pendek. Dua. Tiga kalimat yang lebih panjang dari batas.", 10, 0) == ["Satu kalimat pendek.", "Dua. Tiga kalimat yang lebih panjang dari batas."]
    assert split_spans(None) == [] and split_spans("  ") == []


def test_compatibility_form(spark):
    import unicodedata

    from lontar.functions.text import nfkc

    values = ["  A  B ", "ﬁ ＡＢＣ ½", "Straße\u00a0X", "İstanbul", "", None, "e\u0301"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = {r["k"]: r["n"] for r in df.select("k", nfkc(F.col("v")).alias("n")).collect()}
    assert got == {k: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()) for k, v in enumerate(values)}


def test_title_case_equals_python(spark):
    from lontar.operators.lookup import canonical_place, title_case

    values = ["kota-baru d'or 3desa", "SEI AMBAWANG", "", "tanjung (hulu)"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(title_case(F.col("v"))).collect()] == [v.title() for v in values]
    assert df.limit(1).select(canonical_place(F.lit(" KABUPATEN KUBU RAYA ")), canonical_place(F.lit("Kota Lama"))).first()[:] == ("Kubu Raya", "Kota Lama")
