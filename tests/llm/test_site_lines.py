from lontar.llm.site_lines import boilerplate_blocks, boilerplate_lines, site_of, without_boilerplate

SHAPE = "record_id bigint, canonical_url string, domain string, content_text string, k string, keys string, block string, page string, site string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SHAPE)


def rows():
    out = []
    for k in range(8):
        domain = ["a.example", "WWW.A.example ", None, " "][k % 4]
        out.append((k, f"https://www.a.example/{k}", domain, f"Menu - Atas\r\n\nOnly {k}\nHAK CIPTA, 2020\nBagikan!"))
    out.append((8, "https://www.a.example/0", "a.example", "Menu Atas"))  # the same page again
    out.append((9, "https://b.example/9", "b.example", "Menu Atas\nHak cipta 2020"))
    return out


def found(df):
    return {(r["record_id"], r["line_no"]) for r in df.collect()}


def test_lines_blocks_and_site_forms(spark):
    got = boilerplate_lines(frame(spark, rows()))
    assert found(got) == {(k, n) for k in range(8) for n in (1, 4, 5)} | {(8, 1)}
    # the two closing lines follow each other and are one block, the menu is one of its own
    by_line = {r["line_no"]: r["block"] for r in got.where("record_id = 3").collect()}
    assert by_line[4] == by_line[5] != by_line[1]


def test_support_counts_pages_not_records(spark):
    same = [(k, "https://a.example/1", "a.example", "Sama\nBeda " + "x" * k) for k in range(9)]
    assert found(boilerplate_lines(frame(spark, same))) == set()


def test_nulls_empty_and_repeated_rows(spark):
    odd = rows() + [(None, "https://a.example/n", "a.example", "Bagikan"), (20, None, None, "Bagikan"), (21, "https://a.example/21", "a.example", None), (22, "https://a.example/22", "a.example", ""), (0, *rows()[0][1:])]
    got = boilerplate_lines(frame(spark, odd)).collect()
    assert (None, 1) in {(r["record_id"], r["line_no"]) for r in got}
    assert not any(r["record_id"] in (20, 21, 22) for r in got)
    assert boilerplate_lines(frame(spark, [])).count() == 0


def test_text_comes_out_without_them(spark):
    out = {r["record_id"]: r["content_text"] for r in without_boilerplate(frame(spark, rows())).collect()}
    assert out[3] == "\nOnly 3" and out[8] == "" and out[9] == "Menu Atas\nHak cipta 2020"
    assert without_boilerplate(frame(spark, rows())).columns == frame(spark, rows()).columns


def test_blocks_and_their_occurrences(spark):
    own = [(k, f"https://a.example/{k}", "a.example", f"Kepala\n \nMenu\n\nIsi {k}\n\nKaki") for k in range(7)]
    own.append((7, "https://a.example/7", "a.example", "Kepala\nIsi 7\n\nMenu"))
    got = {r["first_line"]: tuple(r)[2:] for r in boilerplate_blocks(frame(spark, own)).collect()}
    assert got == {"kepala": (2, 8, 16), "kaki": (1, 7, 7)}
    out = {r["record_id"]: r["content_text"] for r in without_boilerplate(frame(spark, own)).collect()}
    assert out[3] == "\nIsi 3\n" and out[7] == "Isi 7\n"  # the blank line inside the block goes, those around the text stay
    assert boilerplate_blocks(frame(spark, [])).count() == 0


def test_long_text(spark):
    text = "\n".join(f"baris {k}" for k in range(20_000))
    many = [(k, f"https://a.example/{k}", "a.example", text) for k in range(6)]
    assert boilerplate_lines(frame(spark, many)).count() == 6 * 20_000


def test_site_of(spark):
    df = spark.createDataFrame([(" WWW.X.example", None), (None, "HTTPS://u@WWW.Y.example:80/a"), ("", "no address"), (None, None)], "d string, u string")
    assert [r[0] for r in df.select(site_of(df["d"], df["u"])).collect()] == ["x.example", "y.example", None, None]
