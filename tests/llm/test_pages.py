import random
import time

import pytest

from lontar.llm import blocks as B
from lontar.llm.main_body import frame_lines, main_bodies, read_page
from lontar.llm.residue import _near_cores, line_kind, residue_records, without_residue

PAGE = """Beranda | Berita | Video | Cari
Beranda > Energi > Panel Surya Menyala di Desa Sera
[Panel Surya Menyala di Desa Sera]
Penulis: Bu Rani
Senin, 3 Mei 2021 10:00:00 WIB
Bagikan ke teman Anda
Warga desa menyambut panel surya yang dipasang sejak Januari, karena lampu tidak padam lagi.
IKLAN
• Kontak: Pak Budi, Desa Sera
Suara dari Desa Sera dan Dusun Baru
Bagikan hasil panen surya ini ke desa tetangga, pinta Pak Budi sambil menunjuk panel.
Baca juga: Harga Aki Naik, Warga Mengeluh
“Terang sekali rumah kami sekarang,” ujar Bu Rani.
Tag: desa sera, dusun baru
Baca Juga
1. Harga Sekring Naik, Pak Joko Mengeluh
2. Cerita Bu Ina Merawat Aki
Belum ada komentar
© 2021 Media Sera - All rights reserved
Kembali ke atas"""
MAIN = {3, 7, 9, 10, 11, 13}


def test_main_body_of_a_page():
    page = read_page(PAGE, ("Panel Surya Menyala di Desa Sera",))
    frame, trusted, main = page.frame, page.trusted, page.main
    assert set(frame) == set(range(1, 21)) - MAIN and not trusted
    assert main.split("\n") == [PAGE.split("\n")[k - 1] for k in sorted(MAIN)]


def test_headline_without_a_title():
    assert 3 not in read_page(PAGE).frame


@pytest.mark.parametrize(
    "line, mark",
    [
        ("  ​", B.BLANK), ("Hak cipta 2020 Media Sera. Seluruh isi dilindungi undang-undang. »", B.FRAME), ("[Atur pilihan kuki]", B.FRAME), ("SALIN TAUTAN:", B.FRAME),
        ("Haji Baru - Media Sera", B.FRAME), ("2024-03-08 07:16:55", B.FRAME), ("6 Desember 2023 pukul 18.37", B.FRAME), ("Terpopuler:", B.LINKS),
        ("Di desa, hak cipta buku panduan panel dipegang dinas sejak 2012.", B.MAIN), ("Menu makan siang di balai desa hari itu ikan asap, cerita Pak Budi.", B.MAIN), ("Jadwal Mei 2021 di Desa Sera", B.OPEN),
    ],
)
def test_first_pass(line, mark):
    assert B.first_pass(line) == mark


@pytest.mark.parametrize(
    "line, kind",
    [
        ("${lokasi}", "placeholder"), ("Harga {{ harga }} di desa", "placeholder"), ("penulis DI SINI", "placeholder"), ("{% block isi %}", "placeholder"),
        ("Catatan alat berbunyi {\"arus\": {n}} saat diperiksa.", "other"), ("Halaman tidak ditemukan", "residue"), ("You need to enable JavaScript to run this app. (Media X)", "residue"),
        ("Amet elit nisi ullamco aliqua amet dolor velit nulla.", "residue"), ("Brosur masih memuat lorem ipsum pada kolom harga, keluh Bang Luti.", "other"), ("asdf asdf jkl (2) draf 0af3", "residue"),
    ],
)
def test_line_kind(line, kind):
    assert line_kind(line, B.OPEN) == kind


ARTICLE = "Judul Berita Panjang Desa\nWarga desa menyambut panel surya yang dipasang sejak Januari, karena lampu tidak padam lagi."


def records(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", True) for i, t in rows], "record_id bigint, content_text string, id string, text string, trusted boolean")


def test_residue(spark):
    rows = [
        (1, PAGE), (2, "404\nHalaman tidak ditemukan\nKembali ke atas"), (3, ARTICLE + "\nHarga ${harga} per bulan menurut warga desa itu."), (4, "Peramban Anda tidak mendukung skrip. Aktifkan skrip lalu muat ulang Media Sera."),
        (5, ARTICLE + "\nLayar menampilkan pesan Error 404 dan warga mengira halaman tidak ditemukan di peladen desa."), (6, None), (7, ""), (8, " \n\t"), (None, "${judul}"), (2, "404\nHalaman tidak ditemukan\nKembali ke atas"),
        (9, "kata " * 200_000), (10, "baris\n" * 50_000),
    ]
    got = sorted((r["record_id"] for r in residue_records(records(spark, rows)).collect()), key=str)
    assert got == [2, 2, 3, 4, None]
    assert residue_records(records(spark, [])).count() == 0
    assert {r["record_id"] for r in without_residue(records(spark, rows[:3] + rows[8:9])).collect()} == {1, None}


def test_likeness_spreads_trusted_labels(spark):
    known = "Terjadi kesalahan pada sistem kami sehingga isi berita belum dapat kami muat untuk anda pada saat ini silakan ulangi sebentar lagi ya"
    like = known.replace("Terjadi kesalahan pada sistem kami", "Sebuah masalah pada sistem kami")
    other = "Koperasi desa membagikan panel surya kepada warga yang rumahnya jauh dari jaringan listrik sejak musim hujan yang lalu."
    got = {r["record_id"] for r in residue_records(records(spark, [(1, known), (2, like + "."), (3, other)])).collect()}
    assert 1 in got and 3 not in got


def test_frame_lines_and_bodies(spark):
    df = records(spark, [(1, PAGE), (2, "404\nHalaman tidak ditemukan"), (3, None), (4, "")])
    assert {(r["record_id"], r["line_no"]) for r in frame_lines(df).collect()} == {(1, k) for k in range(1, 21) if k not in MAIN}
    bodies = {r["record_id"]: r["main_text"] for r in main_bodies(df).collect()}
    assert bodies[3] is None and bodies[4] == "" and "Terang sekali" in bodies[1] and "Bagikan ke teman" not in bodies[1]
    assert frame_lines(records(spark, [])).count() == 0


def test_likeness_reaches_the_record_at_the_threshold(spark):
    known = "Terjadi kesalahan pada sistem kami sehingga isi berita belum dapat kami muat untuk anda pada saat ini silakan ulangi sebentar lagi ya"
    like = known.replace("Terjadi kesalahan pada sistem kami", "Sebuah masalah pada sistem kami")
    assert {r["record_id"] for r in residue_records(records(spark, [(1, known), (2, like + ".")])).collect()} == {1, 2}


def test_links_of_cores_equal_brute_force(spark):
    rng = random.Random(4)
    cores = []
    for k in range(300):
        w = [f"k{rng.randrange(5000)}" for _ in range(rng.randrange(3, 80))]
        cores.append(w)
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randrange(1, 3)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(5000)}"
            cores.append(v)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in cores]
    expected = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])}
    got = {(r["a"], r["b"]) for r in _near_cores(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(cores)], "node bigint, core string")).collect()}
    assert got == expected and len(expected) > 100


NOTICES = """Terjadi kesalahan pada sistem kami sehingga isi berita belum dapat kami muat untuk anda
Silakan muat ulang laman ini sebentar lagi atau ulangi lewat peramban yang berbeda bila masih gagal
Sesi anda di laman kami sudah lama berakhir sebab tidak ada kegiatan selama beberapa jam
Jika halaman masih belum juga tidak muncul tunggu sampai kami selesai memperbaiki semua bagian
Mohon coba lagi nanti malam setelah perbaikan peladen kami selesai dan semua layanan berjalan
Terjadi kesalahan saat kami menyambung ke pusat data yang menyimpan seluruh tulisan dan gambar"""


def test_residue_whatever_the_length(spark):
    flat = "Halaman tidak ditemukan. Maaf, halaman yang Anda cari sudah tidak ada di situs kami. Silakan coba lagi beberapa saat lagi. Kode galat: 4F2A. Kembali ke beranda. Hubungi pengelola situs."
    article = "Maaf, kami tidak menyangka halaman itu hilang, kata Pak Budi. Warga desa menyambut panel surya yang dipasang sejak Januari, karena lampu tidak padam lagi dan tagihan turun."
    assert len(flat) > 160 and line_kind(flat, B.MAIN) == "residue"
    assert len(article) > 160 and line_kind(article, B.MAIN) == "sentence"
    unknown = NOTICES.rpartition("\n")[0] + "\nAda gangguan saat kami menyambung ke pusat data yang menyimpan seluruh tulisan dan gambar."
    opening = "isi tulisan ini belum selesai kami siapkan\nharap bersabar sampai tim kami kembali\nsemua gambar dan tulisan ikut kami pindahkan"
    rows = [(1, flat), (2, article), (3, NOTICES), (4, unknown), (5, "Terjadi kesalahan pada peladen\n" + opening), (6, opening)]
    assert len(NOTICES.split()) > 80
    assert sorted(r["record_id"] for r in residue_records(records(spark, rows)).collect()) == [1, 3, 4, 5, 6]


def test_filled_copies_of_an_article_stay(spark):
    text = "Warga desa menyambut panel surya yang dipasang sejak Januari dengan harga %s per bulan, karena lampu tidak padam lagi."
    got = [r["record_id"] for r in residue_records(records(spark, [(1, text % "${harga}"), (2, text % "Rp12.000"), (3, ARTICLE + "\n" + text % "Rp9.000")])).collect()]
    assert got == [1]


def test_repeated_bodies_without_any_message_list(spark):
    """Unknown wordings, told by standing alone under different headlines; an article that is published again stays."""
    notice, filler = "The lamp is out at {0}, come back tomorrow.\nTicket {1}", "write your words in this box"
    article = "Warga Desa Sera menyambut panel surya yang dipasang Pak Budi sejak Januari, kata Bu Rini."
    shape = "record_id bigint, content_text string, content_title string, domain string, canonical_url string"
    rows = [(k, notice.format("Media Sera", k * 7919), f"Judul nomor {'abcdefg'[k]}", "mediasera.example", f"https://mediasera.example/{k}") for k in range(3)]
    rows += [(3, notice.format("Kabar Tulo", "e02267ee4ecf"), "Kabar yang lain", "kabartulo.example", None), (4, "The lamp is out at Kabar Tulo, come back tomorrow.", "Satu lagi", "kabartulo.example", None)]
    rows += [(10 + k, filler, "Judul sama", "a.example", None) for k in range(4)]  # one headline only
    rows += [(20 + k, article, f"Warga {'pqrs'[k]} menyambut", "b.example", None) for k in range(4)]  # many names
    got = residue_records(spark.createDataFrame(rows, shape), title_cols=("content_title",), site_cols=("domain", "canonical_url"), messages=False)
    assert sorted(r["record_id"] for r in got.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("find, kept", [(residue_records, range(9)), (frame_lines, range(100, 3100))])
def test_long_chains_of_likeness_do_not_move_the_articles(spark, find, kept):
    """Every further link of a chain costs a look at the articles, but none of them is shuffled for it."""

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        time.sleep(0.3)  # the figures are renewed with the next task after a tenth of a second
        spark.range(1).count()
        sc.listenerBus().waitUntilEmpty(30_000)
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [" ".join(word() for _ in range(4)) for _ in range(36)]
    # windows of 80 words; neighbours have a similarity of 0.81, the next but one 0.65
    chain = [(k, "\n".join(lines[2 * k : 2 * k + 20] + ["${judul}"] * (k == 0))) for k in range(9)]
    articles = [(100 + k, f"Bagikan ke teman Anda\nWarga {' '.join(word() for _ in range(45))}, kata mereka sejak Januari.") for k in range(3000)]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        before = shuffled()
        got = sorted(r["record_id"] for r in find(records(spark, chain + articles)).collect())
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert got == list(kept)
    assert moved < sum(len(t) for _, t in articles) / 2
