import random
import re

import pytest

from lontar.llm.charset_repair import repair, repaired
from lontar.llm.encode_corpus import TOKENIZERS, Encoder, cut, encode_long, encoded
from lontar.llm.leakage import leaks, passages_of, automaton, word_spans


@pytest.fixture(scope="module")
def enc():
    return Encoder(open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = [
    "Warga desa memuji panel surya, hemat Rp12.000 sebulan!", " dua  blank   dan\ttab\r\n\n baris", "it's they'll 's 'S o'clock I'd", "日照时间 😀👨‍👩‍👧‍👦 ـقبة ไทย é", "<|endoftext|> teks biasa <|endoftext|>", "a" * 500, "\xa0　 x", "١٢٣ ²½ 12345678901234567890",
]


def test_ids_equal_the_other_library(enc, peer):
    assert [enc.encode(t) for t in TEXTS] == [e.ids for e in peer.encode_batch(TEXTS, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation_is_exact(enc, seed):
    rng = random.Random(seed)
    pieces = ["a", "banana", "12345", " ", "   ", "\n", "'s", "'", "!!!", "日本", "😀", "lampu ", "é", "..", "xyzzy"]
    text = "".join(rng.choice(pieces) * rng.choice([1, 1, 2, 9, 40]) for _ in range(250))
    for size in (20, 57, 200):
        assert encode_long(enc, text, size) == enc.encode(text)
        assert "".join(t for t, _ in cut(text, size)) == text


@pytest.mark.parametrize("unit", ["a", "ab", "abcdefghij", " ", "\n", "!", "=-", "1", "日本語", "é", "😀", "'", "a1"])
def test_unsplit_runs(enc, unit):
    text = "awal " + unit * (9000 // len(unit)) + " akhir"
    for size in (700, 3000):
        assert encode_long(enc, text, size) == enc.encode(text)


def test_random_letters(enc):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert encode_long(enc, text, 1500) == enc.encode(text)


def test_encoded_table(spark, enc):
    long = "kata panjang sekali " * 500 + "x" * 9000
    rows = [(1, None), (2, ""), (3, " "), (4, "Halo dunia"), (4, "Halo dunia"), (5, long), (5, long), (None, long + "y"), (None, "z")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, id string, ids int")
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded(df, piece=1000).collect()), key=str)
    assert got == sorted(((i, enc.encode(t) if t else []) for i, t in rows), key=str)
    assert encoded(df.limit(0)).count() == 0


def brute_leaks(docs, items, run=12):
    def grams(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}

    own = [(i, grams(t)) for i, t in items if i is not None]
    return {(d, i) for d, t in docs for i, g in own if g & grams(t)}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"k{n}" for n in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40)))) for k in range(30)] + [(99, None), (98, ""), (97, "pendek"), (None, "x " * 20)]
    docs = []
    for k in range(80):
        t = [rng.choice(words) for _ in range(30)]
        if k % 2:
            w = rng.choice(items[:30])[1].split()
            n = rng.randrange(8, 16)
            t[10:10] = w[:n]
        docs.append((k, ", ".join(t).upper()))
    docs += [(None, items[0][1]), (200, None), (201, "")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items + items[:3]], "item_id bigint, text string, doc_id string")
    expected = brute_leaks(docs, items)
    for limit in (200_000, 50):  # one automaton, and many
        assert {(r["doc_id"], r["item_id"]) for r in leaks(d, i, limit=limit).collect()} == expected
    assert leaks(d, i.limit(0)).count() == 0 and leaks(d.limit(0), i).count() == 0


def test_passages_point_into_the_original():
    item = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas belas tigabelas"
    text = "İ Awal: SATU, dua -- tiga empat LIMA enam tujuh delapan sembilan sepuluh sebelas belas tigabelas! Akhir."
    (s, e, n), = passages_of(text, automaton([(7, item.split())], 12), 12)[0]
    assert text[s:e].startswith("SATU") and text[s:e].endswith("tigabelas") and n == 13
    assert word_spans("A é b") == [(0, 1), (4, 5)]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_round_trip_of_wrong_decoding(codec):
    clean = "Kedai Mèrkõ milik Bang Ñgarå — £ 180, “terang” ½ … 25 °C ✓ 😀 kata Růsasěn"
    raw = clean.encode("utf-8")
    wrong = "".join(bytes([b]).decode(codec) if _has(b, codec) else chr(b) for b in raw)
    new, undone, n = repair(wrong)
    assert new == clean and undone and n > 0


def _has(b, codec):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


def test_twice_wrong_and_partly_wrong():
    clean = "Nama Růsasěn — “puas” ½"
    once = "".join(bytes([b]).decode("cp1252") if _has(b, "cp1252") else chr(b) for b in clean.encode())
    twice = "".join(bytes([b]).decode("cp1252") if _has(b, "cp1252") else chr(b) for b in once.encode())
    assert repair(twice)[0] == clean
    assert repair("Nomor 185º Běńyenga. Sewa Â£ 151")[0] == "Nomor 185º Běńyenga. Sewa £ 151"
    assert repair("鈥檚udah terang 路 begitu pula B盲ma")[0] == "’sudah terang · begitu pula Bäma"


@pytest.mark.parametrize("text", ["SÃO 35 PAINÉIS, ATENÇÃO: À DESA", "menurut Luðå, tukang", "日照时间 小时", "солнце", "merek Kujiwî™. Geğarmâ™ Pâße", "├── panel", "ناحية", "„menerangi” ’sudah’ × Ñ", "é" * 9])
def test_clean_text_stays(text):
    assert repair(text) == (text, [], 0)


def test_repaired_table(spark):
    rows = [(1, None), (2, ""), (3, "ascii"), (4, "Â£ 3"), (4, "Â£ 3"), (5, "hilang � kata"), (None, "Ã© 1"), (6, "é bersih"), (7, "Ã© " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, id string")
    got = {(r["doc_id"], r["restored"][:5], r["lost"]) for r in repaired(df).collect()}
    assert got == {(4, "£ 3", 0), (5, "hilan", 1), (None, "é 1", 0), (7, "é é é", 0)}
    assert repaired(df).count() == 5 and repaired(df.limit(0)).count() == 0


@pytest.mark.parametrize("clean", ["emisi CO₂ turun", "hambatan 10 kΩ", "hambatan 5 MΩ", "kata বাংলা ভাষা", "தமிழ் மொழி", "ꦲꦏ꧀ꦱꦫ", "ខ្មែរ", "ბათუმი", "հայ"])
def test_any_assigned_character_is_restored(clean):
    wrong = "".join(bytes([b]).decode("cp1252") if _has(b, "cp1252") else chr(b) for b in clean.encode())
    assert repair(wrong)[0] == clean


def test_han_and_hangul_read_in_two_byte_encodings():
    for clean in ("日照时间", "太阳能电池板"):
        wrong = clean.encode().decode("gb18030")
        assert repair(wrong)[0] == clean
    assert repair("태양광발전".encode().decode("gb18030", errors="replace"))[0].startswith("태양광발")


@pytest.mark.parametrize("text", ["CAFÉ® dan “MENÚ”", "É… voilà\xa0…", "2 ×\xa03 «École»", "–£5 dan —Écoute", "中国人民 태양광 발전소", "ОАО «МИР» и солнце"])
def test_ordinary_text_stays(text):
    assert repair(text) == (text, [], 0)


def test_long_text_by_levels_of_the_tree(spark, enc):
    """A text of more pieces than one task joins, through the distributed path."""
    rng = random.Random(8)
    text = "".join(rng.choice(["panel surya ", "a" * 40, "1234567", "  \n", "…“”", "漢字かな", "x'll "]) for _ in range(9000))
    df = spark.createDataFrame([(1, text), (2, "pendek"), (3, text + "z")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in encoded(df, piece=1000).collect()}
    assert len(text) > 40 * 1000 and all(got[k] == enc.encode(t) for k, t in ((1, text), (2, "pendek"), (3, text + "z")))


@pytest.mark.parametrize("times", [1, 3, 4, 6])
def test_text_decoded_wrongly_many_times(times):
    text = own = "Kata “panel” dan “surya” – héßö"
    for _ in range(times):
        text = text.encode().decode("latin-1")
    assert repair(text)[0] == own
