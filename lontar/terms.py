"""Terms that the demonstration queries and their SQL share."""

from __future__ import annotations

# Word to (label, weight).
WORDS = {
    "terang": ("positif", 1.2), "puas": ("positif", 1.4), "awet": ("positif", 1.1), "hemat": ("positif", 1.2), "tenang": ("positif", 1.0), "memuji": ("positif", 1.3), "mudah": ("positif", 1.0),
    "rusak": ("negatif", 1.3), "mati": ("negatif", 1.2), "padam": ("negatif", 1.1), "gelap": ("negatif", 1.0), "kecewa": ("negatif", 1.5), "mengeluh": ("negatif", 1.2), "dicuri": ("negatif", 1.4),
}
PHRASES = ["belum pernah rusak", "cepat panas", "tidak merata", "serah terima", "tidak gelap lagi", "terang", "kecewa", "padam", "awet", "puas"]
ASPECTS = {"biaya": ["cicilan", "harga", "biaya", "iuran"], "keandalan": ["padam", "mati sejak", "rusak"], "perawatan": ["teknisi", "suku cadang"], "manfaat": ["terang", "hemat"]}
SOURCE_LIST = ["mediamerdeka7.example", "kabarkulogar.example"]
OUTSIDE_TERMS = ["pulau", "teluk"]
LOCAL_TERMS = ["desa", "dusun"]
