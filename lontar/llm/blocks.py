"""Line blocks of a web page: frame, main body, or undecided until the neighbours are known.

The rules run in two passes over the lines of one page.

Pass 1 looks at a line alone. Length, stop-word density and link density decide most lines; wording that pages
use for their frame (legal notices, share prompts, bylines, comment forms ...) decides others. Pass 2 gives each
undecided short line the label of the nearest decided neighbours, with three openings for structure: the page's
headline, link lists under a heading such as "related articles", and list items next to paragraphs.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAIN, FRAME, OPEN, BLANK = "M", "C", "?", "-"
#: Pass-1 marks that pass 2 treats specially: a heading of a link list, and a line of a link list.
LINKS = "R"

# Function words of Indonesian, Malay and English (and a few of other languages of the crawl).
STOP_WORDS = frozenset(
    """yang dan di ke dari untuk pada dengan dalam oleh karena sebab agar supaya bagi tentang seperti sebagai adalah
    ialah itu ini tersebut akan telah sudah belum tidak bukan jangan juga pun lagi masih sedang sangat lebih paling
    hanya saja atau tetapi tapi namun serta maupun jika kalau bila ketika saat waktu sejak sampai hingga setelah
    sebelum menurut kata ujar tulis para ada bisa dapat harus mereka kami kita saya dia ia anda per tiap setiap sebuah
    seorang sekitar antara meski walau sambil lalu kemudian begitu sehingga jadi menjadi atas bawah hari bulan tahun
    jam dipakai masuk tak nya
    the a an of to in on at for from by with and or but is are was were be been has have had that this these those it
    its as not no after before during which who their they he she we you his her our when while because so than then
    de la le les des du un une et en est dans pour par sur que qui van het een en voor op met el los las y os as um
    uma do da dos das que com para""".split()
)

# Opening words of frame lines, matched at the start of a line, lower case.
_FRAME_START = re.compile(
    r"""(?:
    (?:we|this\ (?:web)?site)\ uses?\ cookies | your\ privacy\ (?:matters|is) | situs\ .{1,60}\ (?:memakai|menggunakan)\ (?:kuki|cookie)
    | kami\ (?:dan\ mitra\b.{0,60})?\s?(?:menyimpan\ data|memakai\ kuki|menggunakan\ (?:kuki|cookie)) | .{2,60}\ menghargai\ privasi\ anda
    | saya\ mengerti,?\ tutup | (?:terima|tolak)\ (?:semua\ )?(?:kuki|cookies?) | atur\ (?:pilihan|preferensi)\ (?:kuki|cookie)
    | kelola\ (?:persetujuan|preferensi) | (?:accept|reject)\ all\b | manage\ (?:preferences|cookies) | cookie\ (?:policy|settings|notice)
    | hak\ cipta\ (?:©\ ?)?(?:19|20)\d\d | (?:copyright\ )?(?:©|\(c\))\ ?(?:19|20)?\d?\d? | copyright\b | .{0,60}all\ rights\ reserved
    | dilarang\ (?:mengutip|menyalin|memperbanyak|menyebarluaskan)\b.{0,60}\b(?:isi|halaman|artikel|konten|tulisan)
    | isi\ komentar\ (?:sepenuhnya|menjadi|adalah)?\ ?tanggung\ jawab | tulisan\ (?:kiriman\ )?(?:pembaca|ini)\ (?:telah|sudah|merupakan)\b.{0,30}\bpenyuntingan
    | this\ (?:article|story|content)\ (?:was|is|has\ been)\ (?:provided|supplied|published|republished)
    | .{2,60}\ terdaftar\ (?:pada|di)\ dewan | didukung\ oleh\ (?:mesin|teknologi) | powered\ by\b
    | (?:baca|lihat|simak|cek|tonton)\ (?:juga|pula)\b | (?:read|see)\ (?:also|more)\b
    | (?:tags?|topik|label|kata\ kunci|keywords?)\s?:\ ?\S
    | (?:\#\w[\w\ -]*[,;]?\s*)+(?:[\w\ -]+[,;]\s*)*[\w\ -]*$
    | (?:belum|tidak)\ ada\ komentar | \d+\ komentar$ | (?:tulis|kirim|laporkan|tinggalkan|beri|lihat\ semua)\ komentar\b.{0,20}$
    | alamat\ (?:surel|email)\ anda\ tidak | your\ email\ address\ will | (?:silakan\ )?masuk\ untuk\ (?:berkomentar|menulis\ komentar)
    | leave\ a\ (?:comment|reply) | no\ comments\ yet | log\ ?in\ to\ comment | urutkan\s?:\ ?\w+ | sort\ by\b
    | telepon\ (?:kantor|redaksi)\ ?:?\ ?[\d+(] | (?:telp|telepon|fax|faks)\.?\ ?:?\ ?[\d+(][\d\ ()+-]{4,}$
    | (?:jalan|jl\.?)\ [\w\ .]{2,40}\ (?:nomor|no\.?)\ \d+
    | (?:ikuti|follow)\ (?:kami|kanal|us\b|akun).{0,80}$ | unduh\ aplikasi\b.{0,60}$ | download\ (?:the|our)\ app | dapatkan\ (?:kabar|berita|info|pemberitahuan)\b.{0,80}$
    | media\ sosial\ .{2,50}$ | pasang\ iklan\ di\b.{0,50}$ | subscribe\b.{0,60}$ | sign\ up\ (?:for|to)\b.{0,60}$
    | berlangganan\ (?:buletin|kabar|sekarang|newsletter)\b
    | bagikan(?:\ (?:artikel|berita|halaman|tulisan|cerita))?(?:\ ini)?(?:\ (?:ke|lewat|via|di)\ (?:teman|media\ sosial|pesan|grup)(?:\ anda)?)?$
    | share\ (?:this|on|via|to)\b.{0,30}$ | sebarkan(?:\ (?:artikel|berita))?(?:\ ini)?$
    | (?:salin|copy)\ (?:tautan|link|url)$ | cetak(?:\ (?:halaman|artikel))?(?:\ ini)?$ | print(?:\ (?:this\ )?page)?$
    | kirim(?:\ (?:lewat|via|melalui)\ \w+)?$ | simpan\ (?:untuk\ dibaca\ nanti|artikel)$ | save\ for\ later$
    | gulir\ untuk\ lanjut.{0,30}$ | (?:advertisement|iklan|ads?)\ ?-\ ?(?:scroll|gulir).{0,30}$ | scroll\ to\ continue.{0,20}$
    | lanjut\ ke\ halaman.{0,20}$ | lanjutkan\ membaca.{0,20}$ | continue\ reading.{0,20}$ | simak\ video\b.{0,30}$ | (?:sponsored|promoted)\b.{0,20}$
    | kembali\ ke\ (?:atas|beranda\b.{0,40})$ | back\ to\ top$ | versi\ (?:seluler|desktop|mobil|cetak)$
    )""",
    re.X,
)

# Headings over lists of links to other articles.
_LINK_HEADING = re.compile(
    r"""(?:
    (?:baca|lihat|simak)\ (?:juga|pula) | (?:artikel|berita|tulisan|kabar)\ (?:lain(?:nya)?|terkait|terbaru|terpopuler|terkini|pilihan)(?:\ (?:di|dari)\ .{2,50})?
    | terpopuler | terkini | terbaru | (?:sedang\ )?trending(?:\ di\ .{2,50})? | rekomendasi(?:\ untuk\ anda)? | pilihan\ (?:redaksi|editor|pembaca)
    | you\ (?:may|might)\ also\ like | (?:related|recommended|popular|latest|more)\ (?:articles?|posts?|news|stories|for\ you)
    | (?:most\ (?:read|popular)) | more\ from\ .{2,50} | also\ read | read\ (?:also|next)
    )$""",
    re.X,
)

# Single labels of menus and footers.
_LABELS = frozenset(
    """iklan|advertisement|ad|ads|pariwara|sponsor|rss|redaksi|disclaimer|penafian|karier|karir|tentang kami|hubungi kami
    |kontak|kontak redaksi|peta situs|pedoman media siber|kebijakan privasi|kebijakan kuki|syarat dan ketentuan|beranda|home
    |menu|cari|search|masuk|login|log in|daftar|register|langganan|berlangganan|indeks|index|news|berita|video|foto|galeri|podcast
    |infografik|opini|about|about us|contact|contact us|e-paper|iklan baris|surat pembaca|arsip|cuaca|jadwal|tokoh|pemilu|hukum
    |budaya|wisata|kuliner|olahraga|pendidikan|kesehatan|ekonomi|teknologi|lingkungan|energi|desa|pasar|komunitas|balas|reply
    |privacy policy|terms|terms of use|terms of service|sitemap|careers|newsletter|copyright|privacy""".replace("\n", "").replace("    ", "").split("|")
)

# Month and weekday names.
_MONTH = (
    r"(?:jan(?:uari|uary)?|feb(?:ruari|ruary)?|mar(?:et|ch)?|apr(?:il)?|mei|may|jun[ie]?|jul[iy]?|ag(?:u|us|ustus)|aug(?:ust)?"
    r"|sep(?:t|tember)?|okt(?:ober)?|oct(?:ober)?|nov(?:ember)?|des(?:ember)?|dec(?:ember)?)"
)
_DAY = r"(?:senin|selasa|rabu|kamis|jumat|jum'at|sabtu|minggu|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
_DATE = (
    rf"(?:{_DAY},?\s+)?(?:\d{{4}}-\d\d?-\d\d?|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|\d{{1,2}}\.?\s+{_MONTH}\.?,?\s+\d{{4}}|{_MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}})"
)
_DATE_LINE = re.compile(
    rf"(?:(?:di)?(?:terbit(?:kan)?|perbarui|publikasikan|unggah|tayang(?:kan)?|rilis)|tanggal|published|updated|posted|last updated)?\s*(?:pada|on)?\s*:?\s*{_DATE}"
    r"[T,|\s-]*(?:(?:pukul|jam|at|pkl)\.?\s*)?(?:\d{1,2}[.:]\d\d(?:[.:]\d\d)?)?\s*(?:wib|wita|wit|am|pm|utc|gmt|z)?(?:[+-]\d\d:?\d\d)?\.?$"
)
_AUTHOR = re.compile(
    r"(?:(?:di)?(?:tulis|laporkan|sunting|edit)\s+oleh|oleh|penulis|reporter|editor|redaktur|penyunting|pewarta|jurnalis|wartawan|kontributor|laporan|by|written by|author|reported by)"
    r"\s*:?\s+[^.!?:]{2,60}$"
)
_BYLINE_ROLES = re.compile(r"^(?:oleh|penulis|reporter|editor|redaktur|penyunting|pewarta|laporan|kontributor|by|author)\b")
_SEPARATORS = re.compile(r"\s*[|/›>»·•‹<]\s*|\s{2,}")
_MARKS, _WIDE = "|/›>»·•‹<", re.compile(r"[^\S ]\s|\s[^\S ]")
_CRUMB = re.compile(r"(?:beranda|home|depan)\s*[>›/»|]")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_ZERO_WIDTH = re.compile("[​‌‍⁠﻿­]")
_BULLETS = frozenset("•*·–—-(")
_BULLET = re.compile(r"^(?:[•*·–—-]\s+|\(?\d{1,3}[.)]\s+)")
_NUMBERED = re.compile(r"^\(?\d{1,3}[.)]\s+")
_FIELD = re.compile(r"^\w+:\s")
#: Frame lines that stand inside a body too, and so tell nothing of the lines around them.
_INTERRUPTS = re.compile(
    r"(?:advertisement|iklan|ads?|pariwara|sponsor|gulir|scroll|lanjut|continue reading|simak video|pasang iklan|(?:baca|lihat|simak|cek|tonton) (?:juga|pula)|(?:read|see) (?:also|more))\b"
)


def ends_sentence(s: str) -> bool:
    return s.rstrip("\"'”’)»")[-1:] in _ENDS


_ENDS = frozenset(".!?…")


def strip_marks(line: str) -> str:
    """The line without zero-width characters, outer blanks, bullet, enclosing brackets and closing `:` or `»`."""
    s = line.strip() if line.isascii() else _ZERO_WIDTH.sub("", line).replace("\xa0", " ").strip()
    if s and (s[0] in _BULLETS or s[0].isdigit()):
        s = _BULLET.sub("", s, count=1)
    while s and s[-1] in ":»":
        s = s[:-1].rstrip()
    if len(s) > 2 and s[0] == "[" and s[-1] == "]":
        s = s[1:-1].strip()
    return s


def squash(text: str | None) -> str:
    """Lower case, with everything but a-z and 0-9 dropped."""
    return re.sub(r"[^a-z0-9]+", "", text.lower()) if text else ""


def stop_word_density(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def link_density(text: str) -> float:
    """Share of the pieces between separators that are as short as the links of menus and footers; 0 below three."""
    if "  " not in text and not any(c in text for c in _MARKS) and not _WIDE.search(text):
        return 0.0
    pieces = [p for p in _SEPARATORS.split(text) if p]
    if len(pieces) < 3:
        return 0.0
    return sum(len(p.split()) <= 6 for p in pieces) / len(pieces) if sum(len(p.split()) for p in pieces) <= 4.5 * len(pieces) else 0.0


def first_pass(line: str) -> str:
    """Label of a line alone: MAIN, FRAME, LINKS (heading of a link list), OPEN or BLANK."""
    return _first_pass(strip_marks(line))


def _first_pass(s: str) -> str:
    if not s:
        return BLANK
    low = s.casefold()
    if _FRAME_START.match(low):
        return LINKS if _LINK_HEADING.match(low) else FRAME
    if len(s) > 140:
        return FRAME if len(s) < 1000 and not ends_sentence(s) and link_density(s) >= 0.8 else MAIN
    if _LINK_HEADING.match(low):
        return LINKS
    if low in _LABELS:
        return FRAME
    if _CRUMB.match(low):
        return FRAME
    if len(s) < 90 and (_DATE_LINE.match(low) or _is_byline(s, low)):
        return FRAME
    words = _WORD.findall(low)
    ends = ends_sentence(s)
    if not ends and link_density(s) >= 0.8:
        return FRAME
    if not words:
        return OPEN
    if ends and len(words) >= 6 and (stop_word_density(words) >= 0.08 or len(words) >= 9):
        return MAIN
    if s[0] in "“\"'‘„«" and len(words) >= 4:
        return MAIN
    if len(words) >= 14 and stop_word_density(words) >= 0.2:
        return MAIN
    return OPEN


def _is_byline(s: str, low: str) -> bool:
    if _AUTHOR.match(low):
        names = re.split(r"\s*[|,]\s*", low)
        rest = s.split(None, 1)[1] if " " in s else ""
        small = [w for w in rest.split() if w[:1].islower() and w not in ("untuk", "dan", "oleh", "for", "and", "di")]
        return len(low.split()) <= 12 and (len(small) <= 1 or s.isupper() or s.islower()) and all(len(n.split()) <= 10 for n in names)
    if " - " in s and not ends_sentence(s):
        left, _, right = s.partition(" - ")
        if 2 <= len(left.split()) <= 4 and 1 <= len(right.split()) <= 4:
            tokens = (left + " " + right).split()
            return s.isupper() or s.islower() or all(t[:1].isupper() or t[:1].isdigit() for t in tokens)
    return False


def label_lines(lines: list[str], titles: tuple[str, ...] = (), cache: dict[str, Line] | None = None) -> list[str]:
    """MAIN, FRAME or BLANK for each line of one page."""
    return page_lines(lines, titles, cache)[1]


class Line(NamedTuple):
    """What pass 1 knows of a line: its label, its text by strip_marks(), words, and whether it is a frame line that stands
    inside bodies too."""

    mark: str
    text: str
    n_words: int
    inside: bool


def read_line(line: str) -> Line:
    s = strip_marks(line)
    mark = _first_pass(s)
    return Line(mark, s, len(s.split()), mark == FRAME and bool(_INTERRUPTS.match(s.casefold())))


def is_title(line: str, titles: tuple[str, ...]) -> bool:
    """Whether the line squashed is one of the squashed titles; its first character tells most lines apart."""
    first = line.lstrip()[:1].lower()
    if first.isascii() and first.isalnum() and not any(t[0] == first for t in titles):
        return False
    return squash(line) in titles


def page_lines(lines: list[str], titles: tuple[str, ...] = (), cache: dict[str, Line] | None = None) -> tuple[list[Line], list[str], set[int]]:
    """Pass 1, final labels and the indexes of the lines in link lists, of one page.

    titles: squashed headlines that the page's record names, where it has any. cache: keeps pass 1 of lines that recur on
    many pages.
    """
    known = []
    for line in lines:
        x = cache.get(line) if cache is not None else None
        if x is None:
            x = read_line(line)
            if cache is not None and len(line) < 200:
                if len(cache) > 200_000:
                    cache.clear()
                cache[line] = x
        known.append(x)
    out = [x.mark for x in known]
    rows = [i for i, m in enumerate(out) if m != BLANK]
    top = _headline(lines, known, out, rows, titles)
    _link_lists(lines, known, out, rows)
    links = {i for i in rows if out[i] == FRAME and known[i].mark == OPEN}
    _neighbours(known, out, rows, top, links)
    return known, [m if m in (BLANK, MAIN) else FRAME for m in out], links


def _headline(lines: list[str], known: list[Line], out: list[str], rows: list[int], titles: tuple[str, ...]) -> int:
    """Line of the headline, -1 without one: the first line that equals a headline of the record, else the last
    undecided line of four words or more before the first paragraph."""
    if titles:
        for i in rows:
            if known[i].mark != LINKS and is_title(lines[i], titles):
                out[i] = MAIN
                return i
    best = -1
    for i in rows:
        if known[i].mark in (MAIN, LINKS):
            break
        if known[i].mark == OPEN and known[i].n_words >= 4:
            best = i
    if best >= 0:
        out[best] = MAIN
    return best


def _style(line: str) -> str:
    s = _ZERO_WIDTH.sub("", line).strip()
    m = _BULLET.match(s)
    if not m:
        return ""
    return m.group().strip()[-1]


def _link_lists(lines: list[str], known: list[Line], out: list[str], rows: list[int]) -> None:
    """Undecided lines right under the heading of a link list belong to the list, as long as they keep its bullets
    and look like headlines: no closing mark, no field name before a colon."""
    inside, style, count = False, "", 0
    for i in rows:
        if known[i].mark == LINKS:
            inside, style, count = True, "", 0
        elif inside and out[i] == OPEN:
            own, s = _style(lines[i]), known[i].text
            if count and own != style or own in ("•", "*", "·", "-", "–", "—", ")") or s[-1:] in "?!" or _FIELD.match(s):
                inside = False
                continue
            style, count = own, count + 1
            out[i] = FRAME
        else:
            inside = False


def _neighbours(known: list[Line], out: list[str], rows: list[int], top: int, links: set[int]) -> None:
    """Undecided lines take the label of the nearest decided lines above and below; where those differ, one or two
    words follow the frame, more the main body. Advertising, link lists and link lines stand inside the body too and so
    don't count as decided; whatever stands above the headline is frame."""
    n = len(rows)
    decided: list[str | None] = []
    for i in rows:
        inside = out[i] in (OPEN, LINKS) or i in links or out[i] == FRAME and known[i].inside
        decided.append(None if inside else out[i])
    back: list[str | None] = [None] * n
    ahead: list[str | None] = [None] * n
    last = None
    for k in range(n):
        last = decided[k] or last
        back[k] = last
    last = None
    for k in range(n - 1, -1, -1):
        last = decided[k] or last
        ahead[k] = last
    for k in range(n):
        i = rows[k]
        if out[i] != OPEN:
            continue
        words = known[i].n_words
        if i < top:
            out[i] = FRAME
        elif back[k] == ahead[k] and back[k]:
            out[i] = back[k]
        elif words <= 2:
            out[i] = FRAME
        else:
            out[i] = MAIN if MAIN in (back[k], ahead[k]) else FRAME if back[k] or ahead[k] else MAIN
