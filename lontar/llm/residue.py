"""Problem 4: records that hold template residue, filler, an error message or a script notice and no content.

Two kinds of evidence give trusted labels. Lines: `line_kind` tells placeholders, filler and messages from sentences, and
a record is trusted residue if its body has an unfilled placeholder, or residue lines and no sentence; a long line is
read piece by piece. Repetition: a short body, nearly without names, all of whose lines stand in such bodies under several
different headlines is no page's content, whatever its wording; lines and headlines are counted over all records.
Wordings that neither knows are found by likeness: each record has as cores all its lines outside the frame and its
sentences and residue lines alone, both without numbers and names. Cores are sets of five-word shingles, whose rarest elements
bring together all pairs of Jaccard similarity 0.8 or more (pigeonhole.py) among the cores that can hang together with a
seed, a trusted record without any sentence; pairs are verified by Hamming distance on a sketch and by the similarity of
the sets, and a component that holds a seed is residue. A sentence beside a placeholder may be an article's, whose filled copies are none.

Cases: null or blank text is no case; records without an id keep their null id; repeated rows come out as often as
they go in; an empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .pigeonhole import block_pairs, verified
from .shared import forget, stored

#: Words of a shingle, and the least Jaccard similarity of a link, in thousandths.
SHINGLE, SIMILARITY = 5, 800
#: A body of up to BRIEF words, one in NAMES of them a name at most, is nobody's content if all its lines stand in such
#: bodies under HEADLINES different headlines or more.
BRIEF, NAMES, HEADLINES = 40, 5, 3
#: Rows of 8 or, for bodies, up to 330 bytes that may be sent to all executors.
BROADCAST = 200_000

# Forms of unfilled placeholders in common template languages. A single brace counts only with a filter.
_PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|<<[^<>\n]{1,60}>>|<\?(?:=|php)[^?\n]{1,80}\?>|<%=?[^%\n]{1,60}%>"
    r"|\{%-?\s*\w+[^%\n]{0,60}%\}|&lt;[a-z_][\w.]{1,40}&gt;|<[a-z]+(?:[._][a-z]+)+>|\{[a-z_.]{2,40}\|[\w ]{1,40}\}|@Model\.\w+|(?<!\w)__[a-z_]{2,40}__(?!\w)"
    r"|%[a-z_]{3,40}%|\[(?:article|page|post|site|user)\.[a-z_]+\]|\[(?:content|title|body|headline|judul|isi|isi_berita|lokasi|tanggal|penulis|kutipan|harga|nama_\w+)\]"
    r"|\b[a-z]+(?:[_.][a-z]+)* DI SINI\b"
)

# What every placeholder has one of.
_OPENS = ("{", "[", "<", "%", "@", "&", "__", "DI SINI")

# Words of the usual filler text.
_LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et
    dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo
    consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint
    occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)

# Whole-line messages of error pages, script notices and filler, lower case.
_MESSAGE = re.compile(
    r"""(?:
    (?:(?:error|galat|http)\s*)?[45]\d\d(?:\s*[-:|]?\s*(?:[a-z]+\s?){0,4})?$
    | (?:page\ |halaman\ |artikel\ |berita\ )?(?:not\ found|tidak\ (?:dapat\ )?ditemukan)\b.{0,40}$ | the\ requested\ (?:page|url|resource)\b
    | (?:alamat|halaman|artikel)\ (?:yang\ )?anda\ (?:tuju|cari|minta)\b | (?:ups|oops|maaf)\b.{0,20}\b(?:tidak|kami|halaman|terjadi|something|we)\b
    | (?:coba\ )?gunakan\ kolom\ pencarian | kembali\ ke\ (?:beranda|halaman\ (?:utama|depan))\b.{0,60}$ | (?:access\ (?:denied|forbidden)|forbidden|akses\ ditolak)\b.{0,40}$
    | you\ (?:do\ not|don't)\ have\ permission | anda\ tidak\ (?:memiliki|punya)\ (?:izin|akses) | kode\ (?:rujukan|permintaan|galat|kesalahan|error)\b.{0,60}$
    | (?:request|reference|ray|incident)\ (?:id|code|number)\b.{0,60}$
    | batas\ permintaan\b | too\ many\ requests | terjadi\ (?:kesalahan|galat)\ (?:pada|di|saat|ketika|internal|server)\b | internal\ server\ error
    | (?:silakan|mohon|harap)\ (?:muat\ ulang|coba\ (?:lagi|beberapa)|segarkan)\b | sesi\ anda\b.{0,60}\b(?:berakhir|habis|kedaluwarsa)
    | (?:your\ )?session\b.{0,30}\bexpired | (?:muat\ ulang|segarkan)\ halaman\b | (?:database|koneksi\ (?:basis\ data|database))\b.{0,20}(?:connection|failed|gagal|error)
    | error\ establishing\b | hubungi\ (?:pengelola|administrator|admin)\b.{0,60}$ | .{2,60}\bsedang\ dalam\ (?:pemeliharaan|perbaikan|perawatan)\b.{0,60}$
    | (?:site|website)\b.{0,30}\b(?:maintenance|unavailable) | kami\ (?:akan\ )?segera\ kembali | (?:we(?:'ll|\ will)\ be\ )back\ soon
    | (?:service\ (?:temporarily\ )?unavailable|bad\ gateway|gateway\ time-?out)\b.{0,40}$ | peladen\ .{2,60}/\d[\d.]*$ | (?:nginx|apache|cloudflare|openresty)\b.{0,30}$
    | (?:please\ )?(?:enable|turn\ on)\ (?:javascript|scripts|cookies)\b | you\ need\ to\ enable\ (?:javascript|scripts)\b | (?:this\ (?:site|page|app)\ )requires\ javascript
    | peramban\ anda\ (?:tidak|belum)\ mendukung\b | (?:no-?script\b\W*)?(?:aktifkan|nyalakan)\ (?:javascript|java\ script|js|skrip)\b | anda\ (?:perlu|harus)\ (?:mengaktifkan|menyalakan)\ (?:javascript|skrip)\b
    | (?:halaman|situs|aplikasi)\ .{2,60}\bmembutuhkan\ (?:skrip|javascript)\b | nyalakan\ (?:skrip\ )?pada\ setelan\ peramban | (?:memuat|loading|mohon\ tunggu|please\ wait)\s?(?:\.{2,}|…)?$
    | jika\ halaman\b.{2,60}\btidak\ muncul\b | (?:checking\ your\ browser|verify(?:ing)?\ (?:that\ )?you\ are\ (?:a\ )?human|just\ a\ moment)\b
    | (?:tulis|masukkan|ketik)\ (?:isi|judul|teks)\b.{0,60}\b(?:di\ sini|bagian\ ini)\b | isi\ (?:paragraf|artikel|berita)\b.{0,30}\bdi\ sini\b | (?:contoh\ teks|teks\ contoh)\b
    | judul\ (?:halaman|artikel|berita)\ contoh\b | deskripsi\ singkat\ akan\b | (?:your|sample|dummy|placeholder|insert)\ (?:text|title|content|headline)\b.{0,40}$
    | (?:lorem\ ipsum)\b.{0,20}$ | (?:asdf\w*|qwerty|jkl)(?:\s+(?:asdf\w*|qwerty|jkl))*\b | x{2,}(?:\s+x{2,})+ | te?st?(?:\s+te?st?)+(?:\s+\d+)* | tes(?:\s+tes)+(?:\s+\d+)* | untitled(?:\ \w+)?$
    )""",
    re.X,
)
#: Characters up to which a line is one message by its beginning; longer ones are read piece by piece.
LINE = 160
_PIECE = re.compile(r"(?<=[.!?…])\s+|\s*[|»•·\t]\s*|\s{2,}")
_DRAFT = re.compile(r"\s*\(\d+\)\s+draf\b.*$")
_TOKEN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_STOP, _OPENING = re.compile(r"[.!?]\s"), re.compile(r"[.!?]\s+(\w+)")


def line_kind(line: str, mark: str, messages: bool = True) -> str:
    """placeholder, residue, sentence or other, for a line outside the frame; mark: its pass-1 label."""
    s = B.strip_marks(line)
    return kind_of(line, s, mark, line_words(s)[0], messages)


def kind_of(line: str, s: str, mark: str, words: list[str], messages: bool = True) -> str:
    """line_kind() of a line with its strip_marks() and the words of line_words(); messages: whether the list of message
    forms takes part."""
    if has_placeholder(line, s):
        return "placeholder"
    if messages:
        low = (_DRAFT.sub("", s) if "draf" in s else s).casefold()
        if _MESSAGE.match(low) if len(low) <= LINE else _only_messages(s):
            return "residue"
    if len(words) >= 5 and sum(t in _LOREM for t in " ".join(words).lower().split()) >= 0.7 * len(words):
        return "residue"
    return "sentence" if mark == B.MAIN else "other"


def has_placeholder(line: str, s: str) -> bool:
    return any(x in line for x in _OPENS) and bool(_PLACEHOLDER.search(s) or _PLACEHOLDER.search(line))


def _only_messages(line: str) -> bool:
    """Whether the pieces of a line have a message and no sentence."""
    found = False
    for piece in _PIECE.split(line):
        s = B.strip_marks(piece)
        low = s.casefold()
        if s and (_MESSAGE.match(low) or _MESSAGE.match(low.rstrip(".!?…"))):
            found = True
        elif B.first_pass(piece) == B.MAIN:
            return False
    return found


def line_words(s: str) -> tuple[list[str], list[str]]:
    """The words of a line of strip_marks() without numbers and codes; and of those the ones that are no names. A name has
    a capital and small letters inside a sentence; the first word of one says nothing."""
    if "draf" in s:
        s = _DRAFT.sub("", s)
    every = _TOKEN.findall(s)
    if _DIGIT.search(s):
        every = [t for t in every if t.isalpha() or not _DIGIT.search(t)]
    if not every:
        return every, every
    first = [m.group(1) for m in _OPENING.finditer(s)] if _STOP.search(s) else ()
    plain = [t for t in every if not t.istitle() or t in first]
    return every, plain if not plain or every[0] == plain[0] else [every[0], *plain]


def core_of(lines: list[tuple[str, list[str], list[str]]]) -> str:
    """Lower-case words of the lines (strip_marks() and line_words() of each), without names unless that leaves less than
    a shingle."""
    plain = [t for _, _, words in lines for t in words]
    return " ".join(plain if len(plain) >= SHINGLE else [t for _, words, _ in lines for t in words]).lower()


def brief_body(lines: list[tuple[str, list[str], list[str]]], site: str) -> list[int] | None:
    """Hashes of the lines, without numbers, codes and names, of a body of up to BRIEF words of which few are names; None
    for any other. lines: strip_marks() and line_words() of each; site: the site's name, whose words don't count."""
    import xxhash

    n = names = 0
    out = set()
    for s, every, plain in lines:
        tokens = _TOKEN.findall(_DRAFT.sub("", s) if "draf" in s else s)
        own = _site_words([t.lower() for t in tokens], site) if site else 0
        n += len(tokens) - own
        names += len(tokens) - len(plain) - own
        x = " ".join(plain or every).lower()
        if x:
            out.add(xxhash.xxh64_intdigest(x) - 2**63)
    return sorted(out) if out and n <= BRIEF and names * NAMES <= n else None


def _site_words(low: list[str], site: str) -> int:
    """Words of the longest run that spells the site's name."""
    best = 0
    for i in range(len(low)):
        text = ""
        for j in range(i, len(low)):
            text += low[j]
            if not site.startswith(text):
                break
            if text == site:
                best = max(best, j + 1 - i)
    return best


def repeated_bodies(pages: DataFrame) -> DataFrame:
    """The values of `brief` all of whose lines stand alone under HEADLINES different headlines or more."""
    own = pages.where("brief IS NOT NULL")
    seen = own.where("head IS NOT NULL").select("head", F.explode("brief").alias("line")).distinct()
    common = seen.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEADLINES).select("line")
    each = own.select("brief").distinct().select("brief", F.explode("brief").alias("line")).join(common, "line")
    return each.groupBy("brief").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("brief")).select("brief")


def propagate(pages: DataFrame) -> DataFrame:
    """Ids of all residue records. pages: id, trusted, seed (boolean), brief, head, cores (array of strings)."""
    repeated = _small(stored(repeated_bodies(pages), "repeated"))

    def marked(by: str) -> DataFrame:
        # only short bodies meet the repeated ones, so that whole pages are never moved
        return pages.where(by).unionByName(pages.where(f"NOT {by} AND brief IS NOT NULL").join(repeated, "brief", "left_semi"))

    known = marked("trusted").select("id")
    seeds = stored(_nodes(marked("seed")).select("node").distinct(), "seeds")
    near = _near_seeds(_nodes(pages), seeds)
    labels, _ = components(_near_cores(near))
    own = near.select("node").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    bad = stored(own.join(own.join(seeds, "node", "left_semi").select("root").distinct(), "root", "left_semi").select("node"), "residue-cores")
    forget(seeds)
    rest = pages.where("NOT trusted").withColumn("row", F.monotonically_increasing_id())
    found = _nodes(rest, "row", "id", "brief").join(_small(bad), "node", "left_semi").dropDuplicates(["row"])
    return known.unionByName(found.join(repeated, "brief", "left_anti").select("id"))


def _nodes(pages: DataFrame, *keep: str) -> DataFrame:
    """node, core of each core of each page, as often as pages have it."""
    return pages.select(*keep, F.explode("cores").alias("core")).select(*keep, F.xxhash64("core").alias("node"), "core")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _near_seeds(cores: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, core, each once, of all cores that a chain of links can tie to a seed, and of some more.

    A core has SIMILARITY of its shingles in common with each core that it is linked to. So cores are taken in that have as
    many among the shingles of the seeds, then those that have as many among the shingles of the newly taken, until none
    is left. A look at so few shingles of each core that one of them must be among those comes first, and only what it
    finds is moved: the length of the chains decides how often the cores are read, and nothing else of their number.
    """
    heads = stored(cores.select("node", "core").mapInArrow(_core_shingles(True), "id long, n int, items array<long>"), "core-heads")
    first = heads.select(F.col("id").alias("node"), F.explode("items").alias("h"))
    new = stored(_texts(cores, seeds), "near-seeds")
    taken: DataFrame | None = None
    while True:
        taken = new if taken is None else taken.unionByName(new)
        known = stored(_elements(new).select("h").distinct(), "shingles")
        among = _small(known.withColumn("in", F.lit(1)))
        hit = stored(first.join(among, "h", "left_semi").select("node").distinct().join(taken, "node", "left_anti"), "hits")
        texts = stored(_texts(cores, hit), "hit-cores")
        counted = _elements(texts).join(among, "h", "left").groupBy("id", "n").agg(F.count("in").alias("common"))
        close = counted.where(F.col("common") * 1000 >= F.col("n") * SIMILARITY).select(F.col("id").alias("node"))
        new = stored(texts.join(close, "node", "left_semi"), "near-seeds")
        for t in (known, hit, texts):
            forget(t)
        if new.isEmpty():
            forget(heads)
            return taken


def _texts(cores: DataFrame, nodes: DataFrame) -> DataFrame:
    return cores.join(_small(nodes), "node", "left_semi").groupBy("node").agg(F.min("core").alias("core"))


def _elements(cores: DataFrame) -> DataFrame:
    return cores.select("node", "core").mapInArrow(_core_shingles(False), "id long, n int, items array<long>").select("id", "n", F.explode("items").alias("h"))


def _near_cores(cores: DataFrame) -> DataFrame:
    """All links a < b between cores of similarity SIMILARITY or more, stored."""
    sets = stored(cores.select("node", "core").mapInArrow(_core_shingles(False), "id long, n int, items array<long>"), "core-sets")
    pairs = block_pairs(sets, SIMILARITY)
    links = stored(verified(pairs, sets, SIMILARITY).select("a", "b"), "core-links")
    forget(pairs)
    forget(sets)
    return links


def _core_shingles(few: bool):
    """Distinct runs of SHINGLE words of each core, as 64-bit hashes in their order, and their number; a core of fewer words
    is one run. With few, only as many as can't all be missing in a set that has SIMILARITY of them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = pc.split_pattern(batch.column(1), " ")
            n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            known = words.flatten().dictionary_encode()
            own = np.array([xxhash.xxh64_intdigest(w) for w in known.dictionary.to_pylist()], dtype=np.uint64)[known.indices.to_numpy(zero_copy_only=False)]
            # words beyond the end of a short core count as zero
            own = np.concatenate((own, np.zeros(SHINGLE, np.uint64)))
            start = np.cumsum(n) - n
            runs = np.maximum(n - SHINGLE + 1, 1)
            row = np.repeat(np.arange(len(n)), runs)
            k = np.arange(len(row)) - (np.cumsum(runs) - runs)[row]
            at, left = start[row] + k, n[row] - k
            h = np.zeros(len(row), np.uint64)
            for j in range(SHINGLE):
                h = h * odd + np.where(j < left, own[at + j], np.uint64(0))
            h = (h ^ (h >> np.uint64(29))) * odd
            h ^= h >> np.uint64(32)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            size = np.bincount(row, minlength=len(n))
            if few:
                place = np.arange(len(h)) - (np.cumsum(size) - size)[row]
                keep = place < (size - -(-size * SIMILARITY // 1000) + 1)[row]
                h, row = h[keep], row[keep]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["id", "n", "items"])

    return run


def residue_records(
    df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", title_cols: tuple[str, ...] = (), site_cols: tuple[str, str] | None = None, messages: bool = True,
) -> DataFrame:
    """The ids of the records that hold residue and no content, in the column id_col. title_cols: headlines of the record;
    site_cols: its domain and URL, which tell the site's name in messages; messages: whether the list of message forms
    gives trusted labels besides placeholders, filler words and repetition."""
    from .main_body import scan_pages

    pages = stored(scan_pages(df, id_col, text_col, title_cols, site_cols=site_cols, messages=messages).drop("frame_lines"), "pages")
    return propagate(pages).select(F.col("id").alias(id_col))


def without_residue(
    df: DataFrame, id_col: str = "record_id", text_col: str = "content_text", title_cols: tuple[str, ...] = (), site_cols: tuple[str, str] | None = None,
) -> DataFrame:
    """df without its residue records; records with a null id stay."""
    return df.join(residue_records(df, id_col, text_col, title_cols, site_cols).distinct(), id_col, "left_anti")
