"""Problem 10: text that was decoded with the wrong character encoding.

Method: the characters outside ASCII are mapped back to the bytes of a legacy encoding, an automaton of the structure of
UTF-8 bytes finds maximal well-formed multibyte spans, and only those spans are decoded. Any assigned character counts;
whether it is to be expected only decides between the readings, the text as it stands being one of them. The legacy
encoding is chosen for each text by the characters that fall into such spans; rounds repeat for text that was decoded wrongly more
than once. Replacement characters tell of characters that can't be restored.

Cases: a null text is no case; text outside ASCII that is well-formed in none of the encodings stays as it is; repeated
rows come out as often as they go in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# Legacy encodings in which UTF-8 is read by mistake, the most frequent first.
SINGLE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "iso8859_2", "iso8859_15", "koi8_r", "cp1254", "cp1257")
MULTI_BYTE = ("gb18030", "big5", "shift_jis", "euc_kr")

_WELL_FORMED = re.compile(
    rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+"
)
_FOREIGN = re.compile("[^\x00-\x7f]+")
_NOT_READ = "�"


class _Bytes(dict):
    """For str.translate(): characters that the encoding lacks become 0, which breaks spans."""

    def __missing__(self, key: int) -> int:
        return 0


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[int, int]:
    """Code point to byte of a single-byte encoding; bytes that it leaves open stand for the control of that number."""
    table: dict[int, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = b
    for b in range(128, 160):
        table.setdefault(b, b)
    return _Bytes(table)


@lru_cache(maxsize=None)
def _spans_in(encoding: str) -> re.Pattern[str]:
    """What every well-formed span has: a leading byte before a continuing one, as characters of the encoding."""
    table = _bytes_of(encoding)
    lead, rest = ("".join(re.escape(chr(c)) for c, b in table.items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile(f"[{lead}][{rest}]")


# Blocks of code points that text of the web has beyond two UTF-8 bytes, first and last.
_BLOCKS = (
    (0x0900, 0x097F), (0x0E00, 0x0E7F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x218F), (0x2190, 0x23FF), (0x2460, 0x27BF),
    (0x2900, 0x2BFF), (0x3000, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF),
    (0x1F000, 0x1FAFF), (0xE0020, 0xE007F),
)
# Latin letters and their marks beyond Latin Extended-A.
_LATIN = {0x192, 0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x218, 0x219, 0x21A, 0x21B, 0x259, 0x18F, 0x2BC, 0x2C6, 0x2C7, 0x2D8, 0x2D9, 0x2DA, 0x2DB, 0x2DC, 0x2DD}
#: Letters of another script that a span must have in a row: one or two may as well be accented letters of their own.
_SCRIPT_RUN = 3


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    """L: may stand alone in a span; S: letter of another script; empty: not to be expected in text."""
    p = ord(c)
    if p < 0x80 or 0x80 <= p < 0xA0:
        return "L" if 0x80 <= p < 0xA0 else ""
    if p < 0x180 or p in _LATIN or 0x300 <= p <= 0x36F:
        return "L"
    if 0x370 <= p <= 0x52F or 0x5D0 <= p <= 0x5EA or 0x600 <= p <= 0x6FF:
        return "S" if c.isalpha() or 0x600 <= p else ""
    return "L" if any(a <= p <= b for a, b in _BLOCKS) else ""


def _plausible(c: str) -> bool:
    return bool(_kind(c))


#: Marks that may follow a word, and signs that follow one of two letters or more.
_AFTER, _SIGNS = frozenset("”’»…–—"), frozenset("™®©°ºª")


def _natural(own: str, before: str) -> bool:
    """Whether the characters that a single one was read as may stand in ordinary text after `before`."""
    lead, rest = own[0], own[1:]
    if own.isalpha() or unicodedata.category(lead)[0] in "PZ" or rest.isalpha() and not lead.isalpha() or rest[0].isspace():
        return True
    if not all(c in _AFTER or c in _SIGNS or c.isspace() for c in rest):
        return False
    word = before[-2:]
    inside = len(word) == 2 and word.isalpha() and (word.isupper() if lead.isupper() else word.islower())
    return inside or lead in "Ø×" or rest[0] in _AFTER and not before[-1:].isalpha()


def _decode_spans(raw: bytes, run: str, before: str) -> list[tuple[int, int, str, float]]:
    """(start, end, text, weight) of the maximal well-formed spans of assigned characters. Spans with characters that
    aren't to be expected weigh less, and only what is to be expected of them counts where the run may as well stand."""
    out = []
    for m in _WELL_FORMED.finditer(raw):
        at = m.start()
        part: list[tuple[str, int, int]] = []
        for c in [*m.group().decode("utf-8"), ""]:
            if c and (_kind(c) or unicodedata.category(c)[0] in "LMNPSZ" or unicodedata.category(c) == "Cf"):
                part.append((c, at, at + len(c.encode("utf-8"))))
            elif part:
                out += _accepted(part, run, before)
                part = []
            at += len(c.encode("utf-8"))
    return out


def _accepted(part: list[tuple[str, int, int]], run: str, before: str) -> list[tuple[int, int, str, float]]:
    text = "".join(c for c, _, _ in part)
    odd = [(s, e) for c, s, e in part if _kind(c) != "L"]
    if all(_kind(c) for c in text) and _enough(text):
        return [(part[0][1], part[-1][2], text, 1.0)]
    if not all(_natural(run[s:e], before + run[:s]) for s, e in odd):
        return [(part[0][1], part[-1][2], text, 0.9)]
    out, kept = [], []
    for x in [*part, ("", 0, 0)]:
        if x[0] and _kind(x[0]):
            kept.append(x)
        else:
            if kept and _enough("".join(c for c, _, _ in kept)):
                out.append((kept[0][1], kept[-1][2], "".join(c for c, _, _ in kept), 1.0))
            kept = []
    return out


def _enough(part: str) -> bool:
    script = sum(_kind(c) == "S" for c in part)
    return script == 0 or script >= _SCRIPT_RUN


def _single(run: str, encoding: str, before: str = "") -> tuple[str, int, int, float]:
    """The run with its spans decoded, the characters in spans, those that the encoding has, and the spans' weight."""
    raw = run.translate(_bytes_of(encoding)).encode("latin-1")
    spans = _decode_spans(raw, run, before)
    if not spans:
        return run, 0, sum(b > 0 for b in raw), 0.0
    out, at = [], 0
    for start, end, text, _ in spans:
        out.append(run[at:start])
        out.append(text)
        at = end
    out.append(run[at:])
    return "".join(out), sum(e - s for s, e, _, _ in spans), sum(b > 0 for b in raw), sum((e - s) * w for s, e, _, w in spans)


# Lead bytes of the common characters in East Asian sets, whose first level holds what text mostly has.
_COMMON = (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("shift_jis", 0x88, 0x97), ("euc_kr", 0xB0, 0xC8))


@lru_cache(maxsize=100_000)
def _common(c: str) -> bool:
    """Whether a character is one of the frequent ones of its script; other scripts than Han and Hangul: any assigned."""
    if not (0x3400 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7FF or ord(c) >= 0x20000):
        return unicodedata.category(c)[0] in "LMNPSZ"
    for name, low, high in _COMMON:
        try:
            if low <= c.encode(name)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


def _multi(run: str, encoding: str, before: str = "") -> tuple[str, int, int, float]:
    """As _single() for two-byte encodings: a run counts only if it is well-formed but for a cut last character, since
    ordinary text in such a script has well-formed pairs by chance; where the restored text is in such a script too, or
    has characters that aren't to be expected, only if it has more of the common characters than the run."""
    core = run.rstrip(_NOT_READ)
    lost = len(run) - len(core)
    try:
        raw = core.encode(encoding)
    except UnicodeEncodeError:
        return run, 0, 0, 0.0
    if not core or max(raw, default=0) < 128:
        return run, 0, 0, 0.0
    text = raw.decode("utf-8", errors="replace" if lost else "strict") if _fits(raw, lost) else None
    if text is None:
        return run, 0, len(core), 0.0
    body = text.rstrip(_NOT_READ) if lost else text
    if not body:
        return run, 0, len(core), 0.0
    sure = not any(ord(c) > 127 and not _plausible(c) or 0x3400 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7FF for c in body)
    if not sure and not sum(map(_common, body)) / len(body) > sum(map(_common, core)) / len(core):
        return run, 0, len(core), 0.0
    return text + ("" if text.endswith(_NOT_READ) else _NOT_READ * bool(lost)), len(core), len(core), 2.0 * len(core)


def _fits(raw: bytes, lost: int) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError as e:
        return bool(lost) and e.reason == "unexpected end of data"


def repair(text: str) -> tuple[str, list[str], int]:
    """(text with its wrongly decoded spans restored, encodings undone in their order, characters in spans)."""
    undone, changed = [], 0
    seen = set()
    while text not in seen:
        seen.add(text)
        runs = [(m.group(), text[max(0, m.start() - 2) : m.start()]) for m in _FOREIGN.finditer(text)]
        if not runs:
            break
        best = ("", 0, 0.0)
        for encoding in (*(e for e in SINGLE_BYTE if _spans_in(e).search(text)), *MULTI_BYTE):
            hit, weight = 0, 0.0
            for r, before in runs:
                _, h, _, w = (_multi if encoding in MULTI_BYTE else _single)(r, encoding, before)
                hit, weight = hit + h, weight + w
            if weight > best[2]:
                best = (encoding, hit * (1 + (encoding in MULTI_BYTE)), weight)
        if not best[1]:
            break
        one = _multi if best[0] in MULTI_BYTE else _single
        new = _FOREIGN.sub(lambda m, f=one, e=best[0]: f(m.group(), e, text[max(0, m.start() - 2) : m.start()])[0], text)
        if new == text:
            break
        text, changed = new, changed + best[1]
        undone.append(best[0])
    return text, undone, changed


def repaired(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, restored (the text with all that can be restored), encodings array<string>, spans (characters of wrongly
    decoded spans), lost (replacement characters), for the rows with any of them."""
    ship(df.sparkSession)
    own = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_batches, f"id {kind}, restored string, encodings array<string>, spans int, lost int").withColumnRenamed("id", id_col)


def _batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows, texts, encodings, spans, lost = [], [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            if not text or text.isascii():
                continue
            new, undone, n = repair(text)
            gone = text.count(_NOT_READ)
            if n or gone:
                rows.append(k)
                texts.append(new)
                encodings.append(undone)
                spans.append(n)
                lost.append(gone)
        arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(encodings, pa.list_(pa.string())), pa.array(spans, pa.int32()), pa.array(lost, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "restored", "encodings", "spans", "lost"])
