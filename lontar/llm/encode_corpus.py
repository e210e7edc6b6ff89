"""Problem 8: the whole corpus as ids of a public byte-level BPE.

Texts of usual length are encoded where they are read, without a shuffle. Longer ones are cut into pieces that many
tasks encode at once, and joined by tree concatenation: neighbouring halves meet, and where a cut fell inside a run that
the tokenizer doesn't split, windows around the join are encoded anew, growing until their first and last tokens agree
with the halves. A sequence of byte-pair tokens is the encoding of a run exactly if all neighbouring pairs are, so
agreement on both sides makes the joined sequence the encoding of the whole run.

Cases: a null text and an empty one have an empty list; blanks are ordinary text; strings of special tokens are
ordinary text; repeated rows come out as often as they go in.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the public vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a piece. Texts up to two pieces are encoded at once.
PIECE = 100_000
#: Neighbouring parts that one task joins at each level of the tree; bytes that a text can have at all.
FANOUT, LONGEST = 32, 2**31


class Encoder:
    """The tokenizer of a .tiktoken file: lines of base64 bytes and rank."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self._enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._bytes = {rank: piece for piece, rank in table.items()}

    def encode(self, text: str) -> list[int]:
        return self._enc.encode_ordinary(text)

    def encode_run(self, raw: bytes) -> list[int]:
        """Ids of bytes that belong to one run, however long."""
        return self._enc._encode_single_piece(raw)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(self._bytes[i] for i in ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two halves whose cut fell inside one run."""
        if not left or not right:
            return left + right
        size = 4
        while True:
            a, b = left[-size:], right[:size]
            mid = self.encode_run(self.bytes_of(a) + self.bytes_of(b))
            whole_a, whole_b = len(a) == len(left), len(b) == len(right)
            if (whole_a or mid[0] == a[0]) and (whole_b or mid[-1] == b[-1]):
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            size *= 2


def _class_of(c: str) -> str:
    return "s" if c.isspace() else "l" if c.isalpha() else "n" if c.isnumeric() else "o"


_NEAR = 2000


def cut(text: str, size: int = PIECE) -> list[tuple[str, bool]]:
    """Pieces of about `size` characters, each with whether its start cuts a run. Where blank follows non-blank the
    tokenizer always splits; where no such place is near, the cut falls inside a run of one class."""
    out, start, inside = [], 0, False
    n = len(text)
    while n - start > size + size // 2:
        at, run = _place(text, start + size, n)
        out.append((text[start:at], inside))
        start, inside = at, run
        if at >= n:
            return out
    out.append((text[start:], inside))
    return out


def _place(text: str, at: int, n: int) -> tuple[int, bool]:
    """A place to cut at or after `at`: (position, inside a run)."""
    for k in range(at, min(n, at + _NEAR)):
        if text[k].isspace() and not text[k - 1].isspace():
            return k, False
    k = at
    while k < n - 3:
        around = {_class_of(c) for c in text[k - 3 : k + 3]}
        if text[k].isspace() and not text[k - 1].isspace():
            return k, False
        if len(around) == 1 and "o" not in around:
            return k, True
        if around == {"o"} and "'" not in text[k - 3 : k + 3]:
            return k, True
        k += 1
    return n, False


def encode_long(enc: Encoder, text: str, size: int = PIECE) -> list[int]:
    """The ids of one text by pieces, as the distributed path gives them."""
    return concat(enc, [(enc.encode(t), inside) for t, inside in cut(text, size)])


def concat(enc: Encoder, parts: list[tuple[list[int], bool]]) -> list[int]:
    """Tree concatenation of encoded pieces in their order. In a join inside a run only the run's own tokens take part."""
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            (a, start), (b, inside) = parts[k], parts[k + 1]
            joined.append((_join(enc, a, b) if inside else a + b, start))
        if len(parts) % 2:
            joined.append(parts[-1])
        parts = joined
    return parts[0][0] if parts else []


def _join(enc: Encoder, a: list[int], b: list[int]) -> list[int]:
    """Joins halves at a cut inside a run: the last run of a and the first one of b are one run."""
    i, j = _run_start(enc, a), _run_end(enc, b)
    return a[:i] + enc.join(a[i:], b[:j]) + b[j:]


_pattern = None


def _splits(text: str) -> list[str]:
    global _pattern
    if _pattern is None:
        import regex

        _pattern = regex.compile(PATTERN)
    return _pattern.findall(text)


def _edge(enc: Encoder, ids: list[int], first: bool) -> int:
    """Number of ids of the first (last) run of a token sequence."""
    size = 64
    while True:
        part = ids[:size] if first else ids[-size:]
        raw = enc.bytes_of(part)
        whole = len(part) == len(ids)
        text = raw.decode("utf-8", errors="ignore") if not first else _head(raw, whole)
        runs = _splits(text)
        # a run that ends (starts) inside the part is known in full; keep one more run as context
        if whole or len(runs) >= 4:
            if not runs:
                return len(part)
            goal = len(runs[0].encode()) if first else len(runs[-1].encode())
            took, count = 0, 0
            for i in part if first else reversed(part):
                if took >= goal:
                    break
                took += len(enc._bytes[i])
                count += 1
            return count
        size *= 4


def _head(raw: bytes, whole: bool) -> str:
    return raw.decode("utf-8", errors="strict" if whole else "ignore")


def _run_start(enc: Encoder, ids: list[int]) -> int:
    return len(ids) - _edge(enc, ids, False)


def _run_end(enc: Encoder, ids: list[int]) -> int:
    return _edge(enc, ids, True)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", piece: int = PIECE) -> DataFrame:
    """id_col and ids array<int> of every row."""
    spark = ship(df.sparkSession)
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # one vocabulary file, below 2 MB
    own = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > 2 * piece, F.lit(False))
    short = own.where(~is_long).mapInArrow(_encode_batches(ranks), f"id {kind}, ids array<int>")
    pieces = own.where(is_long).withColumn("doc", F.concat_ws("-", F.xxhash64("id", "text").cast("string"), F.md5("text")))
    copies = pieces.groupBy("doc").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    cuts = copies.mapInArrow(_cut_batches(piece), f"doc string, id {kind}, copies long, k int, inside boolean, text string")
    parts = cuts.repartition("doc", "k").mapInArrow(_encode_pieces(ranks), f"doc string, id {kind}, copies long, k int, inside boolean, ids array<int>")
    # levels enough for any text; where no text is long the shuffles are empty
    left = LONGEST // piece + 1
    while left > 1:
        parts = parts.groupBy("doc", "id", "copies", F.floor(F.col("k") / FANOUT).cast("int").alias("at")).applyInArrow(_concat_group(ranks), parts.schema)
        left = -(-left // FANOUT)
    long = parts.select("id", "ids", F.explode(F.sequence(F.lit(1), "copies")).alias("c")).drop("c")
    return short.unionByName(long).select(F.col("id").alias(id_col), "ids")


def _encode_batches(ranks):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = Encoder(ranks.value)
        for batch in batches:
            ids = [enc.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _cut_batches(piece: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                doc, own, text, copies = (batch.column(c)[n] for c in range(4))
                parts = cut(text.as_py(), piece)
                m = len(parts)
                arrays = [pa.array([doc.as_py()] * m), pa.array([own.as_py()] * m, batch.column(1).type), pa.array([copies.as_py()] * m, pa.int64())]
                arrays += [pa.array(range(m), pa.int32()), pa.array([x for _, x in parts]), pa.array([t for t, _ in parts])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "id", "copies", "k", "inside", "text"])

    return run


def _encode_pieces(ranks):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = Encoder(ranks.value)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.list_(pa.int32()))], names=["doc", "id", "copies", "k", "inside", "ids"])

    return run


def _concat_group(ranks):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("k")
        enc = _encoder(ranks)
        inside = table.column("inside").to_pylist()
        ids = concat(enc, list(zip(table.column("ids").to_pylist(), inside, strict=True)))
        head = table.slice(0, 1)
        at = pa.array([head.column("k")[0].as_py() // FANOUT], pa.int32())
        return pa.table({**{c: head.column(c) for c in ("doc", "id", "copies")}, "k": at, "inside": pa.array(inside[:1]), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return run


_encoders: dict = {}


def _encoder(ranks) -> Encoder:
    if "own" not in _encoders:
        _encoders["own"] = Encoder(ranks.value)
    return _encoders["own"]
