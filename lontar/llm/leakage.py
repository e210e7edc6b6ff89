"""Problem 9: passages of evaluation items inside the documents of a corpus.

Method: one Aho-Corasick automaton over the normalised passages. Each item's runs of `run` words are its patterns, all
patterns go into one automaton, and every text is scanned once; matches are merged into passages and mapped to the
offsets of the original text. Item texts are sent to the executors in blocks of bounded size, one automaton each, so a
benchmark of any size fits; one block holds all items of usual benchmarks. All automata pass over the texts that a task
holds, so that the corpus is read once.

Cases: items with fewer words, null or empty ones have no patterns; null texts have no matches; repeated documents come
out as often as they go in, repeated items once; an item and a document match once however often a passage occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Words of the items of one automaton: about 500 bytes of it each.
BLOCK_WORDS = 200_000
_WORD = re.compile("[a-z0-9]+")


def item_blocks(items: DataFrame, item_id: str, text_col: str, limit: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The items' ids and words in blocks of limited size; the driver holds one block at a time."""
    block, size = [], 0
    own = items.where(items[item_id].isNotNull() & items[text_col].isNotNull()).select(items[item_id].alias("i"), items[text_col].alias("t")).distinct()
    for r in own.orderBy("i", "t").toLocalIterator():
        words = _WORD.findall(r["t"].lower())
        if size and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], words))
        size += len(words)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 12, limit: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, passages: array of (start, end, words) - characters of the original text from 0, end excluded.
    The corpus is read once, whatever the number of blocks."""
    spark = ship(docs.sparkSession)
    source = docs.select(docs[doc_id].alias("d"), docs[doc_text].alias("t")).where("t IS NOT NULL")
    d, i = source.schema["d"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    shape = f"{doc_id} {d}, {item_id} {i}, passages array<struct<start: int, end: int, words: int>>"
    blocks = [spark.sparkContext.broadcast(block) for block in item_blocks(items, item_id, item_text, limit)]
    return source.mapInArrow(_scan(blocks, run, doc_id, item_id, i), shape) if blocks else spark.createDataFrame([], shape)


def automaton(block: list[tuple], run: int):
    """The automaton of the runs of the items of a block; each pattern's value holds the positions of its items."""
    import ahocorasick

    at: dict[str, set[int]] = {}
    for n, (_, words) in enumerate(block):
        for k in range(len(words) - run + 1):
            at.setdefault(f" {' '.join(words[k : k + run])} ", set()).add(n)
    if not at:
        return None
    a = ahocorasick.Automaton()
    for pattern, owners in at.items():
        a.add_word(pattern, tuple(sorted(owners)))
    a.make_automaton()
    return a


def passages_of(text: str, a, run: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per item (its place in the block) the passages of one text as (start, end, words)."""
    words = _WORD.findall(text.lower())
    if len(words) < run:
        return {}
    flat = f" {' '.join(words)} "
    hits = list(a.iter(flat))
    if not hits:
        return {}
    # word number at each blank of flat, and each word's place in the original
    number, k = {}, 0
    for pos, c in enumerate(flat):
        if c == " ":
            number[pos] = k
            k += 1
    spans = word_spans(text)
    ends: dict[int, list[int]] = {}
    for end, owners in hits:
        for n in owners:
            ends.setdefault(n, []).append(number[end])  # words before the closing blank
    out = {}
    for n, stops in ends.items():
        merged: list[list[int]] = []
        for stop in stops:
            start = stop - run
            if merged and start <= merged[-1][1]:
                merged[-1][1] = stop
            else:
                merged.append([start, stop])
        out[n] = [(spans[s][0], spans[e - 1][1], e - s) for s, e in merged]
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the text itself; lower-casing may make one character two."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    origin = [k for k, c in enumerate(text) for _ in c.lower()]
    if len(origin) != len(low):
        low = "".join(c.lower() for c in text)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(low)]


#: Bytes of text that a task holds while all automata pass over it; automata that a Python worker keeps.
HELD, KEPT = 64_000_000, 2
_automata: dict = {}


def _automaton(block, run: int):
    """The automaton of a broadcast block, kept for the next tasks of the worker; and the ids of its items."""
    key = (id(block), run)  # of the worker's own broadcast, which the entry holds
    if key not in _automata:
        while len(_automata) >= KEPT:
            del _automata[next(iter(_automata))]
        _automata[key] = (automaton(block.value, run), [i for i, _ in block.value], block)
    return _automata[key][:2]


def _held(batches: Iterator) -> Iterator:
    """Batches together, up to HELD bytes."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield own
            own, size = [], 0
    if own:
        yield own


def _scan(blocks: list, run: int, doc_id: str, item_id: str, item_type: str):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
        item_kind = {"bigint": pa.int64(), "int": pa.int32()}.get(item_type, pa.string())
        for held in _held(batches):
            found: dict = {}
            for block in blocks:
                a, ids = _automaton(block, run)
                if a is None:
                    continue
                for b, batch in enumerate(held):
                    for k, text in enumerate(batch.column(1).to_pylist()):
                        for n, passages in passages_of(text, a, run).items():
                            found.setdefault((b, k, ids[n]), []).extend(passages)
            rows: dict[int, list] = {}
            for (b, k, item), passages in found.items():
                rows.setdefault(b, []).append((k, item, [{"start": s, "end": e, "words": w} for s, e, w in sorted(set(passages))]))
            for b, own in rows.items():
                k, item, passages = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([held[b].column(0).take(pa.array(k, pa.int64())), pa.array(item, item_kind), pa.array(passages, kind)], names=[doc_id, item_id, "passages"])

    return scan


def leaked_items(found: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Per item: documents that give it away and the longest passage in words."""
    longest = F.array_max(F.transform("passages", lambda p: p["words"]))
    return found.groupBy(item_id).agg(F.count(F.lit(1)).alias("documents"), F.max(longest).alias("longest"))
