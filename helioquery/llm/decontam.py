"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised byte by byte: A-Z become lower case, ASCII characters other than letters and digits become
spaces, bytes from 0x80 on are kept, so a word is a run of ASCII letters, digits and non-ASCII characters. A window is
``width`` consecutive words of an item, or the whole item if it has fewer. Each distinct benchmark word is one letter
of the automaton's alphabet, so windows cannot match across word bounds; it scans each normalised document once. Ends
of matches are word numbers and, through the word bounds of the original text, become character offsets.

The benchmark is read in blocks of at most ``block_bytes`` of text; a longer item is cut into pieces that share ``width - 1``
words, so no window is lost. Test sets normally are one block and one automaton, which a worker keeps. Of more blocks a
worker holds one automaton at a time and builds it once for each ``hold_bytes`` of documents.

Items with a null id count for n_hit and spans like others; in ``items`` all of them are one null, sorted last, which counts as
one item (as in the SQL, whose joined names leave it out). Null and empty texts have no words and no hits; repeated rows are scanned each for itself; an empty benchmark gives no
hits; documents need an id and a text, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_WORDS, ship, slices

_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_ARROW = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else bytes(text)).translate(FOLD_WORDS).split()


def _letter(i: int) -> str:
    """One character per word number; 0 is kept for words that no item has, surrogates are left out."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


class Matcher:
    """The automaton of one block: words are its letters, windows its keys, values (words, items)."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.letters: dict[bytes, str] = {}
        found: dict[str, tuple[int, list[str | None]]] = {}
        for item, text in items:
            words = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in words_of(text))
            n = min(width, len(words))
            for key in {words[i : i + n] for i in range(len(words) - n + 1)} if words else ():
                found.setdefault(key, (n, []))[1].append(item)
        self.automaton = ahocorasick.Automaton()
        for key, value in found.items():
            self.automaton.add_word(key, value)
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, tuple[int, list[str | None]]]]:
        """(number of the last word, (words, items)) of every occurrence."""
        if not len(self.automaton):
            return []
        get = self.letters.get
        return list(self.automaton.iter("".join([get(w, "\0") for w in words])))


def scan(text: bytes, matchers: Iterable[Matcher]) -> tuple[int, int, list[str | None], list[dict]]:
    """n_words, n_hit, items and the hit spans (character offsets into the original text)."""
    words = text.translate(FOLD_WORDS).split()
    found = [h for m in matchers for h in m.hits(words)] if words else []
    if not found:
        return len(words), 0, [], []
    ends, counts = np.array([e for e, _ in found]), np.array([v[0] for _, v in found])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, ends - counts + 1, 1)
    np.add.at(cover, ends + 1, -1)
    hit = np.cumsum(cover[:-1]) > 0
    items = sorted({i for v in {id(v): v for _, v in found}.values() for i in v[1]}, key=lambda i: (i is None, i or ""))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    bounds = [x for s, e in zip(edges[::2], edges[1::2], strict=True) for x in (at[s][0], at[e - 1][1])]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))[bounds]
    spans = [{"start": int(s), "end": int(e)} for s, e in zip(chars[::2], chars[1::2], strict=True)]
    return len(words), int(hit.sum()), items, spans


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, width: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    for item, whole in rows.toLocalIterator():
        for text in _pieces(whole, width, block_bytes):
            if block and held + len(text) > block_bytes:
                yield block
                block, held = [], 0
            block.append((item, text))
            held += len(text)
    yield block


def _pieces(text: str, width: int, block_bytes: int) -> Iterator[str | bytes]:
    """The text, or pieces of a longer one with all its windows: each ends with the first ``width - 1`` words of the next."""
    if len(text) <= block_bytes:
        yield text
        return
    words = words_of(text)
    start = held = 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held >= block_bytes // 2 and i - start >= 2 * width or i == len(words) - 1:
            yield b" ".join(words[start : i + 1])
            start, held = max(start, i + 2 - width), 0


class _Matchers:
    """Matchers of broadcast blocks, made anew each time if there are several."""

    def __init__(self, shipped: list, width: int):
        self.shipped, self.width, self.only = shipped, width, None

    def __iter__(self) -> Iterator[Matcher]:
        if len(self.shipped) == 1:
            if self.only is None:
                self.only = _kept(self.shipped[0].value, self.width)
            yield self.only
        else:
            for b in self.shipped:
                yield Matcher(b.value, self.width)
                vars(b).pop("_value", None)  # a worker keeps one block


_last: list = [None, None]


def _kept(block: list[tuple[str | None, str | None]], width: int) -> Matcher:
    name = hashlib.sha1(repr((block, width)).encode()).hexdigest()
    if _last[0] != name:
        _last[:] = [name, Matcher(block, width)]
    return _last[1]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 1 << 20,
                 hold_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with its columns and n_words, n_hit, items (sorted, null last) and spans of hit text."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shipped = [sc.broadcast(b) for b in _blocks(benchmark, item_id_col, item_text_col, block_bytes, width)]
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(_RESULT).fields)
    place = docs.columns.index(text_col)

    def scanned(batches):
        matchers = _Matchers(shipped, width)
        for batch in slices(batches) if len(shipped) == 1 else _gathered(batches, hold_bytes):
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            if len(shipped) > 1:
                rows = _by_block(texts, matchers)
            else:
                rows = [scan(t, matchers) for t in texts]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(scanned, schema)


def _gathered(batches: Iterable[pa.RecordBatch], hold_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``hold_bytes``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= hold_bytes:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class _Found:
    """Hits of all blocks in one text, in the shape of a matcher."""

    def __init__(self):
        self.found: list = []

    def hits(self, words):
        return self.found


def _by_block(texts: list[bytes], matchers: Iterable[Matcher]) -> list[tuple]:
    found = [_Found() for _ in texts]
    for m in matchers:
        for text, f in zip(texts, found, strict=True):
            f.found += m.hits(text.translate(FOLD_WORDS).split())
    return [scan(t, [f]) for t, f in zip(texts, found, strict=True)]


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = {
    "op5_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
lens AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT g.doc_id, g.i, g.n, win.item
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)) g
  JOIN win ON win.n = g.n AND win.k = g.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
