"""Benchmark decontamination by one Aho-Corasick automaton.

Patterns are the windows of 10 words of the normalised benchmark items. The automaton runs over numbers of words: an
automaton over characters has some seven times as many nodes. A document is normalised and numbered once and scanned once. Words
that the benchmark doesn't have, and neighbours that are never neighbours in it, part a text into runs; what is left is
scanned, and the places of matches, which are numbers of words, are mapped to offsets of the original text.

The automaton is built once in each Python worker from a broadcast of bounded size: MOST_NODES nodes of some 50 bytes, 200 MB,
which is about 5 MB of benchmark text. A benchmark beyond that is cut into parts, each with an automaton of that size,
and the parts' hits add up.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

WINDOW = 10
#: Words in the windows that one automaton is made of; it has no more nodes.
MOST_NODES = 4_000_000
#: Bits of the filter of neighbours.
PAIR_BITS = 24
#: A-Z to a-z, and what parts words (ASCII other than letters and digits) to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A word of a text that isn't lower-cased yet.
WORD_RX = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None) -> set[tuple[bytes, ...]]:
    """An item's windows; one of fewer words, but not none, is one window."""
    words = words_of(text)
    return {tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))} if words else set()


class Scanner:
    """The automaton of some windows, and the numbers of their words; 0 is any other word."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        import ahocorasick

        self.number = {w: k for k, w in enumerate(sorted({w for p in patterns for w in p}), 1)}
        self.shortest = min(map(len, patterns), default=0)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, p in enumerate(patterns):
            ids = tuple(self.number[w] for w in p)
            self.automaton.add_word(ids, (k, len(ids)))
            at = np.array(ids, np.uint64)
            self.pairs[self._place(at[:-1], at[1:])] = True
        if patterns:
            self.automaton.make_automaton()

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PAIR_BITS)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """Words of a text, and for each occurrence of a window its first word, its words and its number."""
        words = words_of(text)
        if not self.shortest or len(words) < self.shortest:
            return len(words), []
        get = self.number.get
        ids = np.fromiter([get(w, 0) for w in words], np.uint64, len(words))
        known = ids > 0
        #: Whether a word goes on from the one before it.
        on = np.zeros(len(ids) + 1, bool)
        on[1:-1] = known[1:] & known[:-1] & self.pairs[self._place(ids[:-1], ids[1:])]
        starts = np.flatnonzero(known & ~on[:-1])
        ends = np.flatnonzero(known & ~on[1:]) + 1
        long = ends - starts >= self.shortest
        found = []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            found += [(a + end + 1 - n, n, k) for end, (k, n) in self.automaton.iter(tuple(ids[a:b].tolist()))]
        return len(words), found


def offsets(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where hit words (first, words) lie in the original text: spans of code points, joined where they meet."""
    places = [m.span() for m in WORD_RX.finditer(text)]
    out: list[tuple[int, int]] = []
    for first, n in sorted(hits):
        a, b = places[first][0], places[first + n - 1][1]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The benchmark's windows and the items that have them, in parts of bounded size; one part at least."""
    part: dict[tuple[bytes, ...], list[str]] = {}
    size = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct().toLocalIterator():
        for w in windows(row["text"]):
            size += 0 if w in part else len(w)
            part.setdefault(w, []).append(row["item_id"])
            if size >= MOST_NODES:
                yield part
                part, size = {}, 0
    if part or not size:
        yield part


_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_FOUND_SQL = "struct<n_words:bigint,n_hit:bigint,hits:array<bigint>,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
#: The last scanner that this worker built, by its broadcast: tasks of one worker follow each other.
_last: list[tuple[str, Scanner]] = []


def _scanner(name: str, patterns: list[tuple[bytes, ...]]) -> Scanner:
    if not _last or _last[0][0] != name:
        _last[:] = [(name, Scanner(patterns))]
    return _last[0][1]


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with a column __found: n_words, n_hit, hits (first word << 20 | words), items that occur, and spans of the
    original text, in code points, that the hit words take up.

    A window lies within an item's words; a null or wordless text or item has none, and a null item_id is the empty string.
    Equal items and repeated rows do no harm: each row of docs gives one row. A column named __found is replaced.
    """
    spark = docs.sparkSession
    out = docs.withColumn("__found", F.lit(None).cast(_FOUND_SQL))
    at_text, at_found = out.columns.index("text"), out.columns.index("__found")
    for part in _parts(benchmark):
        names = sorted(part)
        held = spark.sparkContext.broadcast((names, [sorted(set(part[w])) for w in names]))

        def look(batches: Iterator[pa.RecordBatch], held=held, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            names, items = held.value
            scanner = _scanner(name, names)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    rows = []
                    for value, old in zip(some.column(at_text), some.column(at_found).to_pylist(), strict=True):
                        text = value.as_py()
                        n, found = scanner.scan(text)
                        hits = sorted({first << 20 | size for first, size, _ in found} | set((old or {}).get("hits") or ()))
                        who = {x for k in {k for _, _, k in found} for x in items[k]} | set((old or {}).get("items") or ())
                        places = [(h >> 20, h & (1 << 20) - 1) for h in hits]
                        words = {first + k for first, size in places for k in range(size)}
                        spans = [{"start": a, "end": b} for a, b in offsets(text, places)] if places else []
                        rows.append({"n_words": n, "n_hit": len(words), "hits": hits, "items": sorted(who), "spans": spans})
                    columns = list(some.columns)
                    columns[at_found] = pa.array(rows, _FOUND)
                    yield pa.RecordBatch.from_arrays(columns, names=some.schema.names)

        out = in_arrow(out, look, out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs; an empty table gives none."""
    rows = scanned(docs.select("doc_id", "text"), benchmark).select("doc_id", "__found.*")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, all columns as they were. Rows with null, empty or repeated
    texts are treated like any other, each by itself."""
    return scanned(docs, benchmark).filter("__found.n_hit = 0").select(*docs.columns)
