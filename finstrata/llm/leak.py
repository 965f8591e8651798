"""Passages of evaluation items in corpus documents, by q-gram lemma filtering and banded alignment.

Every q-gram of a document that an item has too lies on a diagonal (place in the document less place in the item).  A
passage of at least L characters with at most e edits leaves at least L + 1 - q(e + 1) common q-grams in a band of
e + 1 diagonals.  Bands overlap, so that any passage is whole in one of them; bands that reach the count are aligned: from
every word of the item that may begin a passage, the furthest points within the edit budget are followed diagonal by
diagonal, and the longest passage between word ends counts.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Items of up to so many characters and rows are broadcast as one index; more are joined by their minimizers.  Both give the same rows.
BROADCAST_CHARS, BROADCAST_ITEMS = 4_000_000, 100_000
#: Longest q-gram (a power of two).
MAX_Q = 32
#: Indexes kept by a worker: of a broadcast, or of single items in the join.
KEPT = 256
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INDEXES: OrderedDict = OrderedDict()


def normal_words(text: str | None) -> str:
    """The words of ``text`` (runs of letters or digits, lower case) joined by single blanks."""
    return " ".join(_WORD.findall(text.lower())) if text else ""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def all_hashes(points: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """64-bit hashes of all q-grams for every power of two up to ``most``, by doubling."""
    h, step, base, out = points.astype(np.uint64) + np.uint64(1), 1, _BASE, {}
    with np.errstate(over="ignore"):
        while True:
            out[step] = h ^ (h >> np.uint64(29))
            if step >= most:
                return out
            h = h[:-step] * base + h[step:] if len(h) > step else np.empty(0, np.uint64)
            base = base * base
            step *= 2


def shortest_passage(text: str, min_words: int) -> int:
    """The characters of the shortest run of ``min_words`` words of a normal-form text; 0 if it has fewer."""
    ends = np.cumsum([0] + [len(w) + 1 for w in text.split(" ")])
    return int((ends[min_words:] - ends[:-min_words]).min()) - 1 if len(ends) > min_words else 0


def gram_length(shortest: int, max_edits: int, max_q: int = MAX_Q) -> int:
    """The longest q (a power of two) of which a passage of ``shortest`` characters keeps some under ``max_edits`` edits."""
    q = 1
    while q * 2 <= max_q and q * 2 * (max_edits + 1) < shortest:
        q *= 2
    return q


def _same(a: str, i: int, b: str, j: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal."""
    n, step = 0, 16
    most = min(len(a) - i, len(b) - j)
    while n < most:
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, step * 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
    return min(n, most)


def furthest(a: str, i: int, b: str, j: int, edits: int) -> dict[int, int]:
    """For each shift against the diagonal of (i, j), the furthest place of ``a`` that an alignment from there reaches with at most ``edits`` edits."""
    reach = {0: i + _same(a, i, b, j)}
    for k in range(1, edits + 1):
        after = {}
        for d in range(-k, k + 1):
            at = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            at = min(at, len(a), len(b) - (j - i) - d)
            if at >= i and at + (j - i) + d >= j:
                after[d] = at + _same(a, at, b, at + (j - i) + d)
        reach = {d: max(after.get(d, -1), reach.get(d, -1)) for d in {*after, *reach}}
    return reach


class _Item:
    """One item's words."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.end() for m in re.finditer(r"[^ ]+", text)]
        self.starts = [m.start() for m in re.finditer(r"[^ ]+", text)]

    def longest(self, doc: str, starts: set[int], ends: set[int], diagonals: range, lo: int, hi: int, edits: int) -> int:
        """The most words of a passage that begins at a place from ``lo`` to ``hi``, on one of ``diagonals``, and ends at word ends."""
        best = 0
        beyond = dict.fromkeys(diagonals, -1)
        for n in range(bisect_left(self.starts, lo), bisect_right(self.starts, hi)):
            s = self.starts[n]
            for d in diagonals:
                if s + d not in starts or s < beyond[d]:
                    continue
                reach = furthest(self.text, s, doc, s + d, edits)
                if not edits:
                    beyond[d] = reach[0]  # later starts in the same run end where it ends
                for shift, at in reach.items():
                    k = bisect_right(self.ends, at) - 1
                    while k - n + 1 > best and self.ends[k] + d + shift not in ends:
                        k -= 1
                    best = max(best, k - n + 1)
        return best


class ItemIndex:
    """The q-grams of items, by length, and the counts that their passages must reach."""

    def __init__(self, ids: list, texts: list[str], min_words: int, max_edits: int, max_q: int = MAX_Q):
        normal = [(i, normal_words(t)) for i, t in zip(ids, texts, strict=True)]
        kept = [(i, t, n) for i, t in normal if (n := shortest_passage(t, min_words))]
        self.ids, self.items = [i for i, _, _ in kept], [_Item(t) for _, t, _ in kept]
        self.min_words, self.max_edits = min_words, max_edits
        self.q = np.array([gram_length(n, max_edits, max_q) for _, _, n in kept], dtype=np.int64)
        self.need = np.array([max(1, n + 1 - q * (max_edits + 1)) for (_, _, n), q in zip(kept, self.q, strict=True)], dtype=np.int64)
        self.longest = max((len(t) for _, t, _ in kept), default=0)
        self.lists = {}
        for q in sorted({int(q) for q in self.q}):
            own = np.flatnonzero(self.q == q)
            grams = [all_hashes(_points(self.items[i].text), q)[q] for i in own]
            h, item = np.concatenate(grams), np.repeat(own, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            shift = np.uint64(64 - min(22, len(h).bit_length() + 4))
            seen = np.zeros(1 << (64 - int(shift)), dtype=bool)
            seen[h >> shift] = True
            self.lists[q] = h[order], item[order].astype(np.int64), place[order].astype(np.int64), seen, shift

    def _hits(self, texts: list[str], starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, item number, place in the item, diagonal) of every common q-gram."""
        hashes = all_hashes(_points("\n".join(texts)), max(self.lists))
        for q, (known, items, places, seen, shift) in self.lists.items():
            h = hashes[q]
            maybe = np.flatnonzero(seen[h >> shift])
            left = np.searchsorted(known, h[maybe], "left")
            many = np.searchsorted(known, h[maybe], "right") - left
            maybe, left, many = maybe[many > 0], left[many > 0], many[many > 0]
            pos = np.repeat(maybe, many)
            entry = np.repeat(left, many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
            doc = np.searchsorted(starts, pos, "right") - 1
            yield doc, items[entry], places[entry], pos - starts[doc] - places[entry]

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, item number, words of the longest passage) for normal-form texts, where the passage is long enough."""
        if not self.ids or not texts:
            return []
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc, item, place, diagonal = (np.concatenate(x) for x in zip(*self._hits(texts, firsts), strict=True))
        if not len(doc):
            return []
        width = self.max_edits + 1
        # bands of 2w diagonals beginning every w: any w neighbouring diagonals lie whole in one of them
        band = (diagonal + self.longest) // width
        if width > 1:
            band = np.concatenate([band, band - 1])
            doc, item, place = (np.tile(x, 2) for x in (doc, item, place))
        order = np.lexsort((place, band, item, doc))
        doc, item, band, place = doc[order], item[order], band[order], place[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        count = np.diff(np.r_[first, len(doc)])
        enough = count >= self.need[item[first]]
        best: dict[tuple[int, int], int] = {}
        at_words = -1
        for f, n in zip(first[enough], count[enough], strict=True):
            d, i, b = int(doc[f]), int(item[f]), int(band[f])
            if d != at_words:
                words = [m.span() for m in re.finditer(r"[^ ]+", texts[d])]
                starts, ends, at_words = {s for s, _ in words}, {e for _, e in words}, d
            lo = b * width - self.longest
            least = int(place[f]) - int(self.q[i]) * self.max_edits  # an edit takes at most q grams away
            run = self.items[i].longest(texts[d], starts, ends, range(lo, lo + (2 * width if width > 1 else 1)), least, int(place[f + n - 1]), self.max_edits)
            best[d, i] = max(best.get((d, i), 0), run)
        return [(d, i, run) for (d, i), run in best.items() if run >= self.min_words]


def _kept_index(key: object, make: Callable[[], ItemIndex]) -> ItemIndex:
    """The index of ``key``, built once per worker while it is in use."""
    if key in _INDEXES:
        _INDEXES.move_to_end(key)
    else:
        _INDEXES[key] = make()
        if len(_INDEXES) > KEPT:
            _INDEXES.popitem(last=False)
    return _INDEXES[key]


def _rows(schema: T.StructType, types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)


def _by_broadcast(docs: DataFrame, items: list[tuple], schema: T.StructType, min_words: int, max_edits: int) -> DataFrame:
    """Rows found with one index of all ``items`` on every worker; the documents are read once and not shuffled."""
    sent, name = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], [t for _, t in items])), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _kept_index(name, lambda: ItemIndex(*sent.value, min_words, max_edits))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                keys = b.column(0).to_pylist()
                if hits := index.find([normal_words(t) for t in b.column(1).to_pylist()]):
                    yield _rows(schema, [b.schema.field(0).type, None, pa.int32()], [(keys[d], index.ids[i], n) for d, i, n in hits])

    return docs.mapInArrow(run, schema)


def minimizers(points: np.ndarray, q: int, window: int) -> np.ndarray:
    """The q-gram hashes that are the least among some ``window`` neighbouring ones: equal stretches of window + q - 1 characters share one."""
    h = all_hashes(points, q)[q]
    if len(h) > window:
        h = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
        return np.unique(h)
    return h.min(keepdims=True) if len(h) else h


def _by_join(docs: DataFrame, items: DataFrame, schema: T.StructType, min_words: int, max_edits: int) -> DataFrame:
    """Rows found by a join of documents and ``items`` (item, text) on minimizers; neither side is collected.

    A passage of n characters with e edits has an equal stretch of (n - e) / (e + 1); windows are chosen by the shortest
    passage of the items with the same q, so each passage shares a minimizer.  Pairs that meet are checked like the others.
    """
    lengths = T.StructType([items.schema["item"], T.StructField("text", T.StringType()), T.StructField("q", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, n) for i, t in zip(b.column(0).to_pylist(), map(normal_words, b.column(1).to_pylist()), strict=True) if (n := shortest_passage(t, min_words))]
            yield _rows(lengths, [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32()], [(i, t, gram_length(n, max_edits), n) for i, t, n in rows])

    measured = cut(items.mapInArrow(measure, lengths))
    windows = {r.q: max(1, (r.n - max_edits) // (max_edits + 1) - r.q + 1) for r in measured.groupBy("q").agg(F.min("n").alias("n")).collect()}  # one row per power of two

    def marks(name: str, kind: T.DataType, of_item: bool) -> tuple[Callable, T.StructType]:
        out = T.StructType([T.StructField(name, kind), T.StructField("q", T.IntegerType()), T.StructField("mark", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    points = _points(r[1] if of_item else normal_words(r[1]))
                    for q in (r[2],) if of_item else windows:
                        rows += [(r[0], q, int(m)) for m in minimizers(points, q, windows[q]).view(np.int64)]
                yield _rows(out, [b.schema.field(0).type, pa.int32(), pa.int64()], rows)

        return run, out

    d, i = marks("doc", docs.schema[0].dataType, False), marks("item", items.schema["item"].dataType, True)
    key = docs.columns[0]
    pairs = docs.mapInArrow(*d).join(measured.select("item", "text", "q").mapInArrow(*i), ["q", "mark"]).select("doc", "item").distinct()
    full = pairs.join(measured.select("item", F.col("text").alias("passage")), "item").join(docs.select(F.col(key).alias("doc"), F.col(docs.columns[1]).alias("text")), "doc")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, passage, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index = _kept_index((item, passage, min_words, max_edits), lambda item=item, passage=passage: ItemIndex([item], [passage], min_words, max_edits))
                rows += [(doc, item, n) for _, _, n in index.find([normal_words(text)])]
            yield _rows(schema, [b.schema.field(0).type, b.schema.field(1).type, pa.int32()], rows)

    return full.select("doc", "item", "passage", "text").mapInArrow(check, schema)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 18, max_edits: int = 0) -> DataFrame:
    """(doc_id, item_id, common_words) of every document with a passage of at least ``min_words`` consecutive words of an item.

    A passage of the document may differ from the item's in at most ``max_edits`` characters (changed, added or dropped;
    blanks between words count); it begins and ends at words.  ``common_words`` is the length of the longest passage, in the
    item's words.  Case, punctuation and spacing don't count.  Null and empty texts leak nothing, null keys are left out,
    repeated rows count once.
    """
    d_type, i_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField(doc_id, d_type), T.StructField(item_id, i_type), T.StructField("common_words", T.IntegerType())])
    # a passage of n words has at least 2n-1 characters, less what the edits took
    least = max(1, 2 * min_words - 1 - max_edits)
    src = docs.where((F.length(text) >= least) & F.col(doc_id).isNotNull()).select(doc_id, text)
    asked = items.where((F.length(item_text) >= 2 * min_words - 1) & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if size.n <= BROADCAST_ITEMS and (size.chars or 0) <= BROADCAST_CHARS:
        out = _by_broadcast(src, [tuple(r) for r in asked.collect()], schema, min_words, max_edits)
    else:
        out = _by_join(src, asked, schema, min_words, max_edits)
    return out.groupBy(doc_id, item_id).agg(F.max("common_words").alias("common_words"))
