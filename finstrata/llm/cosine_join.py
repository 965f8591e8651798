"""Same and near-same texts across splits: a weighted cosine join of word n-gram vectors.

A text is a vector of word 5-grams, each occurrence its own dimension, weighted by the rarity of its words in the whole
corpus.  One changed, added or dropped word can take at most five grams away, so the texts of a pair within ``k`` words
keep in common at least the weight of all grams less that of the ``5k`` heaviest.  Only the heaviest grams are entered in
the inverted lists, down to where the residual norm of the rest falls below what a pair must share; pairs that meet there
are kept while their partial product and the residuals can still reach it, and get exact products and an exact word
alignment.  Lists that would pair too much in one task are dealt out.

Exact copies are one class throughout: classes are linked, counts come from the sizes of classes, and only
:func:`cross_split_overlaps` writes the rows of linked classes out as pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut
from .canon import canonical

#: Words of a gram.  With at most one word in ten changed, five is the most that leaves any pair a gram in common.
GRAM = 5
#: So many of the commonest words have their counts sent to the executors; all others count as once met.
HEAD_WORDS = 1 << 17
#: A list that pairs more than so many entries is dealt out over parts of about as many.
LIST_PAIRS = 2_000_000
#: Long lists are looked for among the entries of one text in so many; results don't depend on it.
LIST_SAMPLE = 16
#: Cells of the word histograms that are compared before texts are.
SKETCH = 64
#: At most this share of the words may differ.
SHARE = 0.1
_WORD = re.compile(r"[^\W_]+")
_EPS = 1e-9


def words_of(text: str | None) -> list[str]:
    """The words that count: runs of letters or digits of the canonical form, in lower case."""
    return _WORD.findall(canonical(text).lower()) if text else []


def edits_allowed(n: int, share: float = SHARE) -> int:
    return int(n * share + _EPS)


def _widest(n: int, share: float) -> int:
    """The edits allowed to the longest partner of a text of ``n`` words."""
    m = n
    while m + 1 - n <= edits_allowed(m + 1, share):
        m += 1
    return edits_allowed(m, share)


def aligned(a: list[str], b: list[str], k: int) -> int | None:
    """The word edit distance of ``a`` and ``b`` if it is at most ``k``, by an alignment in a band of ``k``."""
    if abs(len(a) - len(b)) > k:
        return None
    inf = k + 1
    prev = {j: j for j in range(min(k, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        cur = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            best = i if j == 0 else min(prev.get(j, inf) + 1, cur.get(j - 1, inf) + 1, prev.get(j - 1, inf) + (a[i - 1] != b[j - 1]))
            cur[j] = min(best, inf)
        if min(cur.values()) > k:
            return None
        prev = cur
    return prev[len(b)] if prev.get(len(b), inf) <= k else None


class _Grams:
    """Gram ids and rarities of many texts at once; words are looked up once per worker."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.counts, self.total = counts, max(total, 2)
        self.memo: dict[str, tuple[int, int]] = {}
        #: The rarity of a gram of words met once, in sixteenths of a bit.
        self.most = GRAM * self._rarity(1)

    def _rarity(self, n: int) -> int:
        return int(16 * math.log2(self.total / n))

    def _word(self, w: str) -> tuple[int, int]:
        import xxhash

        h = self.memo.get(w)
        if h is None:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            h = self.memo[w] = xxhash.xxh64_intdigest(w), self._rarity(self.counts.get(w, 1))
        return h

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, gram id, rarity) of every gram, a repeated gram of a text having a new id each time; the word counts and sketches."""
        split = [t.split(" ") for t in texts]
        n = np.array([len(w) for w in split], dtype=np.int64)
        found = [self._word(w) for ws in split for w in ws]
        h = np.array([x for x, _ in found], dtype=np.uint64)
        r = np.array([x for _, x in found], dtype=np.int64)
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(len(texts)), n)
        sketch = np.bincount(doc * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), minlength=len(texts) * SKETCH).reshape(-1, SKETCH)
        last = len(h) - GRAM + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), n, sketch
        with np.errstate(over="ignore"):
            g, rare = np.zeros(last, dtype=np.uint64), np.zeros(last, dtype=np.int64)
            for i in range(GRAM):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last]
                rare += r[i : i + last]
            inside = np.arange(last) + GRAM <= ends[doc[:last]]
            doc, g, rare = doc[:last][inside], g[inside], rare[inside]
            order = np.lexsort((g, doc))
            doc, g, rare = doc[order], g[order], rare[order]
            same = np.r_[False, (doc[1:] == doc[:-1]) & (g[1:] == g[:-1])]
            at = np.arange(len(g))
            run = at - np.maximum.accumulate(np.where(same, 0, at))
            g = (g ^ (run.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
        return doc, g, rare, n, sketch

    def squared_weights(self, rare: np.ndarray) -> np.ndarray:
        """Squared weights from 1 (words met everywhere) to 2 (words met once)."""
        return 1.0 + rare / max(self.most, 1)


def normal_texts(df: DataFrame, text: str, min_words: int) -> DataFrame:
    """``df`` with ``norm``, its words joined by blanks; rows of fewer than ``min_words`` words are left out."""

    @F.pandas_udf("string")
    def norm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = (words_of(t) for t in s)
            yield pd.Series([" ".join(w) if len(w) >= min_words else None for w in found], dtype=object)

    # a text of n words has at least 2n-1 characters
    return df.where(F.length(text) >= 2 * min_words - 1).withColumn("norm", norm.asNondeterministic()(F.col(text))).where("norm is not null")


def _word_counts(classes: DataFrame) -> tuple[dict[str, int], int]:
    """The counts of the commonest words, at most HEAD_WORDS of them, and the number of all words of all distinct texts."""
    counts = classes.select(F.explode(F.split("norm", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = cut(counts)
    head = counts.orderBy(F.desc("n"), "w").limit(HEAD_WORDS).toPandas()
    return dict(zip(head["w"], head["n"].tolist(), strict=True)), counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


_META = "id long, train boolean, eval boolean, n int, need float, left float, last_rare int, last_gram long, sketch binary"


def _entries(classes: DataFrame, words: tuple[dict[str, int], int], share: float) -> DataFrame:
    """(id, train, eval, n, need, left, last_rare, last_gram, sketch, grams, w2): the inverted-list entries of every distinct text, the heaviest first.

    ``need`` is the squared weight that a partner must share, ``left`` the weight outside the entered grams; the last of
    these, in the order of all grams by rarity and id, is (``last_rare``, ``last_gram``).
    """
    sent = classes.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                doc, g, rare, n, sketch = grams.of(b.column(3).to_pylist())
                order = np.lexsort((g, -rare, doc))  # the heaviest first
                doc, g, rare = doc[order], g[order], rare[order]
                w2 = grams.squared_weights(rare)
                size = np.bincount(doc, minlength=len(n))
                first = np.cumsum(size) - size
                rank = np.arange(len(doc)) - first[doc]
                lose = GRAM * np.array([_widest(int(x), share) for x in n], dtype=np.int64)
                mass = np.bincount(doc, w2, minlength=len(n))
                lost = np.bincount(doc, w2 * (rank < lose[doc]), minlength=len(n))
                entered = rank <= lose[doc]  # then the residual norm is below need
                kept = np.bincount(doc, w2 * entered, minlength=len(n))
                last = np.clip(first + np.minimum(size, lose + 1) - 1, 0, max(len(g) - 1, 0))
                offsets = np.r_[0, np.cumsum(np.minimum(size, lose + 1))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (g[entered].view(np.int64), w2[entered].astype(np.float32))]
                ends = [(-rare[last]).astype(np.int32), (g[last] ^ np.uint64(1 << 63)).view(np.int64)] if len(g) else [np.zeros(len(n), np.int32), np.zeros(len(n), np.int64)]
                bits = [bytes(x) for x in np.minimum(sketch, 255).astype(np.uint8)]
                cols = [b.column(0), b.column(1), b.column(2), n.astype(np.int32), (mass - lost).astype(np.float32), (mass - kept).astype(np.float32), *ends]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols] + [pa.array(bits, pa.binary()), *lists], names=[*(x.split()[0] for x in _META.split(", ")), "grams", "w2"])

    return classes.select("id", "train", "eval", "norm").mapInArrow(run, f"{_META}, grams array<long>, w2 array<float>")


def _met(entries: DataFrame, share: float) -> DataFrame:
    """(id_a, id_b, dot): pairs of a training text and another one of ``entries`` that meet in a list, with their partial product.

    The lists that pair most are dealt out: the training entries over parts, the others to every part.
    """
    lists = entries.select("id", "train", "eval", "n", F.explode(F.arrays_zip("grams", "w2")).alias("x")).select("id", "train", "eval", "n", F.col("x.grams").alias("gram"), "x.w2")
    count = lambda side: F.greatest(F.count(F.when(F.col(side), 1)), F.lit(1)) * LIST_SAMPLE
    sizes = lists.where(F.pmod("id", F.lit(LIST_SAMPLE)) == 0).groupBy("gram").agg((count("train") * count("eval")).alias("pairs"))
    hot = broadcast_if_small(cut(sizes.where(F.col("pairs") > LIST_PAIRS).select("gram", F.ceil(F.col("pairs") / LIST_PAIRS).cast("int").alias("parts"))))
    parts = F.coalesce("parts", F.lit(1))
    a = lists.where("train").join(hot, "gram", "left").withColumn("part", F.pmod(F.hash("id"), parts)).select("gram", "part", F.col("id").alias("id_a"), F.col("n").alias("n_a"), "w2")
    b = lists.where("eval").join(hot, "gram", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("gram", "part", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    near = F.abs(F.col("n_a") - F.col("n_b")) <= F.floor(F.greatest("n_a", "n_b") * share + _EPS)
    return a.join(b, ["gram", "part"]).where(near & (F.col("id_a") != F.col("id_b"))).groupBy("id_a", "id_b").agg(F.sum("w2").alias("dot"))


def _alike(pairs: DataFrame, share: float) -> DataFrame:
    """``pairs`` whose word histograms allow them to be within the share of edits: an edit changes at most two cells by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.maximum(*(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for i in (4, 5))
            ok = np.abs(x - y).sum(axis=1) <= 2 * np.floor(n * share + _EPS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id_a", "id_b"]).filter(pa.array(ok))

    return pairs.select("id_a", "id_b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "id_a long, id_b long")


def _verify(pairs: DataFrame, words: tuple[dict[str, int], int], share: float) -> DataFrame:
    """The pairs of ``pairs`` (cid_a, norm_a, cid_b, norm_b) within the share of edits, with exact cosine and edits."""
    sent = pairs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(*sent.value)
        for b in batches:
            out = []
            for ca, na, cb, nb in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                wa, wb = na.split(" "), nb.split(" ")
                edits = aligned(wa, wb, edits_allowed(max(len(wa), len(wb)), share))
                if edits is not None:
                    doc, g, rare, _, _ = grams.of([na, nb])
                    w2 = grams.squared_weights(rare)
                    dot = float(w2[doc == 0][np.isin(g[doc == 0], g[doc == 1])].sum())
                    norms = float(w2[doc == 0].sum()) * float(w2[doc == 1].sum())
                    out.append((ca, cb, dot / norms**0.5 if norms else 0.0, edits))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.float64(), pa.int32()))], names=["cid_a", "cid_b", "cosine", "edits"])

    return pairs.select("cid_a", "norm_a", "cid_b", "norm_b").mapInArrow(run, "cid_a binary, cid_b binary, cosine double, edits int")


@dataclass(frozen=True)
class Overlaps:
    """``rows`` (key, train, split, group, cid): every row with the class of its text, once each; ``links`` (cid_a, cid_b, cosine, edits): linked classes, of training and other rows."""

    rows: DataFrame
    links: DataFrame


def linked_classes(df: DataFrame, key: str = "chunk_key", text: str = "text", split: str = "split", train: str = "train", group: str | None = None, min_words: int = 8, share: float = SHARE) -> Overlaps:
    """The :class:`Overlaps` of ``train`` rows with rows of other splits whose texts are equal or differ in at most ``share`` of the words.

    Null or short texts, null keys and null splits are in no class; rows delivered twice count once.  ``group`` is a column
    to count by later; other columns of ``df`` don't matter.
    """
    by = F.col(group) if group else F.lit(None).cast("string")
    src = df.where(F.col(split).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(split) == train).alias("train"), F.col(split).alias("split"), by.alias("group"), F.col(text).alias("__text"))
    rows = cut(normal_texts(src, "__text", min_words).select("key", "train", "split", "group", F.unhex(F.md5("norm")).alias("cid"), "norm"))
    classes = rows.groupBy("cid").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"), F.first("norm").alias("norm"))
    classes = cut(classes.withColumn("id", F.xxhash64("cid")))
    words = _word_counts(classes)
    entries = cut(_entries(classes, words, share))
    met = _met(entries, share)
    meta = entries.drop("train", "eval", "grams", "w2")
    names = meta.columns[1:]
    of = lambda side: broadcast_if_small(meta.select(F.col("id").alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in names]))
    met = met.join(of("a"), "id_a").join(of("b"), "id_b")
    # Common grams that didn't meet come, in the order of weights, after the entered ones of the text whose list ends first.
    rest = F.when(F.struct("last_rare_a", "last_gram_a") <= F.struct("last_rare_b", "last_gram_b"), F.col("left_a")).otherwise(F.col("left_b"))
    near = _alike(met.where(F.col("dot") >= F.greatest("need_a", "need_b") * (1 - 1e-5) - rest), share)
    texts = classes.select("id", "cid", "norm")
    near = near.join(texts.toDF("id_a", "cid_a", "norm_a"), "id_a").join(texts.toDF("id_b", "cid_b", "norm_b"), "id_b")
    equal = classes.where("train and eval").select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"), F.lit(1.0).alias("cosine"), F.lit(0).alias("edits"))
    return Overlaps(rows.drop("norm").distinct(), _verify(near, words, share).unionByName(equal))


def cross_split_overlaps(df: DataFrame, key: str = "chunk_key", text: str = "text", split: str = "split", train: str = "train", min_words: int = 8, share: float = SHARE) -> DataFrame:
    """(<key>_train, <key>_eval, edits, cosine) of every pair of a ``train`` row and a row of another split that :func:`linked_classes` links.

    The rows of linked classes are written out, so a group of copies costs what its result costs.
    """
    found = linked_classes(df, key, text, split, train, None, min_words, share)
    ta = found.rows.where("train").select(F.col("cid").alias("cid_a"), F.col("key").alias(f"{key}_train"))
    eb = found.rows.where(~F.col("train")).select(F.col("cid").alias("cid_b"), F.col("key").alias(f"{key}_eval"))
    return found.links.join(ta, "cid_a").join(eb, "cid_b").select(f"{key}_train", f"{key}_eval", "edits", "cosine").distinct()


def overlap_rows(found: Overlaps) -> DataFrame:
    """(key, train, split, group, class_id, n_links, n_pairs, least_edits): every row of a linked class, with its links to classes and rows of the other side."""
    sizes = found.rows.groupBy("cid").agg(F.countDistinct(F.when(F.col("train"), F.col("key"))).alias("n_train"), F.countDistinct(F.when(~F.col("train"), F.col("key"))).alias("n_eval"))
    sums = [F.count("*").alias("n_links"), F.sum("n").alias("n_pairs"), F.min("edits").alias("least_edits")]
    links = cut(found.links)
    of_train = links.join(sizes.select(F.col("cid").alias("cid_b"), F.col("n_eval").alias("n")), "cid_b").groupBy(F.col("cid_a").alias("cid"), F.lit(True).alias("train")).agg(*sums)
    of_eval = links.join(sizes.select(F.col("cid").alias("cid_a"), F.col("n_train").alias("n")), "cid_a").groupBy(F.col("cid_b").alias("cid"), F.lit(False).alias("train")).agg(*sums)
    return found.rows.join(of_train.unionByName(of_eval), ["cid", "train"]).select("key", "train", "split", "group", F.hex("cid").alias("class_id"), "n_links", "n_pairs", "least_edits")


def overlap_counts(df: DataFrame, key: str = "chunk_key", text: str = "text", split: str = "split", source: str = "source", train: str = "train", min_words: int = 8, share: float = SHARE) -> DataFrame:
    """(split, source, n_rows, n_exact, n_pairs) of the evaluation rows: how many overlap with training, exactly or nearly, and in how many pairs.

    Counted by classes; no pairs of rows are made.
    """
    found = overlap_rows(linked_classes(df, key, text, split, train, source, min_words, share)).where(~F.col("train"))
    return found.groupBy(F.col("split").alias(split), F.col("group").alias(source)).agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("least_edits") == 0, 1)).alias("n_exact"), F.sum("n_pairs").alias("n_pairs"))
