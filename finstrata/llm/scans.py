"""Noise of scanned pages: found line by line, and repaired into continuous paragraphs.

Running lines are blocks of lines at the edges of pages that recur, in varied form, on several pages of a document; page
numbers are edge lines that hold nothing but a number that counts on with the pages.  What is made of a broken word (one
word, a compound with its own hyphen, or two words), and which words are misread, is decided by the vocabulary of the
whole corpus: words are folded so that characters that scanners confuse become one, and a word is a misreading only
where the vocabulary has the word that it would be.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: A misread word's model must be this many times as common, and occur this often.
TIMES, LEAST = 8, 5
#: Words of fewer letters than this, and Latin ones, are misread only where unscanned texts never have them.
SHORT = 4
#: Words that are common and sound are left out of the search for misreadings; so many at most are broadcast.  Changes no result.
SOUND_WORDS = 5_000
#: So many lines at either edge of a page may be running lines; each must stand outside of all text.
EDGE_LINES = 4
#: Edge lines are compared within so many pages, and with so many before and after them.
WINDOW, MARGIN = 256, 64
#: Keys of running lines longer than this are compared by their ends and their hash.
KEY_CHARS = 1_000
#: Letters of a running line; shorter ones, and foot lines that end like sentences, must recur on half of the pages.
HEAD_LETTERS = 4

# Characters that scanners put for Cyrillic letters, and letters that they put for digits.
_FOR_LETTERS = {"ьi": "ы", "bl": "ы", "10": "ю", "0": "о", "u": "и", "m": "т", "1": "л", "l": "л", "8": "в", "g": "д", "3": "з", "6": "б", "n": "п", "4": "ч", "r": "г", "i": "л",
                "#": "ж", "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "y": "у", "k": "к", "h": "н", "b": "в", "t": "т"}
_FOR_DIGITS = {"о": "0", "o": "0", "l": "1", "i": "1", "|": "1", "з": "3", "б": "6", "в": "8", "b": "8", "s": "5", "z": "2", "ч": "4"}
# Letters that scanners confuse with one another, Cyrillic and Latin; each class folds to its first.
_ALIKE = ("ес", "ин", "лдц", "кх", "шщ", "оэ", "бв", "пт", "ьъ", "гч", "l1ij|", "o0", "s5", "b8", "ec", "uv")
_FOLD = str.maketrans({c: group[0] for group in _ALIKE[:10] for c in group[1:]})
_FOLD_LATIN = str.maketrans({c: group[0] for group in _ALIKE[10:] for c in group[1:]})
_FOREIGN = re.compile("|".join(sorted(map(re.escape, _FOR_LETTERS), key=len, reverse=True)))

_HYPHENS = "-¬­‐‑"
_BROKEN = re.compile(f"([^\\W\\d_][\\w'•~|#]*|\\w[^\\W\\d_])[{_HYPHENS}] *$")
_LAST, _FIRST = re.compile(f"([^\\W\\d_]+(?:[-‐‑][^\\W\\d_]+)*)[{_HYPHENS}] *$"), re.compile("[^\\W\\d_]+(?:[-‐‑][^\\W\\d_]+)*")
_COMPOUND = re.compile("[^\\W\\d_]+(?:[-‐‑][^\\W\\d_]+)+")
_TOKEN = re.compile(r"[^\s.,;:()«»\"“”„!?/\[\]…—–\-¬­‐‑]+")
_CYR = re.compile("[а-яё]")
_PURE = re.compile("[а-яё]{2,}$|[a-z]{2,}$")
_SPECK = re.compile("(?<=[а-яё])[•~_'|#^*=+@$<>\\\\`{}]+(?=[а-яё])|(?<=[а-яё])[•~_|#^]+$")
_DIGIT_WORD = re.compile("(?=\\D*\\d)[\\d" + "".join(map(re.escape, _FOR_DIGITS)) + "]+$")
_NOT_IN_WORDS = frozenset("вэб")  # letters put for digits only where they stand as capitals
_PAGE_NUMBER = re.compile(r"^[\s\W]*(?:страница|стр|лист|с|page|p)?\.?\s*(?:№\s*)?(\d{1,5})(?:\s*(?:из|/|of)\s*\d{1,5})?[\s\W]*$", re.I)
_GROUPED = re.compile(r"\d{1,3}(?:[   ]\d{3})+$")
_EDGE_NUMBER = re.compile(r"^\s*\d{1,5}(?:\s{2,}|\t)|(?:\s{2,}|\t)\d{1,5}\s*$")
#: Roles of the words of a page: by itself, joined over a line end, at a line end, compound with hyphens.
_PLAIN, _WHOLE, _PART, _HYPHENATED = range(4)
_FORMS = "first: string, rest: string, forms: array<struct<form: string, own: boolean, whole: boolean>>"
_FEATURES = f"""struct<edges: array<struct<line_no: int, foot: boolean, key: string, letters: int, stop: boolean, number: int, first: string, last: string>>,
    words: array<struct<word: string, line_no: int, next_no: int, at: int, role: int>>, breaks: array<struct<line_no: int, next_no: int, upper: boolean, {_FORMS}>>>"""
_WINDOW_NOISE = f"struct<kinds: array<struct<section: %s, line_no: int, kind: string>>, turns: array<struct<section: %s, line_no: int, upper: boolean, {_FORMS}>>>"


def fold(word: str, specks: bool = True) -> str:
    """``word`` in lower case with all characters that scanners confuse made one, and without ``specks``, unless these may be letters."""
    w = _SPECK.sub("", word.lower()) if specks else word.lower()
    if w.isascii():
        return w.translate(_FOLD_LATIN).replace("rn", "m").replace("vv", "w")
    if _FOREIGN.search(w):
        w = _FOREIGN.sub(lambda m: _FOR_LETTERS[m[0]], w)
    return w.replace("ы", "ьл").translate(_FOLD)


def head_key(line: str) -> str:
    """A running line without its page number, case, spacing and punctuation; a very long one by its ends and its hash."""
    key = "".join(filter(str.isalnum, _EDGE_NUMBER.sub("", line).lower()))
    return key if len(key) <= KEY_CHARS else key[: KEY_CHARS // 2] + key[-KEY_CHARS // 2 :] + md5(key.encode()).hexdigest()


def number_in(token: str) -> str | None:
    """The number that a token of digits and letters put for digits would be; None where it can't be one."""
    low = token.lower()
    if not _DIGIT_WORD.match(low):
        return None
    letters = [c for c in token if not c.isdigit()]
    digits = len(token) - len(letters)
    if any(c in "вбч" and c != "б" for c in letters) and digits < 2:
        return None
    if 0 < len(letters) <= 2 and digits >= 2 or len(letters) == digits == 1 and token[0] in "oOЗзlI":
        return "".join(_FOR_DIGITS.get(c, c) for c in low)
    return None


def may_be_misread(word: str) -> str | None:
    """mixed, pure or None: whether a lower-case word has characters that can only be misread, or letters of one script."""
    if _PURE.match(word):
        return "pure"
    if word.isascii():
        letters = sum(c.isalpha() for c in word)
        return "mixed" if letters >= 3 and letters < len(word) and word[0].isalpha() and all(c.isalpha() or c in "0158|" for c in word) else None
    cyrillic = len(_CYR.findall(word))
    if cyrillic == len(word) or cyrillic < 2:
        return None
    if _SPECK.search(word):
        return "mixed"
    return "mixed" if cyrillic >= len(word) - cyrillic and all(_CYR.match(c) or c in _FOR_LETTERS or c == "b" for c in word) else None


def break_forms(first: str, rest: str) -> tuple[str, str, list[tuple[str, bool, bool]]]:
    """(last part, first part, forms) of a word broken between ``first`` and ``rest``, each whole words or compounds.

    A form is (word, whether the hyphen is its own, whether it is all of a compound and not only the parts at the break).
    """
    lead, tail = (re.sub("[‐‑]", "-", m).lower() for m in (first, rest))
    a, b = lead.rpartition("-")[2], tail.partition("-")[0]
    return a, b, [(x + h + y, bool(h), w) for x, y, w in ((lead, tail, True), (a, b, False)) for h in ("", "-")]


def _edge(i: int, foot: bool, line: str) -> tuple:
    s = line.strip()
    key = head_key(s)
    m = _PAGE_NUMBER.match(s)
    first, last = _FIRST.match(s), s[-1:] in _HYPHENS and _LAST.search(s)
    number = int(m[1]) if m and not _GROUPED.match(s) else None
    stop = s.endswith((".", ",", ";", ":")) or s[-1:] in _HYPHENS and bool(_BROKEN.search(s))
    return i, foot, key, sum(map(str.isalpha, key)), stop, number, first and first[0], last[1] if last else None


def page_features(text: str | None) -> tuple[list, list, list] | None:
    """(edge lines from either edge inwards, words, breaks) of one page; None for null and blank texts."""
    if not text or not text.strip():
        return None
    lines = text.split("\n")
    solid = [i for i, s in enumerate(lines) if s.strip()]
    edges = [_edge(i, False, lines[i]) for i in solid[:EDGE_LINES]] + [_edge(i, True, lines[i]) for i in reversed(solid[-EDGE_LINES:])]
    after = dict(zip(solid, solid[1:], strict=False))
    words, breaks = [], []
    begun: set[int] = set()
    for i in solid:
        line = lines[i]
        tokens = _TOKEN.findall(line)
        if not tokens:
            continue
        if i in begun and line.lstrip().startswith(tokens[0]):
            tokens = tokens[1:]
        if tokens and line.rstrip(" ")[-1:] in _HYPHENS and _BROKEN.search(line):
            j = after.get(i)
            nxt = lines[j].lstrip() if j is not None else ""
            a, b = _LAST.search(line), _FIRST.match(nxt)
            upper = bool(nxt) and nxt[0].isupper()
            if nxt and not (_PAGE_NUMBER.match(nxt) and j not in after):
                breaks.append((i, j, upper, *(break_forms(a[1], b[0]) if a and b else ("", "", []))))
            head = _TOKEN.match(nxt)
            first = tokens.pop()
            words.append((first.lower(), i, i, len(first), _PART))
            if head and j == i + 1:
                begun.add(j)
                words.append((head[0].lower(), j, j, len(head[0]), _PART))
                words.append(((first + head[0]).lower(), i, j, len(first), _WHOLE))
        for t in tokens:
            if t.isalpha() or not t.isdecimal() and (any(map(str.isalpha, t)) and (not t.isascii() or t[0].isalpha()) or number_in(t)):
                words.append((t.lower(), i, i, len(t), _PLAIN))
        if "-" in line or "‐" in line or "‑" in line:
            words += [(re.sub("[‐‑]", "-", c).lower(), i, i, 0, _HYPHENATED) for c in _COMPOUND.findall(line)]
    return edges, words, breaks


_EDGE_TYPE = pa.struct([("line_no", pa.int32()), ("foot", pa.bool_()), ("key", pa.string()), ("letters", pa.int32()), ("stop", pa.bool_()), ("number", pa.int32()), ("first", pa.string()), ("last", pa.string())])
_FORM_TYPE = pa.list_(pa.struct([("form", pa.string()), ("own", pa.bool_()), ("whole", pa.bool_())]))
_BREAK_TYPE = pa.struct([("line_no", pa.int32()), ("next_no", pa.int32()), ("upper", pa.bool_()), ("first", pa.string()), ("rest", pa.string()), ("forms", _FORM_TYPE)])
_WORD_TYPE = pa.struct([("word", pa.string()), ("line_no", pa.int32()), ("next_no", pa.int32()), ("at", pa.int32()), ("role", pa.int32())])


def _lists(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """A list array of structs, made column by column."""
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = list(zip(*(r for row in rows for r in row), strict=True)) or [()] * kind.num_fields
    parts = []
    for i, values in enumerate(flat):
        t = kind.field(i).type
        parts.append(_lists([[tuple(f) for f in v] for v in values], t.value_type) if pa.types.is_list(t) else pa.array(values, t))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(kind)))


def _features(text: Column) -> Column:
    @F.arrow_udf(_FEATURES)
    def features(texts: pa.Array) -> pa.Array:
        found = [page_features(t) or ([], [], []) for t in texts.to_pylist()]
        parts = [_lists([f[i] for f in found], t) for i, t in enumerate((_EDGE_TYPE, _WORD_TYPE, _BREAK_TYPE))]
        return pa.StructArray.from_arrays(parts, ["edges", "words", "breaks"])

    return features.asNondeterministic()(text)


def within(a: str, b: str, k: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``k`` edits apart, by an alignment in a band of ``k``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    prev = [j if j <= k else k + 1 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - k), min(len(b), i + k)
        cur = [k + 1] * (len(b) + 1)
        if i <= k:
            cur[0] = i
        for j in range(lo, hi + 1):
            cur[j] = min(prev[j - 1] + (x != b[j - 1]), prev[j] + 1, cur[j - 1] + 1)
        if min(cur[max(0, lo - 1) : hi + 1]) > k:
            return False
        prev = cur
    return prev[len(b)] <= k


def _grams(key: str) -> set[str]:
    s = f"<{key}>"
    return {s[i : i + 4] for i in range(max(1, len(s) - 3))}


def recurring(keys: dict[str, set]) -> dict[str, set]:
    """The keys (with the pages that have them) that recur, exactly or in varied form, each with all pages of its forms.

    Leaders are taken from the most frequent key on; a key joins the first leader within a fifth of edits that shares
    4-grams with it.  A leader without an exact repeat needs three pages, or two pages and a tenth of edits.
    """
    pages: dict[str, set] = {}
    member: dict[str, tuple[str, bool]] = {}
    lists: dict[str, list[str]] = defaultdict(list)
    for key in sorted(keys, key=lambda k: (-len(keys[k]), k)):
        grams = _grams(key)
        shared = Counter(leader for g in grams for leader in lists.get(g, ()))
        # an edit takes at most four grams away; repeated grams of a key count once
        for leader, n in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
            longer = max(len(key), len(leader))
            if n < max(2, len(grams) - 4 * (longer // 5)):
                continue
            if (near := within(leader, key, longer // 10)) or within(leader, key, longer // 5):
                member[key] = leader, near
                pages[leader] |= keys[key]
                break
        else:
            member[key] = key, True
            pages[key] = set(keys[key])
            for g in grams:
                lists[g].append(key)
    close: dict[str, set] = defaultdict(set)
    for key, (leader, near) in member.items():
        if near:
            close[leader] |= keys[key]
    ok = {leader for leader, p in pages.items() if len(keys[leader]) > 1 or len(p) > 2 or len(close[leader]) > 1}
    return {key: pages[leader] for key, (leader, near) in member.items() if leader in ok and (near or len(keys[leader]) > 1 or len(pages[leader]) > 2)}


def window_noise(pages: list[tuple], lo: int, hi: int) -> tuple[list, list]:
    """(running lines and page numbers, words broken over page turns) of the pages from ``lo`` up to ``hi``; the others give context.

    ``pages`` are (section, page, edge lines), sorted.  A line counts while all lines outside of it count.
    """
    votes, outer = defaultdict(set), defaultdict(set)
    heads: dict[bool, dict[str, set]] = {False: defaultdict(set), True: defaultdict(set)}
    weak: dict[bool, set[str]] = {False: set(), True: set()}
    for section, page, edges in pages:
        first = {}
        for e in edges:
            outmost = first.setdefault(e["foot"], e) is e
            if e["number"] is not None:
                o = e["number"] - (section + 1 if page is None else page)
                votes[o].add(section)
                if outmost:
                    outer[o].add(section)
            elif e["key"]:
                heads[e["foot"]][e["key"]].add(section)
                if e["letters"] < HEAD_LETTERS or e["foot"] and e["stop"]:
                    weak[e["foot"]].add(e["key"])
    if len(pages) < 2:
        heads = {}
    offset = max(votes, key=lambda o: (len(outer[o]), len(votes[o]), o == 0, o), default=None)
    steady = {foot: recurring(found) for foot, found in heads.items()}

    def runs(e) -> bool:
        on = steady.get(e["foot"], {}).get(e["key"])
        return on is not None and (e["key"] not in weak[e["foot"]] or len(on) >= max(3, len(pages) / 2))

    kinds, body = [], []
    for section, page, edges in pages:
        ends: dict[bool, dict | None] = {False: None, True: None}
        gone = set()
        for foot in (True, False):
            for e in (e for e in edges if e["foot"] == foot):
                if e["number"] is not None and e["number"] - (section + 1 if page is None else page) == offset:
                    kind = "page_number"
                elif e["number"] is None and runs(e):
                    kind = "running_head"
                else:
                    ends[foot] = e
                    break
                gone.add((section, e["line_no"], kind))
        body.append((section, ends))
        if lo <= section < hi:
            kinds += sorted(gone)
    turns = []
    for (section, ends), (_, following) in zip(body, body[1:], strict=False):
        a, b = ends[True], following[False]
        if lo <= section < hi and a and b and a["last"] and b["first"]:
            turns.append((section, a["line_no"], b["first"][0].isupper(), *break_forms(a["last"], b["first"])))
    return kinds, turns


def _edge_noise(pages: DataFrame, doc_id: str, section: str, page: str) -> DataFrame:
    """(doc_id, kinds, turns) by :func:`window_noise`, one row per window of pages; a window's lines are all that is gathered."""
    s = F.col(section)
    at = F.pmod(s, F.lit(WINDOW))
    windows = F.array_compact(F.array(F.floor(s / WINDOW), F.when((at < MARGIN) & (s >= WINDOW), F.floor(s / WINDOW) - 1), F.when(at >= WINDOW - MARGIN, F.floor(s / WINDOW) + 1)))
    rows = pages.select(doc_id, F.struct(s.alias("section"), F.col(page).alias("page"), F.col("f.edges").alias("edges")).alias("p"), F.explode(windows).alias("w"))
    grouped = rows.groupBy(doc_id, "w").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    kind = pages.schema[section].dataType.simpleString()

    number = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32()}.get(kind, pa.int64())
    kind_type = pa.struct([("section", number), ("line_no", pa.int32()), ("kind", pa.string())])
    turn_type = pa.struct([("section", number), ("line_no", pa.int32()), ("upper", pa.bool_()), ("first", pa.string()), ("rest", pa.string()), ("forms", _FORM_TYPE)])

    @F.arrow_udf(_WINDOW_NOISE % (kind, kind))
    def noise(w: pa.Array, p: pa.Array) -> pa.Array:
        out = [window_noise([(x["section"], x["page"], x["edges"]) for x in ps], n * WINDOW, (n + 1) * WINDOW) for n, ps in zip(w.to_pylist(), p.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([_lists([o[0] for o in out], kind_type), _lists([o[1] for o in out], turn_type)], ["kinds", "turns"])

    return grouped.select(doc_id, noise.asNondeterministic()(F.col("w"), F.col("pages")).alias("n")).select(doc_id, "n.*")


def settled_breaks(breaks: DataFrame, vocab: DataFrame, at: list[str]) -> DataFrame:
    """``at`` and ``own`` of the ``breaks`` (at, upper, first, rest, forms) that break a word: whether the hyphen is the word's own.

    The corpus vocabulary decides: the hyphen is the word's own where the hyphenated form is the commoner one; the parts at
    the break decide only where the whole compound is unknown.  Where the vocabulary has no form, lines that go on with a
    capital end in a whole word; others are joined, with the hyphen where both parts are words by themselves.
    """
    keys = [*at, "upper", "first", "rest"]
    asked = F.concat("forms", F.array(*[F.struct(F.col(c).alias("form"), F.lit(None).cast("boolean").alias("own"), F.lit(c == "rest").alias("whole")) for c in ("first", "rest")]))
    forms = breaks.select(*keys, F.explode(asked).alias("x")).select(*keys, "x.*")
    n = lambda own, whole: F.coalesce(F.sum(F.when(F.col("own").eqNullSafe(F.lit(own)) & (F.col("whole") == whole), F.col("n"))), F.lit(0))
    known = forms.join(vocab.select(F.col("word").alias("form"), F.col("n")).where("n > 0"), "form", "left").groupBy(*keys).agg(
        n(True, True).alias("hw"), n(False, True).alias("jw"), n(True, False).alias("hp"), n(False, False).alias("jp"), n(None, False).alias("a"), n(None, True).alias("b")
    )
    c = F.col
    own = F.when(c("hw") + c("jw") > 0, c("hw") > c("jw")).when(c("hp") + c("jp") > 0, c("hp") > c("jp")).when(~c("upper"), (c("a") >= LEAST) & (c("b") >= LEAST))
    return known.select(*keys, own.alias("own")).where("own is not null")


def vocabulary(clean: DataFrame, unsure: DataFrame, read: DataFrame, text: str = "text") -> DataFrame:
    """(word, clean, n, broken): how often each word stands in the texts ``clean``, in all texts, and at line ends of scans.

    ``clean`` are texts that weren't scanned, ``unsure`` texts of unknown origin, ``read`` the words (word, role) of scans.
    Compounds count whole and by their parts.  Line ends with hyphens are left out.
    """
    def of(texts: DataFrame, is_clean: bool) -> DataFrame:
        unbroken = F.regexp_replace(F.lower(text), f"\\S+[{_HYPHENS}][ ]*\\n\\s*\\S*", " ")
        words = texts.select(F.explode(F.regexp_extract_all(unbroken, F.lit(r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*(?:[-‐‑]\p{L}+)*"), 0)).alias("word"))
        return words.groupBy("word").agg(F.count("*").alias("n")).select("word", (F.col("n") if is_clean else F.lit(0)).alias("clean"), "n", F.lit(0).alias("broken"))

    role = F.col("role")
    plain = of(clean, True).unionByName(of(unsure, False))
    parts = F.when(F.col("word").rlike("[-‐‑]"), F.concat(F.array(F.regexp_replace("word", "[‐‑]", "-")), F.split("word", "[-‐‑]"))).otherwise(F.array("word"))
    plain = plain.select(F.explode(parts).alias("word"), "clean", "n", "broken")
    scanned = read.groupBy("word").agg(F.count(F.when(role.isin(_PLAIN, _HYPHENATED), 1)).alias("n"), F.count(F.when(role.isin(_WHOLE, _PART), 1)).alias("broken"))
    both = plain.unionByName(scanned.select("word", F.lit(0).alias("clean"), "n", "broken"))
    return both.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean", "n", "broken")])


def misreadings(vocab: DataFrame) -> DataFrame:
    """(word, meant): words that fold like a word of the vocabulary, where they are rare beside it or have characters that no word has.

    Numbers with letters in them are misread where unscanned texts never write them so.
    """
    @F.pandas_udf("struct<kind: string, folded: array<string>, number: string>")
    def looked_at(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(k := may_be_misread(w), k and list({fold(w), fold(w, "#" not in w)}), None if k == "pure" else number_in(w)) for w in s]
            yield pd.DataFrame(rows, columns=["kind", "folded", "number"], dtype=object)

    seen = F.col("n") + F.col("broken")
    words = cut(vocab.where(~F.col("word").contains("-")).withColumn("x", looked_at(F.col("word"))).select("word", "clean", "n", "broken", "x.*"))
    pure = F.col("kind") == "pure"
    folded = words.withColumn("folded", F.explode("folded"))
    models = folded.where(pure & (F.col("n") > 0)).groupBy("folded").agg(F.max(F.struct("n", "word")).alias("best"))
    pairs = folded.join(models, "folded").where(F.col("word") != F.col("best.word"))
    strange = (F.length("word") < SHORT) | F.col("word").rlike("^[a-z]")
    rare = (F.col("best.n") >= LEAST) & (F.col("best.n") >= TIMES * seen) & (~strange | (F.col("clean") == 0) & (F.col("best.n") >= TIMES * LEAST))
    wrong = pairs.where(F.when(pure, rare).otherwise(F.col("clean") == 0)).select("word", F.col("best").alias("meant"))
    numbers = words.where("number is not null and clean = 0").select("word", F.struct(F.lit(0).cast("long").alias("n"), F.col("number").alias("word")).alias("meant"))
    return wrong.unionByName(numbers).groupBy("word").agg(F.max("meant").getField("word").alias("meant"))


def scan_noise(sections: DataFrame, documents: DataFrame, doc_id: str = "doc_id", section: str = "section_idx", text: str = "text", page: str = "page", kind: str = "document_type", scan: str = "pdf_scan") -> DataFrame:
    """(doc_id, section_idx, line_no, noise_kind, word, meant) of every noisy line of the scanned documents, once each.

    Kinds: hyphen, misread, running_head, page_number.  ``word`` and ``meant`` are given for misreadings, and for line ends
    whose hyphen is the word's own (without and with it).  ``line_no`` counts all lines of the section from 0.  Null and
    blank texts have no noise, documents without a type are no scans, repeated rows count once, other columns of the
    tables don't matter.  A section without a page counts as the page of its number.
    """
    key = [doc_id, section]
    kinds = broadcast_if_small(documents.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(F.col(kind) == scan).alias("__scan"), F.max(F.col(kind)).isNotNull().alias("__known")))
    src = sections.where(F.col(text).isNotNull() & F.col(section).isNotNull()).select(doc_id, section, page, text).join(kinds, doc_id, "left")
    scans = src.where("__scan").select(doc_id, section, page, text).distinct()
    pages = cut(scans.withColumn("f", _features(F.col(text))).select(doc_id, section, page, "f"))
    others = src.where(~F.coalesce("__scan", F.lit(False)))
    known = F.coalesce("__known", F.lit(False))
    at = pages.select(*key, F.explode("f.words").alias("w")).select(*key, "w.*")
    vocab = cut(vocabulary(others.where(known), others.where(~known), at, text))
    wrong = cut(misreadings(vocab))

    edges = cut(_edge_noise(pages, doc_id, section, page))
    lines = edges.select(doc_id, F.explode("kinds").alias("x")).select(doc_id, F.col("x.section").alias(section), "x.line_no", F.col("x.kind").alias("noise_kind"))

    # line ends in words, within pages and over their turns
    turns = edges.select(doc_id, F.explode("turns").alias("x")).select(doc_id, F.col("x.section").alias(section), "x.line_no", F.lit(-1).alias("next_no"), "x.upper", "x.first", "x.rest", "x.forms")
    breaks = pages.select(*key, F.explode("f.breaks").alias("b")).select(*key, "b.*").unionByName(turns)
    settled = cut(settled_breaks(breaks, vocab, [*key, "line_no", "next_no"]))
    own = F.col("own")
    hyphens = settled.groupBy(*key, "line_no").agg(F.max_by(F.struct("own", "first", "rest"), "next_no").alias("b")).select(*key, "line_no", "b.*").select(
        *key, "line_no", F.lit("hyphen").alias("noise_kind"), F.when(own, F.concat("first", "rest")).alias("word"), F.when(own, F.concat_ws("-", "first", "rest")).alias("meant")
    )

    # words over a line end that is settled otherwise are none, and so are the parts of words
    plain = at.where(F.col("role") == _PLAIN)
    role, joined = F.col("role"), F.coalesce(~own, F.lit(False))
    ends = at.where(role.isin(_WHOLE, _PART))
    decided = settled.select(*key, F.explode(F.array("line_no", F.greatest("line_no", "next_no"))).alias("line_no"), own.alias("own")).groupBy(*key, "line_no").agg(F.min("own").alias("own"))
    ends = ends.join(decided, [*key, "line_no"], "left").where(F.when(role == _WHOLE, joined).otherwise(~joined)).select(plain.columns)
    sound = vocab.orderBy(F.desc("n"), "word").limit(SOUND_WORDS).join(wrong, "word", "left_anti").select("word")
    found = plain.unionByName(ends).join(broadcast_if_small(sound, SOUND_WORDS), "word", "left_anti").join(broadcast_if_small(wrong), "word")
    differs = F.expr("filter(sequence(1, greatest(length(word), length(meant))), i -> substring(word, i, 1) <> substring(meant, i, 1))[0]")
    misread = found.select(*key, F.when(differs > F.col("at"), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("noise_kind"), "word", "meant")

    none = F.lit(None).cast("string")
    return lines.withColumns({"word": none, "meant": none}).unionByName(hyphens).unionByName(misread).select(*key, "line_no", "noise_kind", "word", "meant").distinct()


def goes_on(end: str, start: str, widest: int) -> bool:
    """Whether a page that begins with the line ``start`` goes on with the paragraph that ``end`` is the last line of.

    A line of words about as long as the longest line of its page, ``widest``, was wrapped; headings and table rows are shorter.
    """
    if end[-1] in ":;":
        return False
    full = len(end) >= 0.7 * widest and sum(c.isalpha() for c in end) > sum(c.isdigit() for c in end)
    return start[0].islower() or end[-1] in ",(«—–" or end[-1] not in ".!?…" and (full or start[0] in "«(")


def repair_document(pages: list[tuple[str | None, list[tuple[int, str, str | None, str | None]]]]) -> str:
    """Pages with their noise without running lines and page numbers, words joined and corrected, lines run into paragraphs, also over page turns."""
    kept: list[list] = []
    lengths: dict[int, list[int]] = {}
    meant: dict[str, str] = {}
    for page, (text, noise) in enumerate(pages):
        gone = {i for i, kind, _, _ in noise if kind in ("running_head", "page_number")}
        broken = {i for i, kind, _, _ in noise if kind == "hyphen"}
        own = {i for i, kind, _, m in noise if kind == "hyphen" and m}
        meant |= {w: m for _, kind, w, m in noise if w and kind == "misread"}
        fresh = True
        for i, line in enumerate((text or "").split("\n")):
            if i in gone:
                continue
            s = " ".join(line.split())
            if s:
                kept.append([page, s, fresh, i in broken, i in own])
                lengths.setdefault(page, []).append(len(s))
            fresh = not s
    for before, line in zip(kept, kept[1:], strict=False):
        if before[0] != line[0]:
            line[2] = not goes_on(before[1], line[1], max(lengths[before[0]][:-1], default=1 << 30))
    out: list[str] = []
    carry = ""
    for _, s, fresh, cut_off, own_hyphen in kept:
        if carry:
            s, carry = carry + s, ""
            fresh = False
            if out:
                out[-1] = out[-1].rstrip()
        if cut_off:
            m = re.search(f"(\\S+?)[{_HYPHENS}]$", s)
            if m:
                carry, s = m[1] + "-" * own_hyphen, s[: m.start()].rstrip()
        if fresh or not out:
            out.append(s)
        elif s:
            out[-1] = f"{out[-1]} {s}".lstrip()
    if carry:
        out.append(carry) if not out else out.__setitem__(-1, out[-1] + " " + carry)

    def right(m: re.Match) -> str:
        w = m[0]
        good = meant.get(w.lower())
        return w if good is None else good.upper() if w.isupper() else good.capitalize() if w[0].isupper() else good

    return "\n\n".join(_TOKEN.sub(right, p) for p in out if p)


def repair_page(text: str, noise: list[tuple[int, str, str | None, str | None]]) -> str:
    """One page as ``repair_document`` repairs it."""
    return repair_document([(text, noise)])


def _noise_rows(rows) -> list[tuple]:
    return [] if rows is None else [(r["line_no"], r["noise_kind"], r["word"], r["meant"]) for r in rows]


def _with_noise(sections: DataFrame, noise: DataFrame, docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, text, noise): the distinct sections of ``docs``, each with its gathered noise or null."""
    gathered = noise.groupBy(*key).agg(F.collect_list(F.struct("line_no", "noise_kind", "word", "meant")).alias("noise"))
    return sections.select(*key, text).distinct().join(docs, key[0], "left_semi").join(gathered, key, "left")


def repair_scans(
    sections: DataFrame, noise: DataFrame, doc_id: str = "doc_id", section: str = "section_idx", text: str = "text", documents: DataFrame | None = None, kind: str = "document_type", scan: str = "pdf_scan"
) -> DataFrame:
    """``doc_id``, ``section_idx`` and ``repaired``, the continuous text, of every section of the scanned ``documents``.

    Those without noise are run into paragraphs too.  Without ``documents`` the sections are those of the documents that
    have noise.  Sections of other documents are not returned; null texts stay null; repeated rows count once.  What is gathered
    for a section is bounded by its own lines and words.
    """
    key = [doc_id, section]
    docs = (noise if documents is None else documents.where(F.col(kind) == scan)).select(doc_id).distinct()
    src = _with_noise(sections, noise, docs, key, text)

    @F.pandas_udf("string")
    def repaired(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else repair_page(x, _noise_rows(y)) for x, y in zip(t, n, strict=True)], dtype=object)

    return src.select(*key, repaired(F.col(text), F.col("noise")).alias("repaired"))


def with_raw_texts(sections: DataFrame, documents: DataFrame, doc_id: str = "doc_id", section: str = "section_idx", text: str = "text", page: str = "page", raw: str = "raw_text", kind: str = "document_type", scan: str = "pdf_scan") -> DataFrame:
    """(doc_id, section_idx, page, text) of ``sections``, and the ``raw`` text of every scanned document that has none, as its page 1."""
    src = sections.select(doc_id, section, page, text)
    alone = documents.where(F.col(kind) == scan).groupBy(doc_id).agg(F.max(raw).alias(text)).join(src.select(doc_id), doc_id, "left_anti")
    types = {f.name: f.dataType for f in src.schema.fields}
    return src.unionByName(alone.select(doc_id, F.lit(0).cast(types[section]).alias(section), F.lit(1).cast(types[page]).alias(page), text))


def repair_documents(sections: DataFrame, noise: DataFrame, documents: DataFrame, doc_id: str = "doc_id", section: str = "section_idx", text: str = "text", kind: str = "document_type", scan: str = "pdf_scan") -> DataFrame:
    """``doc_id`` and ``repaired``, the continuous text in place of the raw one, of every scanned document.

    The pages are its sections in order (see :func:`with_raw_texts` for documents without any); a document without pages
    has a null.  What is gathered for a document is its own pages, which its text consists of.
    """
    docs = documents.where(F.col(kind) == scan).select(doc_id).distinct()
    src = _with_noise(sections, noise, docs, [doc_id, section], text)
    pages = src.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct(F.col(section).alias("section"), F.col(text).alias("text"), "noise"))).alias("pages"))

    @F.pandas_udf("string")
    def repaired(p: pd.Series) -> pd.Series:
        return pd.Series([None if y is None or all(x["text"] is None for x in y) else repair_document([(x["text"], _noise_rows(x["noise"])) for x in y]) for y in p], dtype=object)

    return docs.join(pages, doc_id, "left").select(doc_id, repaired(F.col("pages")).alias("repaired"))
