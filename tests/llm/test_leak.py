import random
import re

from finstrata.llm import leak


def words(t):
    return re.findall(r"[^\W_]+", t.lower()) if t else []


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def brute(docs, items, n):
    """(doc, item): words of the longest common run, where it is at least n."""
    found = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            best = 0
            row = [0] * (len(v) + 1)
            for x in w:
                row = [0] + [row[k] + 1 if x == y else 0 for k, y in enumerate(v)]
                best = max(best, *row)
            if best >= n:
                found[d, i] = best
    return found


def brute_edits(docs, items, n, most):
    """The same with at most ``most`` edits, over all pairs of word windows."""
    found = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            for a in range(len(v)):
                for b in range(a + n, len(v) + 1):
                    passage = " ".join(v[a:b])
                    if found.get((d, i), 0) < b - a and any(
                        abs(len(x) - len(passage)) <= most and edits(x, passage) <= most for s in range(len(w)) for e in range(s + 1, len(w) + 1) if (x := " ".join(w[s:e]))
                    ):
                        found[d, i] = b - a
    return found


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*i, "s") for i in items], "item_id long, text string, doc_id string")


def made(rng):
    vocab = [f"сл{i}" for i in range(40)] + list("абвгд")
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 17, 18, 30, 60])))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(1000, None), (1001, ""), (1002, "a" * 5000)]
    for d in range(150):
        out = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            w = items[rng.randrange(12)][1].split()
            n, at = rng.randint(10, 40), rng.randrange(max(1, len(w) - 17))
            out += [x.upper() + rng.choice([" ", ", ", "\n"]) for x in w[at : at + n]]
        out += [rng.choice(vocab) for _ in range(rng.randint(0, 20))]
        docs.append((d, " ".join(out)))
    return docs + docs[5:7], items + items[:1]


def rows(df):
    got = df.collect()
    out = {(r.doc_id, r.item_id): r.common_words for r in got}
    assert len(out) == len(got)
    return out


def test_against_brute_force(spark, monkeypatch):
    """The longest run of every pair, with one broadcast index and by the join of minimizers."""
    docs, items = made(random.Random(3))
    d, i = frames(spark, docs, items)
    for n in (18, 6):
        want = brute(docs, items, n)
        assert rows(leak.leaked_items(d, i, min_words=n)) == want and want
    monkeypatch.setattr(leak, "BROADCAST_CHARS", 200)
    assert rows(leak.leaked_items(d, i)) == brute(docs, items, 18)
    assert rows(leak.leaked_items(d, i, min_words=6)) == brute(docs, items, 6)


def edited(rng):
    vocab = ["рост", "цена", "а", "долг", "банк", "и", "итог"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([6, 8, 9])))) for i in range(4)]
    docs = []
    for d in range(14):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            at, how = rng.randrange(len(t)), rng.random()
            t[at : at + (how > 0.3)] = [rng.choice("абвгдр ")] if how < 0.7 else []
        docs.append((d, f"{rng.choice(vocab)} {''.join(t)} {rng.choice(vocab)}"))
    return docs, items


def test_edits_against_brute_force():
    """All passages within the budget are found, with their longest length, at any q."""
    for seed in range(3):
        docs, items = edited(random.Random(seed))
        for most in (1, 2, 3):
            want = brute_edits(docs, items, 5, most)
            for q in (1, 4, 32):
                index = leak.ItemIndex([i for i, _ in items], [t for _, t in items], 5, most, q)
                got = {(docs[a][0], index.ids[b]): n for a, b, n in index.find([leak.normal_words(t) for _, t in docs])}
                assert got == want and want


def test_edits_in_frames(spark, monkeypatch):
    docs, items = edited(random.Random(8))
    d, i = frames(spark, docs, items)
    want = brute_edits(docs, items, 5, 2)
    assert rows(leak.leaked_items(d, i, min_words=5, max_edits=2)) == want
    monkeypatch.setattr(leak, "BROADCAST_ITEMS", 1)
    assert rows(leak.leaked_items(d, i, min_words=5, max_edits=2)) == want


def test_changed_word():
    """A passage of 24 words with one changed word."""
    rng = random.Random(4)
    item = [f"слово{rng.randrange(999)}" for _ in range(24)]
    doc = ["другое", *item, "конец"]
    doc[10] = "словцо" + doc[10][5:]
    index = leak.ItemIndex([7], [" ".join(item)], 18, 3)
    assert index.find([" ".join(doc)]) == [(0, 0, 24)]
    assert leak.ItemIndex([7], [" ".join(item)], 18, 0).find([" ".join(doc)]) == []


def test_empty(spark, monkeypatch):
    for most in (leak.BROADCAST_CHARS, -1):
        monkeypatch.setattr(leak, "BROADCAST_CHARS", most)
        d, i = frames(spark, [], [])
        assert leak.leaked_items(d, i).count() == 0
        d, i = frames(spark, [(1, "а б"), (None, None)], [(1, "а б"), (None, "в " * 40)])
        assert leak.leaked_items(d, i).count() == 0
