import random

import pytest

from finstrata.llm import cosine_join as J


def table(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], "chunk_key long, split string, text string, source string, norm string")


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def made():
    rng = random.Random(9)
    words = [f"слово{i}" for i in range(60)]
    rows = []
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([8, 9, 10, 11, 19, 20, 21, 30, 45, 60]))]
        for _ in range(4):
            t = list(text)
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                at, how = rng.randrange(len(t)), rng.random()
                t[at : at + (how > 0.3)] = [rng.choice(words)] if how < 0.66 else []
            rows.append((len(rows), rng.choice(["train", "train", "test", "validation"]), ", ".join(t).upper(), f"s{base % 3}"))
    rows += [(1000, "train", None, "s"), (1001, "test", "", "s"), (1002, None, rows[0][2], "s"), (1003, "test", "а б в", "s"), (1004, "train", "а б в", "s"), rows[0], rows[1]]
    return rows


def brute(rows):
    ws = {k: (s, J.words_of(t)) for k, s, t, _ in rows if s}
    want = {}
    for a, (sa, wa) in ws.items():
        for b, (sb, wb) in ws.items():
            if sa == "train" and sb != "train" and min(len(wa), len(wb)) >= 8 and (e := edits(wa, wb)) <= max(len(wa), len(wb)) // 10:
                want[a, b] = e
    return want


@pytest.mark.parametrize("pairs", [J.LIST_PAIRS, 3])
def test_join_against_brute_force(spark, monkeypatch, pairs):
    """Also with lists dealt out, and with few words of known counts."""
    monkeypatch.setattr(J, "LIST_PAIRS", pairs)
    monkeypatch.setattr(J, "HEAD_WORDS", min(pairs, J.HEAD_WORDS))
    rows = made()
    df = table(spark, rows)
    found = J.cross_split_overlaps(df)
    got = {(r.chunk_key_train, r.chunk_key_eval): r.edits for r in found.collect()}
    want = brute(rows)
    assert got == want and found.count() == len(want) and len(want) > 20


def test_counts_by_classes(spark):
    rows = made()
    df, want = table(spark, rows), brute(rows)
    of = {k: (s, g) for k, s, _, g in rows}
    counts = {(r.split, r.source): (r.n_rows, r.n_exact, r.n_pairs) for r in J.overlap_counts(df).collect()}
    expected = {}
    for b in {b for _, b in want}:
        links = [e for (_, x), e in want.items() if x == b]
        n, exact, pairs = expected.get(of[b], (0, 0, 0))
        expected[of[b]] = n + 1, exact + (min(links) == 0), pairs + len(links)
    assert counts == expected
    found = {r.key: (r.train, r.n_pairs, r.least_edits) for r in J.overlap_rows(J.linked_classes(df)).collect()}
    assert set(found) == {k for pair in want for k in pair}
    for k, (train, n, least) in found.items():
        links = [e for (a, b), e in want.items() if k == (a if train else b)]
        assert (n, least) == (len(links), min(links))


def test_empty(spark):
    assert J.cross_split_overlaps(table(spark, [])).count() == 0
    assert J.cross_split_overlaps(table(spark, [(1, "train", "а б в г д е ж з", "s")])).count() == 0


def test_alignment_and_bounds():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.choice("абв") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("абв") for _ in range(rng.randint(0, 12))]
        e, k = edits(a, b), rng.randint(0, 5)
        assert J.aligned(a, b, k) == (e if e <= k else None)
    assert [J.edits_allowed(n) for n in (8, 9, 10, 19, 20)] == [0, 0, 1, 1, 2]
    for n in range(8, 200):  # a pair within the limit keeps a gram in common
        assert n - J.GRAM + 1 - J.GRAM * J.edits_allowed(n) >= 1
