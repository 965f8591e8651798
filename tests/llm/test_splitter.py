import random

import pytest

from finstrata.llm.splitter import MAX_CHARS, split_oversized, split_text


def check(text, most, overlap):
    pieces = [text[a:b] for a, b in split_text(text, most, overlap)]
    words = text.split()
    back = []
    for i, p in enumerate(pieces):
        ws = p.split()
        assert len(ws) <= most
        if i:
            n = min(overlap, len(pieces[i - 1].split()))
            assert ws[:n] == pieces[i - 1].split()[-n:] if n else True
            ws = ws[n:]
        assert ws
        back += ws
    assert back == words
    return pieces


def test_random_texts():
    rng = random.Random(6)
    for _ in range(600):
        text = "".join(f"w{i}" + rng.choice([" ", " ", " ", ". ", ".\n", "\n\n", "\n\n\n", " "]) for i in range(rng.randint(1, 120)))
        most = rng.randint(2, 30)
        check(text, most, rng.randint(0, most - 1))


def test_boundaries():
    text = "Первый абзац из слов. Ещё одно предложение тут.\nВторой абзац из слов. И ещё одно предложение."
    assert [p.split()[-1] for p in check(text, 9, 1)] == ["тут.", "предложение."]
    assert [p.split()[-1] for p in check(text, 6, 1)] == ["слов.", "тут.", "слов.", "предложение."]
    assert split_text("а б в", 3, 1) == [(0, 5)] and split_text("", 3, 1) == [] and split_text(None) == []
    with pytest.raises(ValueError):
        split_text("а", 5, 5)


def test_characters():
    """The last level: no piece exceeds the bound on characters, and nothing is lost."""
    assert [b - a for a, b in split_text("а" * 100_000)] and max(b - a for a, b in split_text("а" * 100_000)) <= MAX_CHARS
    rng = random.Random(3)
    texts = ["а" * 100_000, " ".join(["десятьбукв"] * 100), " " * 50, "a" + " " * 60 + "b", *("".join(rng.choice("ab. \n") * rng.randint(1, 40) for _ in range(60)) for _ in range(200))]
    for t in texts:
        for most in (2, 7, 20, 33):
            got = split_text(t, 8, 3, most)
            assert all(0 < b - a <= most for a, b in got)
            covered = {i for a, b in got for i in range(a, b)}
            assert all(i in covered for i, c in enumerate(t) if not c.isspace())
            assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
    assert len(split_text(" ".join(["десятьбукв"] * 100), max_chars=20)) > 50
    assert split_text("а" * 100_000, max_chars=None) == [(0, 100_000)]


def test_frame(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [("d", 1, long, "якорь", 7), ("d", 2, "коротко", None, 7), ("d", 3, None, "я", 7), ("d", 4, "", "я", 7), ("d", 5, " " * 400, "я", 7), ("d", 6, "а" * 5000, "я", 7), ("d", 7, "а" * 9000, "я", 7)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id int, text string, section_anchor string, piece_no int")
    got = split_oversized(df).orderBy("chunk_id", "piece_no").collect()
    parts = [r for r in got if r.chunk_id == 1]
    assert len(parts) == 3 and {r.section_anchor for r in parts} == {"якорь"} and [r.piece_no for r in parts] == [0, 1, 2]
    assert all(long[r.piece_start : r.piece_end] == r.text for r in parts)
    rest = {r.chunk_id: (r.text, r.n_pieces, r.piece_start, r.piece_end) for r in got if r.chunk_id not in (1, 7)}
    assert [r.n_words for r in parts] == [300] * 3 and [(r.n_words, len(r.text) <= MAX_CHARS) for r in got if r.chunk_id == 7] == [(1, True)] * 2
    assert rest == {2: ("коротко", 1, 0, 7), 3: (None, 1, None, None), 4: ("", 1, None, None), 5: (" " * 400, 1, 0, 400), 6: ("а" * 5000, 1, 0, 5000)}
    assert split_oversized(df.limit(0)).count() == 0
