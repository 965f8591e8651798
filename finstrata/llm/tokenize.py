"""Encoding of whole corpora with a public byte-level BPE vocabulary.

The merges are compiled, as they are needed, into a deterministic finite-state transducer over bytes.  A state holds
the token that precedes, and for every position from which a token may still be under way the place in the vocabulary's
trie and the tokens since the last certain one.  Tokens that all of these share are certain and are emitted; that takes
no more lookahead than the longest token.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files.
VOCABULARIES = os.environ.get("FINSTRATA_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pre-tokenizer pattern of the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Memory bounds of one worker; beyond them the memo starts anew, with the same results.
MEMO_WORDS, MEMO_LENGTH, STATES = 400_000, 60, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition of BPE: the adjacent pair of lowest rank merges first, leftmost on ties."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """The lazily determinised transducer of a vocabulary; exact for every byte string."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            n = 0
            for b in token:
                nxt = self.child[n].get(b)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[n][b] = nxt
                    self.child.append({})
                    self.token_at.append(-1)
                n = nxt
            self.token_at[n] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (-1, ((0, ()),))
        self.ids = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.rest: list[tuple[int, ...]] = [()]

    def _may_follow(self, left: int, token: int) -> bool:
        """Whether ``left`` then ``token`` is how the merges cut their bytes; -1 is the beginning of a word."""
        ok = self.follows.get((left, token))
        if ok is None:
            seq = [token] if left < 0 else [left, token]
            ok = merge_word(b"".join(self.bytes_of[t] for t in seq), self.ranks) == seq
            if len(self.follows) > 4 * STATES:
                self.follows.clear()
            self.follows[left, token] = ok
        return ok

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, live = self.states[state]
        moved, end = [], None
        for node, chain in live:
            node = self.child[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and end is None and self._may_follow(chain[-1] if chain else before, token):
                end = (*chain, token)
            if self.child[node]:
                moved.append((node, chain))
        if end is None:
            raise ValueError("the vocabulary lacks single bytes")
        chains = [c for _, c in moved] + [end]
        certain = len(os.path.commonprefix(chains))
        out = end[:certain]
        state = (out[-1] if out else before, tuple([(n, c[certain:]) for n, c in moved] + [(0, end[certain:])]))
        number = self.ids.get(state)
        if number is None:
            number = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.rest.append(state[1][-1][1])
        return number, out

    def encode_bytes(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(self.states) > STATES:
            self._reset()
        moves, state, out = self.moves, 0, []
        for b in word:
            step = moves[state].get(b)
            if step is None:
                step = moves[state][b] = self._determinise(state, b)
            state, emitted = step
            if emitted:
                out.extend(emitted)
        out.extend(self.rest[state])
        return out


class _Memo(dict):
    """Packed ids by pre-token; a missing one is run through the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.transducer.encode_bytes(word.encode()), dtype=np.int32).tobytes()
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids by one vocabulary file."""

    def __init__(self, path: str):
        import regex

        self.memo = _Memo(Transducer(load_ranks(path)))
        self.split = regex.compile(PATTERN).findall

    def packed(self, text: str | None) -> bytes:
        """The ids of ``text`` as native 32-bit integers; none for empty and null."""
        return b"".join(map(self.memo.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


class StreamDecoder:
    """Ids to text, a few at a time; bytes of an unfinished character are held by an incremental UTF-8 machine."""

    def __init__(self, path: str):
        self.bytes_of = encoder(path).memo.transducer.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(self.bytes_of[i] for i in ids))

    def close(self) -> str:
        return self.machine.decode(b"", True)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The path of a public vocabulary file."""
    return os.path.join(folder or VOCABULARIES, f"{name}.tiktoken")


def encode_texts(df: DataFrame, keys: list[str], text: str = "text", to: str = "ids", path: str | None = None) -> DataFrame:
    """``keys`` and the ids of ``text`` (ARRAY<INT>, without special tokens) in ``to``.

    Null and empty texts give an empty list; strings of special tokens are ordinary text.  The file of ``path`` must be
    on every executor.  Whole texts are encoded whatever their length; repeated rows stay repeated.
    """
    path = path or vocabulary()
    src = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + f", `{to}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [enc.packed(t) for t in texts.slice(at, 1000).to_pylist()]
                ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keys, to])

    return src.mapInArrow(run, schema)


def decode_column(ids: Column, path: str | None = None) -> Column:
    """The text of an ARRAY<INT> column of ids; null stays null."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for a in s:
                d = StreamDecoder(path) if a is not None else None
                out.append(None if d is None else d.feed(a) + d.close())
            yield pd.Series(out, dtype=object)

    return decode(ids)
