"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

A word is encoded in linear time, without applying merges one by one: all
vocabulary entries in it are found by one pass of an Aho-Corasick automaton over
its bytes (as Latin-1 characters); from the left, the longest entry is taken whose
junction with the entry before it is one that merging would leave standing, and
where none fits, the last choice is taken back.  Whether two neighbouring entries
can stand side by side is found from the merges and remembered.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.ship import ship

#: Default vocabulary file; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pattern by which this vocabulary's texts are split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words kept in a worker's memory; beyond that they are encoded anew.
REMEMBERED_WORDS = 400_000
REMEMBERED_LENGTH = 64
#: Pairs of neighbouring entries kept in a worker's memory.
REMEMBERED_PAIRS = 500_000


class ByteBPE:
    """Encoder of a vocabulary of byte strings with ranks (ids in order of merging)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = SPLIT):
        import ahocorasick
        import regex

        self.ranks = self._read(path)
        self.words_of = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pair_id: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (halves := self._halves(token, rank)):
                self.halves[rank] = halves
                self.pair_id[halves] = rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) == 1 or rank in self.halves:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}

    @staticmethod
    def _read(path: str) -> dict[bytes, int]:
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two entries that merge into ``token``, by merging its bytes with earlier entries only."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = self.ranks.get(parts[0]), self.ranks.get(parts[1])
        return (a, b) if a is not None and b is not None and a < rank and b < rank else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves a junction between ``left`` and ``right``.

        Both are undone in the order opposite to that of merging; if at any time the
        two entries at the junction form a pair that would have merged before the
        later of their own merges, they can't have stayed apart.
        """
        key = (left, right)
        if (known := self._fits.get(key)) is not None:
            return known
        undone = len(self.ranks) + 1
        a, b, out = left, right, None
        while out is None:
            merged = self.pair_id.get((a, b))
            if merged is not None and merged < undone:
                out = False
            elif a not in self.halves and b not in self.halves:
                out = True
            elif b not in self.halves or (a in self.halves and a > b):
                undone, a = a, self.halves[a][1]
            else:
                undone, b = b + 1, self.halves[b][0]
        if len(self._fits) >= REMEMBERED_PAIRS:
            self._fits.clear()
        self._fits[key] = out
        return out

    def _choices(self, data: str) -> list[list[tuple[int, int]]]:
        """For each position the entries that begin there, longest first."""
        starts: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, (n, rank) in self.automaton.iter(data):
            starts[end - n + 1].append((n, rank))
        for s in starts:
            s.reverse()  # the automaton reports them by their ends, so short ones first
        return starts

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the split text."""
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None and (len(raw) == 1 or whole in self.halves):
            return [whole]
        data = raw.decode("latin-1")
        n = len(data)
        starts = self._choices(data)
        dead = bytearray(n + 1)  # ends from which nothing more can follow
        path: list[int] = []  # ids chosen
        ends = [0]
        tried = [0]  # how many choices were tried at each open position
        while ends[-1] < n:
            at, k = ends[-1], tried[-1]
            options = starts[at]
            while k < len(options):
                size, rank = options[k]
                k += 1
                if not dead[at + size] and (not path or self.fits(path[-1], rank)):
                    tried[-1] = k
                    path.append(rank)
                    ends.append(at + size)
                    tried.append(0)
                    break
            else:
                dead[at] = 1
                path.pop()
                ends.pop()
                tried.pop()
        return path

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, strings of special tokens read as ordinary text; [] for empty and null."""
        out: list[int] = []
        known = self._known
        for word in self.words_of(text) if text else ():
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str = VOCABULARY, pattern: str = SPLIT) -> ByteBPE:
    """The encoder of this process; built once per worker."""
    key = (os.path.abspath(path), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBPE(*key)
    return _ENCODERS[key]


def token_ids(text: Column, vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> Column:
    """Column of token ids (array of int) of ``text``.

    Empty and null texts give an empty list.  Texts are encoded whole, whatever
    their length; nothing is shuffled or broadcast, and each worker reads the
    vocabulary from ``vocabulary``, which must exist on all of them.
    """
    ship(SparkSession.active())

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(vocabulary, pattern).encode
        for texts in batches:
            yield pd.Series([one(t) for t in texts])

    return encode(text)
