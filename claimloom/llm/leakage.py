"""Evaluation texts leaking into training text (problem 9): suffix arrays of the training text.

Each task builds suffix arrays over shards of its own documents, without regard to the
held-out items: all suffixes of the shard's words in order.  Every suffix of every
item is then looked up in them by binary search, and a hit is followed to its end.
Words are compared by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.plans.ship import ship

#: A passage leaks if so many consecutive words of an item stand in a document.
MIN_WORDS = 13
#: Characters of training text in one suffix array.
SHARD_CHARS = 6_000_000
#: Characters of held-out text that are sent and searched together.
BLOCK_CHARS = 20_000_000


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, without regard to case."""
    return _runs()(text.casefold()) if text else []


def _runs():
    global _RUNS
    if _RUNS is None:
        import regex

        _RUNS = regex.compile(r"[\p{L}\p{N}]+").findall
    return _RUNS


_RUNS = None


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as hashes with a 0 after each text; their ranks among all words (0 is lowest); where each text begins."""
    parts: list[str] = []
    begins = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        begins[i] = len(parts)
        parts += words_of(t)
        parts.append("")
    codes, distinct = pd.factorize(np.array(parts, dtype=object))
    hashes = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False).view(np.int64)
    stop = distinct == ""
    hashes = np.where(stop, 0, np.where(hashes == 0, 1, hashes))
    places = np.empty(len(hashes), np.int64)
    places[np.lexsort((hashes, ~stop))] = np.arange(len(hashes))
    return hashes[codes], places[codes], begins


def _run_lengths(words: np.ndarray) -> np.ndarray:
    """For each place how many words from there on are not 0."""
    n = len(words)
    stops = np.append(np.flatnonzero(words == 0), n)
    return stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of the words that follow them, compared over ``depth`` words or more.

    Prefix doubling: ranks by 1, 2, 4, ... words; two ranks make the next.
    """
    rank = ranks
    width = 1
    while width < depth:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:]
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(pair, kind="stable")
        steps = np.empty(len(pair), np.int64)
        steps[order] = np.cumsum(np.r_[False, pair[order[1:]] != pair[order[:-1]]]) if len(pair) else 0
        rank = steps
        width *= 2
        if len(rank) and rank[order[-1]] == len(rank) - 1:  # no two are alike any more
            return order
    return np.argsort(rank, kind="stable")


class Probe:
    """A block of held-out items as one array of words, with all suffixes to be searched."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        self.ids = ids
        words, _, begins = hashed(texts)
        self.words = np.r_[words, np.zeros(min_words + 1, np.int64)]
        self.owner = np.repeat(np.arange(len(ids)), np.diff(np.r_[begins, len(words)]))
        self.offset = np.arange(len(words)) - begins[self.owner] if len(ids) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(_run_lengths(self.words) >= min_words)
        # equal passages of several items are searched once
        mixed = np.zeros(len(self.starts), np.uint64)
        for j in range(min_words):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + self.words[self.starts + j].view(np.uint64)
        _, first, self.gram_of = np.unique(mixed, return_index=True, return_inverse=True)
        self.grams = self.words[self.starts[first][:, None] + np.arange(min_words)]
        self.order = np.argsort(self.gram_of, kind="stable")
        self.first = np.searchsorted(self.gram_of[self.order], np.arange(len(self.grams) + 1))


class Shard:
    """The suffix array of some documents' words; suffixes that end within ``min_words`` words are left out."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int):
        self.ids, self.min_words = ids, min_words
        words, ranks, self.begins = hashed(texts)
        self.words = np.r_[words, np.zeros(min_words + 1, np.int64)]
        order = suffix_array(ranks, min_words)
        self.suffixes = order[_run_lengths(words)[order] >= min_words]

    def _bounds(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of all ``grams`` at once: the range of suffixes that begin with each."""
        width = grams.shape[1]

        def search(right: bool) -> np.ndarray:
            lo, hi = np.zeros(len(grams), np.int64), np.full(len(grams), len(self.suffixes), np.int64)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                at = self.suffixes[mid]
                less = np.full(len(open_), right)  # of equal ones
                tied = np.arange(len(open_))
                for j in range(width):
                    a, b = self.words[at[tied] + j], grams[open_[tied], j]
                    differ = a != b
                    less[tied[differ]] = (a < b)[differ]
                    tied = tied[~differ]
                    if not tied.size:
                        break
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            return lo

        return search(False), search(True)

    def hits(self, probe: Probe) -> pd.DataFrame:
        """Longest verbatim match of every item in every document of the shard."""
        if not len(self.suffixes) or not len(probe.grams):
            return _NONE
        lo, hi = self._bounds(probe.grams)
        found = np.flatnonzero(hi > lo)
        if not found.size:
            return _NONE
        counts = hi[found] - lo[found]
        gram = np.repeat(found, counts)
        at = self.suffixes[np.repeat(lo[found] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
        doc = np.searchsorted(self.begins, at, side="right") - 1
        # a passage that goes on backwards in document and item is reported by its earlier suffix
        uses = probe.first[gram + 1] - probe.first[gram]
        which = np.repeat(np.arange(len(gram)), uses)
        item_at = probe.starts[probe.order[np.repeat(probe.first[gram] - np.r_[0, np.cumsum(uses)[:-1]], uses) + np.arange(uses.sum())]]
        d_at, d = at[which], doc[which]
        head = (item_at == 0) | (d_at == 0) | (probe.words[item_at - 1] == 0) | (self.words[d_at - 1] != probe.words[item_at - 1])
        item_at, d_at, d = item_at[head], d_at[head], d[head]
        length = np.full(len(d), self.min_words, np.int64)
        going = np.arange(len(d))
        while going.size:
            a = self.words[np.minimum(d_at[going] + length[going], len(self.words) - 1)]
            b = probe.words[np.minimum(item_at[going] + length[going], len(probe.words) - 1)]
            going = going[(a == b) & (a != 0)]
            length[going] += 1
        out = pd.DataFrame({"doc_id": np.asarray(self.ids, dtype=object)[d], "item_id": np.asarray(probe.ids, dtype=object)[probe.owner[item_at]], "n_words": length, "doc_word": d_at - self.begins[d], "item_word": probe.offset[item_at]})
        return out.sort_values(["n_words", "doc_word", "item_word"], ascending=[False, True, True]).drop_duplicates(["doc_id", "item_id"])


_SCHEMA = "doc_id bigint, item_id bigint, n_words bigint, doc_word bigint, item_word bigint"
_NONE = pd.DataFrame({"doc_id": [], "item_id": [], "n_words": [], "doc_word": [], "item_word": []}, dtype="int64")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The held-out items in blocks of bounded size, fetched one partition at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Every document that holds ``min_words`` or more consecutive words of an item.

    Columns: doc_id, item_id, n_words (the longest verbatim match), doc_word and
    item_word (where it begins, in words).  One row per document and item.

    The documents stay where they are: each task builds suffix arrays over shards
    of its own documents, once each, and searches all suffixes of the held-out items
    in them by binary search, block after block.  The held-out items are the stated
    query set: they go to the workers in blocks of ``BLOCK_CHARS`` characters, of
    which a worker holds one at a time.  Only hits are shuffled.

    A text without ``min_words`` words, null texts and null items give nothing; so
    do empty tables.  An item or document that comes twice counts once per id, with
    its longest match.  Texts are taken whole.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    sent = [spark.sparkContext.broadcast(block) for block in _blocks(items)]  # each at most BLOCK_CHARS and one text
    if not sent:
        return spark.createDataFrame([], _SCHEMA)

    def probe_of(block) -> Probe:
        rows = block.value
        block.__dict__.pop("_value", None)  # so that a worker doesn't keep all blocks
        return Probe([r[0] for r in rows], [r[1] for r in rows], min_words)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = None
        for ids, texts in _shards(batches, shard_chars):
            shard = Shard(ids, texts, min_words)
            for block in sent:
                probe = only or probe_of(block)
                if len(sent) == 1:
                    only = probe
                yield shard.hits(probe)

    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    found = docs.mapInPandas(search, _SCHEMA).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "m.n_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def _shards(batches: Iterator[pd.DataFrame], shard_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= shard_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that leak no item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
