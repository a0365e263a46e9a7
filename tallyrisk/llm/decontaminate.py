"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are runs of letters a-z, digits and non-ASCII characters after A-Z are lower-cased. An item of n words is
held against each window of n words of a document (the whole document if it is shorter). A window's
fingerprint is the SimHash of its five-word shingles. The 64 bits are cut into 8 blocks: if two fingerprints
differ in at most r bits, one block differs in at most r / 8, so all items within the radius are found by looking
up the blocks. Candidates are verified by the weighted Jaccard similarity of the shingle multisets (the weight
of a shingle is its number of occurrences): sum of the smaller counts over sum of the larger ones.

A window can reach the threshold t only if at least t of an item's shingles are in it, so fingerprints are only made of
windows in which enough shingles belong to some item; this loses nothing.

The benchmark goes to the executors in blocks of bounded size; documents are not shuffled. A benchmark larger than
one block costs one pass over the documents for each.

Defined cases: null texts are empty; items without words match nothing; a text with fewer words than a shingle
matches only an item of the same words; repeated documents and items are reported each; among equally
similar windows the first is reported; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tallyrisk.llm.common import PerWorker, field_type, map_arrow

SHINGLE = 5
SIMILARITY = 0.8
# Bits in which a similar window's fingerprint may differ: at similarity 0.8 about 10 are expected, with a
# standard deviation of 3.
RADIUS = 24
BLOCKS = 8
# UTF-8 bytes of benchmark items that are broadcast at a time.
BLOCK_BYTES = 4_000_000

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(SHINGLE)], dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.encode("utf-8").translate(_CLEAN).split()], dtype=np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n < 1 or width < 1:
        return np.zeros(0, dtype=np.uint64)
    x = reduce(lambda total, j: total + words[j : j + n] * _FACTORS[j], range(width), np.full(n, width, dtype=np.uint64))
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def simhash_of_windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One row of 8 bytes for each window of ``size`` shingles."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1, bitorder="little")


def similarity(a: Counter, b: Counter) -> float:
    keys = a.keys() | b.keys()
    larger = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / larger if larger else 0.0


class Group:
    """Items of the same number of words, with the index of their fingerprints' blocks."""

    def __init__(self, n_words: int, width: int, items: list[tuple[object, np.ndarray]], radius: int):
        self.n_words, self.width, self.radius = n_words, width, radius
        self.ids = [i for i, _ in items]
        self.counts = [Counter(h.tolist()) for _, h in items]
        self.prints = np.concatenate([simhash_of_windows(h, np.array([0]), len(h)) for _, h in items])
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        close = apart <= radius // BLOCKS
        # within[j, value, item]: whether block j of the item is near enough to the value
        self.within = np.stack([close[:, self.prints[:, j]] for j in range(BLOCKS)])

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        found = reduce(np.logical_or, (self.within[j, prints[:, j]] for j in range(BLOCKS)))
        window, item = np.nonzero(found)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        near = distance <= self.radius
        return window[near], item[near]


class Matcher:
    def __init__(self, items: list[tuple[object, str]], threshold: float, radius: int):
        self.threshold = threshold
        by_size: dict[int, list] = {}
        for item_id, text in items:
            words = word_hashes(text or "")
            if len(words):
                by_size.setdefault(len(words), []).append((item_id, shingles(words, min(SHINGLE, len(words)))))
        self.groups = [Group(n, min(SHINGLE, n), found, radius) for n, found in sorted(by_size.items())]
        widths = {g.width for g in self.groups}
        self.known = {w: np.unique(np.array([h for g in self.groups if g.width == w for c in g.counts for h in c], dtype=np.uint64)) for w in widths}

    def matches(self, text: str) -> list[tuple]:
        """(item id, similarity, first word, number of words) of the best window for each item that is in the text."""
        words = word_hashes(text)
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        for width, known in self.known.items():
            hashes = shingles(words, width)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hits = np.concatenate(([0], np.cumsum(known[at] == hashes)))
            if not hits[-1]:
                continue
            for g, group in enumerate(self.groups):
                if group.width != width:
                    continue
                whole = group.n_words - width + 1
                size = min(whole, len(hashes))
                needed = math.ceil(self.threshold * whole - 1e-9)
                starts = np.flatnonzero(hits[size:] - hits[:-size] >= needed)
                if not len(starts):
                    continue
                # Only the part around the windows is needed.
                low, high = starts[0], starts[-1] + size
                windows, items = group.candidates(simhash_of_windows(hashes[low:high], starts - low, size))
                for k, i in zip(windows.tolist(), items.tolist()):
                    start = int(starts[k])
                    value = similarity(group.counts[i], Counter(hashes[start : start + size].tolist()))
                    if value >= self.threshold and value > found.get((g, i), (0.0,))[0]:
                        found[g, i] = (value, start, size + width - 1)
        return [(self.groups[g].ids[i], *best) for (g, i), best in found.items()]


def matchers(benchmark: DataFrame, item_id: str, item_text: str, threshold: float, radius: int, block_bytes: int) -> list[PerWorker]:
    """A matcher for each block of the benchmark."""
    items = benchmark.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, math.ceil(2 * total / block_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    found = []
    for part in range(parts):
        own = [(r["id"], r["text"]) for r in items.where(block == part).collect()]
        found.append(PerWorker(benchmark.sparkSession, own, lambda own: Matcher(own, threshold, radius)))
    return found


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and item in it: doc_id, item_id, similarity, first_word, n_words."""
    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, doc_id)),
        T.StructField("item_id", field_type(benchmark, item_id)),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ])
    chosen = docs.select(F.col(doc_id), F.col(text))
    found = []
    for shared in matchers(benchmark, item_id, item_text, threshold, radius, block_bytes):

        def run(batch, shared=shared):
            matcher = shared.get()
            rows = [(d, *m) for d, t in zip(*(batch.column(k).to_pylist() for k in range(2))) for m in matcher.matches(t or "")]
            return dict(zip(schema.names, zip(*rows) if rows else [[]] * 5))

        found.append(map_arrow(chosen, run, schema))
    return reduce(DataFrame.unionByName, found)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows in whose text no item is found; all columns stay. Each row is judged by its own text, so repeated and
    missing ids do no harm, and nothing is shuffled."""
    at = docs.columns.index(text)
    for shared in matchers(benchmark, item_id, item_text, threshold, radius, block_bytes):

        def run(batches, shared=shared):
            matcher = shared.get()
            for batch in batches:
                clean = [not matcher.matches(x or "") for x in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
