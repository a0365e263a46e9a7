"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per UTF-8 byte, the last one marked as word end. The adjacent pair of
lowest rank is popped from a heap again and again and merged in a doubly linked list; the count is the
initial symbols minus the merges, and no identifier is ever written down. Text is prepared as the
tokenizer file says: added tokens are cut out first (one token each), the rest is NFC-normalised,
lower-cased and split into words, white space dropped.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; further
columns of the input are ignored; an empty table gives an empty table. A very long word costs
n log n, not n squared.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tallyrisk.llm.common import PerWorker, field_type, map_arrow

# Words kept with their count, per Python worker: when the newer half is full, it replaces the older half.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(printable))
    return [shown[b] for b in range(256)]


def merge_count(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Number of merges for the symbols. ``ranks``: a pair, as left << 32 | right, to its rank;
    ``merged``: a rank to the symbol that the merge makes."""
    n = len(symbols)
    rank_of = ranks.get
    heap = []  # rank << 32 | place of the left symbol
    for i in range(n - 1):
        rank = rank_of(symbols[i] << 32 | symbols[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return 0
    heapify(heap)
    symbols = symbols + [-1]
    before = list(range(-1, n))
    after = list(range(1, n + 2))
    merges = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        left = symbols[i]
        j = after[i]
        if left < 0 or j >= n or rank_of(left << 32 | symbols[j]) != entry >> 32:
            continue  # one of the two was merged meanwhile
        symbol = symbols[i] = merged[entry >> 32]
        symbols[j] = -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(symbol << 32 | symbols[k])
            if rank is not None:
                heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << 32 | symbol)
            if rank is not None:
                heappush(heap, rank << 32 | h)
    return merges


class WordTokenizer:
    """What a word-end BPE tokenizer file says, reduced to what counting needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"]:
            raise ValueError(f"{path}: only NFC, white space, lower case and kept matches are supported")
        end = model["end_of_word_suffix"]
        self.first = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + end] for c in byte_symbols()]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [vocab[a + b] for a, b in model["merges"]]
        # \s of the file is Unicode white space, and not the four separators 1C to 1F.
        self.words = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.added = [x["content"] for x in spec["added_tokens"]]


class WordCounter:
    """Counts the tokens of texts; one per Python worker."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer
        self.words = regex.compile(tokenizer.words)
        self.added = regex.compile("|".join(map(regex.escape, sorted(tokenizer.added, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        data = word.encode("utf-8")
        symbols = [self.tokenizer.first[b] for b in data[:-1]] + [self.tokenizer.last[data[-1]]]
        return len(symbols) - merge_count(symbols, self.tokenizer.ranks, self.tokenizer.merged)

    def of_text(self, text: str) -> int:
        parts = self.added.split(text)
        total = len(parts) - 1
        if len(self.cache) >= CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
        cache = self.cache
        for part in parts:
            low = unicodedata.normalize("NFC", part)
            # A capital sigma at a word's end is lower-cased like any other.
            low = low.lower() if "Σ" not in low else "".join(c.lower() for c in low)
            for word, n in Counter(self.words.findall(low)).items():
                count = cache.get(word)
                if count is None:
                    count = self.older.get(word) or self.of_word(word)
                    if len(word) <= 64:
                        cache[word] = count
                total += n * count
        return total


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each whole text, by the tokenizer file at ``path``. The merges
    (one file, read by the driver) are broadcast; rows are not shuffled."""
    counter = PerWorker(docs.sparkSession, WordTokenizer(path), WordCounter)

    def run(batch):
        count = counter.get().of_text
        texts = [x or "" for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [len(x.encode("utf-8")) for x in texts], "n_tokens": [count(x) for x in texts]}

    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, doc_id)),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])
    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, schema)


def flag_long(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
