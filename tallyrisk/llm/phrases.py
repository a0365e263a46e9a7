"""Phrases that stand together more often than their parts, counted over a prefix-free parse.

A text is a sequence of words and breaks. Its parse cuts it where the hash of a window of OVERLAP words meets a fixed remainder:
content alone decides, so passages that repeat give the same chunks wherever they stand. A chunk
reaches over the window at its end, which is also the beginning of the next one, and a text's end counts as OVERLAP breaks.
Equal chunks are counted once, with their frequency in the parse (the dictionary), and phrases are counted inside
the distinct chunks, weighted by it. A phrase of up to OVERLAP + 1 words belongs to the chunk in which it starts before
the window at the end, so those in an overlap count once.

A phrase is as frequent as its parts at most. Hashes of words and pairs of words are counted first, and those that are
frequent mark a bit table of fixed size, which may say yes wrongly but never no. Then phrases of all lengths are counted whose words,
or pairs of words, are all marked. Inside a task phrases are told apart by two hashes of 64 bits, between tasks by their text.

Defined cases: a null text has no words, a null language is ``und``; pieces end at . , ; : ! ? and line ends, words at
blanks and tabs, A to Z become a to z; a chunk without a cut ends after LONGEST words (any cuts give the same
counts); repeated rows count each; languages without frequent phrases have no rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallyrisk.llm.common import PerWorker, release, write_out
from tallyrisk.llm.suffix_dedup import RangeHash

MAX_WORDS = 4
# Words that a chunk shares with the next one: all but one of the longest phrase.
OVERLAP = MAX_WORDS - 1
# Mean number of words between cuts, and the longest chunk without one.
SPACING = 24
LONGEST = 4096
# Distinct chunks that a task adds up before they are shuffled, and bytes of chunks that it counts at a time.
HELD_CHUNKS = 100_000
BLOCK_BYTES = 1 << 20
# Bits of the table of frequent words and pairs: 8 MB, whatever their number.
TABLE_BITS = 26
TOP_SHARES = 64

_BREAK = "."
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD_BYTES = bytes(
    ord(_BREAK) if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text, and a break between pieces. After the table no byte but the blank parts words."""
    return (text or "").encode("utf-8").translate(_WORD_BYTES).replace(b".", b" . ").split()


class _Hashes(dict):
    """64-bit hashes of words, kept when first asked for."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word) >> 2
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _PRIMES[1]
    return x ^ x >> np.uint64(32)


def chunks_of(words: list[bytes], hashes: _Hashes, spacing: int = SPACING) -> list[tuple[bytes, int]]:
    """The parse of one text: chunks (words parted by blanks) and the words, breaks left out, that start in each."""
    if not words:
        return []
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    n = max(0, len(h) - OVERLAP + 1)
    window = np.zeros(n, dtype=np.uint64)
    for k in range(OVERLAP):
        window += h[k : k + n] * _PRIMES[k]
    cuts = np.flatnonzero(_mixed(window) % np.uint64(spacing) == 0).tolist()
    full, out, start = [*words, *[_BREAK.encode()] * OVERLAP], [], 0
    for cut in [*cuts, len(words)]:
        while cut > start:
            end = min(cut, start + LONGEST)
            own = full[start:end]
            out.append((b" ".join(full[start : end + OVERLAP]), len(own) - own.count(b".")))
            start = end
    return out


def parse(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The dictionary: lang, chunk, words (that start in it) and copies."""

    def run(batches):
        hashes, held = _Hashes(), Counter()

        def out() -> pa.RecordBatch:
            langs, chunks, words = zip(*held)
            columns = [pa.array(langs, pa.string()), pa.array([c.decode("utf-8") for c in chunks], pa.string()), pa.array(words, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(held.values(), pa.int64())], names=["lang", "chunk", "words", "copies"])

        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for chunk, words in chunks_of(words_of(value), hashes):
                    held[own, chunk, words] += 1
            if len(held) >= HELD_CHUNKS:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parts = rows.mapInArrow(run, "lang string, chunk string, words long, copies long")
    return write_out(parts.groupBy("lang", "chunk", "words").agg(F.sum("copies").alias("copies")), "phrase-dictionary")


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = _mixed(out * _PRIMES[0] + hashes[j : j + n])
    return out


class Tokens:
    """The words of some chunks in one array of bytes, with a hash of each word and its language, made without a loop."""

    def __init__(self, langs: pa.StringArray, chunks: pa.StringArray, copies: np.ndarray, hashes: list[RangeHash]):
        _, ends, data = chunks.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        begins = np.zeros(len(self.data) + 1, dtype=bool)
        begins[np.flatnonzero(self.data == 32) + 1] = True
        begins[ends[:-1]] = True
        self.starts = np.flatnonzero(begins[:-1])
        places = np.searchsorted(self.starts, ends)  # the first word of each chunk
        self.langs = langs
        self.owner = np.repeat(np.arange(len(langs)), np.diff(places))
        self.copies = copies[self.owner]
        self.ends = np.append(self.starts[1:] - 1, len(self.data))
        self.ends[places[1:] - 1] = ends[1:]
        self.size = len(self.starts) - OVERLAP  # the last words of a chunk are owned by the next
        self.owned = np.arange(self.size) < places[1:][self.owner[: self.size]] - OVERLAP
        self.word = (self.ends - self.starts != 1) | (self.data[self.starts] != ord(_BREAK))
        coded = langs.dictionary_encode()
        of_lang = np.array([xxhash.xxh3_64_intdigest(lang) for lang in coded.dictionary.to_pylist()], dtype=np.uint64)
        spoken = of_lang[coded.indices.to_numpy()][self.owner]
        self.lanes = [h.of(h.sums(self.data), self.starts, self.ends) ^ spoken for h in hashes]

    def owned_phrases(self, k: int) -> np.ndarray:
        """Which of the owned words begin a phrase of k words."""
        usable = self.owned.copy()
        for j in range(k):
            usable &= self.word[j : j + self.size]
        return usable

    def phrases(self, starts: np.ndarray, k: int) -> pa.StringArray:
        """The texts of the phrases of k words: words of a chunk are parted by one blank, so each is one range of bytes."""
        begins = self.starts[starts]
        lengths = self.ends[starts + k - 1] - begins
        ends = np.concatenate(([0], np.cumsum(lengths)))
        data = self.data[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], lengths)]
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))

    def langs_of(self, starts: np.ndarray) -> pa.StringArray:
        return self.langs.take(pa.array(self.owner[starts]))


def _token_blocks(batches) -> Iterator[Tokens]:
    """Batches of (lang, chunk, copies) in blocks of about BLOCK_BYTES."""
    hashes, held, size = [RangeHash(3), RangeHash(4)], [], 0

    def joined() -> Tokens:
        langs, chunks, copies = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        return Tokens(langs.cast(pa.string()), chunks.cast(pa.string()), copies.to_numpy(), hashes)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where each distinct key begins in it, sum of its weights)."""
    order = np.argsort(keys)
    heads = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order, heads, np.add.reduceat(weights[order], heads) if len(heads) else heads


def frequent_table(dictionary: DataFrame, least: int) -> np.ndarray:
    """Bits of the slots of words and pairs of words that may occur ``least`` times: hashes are counted, so a slot can
    be marked wrongly, but that of a frequent word or pair always is. At most 2^TABLE_BITS / 64 rows reach the driver."""

    def run(batches):
        for tokens in _token_blocks(batches):
            keys, weights = [], []
            for k in (1, 2):
                starts = np.flatnonzero(tokens.owned_phrases(k))
                keys.append(_rolled(tokens.lanes[0], k)[starts])
                weights.append(tokens.copies[starts])
            keys = np.concatenate(keys)
            order, heads, totals = _summed(keys, np.concatenate(weights))
            yield pa.RecordBatch.from_arrays([pa.array(keys[order[heads]].view(np.int64)), pa.array(totals)], names=["hash", "a"])

    counts = dictionary.select("lang", "chunk", "copies").mapInArrow(run, "hash long, a long")
    frequent = counts.groupBy("hash").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    slot = F.col("hash").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    cells = frequent.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def count_block(tokens: Tokens, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """lang, phrase and count of the phrases owned by some chunks whose words, or pairs of words, are all marked."""
    single, pair = (_marked(table, _rolled(tokens.lanes[0], k)) for k in (1, 2))
    for k in range(1, MAX_WORDS + 1):
        usable = tokens.owned_phrases(k)
        if k == 1:
            usable &= single[: tokens.size]
        for j in range(k - 1):
            usable &= pair[j : j + tokens.size]
        starts = np.flatnonzero(usable)
        first, second = (_rolled(lane, k)[starts] for lane in tokens.lanes)
        # Two hashes of 64 bits tell phrases apart; where they disagree on it, each occurrence goes out by itself.
        order, heads, totals = _summed(first, tokens.copies[starts])
        lead = np.repeat(heads, np.diff(np.append(heads, len(order))))
        if not np.array_equal(second[order], second[order[lead]]):
            order, heads, totals = np.arange(len(starts)), np.arange(len(starts)), tokens.copies[starts]
        starts = starts[order[heads]]
        yield pa.RecordBatch.from_arrays([tokens.langs_of(starts), tokens.phrases(starts, k), pa.array(totals)], names=["lang", "phrase", "a"])


def count_phrases(dictionary: DataFrame, table: np.ndarray, least: int) -> DataFrame:
    """lang, phrase, size (words) and a: the phrases of up to MAX_WORDS words that occur ``least`` times or more."""
    shared = PerWorker(dictionary.sparkSession, table, lambda t: t)

    def run(batches):
        for tokens in _token_blocks(batches):
            yield from count_block(tokens, shared.get())

    counts = dictionary.select("lang", "chunk", "copies").mapInArrow(run, "lang string, phrase string, a long")
    frequent = counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return write_out(frequent.withColumn("size", F.size(F.split("phrase", " ", -1))), "phrase-counts")


def _wide(column) -> F.Column:
    return F.col(column).cast("decimal(38,0)")


def scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of each candidate's cut with the lowest score, of equal ones the first."""
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("tail"),
    )
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("cast(cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r) as long)")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase and longest_a: for each phrase inside longer candidates, the most frequent of these."""
    words = F.split("phrase", " ", -1)
    n = F.size("words")
    inner = lambda w: F.flatten(
        F.transform(
            F.sequence(F.lit(2), n - 1),
            lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(w, at, size), " ")),
        )
    )
    longer = candidates.withColumn("words", words).where(n > 2)
    return longer.select("lang", "a", F.explode(inner(F.col("words"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))


def collocations(docs: DataFrame, least: int, covered_percent: int, top: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each language the ``top`` phrases of 2 to MAX_WORDS words that occur
    ``least`` times or more and are not covered by a longer one that has covered_percent of their occurrences."""
    dictionary = parse(docs, lang, text)
    release(docs.sparkSession)
    sizes = dictionary.groupBy("lang").agg(F.sum(F.col("words") * F.col("copies")).alias("n"))
    counts = count_phrases(dictionary, frequent_table(dictionary, least), least)
    release(docs.sparkSession)
    candidates = counts.where("size > 1").drop("size")
    parts = counts.where(F.col("size") < MAX_WORDS).drop("size")
    covered = (F.col("longest_a").isNotNull()) & (_wide("longest_a") * 100 >= _wide("a") * covered_percent)
    open_ones = candidates.join(contained(candidates), ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a")
    best = scored(open_ones, parts)
    # The best of each share of a language first, so that the last task of a language has TOP_SHARES times ``top`` rows at most.
    for shares in (TOP_SHARES, 1):
        keys = ["lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))]
        line = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
