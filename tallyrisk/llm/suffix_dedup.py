"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler order.

Every byte is removed that lies in a string of W bytes which also starts earlier: in a document with a smaller id,
or in the same document further left. Strings never cross documents; overlaps count; all is judged on
the input.

A suffix array over the whole corpus does not fit a cluster of tasks, so the strings are dealt out by content: each
string of W bytes has one anchor, the K bytes of smallest hash in it, and equal strings have equal
anchors at the same offset. What decides on the strings around an anchor is its context, W - K bytes to
the left and W - K to the right of it. So

1. each text gives its anchors with the hash of the context (narrow rows), equal ones collapsed in the task;
2. equal contexts are collapsed to the earliest: all strings of the others are repeated;
3. anchors that still have several contexts get the bytes of these, gathered into chunks;
4. in a chunk, the suffixes are sorted and intervals are expanded breadth first: the classes of suffixes
   equal in l + 1 bytes follow from those equal in l bytes by one step of backward extension, so
   boundaries (common prefixes) appear by increasing length, and the expansion stops at W;
5. anchors with very many contexts are spread over chunks; these hand on one representative for
   each class, and a second grouping finds the earliest of all chunks.

The anchors are computed twice, which costs less than keeping them. Defined cases: a null text is empty; texts
shorter than W bytes lose nothing; rows that repeat both id and text are one document and are treated alike;
among rows with one id and different texts the smaller digest counts as earlier; a null id comes after all
others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyrisk.llm.common import field_type, map_arrow, release, spread_lookup, write_out
from tallyrisk.operators.running import ranked

K = 32
# Contexts of one anchor in one chunk, and bytes of a chunk.
GROUP = 2048
CHUNK_BYTES = 1 << 14
ROWS_PER_TASK = 100_000
# Anchors that a task collapses at a time before they are shuffled.
COLLAPSE = 250_000
# Bytes that are anchored at a time, which bounds memory for very long texts.
STRETCH = 1 << 22

_FULL = (1 << 64) - 1


def _mixed(x: int) -> int:
    """A fixed scrambling of 64 bits; makes the tables below from a counter."""
    x = (x + 0x9E3779B97F4A7C15) & _FULL
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _FULL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _FULL
    return x ^ x >> 31


class RangeHash:
    """Hash of any range of a byte string, from running sums modulo 2^64."""

    def __init__(self, seed: int):
        self.values = np.array([_mixed(seed << 32 | b) for b in range(256)], dtype=np.uint64)
        self.base = _mixed(seed << 32 | 999) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.backs = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            m = len(self.powers)
            self.powers = np.concatenate((self.powers, self.powers * np.uint64(pow(self.base, m, 1 << 64))))
            self.backs = np.concatenate((self.backs, self.backs * np.uint64(pow(self.inverse, m, 1 << 64))))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.backs[: len(sums)][start]
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


class Anchors:
    """The anchors of a text and the hashes of their contexts."""

    def __init__(self, width: int):
        self.width = width
        self.own, self.context = RangeHash(1), RangeHash(2)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, context hash, place) of each anchor; none if the text is shorter than a string."""
        found = []
        # Anchors are placed up to the last K bytes, beyond the last start of a string.
        for at in range(0, max(1, len(data) - K + 1), STRETCH):
            # The stretch has all strings whose anchors are placed in it, and the context to both sides.
            left = max(0, at - (self.width - K))
            hashes, contexts, places = self._stretch(data[left : at + STRETCH + 2 * self.width])
            places = places + left
            new = (places >= at) & (places < at + STRETCH) | (at == 0) & (places < at + STRETCH)
            found.append((hashes[new], contexts[new], places[new]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _stretch(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, span = len(data), self.width - K + 1
        if n < self.width:
            nothing = np.zeros(0, dtype=np.int64)
            return nothing.astype(np.uint64), nothing.astype(np.uint64), nothing
        sums = self.own.sums(data)
        grams = self.own.of(sums, slice(0, n - K + 1), slice(K, n + 1))
        # Hash above, place below: the least is the leftmost of the smallest hash.
        ranked = grams & ~np.uint64((1 << 24) - 1) | np.arange(len(grams), dtype=np.uint64)
        least, reach = ranked, 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: reach - span], least[span - reach :])
        places = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        places = places[np.concatenate(([True], places[1:] != places[:-1]))]
        start = np.maximum(0, places - (self.width - K))
        end = np.minimum(n, places + self.width)
        contexts = self.context.of(self.context.sums(data), start, end)
        shape = (places - start).astype(np.uint64) << np.uint64(32) | (end - start).astype(np.uint64)
        return grams[places], contexts ^ shape * np.uint64(0x9E3779B97F4A7C15), places


def _ranks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each place, equal ones alike) of keys that leave ``bits`` bits for the place."""
    if int(keys.max(initial=0)) >> (62 - bits) == 0:
        packed = np.sort(keys << bits | np.arange(len(keys)))
        order, keys = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    return order, rank


def suffix_order(symbols: np.ndarray, width: int) -> np.ndarray:
    """The suffixes ordered by their first ``width`` symbols at least, by prefix doubling from four packed symbols of 9 bits."""
    n = len(symbols)
    bits = n.bit_length()
    keys = symbols.astype(np.int64) + 1
    for reach in (1, 2):
        further = np.zeros(n, dtype=np.int64)
        further[:-reach] = keys[reach:]
        keys = keys << (10 * reach) | further
    order, rank = _ranks(keys, bits)
    reach = 4
    while reach < width and rank[order[-1]] < n - 1:
        keys = rank << bits
        keys[:-reach] += rank[reach:] + 1
        order, rank = _ranks(keys, bits)
        reach *= 2
    return order


def equal_classes(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of each entry): suffixes in one class are equal in their first ``width`` symbols.

    Backward extension: the entry q, preceded by its first symbol, comes from the entry of the suffix one
    further right. Two neighbours part at length l + 1 if their first symbols differ or the entries they
    come from are in different classes of length l. A boundary once found stays, so each length looks only at
    neighbours that have not long parted; the loop ends at the width, or before if some lengths part none."""
    order = suffix_order(symbols, width)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    first = symbols[order]
    bounds = np.concatenate(([True], first[1:] != first[:-1]))
    source = place[np.minimum(order + 1, len(symbols) - 1)]  # a text's end is no part of a whole string
    open_ = np.flatnonzero(~bounds)
    left, right = source[open_ - 1], source[open_]
    found = int(bounds.sum())
    for length in range(1, width):
        classes = np.cumsum(bounds, dtype=np.int32)
        parted = classes.take(left) != classes.take(right)
        bounds[open_[parted]] = True
        if length % 8 == 1:  # those that parted are left out from time to time; looking at them again does no harm
            now = int(bounds.sum())
            if now == found:
                break
            found, together = now, ~parted
            open_, left, right = open_[together], left[together], right[together]
    return order, np.cumsum(bounds) - 1


def repeats_in_chunk(contexts: list[bytes], ids: np.ndarray, places: np.ndarray, shared: np.ndarray, width: int):
    """Windows of the contexts that start earlier in the same chunk, as runs (id, start, end), and for contexts of
    spread groups (``shared``) one (digest, id, place) for each class. ids: order numbers of documents;
    places: where each context begins in its document."""
    lengths = np.array([len(c) for c in contexts])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8).astype(np.int16)
    symbols[starts[1:] - 1] = 256
    order, classes = equal_classes(symbols, width)
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), lengths + 1)[order]
    offset = order - starts[owner]
    whole = offset + width <= lengths[owner]
    if not shared.any():
        # A string that stands alone in its class is neither repeated nor handed on.
        whole &= np.bincount(classes[whole], minlength=len(order))[classes] > 1
    owner, offset, classes = owner[whole], offset[whole], classes[whole]
    known, doc = np.unique(ids, return_inverse=True)
    doc, place = doc[owner], places[owner] + offset
    # Class, document and place in one number where they fit.
    doc_bits, place_bits = len(known).bit_length(), int(place.max(initial=0)).bit_length()
    if len(order).bit_length() + doc_bits + place_bits <= 63:
        by = np.argsort((classes << doc_bits | doc) << place_bits | place)
    else:
        by = np.lexsort((place, doc, classes))
    owner, offset, classes, doc, place = owner[by], offset[by], classes[by], doc[by], place[by]
    head = np.concatenate(([True], classes[1:] != classes[:-1])) if len(classes) else np.zeros(0, bool)
    head_of = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.zeros(0, int)
    later = (doc != doc[head_of]) | (place != place[head_of])
    d, p = doc[later], place[later]
    if doc_bits + place_bits <= 63:
        packed = np.sort(d << place_bits | p)
        d, p = packed >> place_bits, packed & ((1 << place_bits) - 1)
    else:
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
    if len(d):
        cut = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)))
        run_start = np.flatnonzero(cut)
        run_last = np.concatenate((run_start[1:], [len(d)])) - 1
        runs = (known[d[run_start]], p[run_start], p[run_last] + width)
    else:
        runs = (d, p, p)
    handed = []
    if shared.any():
        spread = np.zeros(len(head), bool)
        np.logical_or.at(spread, head_of, shared[owner])
        for i in np.flatnonzero(head & spread):
            text = contexts[owner[i]][offset[i] : offset[i] + width]
            handed.append((hashlib.blake2b(text, digest_size=16).digest(), int(known[doc[i]]), int(place[i])))
    return runs, handed


_ANCHOR = ("doc", "anchor", "context", "place", "copies")


def _collapse(parts: list[tuple]) -> list[np.ndarray]:
    """The earliest of equal contexts, with their number."""
    doc, anchor, context, place = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((place, doc, context, anchor))
    doc, anchor, context, place = doc[by], anchor[by], context[by], place[by]
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))))
    return [doc[head], anchor[head], context[head], place[head], np.diff(np.concatenate((head, [len(doc)])))]


def _anchor_rows(texts: DataFrame, width: int, collapse: bool) -> DataFrame:
    own = Anchors(width)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (_ANCHOR if collapse else _ANCHOR[:4])])
    names = schema.names

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, contexts, places = own.of(np.frombuffer(text.encode("utf-8"), dtype=np.uint8))
                if len(places):
                    parts.append((np.full(len(places), doc, dtype=np.int64), hashes.view(np.int64), contexts.view(np.int64), places))
                    held += len(places)
            if parts and not collapse:
                yield out([np.concatenate(x) for x in zip(*parts)])
                parts = []
            elif held >= COLLAPSE:
                yield out(_collapse(parts))
                parts, held = [], 0
        if parts:
            yield out(_collapse(parts))

    return texts.mapInArrow(run, schema)


def _chunk_rows(contexts: DataFrame, width: int) -> DataFrame:
    """Process sorted contexts chunk by chunk; groups are kept whole."""
    schema = T.StructType([
        T.StructField("doc", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("digest", T.BinaryType()),
    ])
    fields = to_arrow_schema(schema)

    def out(chunk: list[tuple]) -> pa.RecordBatch:
        _, docs, places, spread, data = zip(*chunk)
        runs, handed = repeats_in_chunk(list(data), np.array(docs), np.array(places), np.array(spread), width)
        digests, d, p = zip(*handed) if handed else ((), (), ())
        columns = [
            np.concatenate((runs[0], np.array(d, dtype=np.int64))),
            np.concatenate((runs[1], np.array(p, dtype=np.int64))),
            np.concatenate((runs[2], np.array(p, dtype=np.int64) + width)),
        ]
        arrays = [pa.array(c.astype(np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([None] * len(runs[0]) + list(digests), pa.binary())], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK_BYTES and row[0] != last:
                    yield out(chunk)
                    chunk, size = [], 0
                chunk.append(row)
                size += len(row[4])
                last = row[0]
        if chunk:
            yield out(chunk)

    return contexts.mapInArrow(run, schema)


def repeated_spans(texts: DataFrame, width: int) -> DataFrame:
    """(doc, start, end) byte ranges of texts (columns doc, the place in the order of documents, and text) that are
    covered by earlier strings; ranges may overlap."""
    spark = texts.sparkSession
    # One shuffle, by anchor: it serves the contexts and the counts over them.
    dealt = _anchor_rows(texts, width, collapse=True).repartition("anchor")
    first = dealt.groupBy("anchor", "context").agg(F.min(F.struct("doc", "place")).alias("first"), F.sum("copies").alias("copies"))
    same = Window.partitionBy("anchor")
    counted = first.withColumns({"kinds": F.count(F.lit(1)).over(same), "all": F.sum("copies").over(same)})
    marked = write_out(counted.where("all > 1").drop("all"), "suffix-contexts")
    release(spark)

    # All but the earliest of equal contexts are repeated over their whole length.
    many = marked.where("copies > 1").select("anchor", "context", "first", "copies")
    rows = _anchor_rows(texts, width, collapse=False)
    later = spread_lookup(rows, many, ["anchor", "context"], "copies", F.xxhash64("doc", "place"), ROWS_PER_TASK)
    later = later.where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place"))).select(
        "doc", (F.col("place") - (width - K)).alias("start"), (F.col("place") + width).alias("end")
    )
    later = write_out(later, "suffix-later")
    release(spark)

    # The earliest of each context, where an anchor has several.
    open_ones = marked.where("kinds > 1").select(
        "anchor",
        F.pmod(F.col("context"), F.ceil(F.col("kinds") / GROUP)).alias("part"),
        (F.col("kinds") > GROUP).alias("spread"),
        F.col("first.doc").alias("doc"),
        F.col("first.place").alias("place"),
    )
    wanted = open_ones.groupBy("doc").agg(F.collect_list(F.struct("place", "anchor", "part", "spread")).alias("wanted"))
    contexts = _context_rows(wanted.join(texts, "doc"), width)
    contexts = contexts.repartition("group").sortWithinPartitions("group")
    found = write_out(_chunk_rows(contexts, width), "suffix-chunks")
    release(spark)
    inside = found.where("digest is null").select("doc", "start", "end")
    handed = found.where("digest is not null")
    heads = handed.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"))
    across = handed.join(heads, "digest").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return later.unionByName(inside).unionByName(across.select("doc", "start", "end"))


def _context_rows(docs: DataFrame, width: int) -> DataFrame:
    schema = T.StructType([
        T.StructField("group", T.LongType()),
        T.StructField("doc", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("spread", T.BooleanType()),
        T.StructField("bytes", T.BinaryType()),
    ])

    def run(batch):
        out = []
        for doc, wanted, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = text.encode("utf-8")
            for w in wanted:
                start = max(0, w["place"] - (width - K))
                out.append((w["group"], doc, start, w["spread"], data[start : w["place"] + width]))
        return dict(zip(("group", "doc", "place", "spread", "bytes"), zip(*out) if out else [[]] * 5))

    keyed = F.transform("wanted", lambda w: F.struct(w.place.alias("place"), F.xxhash64(w.anchor, w.part).alias("group"), w.spread.alias("spread")))
    return map_arrow(docs.select("doc", keyed.alias("wanted"), "text"), run, schema)


def cut_documents(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, the text without the repeated bytes (a character cut in two is dropped) and, if
    there is such a column, its n_chars. Rows that lose all of their text go."""
    cut = remove_repeats(docs, width, doc_id, text, carry=True).where("n_removed < n_bytes or n_bytes = 0")
    kept = F.col("kept_text")
    columns = {text: F.when(F.col(f"row.{text}_null"), F.lit(None)).otherwise(kept)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(kept).cast(field_type(docs, "n_chars"))
    return cut.select(*[(columns[c] if c in columns else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def remove_repeats(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for each row;
    ``carry`` adds kept_text and the row's other columns as a struct.

    The texts go through two shuffles: one to cut contexts, one to cut the removed ranges out."""
    if not isinstance(field_type(docs, doc_id), (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError("ids are whole numbers: their order says which text is earlier")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] + [F.col(text).isNull().alias(f"{text}_null")]
    row = F.struct(*others)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([row.alias("row")] if carry else []))
    own = own.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    digest = F.sha2("text", 256)
    clash = own.groupBy("doc").agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.count(F.lit(1)).alias("n"))
    texts_differ, rows_repeat = clash.agg(F.max(F.expr("a <> b")), F.max(F.expr("n > 1"))).first()
    if texts_differ:
        # Ids with several texts: order numbers take the place of ids.
        order = ranked(own.select(F.col("doc").alias("id"), digest.alias("digest")).distinct(), ["id", "digest"])
        numbered = own.join(order, (F.col("doc") == F.col("id")) & (digest == F.col("digest")))
        own = write_out(numbered.withColumn("doc", F.col("position")).select(own.columns), "suffix-numbered")
    texts = own.select("doc", "text")
    if rows_repeat:
        # Rows that repeat an id and a text are one text: its ranges are found once and handed to each of them.
        texts = write_out(texts.dropDuplicates(["doc"]), "suffix-texts")
    spans = repeated_spans(texts, width)
    ranges = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    none = F.array().cast("array<long>")
    if rows_repeat:
        ranges = own.groupBy("doc").agg(F.count(F.lit(1)).alias("__rows")).join(ranges, "doc", "left")
        joined = spread_lookup(own, ranges, "doc", "__rows", F.monotonically_increasing_id(), ROWS_PER_TASK)
    else:
        joined = own.join(ranges, "doc", "left")
    flat = joined.select(
        "doc_id",
        "text",
        F.coalesce(F.col("ranges.start"), none).alias("starts"),
        F.coalesce(F.col("ranges.end"), none).alias("ends"),
        *(["row"] if carry else []),
    )
    return _cut(flat, field_type(docs, doc_id))


def cut_ranges(data: bytes, starts: list[int], ends: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs, and what remains."""
    mark = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(mark, np.clip(starts, 0, len(data)), 1)
    np.add.at(mark, np.clip(ends, 0, len(data)), -1)
    gone = np.cumsum(mark[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


def _cut(docs: DataFrame, id_type: T.DataType) -> DataFrame:
    schema = T.StructType([
        T.StructField("doc_id", id_type),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ])
    carry = "row" in docs.columns
    if carry:
        schema = schema.add("kept_text", T.StringType()).add("row", field_type(docs, "row"))

    def run(batch):
        sizes, cuts = [], []
        for text, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(1, 4))):
            data = text.encode("utf-8")
            sizes.append(len(data))
            cuts.append(cut_ranges(data, starts, ends) if starts else (0, 0, data))
        removed, spans, kept = zip(*cuts) if cuts else ((), (), ())
        out = {"doc_id": batch.column(0), "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept": kept}
        return out | {"kept_text": [k.decode("utf-8", "ignore") for k in kept], "row": batch.column(4)} if carry else out

    return map_arrow(docs, run, schema)
