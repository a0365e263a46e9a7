"""Near-duplicate classes by SimHash with pigeonring filtering.

A document's 64-bit fingerprint has a bit set if it is set in over half of its shingles' hashes. Two documents
are linked if their fingerprints differ in at most r bits; classes are the connected components.

Search: the 64 bits form a ring of r + 1 segments. If two fingerprints differ in at most r bits, then from
some segment on every chain of l consecutive segments differs in at most floor(l * r / (r + 1)) = l - 1
bits. So that segment is equal, the next differs in one bit at most, and it and the one after it in two. With
both cut in halves, either the next is equal, or one half of it and one half of the one after it are: five
keys a segment, of about 26 bits for r = 4. Longer chains prune the candidates before the full distance.

Work is done on distinct fingerprints, so exact copies cost one row. Within a key no pairs are enumerated
while they can be told from representatives: first each member is compared with up to four of the key's
members, and the links found are closed to components; only members of keys that still hold several
components are then compared across components, in blocks. Every link between different
components is found, so the classes are exact.

Defined cases: a null text counts as empty; texts without words have fingerprint 0 and link like any other;
a null doc_id is kept, and a class of null ids only has a null component_id; repeated rows stay
rows of the same class, and one id may be in several classes; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyrisk.llm.common import field_type, map_arrow, row_key, spread_lookup, write_out
from tallyrisk.llm.components import components

SEED = 42
# Documents of one fingerprint that a task looks up; more are dealt out.
ROWS_PER_TASK = 100_000
# Members of a key that one task compares with the whole key.
BLOCK = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and key (of id and text) of each whole text; no shuffle."""

    def run(batch):
        ids, texts = (batch.column(k).to_pylist() for k in range(2))
        return {"doc_id": batch.column(0), "fp": [fingerprint(x or "", shingle) for x in texts], "key": list(map(row_key, ids, texts))}

    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, doc_id)),
        T.StructField("fp", T.LongType()),
        T.StructField("key", T.BinaryType()),
    ])
    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, schema)


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the ring's segments."""
    n = radius + 1
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def ring_keys(fp: Column, radius: int) -> Column:
    """Array of (segment number, key): the hash of the segment and two halves of the following ones. Keys that share
    a hash are compared too, which does no harm."""
    ring = segments(radius)
    keys = []
    for i, (start, width) in enumerate(ring):
        halves = []
        for a, w in (ring[(i + 1) % len(ring)], ring[(i + 2) % len(ring)]):
            halves += [(a, w // 2), (a + w // 2, w - w // 2)]
        for kind, (p, q) in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))):
            cells = [_bits(fp, start, width), _bits(fp, *halves[p]), _bits(fp, *halves[q])]
            keys.append(F.struct(F.lit(i).alias("part"), F.xxhash64(F.lit(5 * i + kind), *cells).alias("id")))
    return F.array(*keys)


def _mask(start: int, width: int) -> int:
    mask = ((1 << width) - 1) << start
    return mask - (1 << 64) if mask >> 63 else mask


def chain_holds(x: Column, part: Column, radius: int) -> Column:
    """Whether, from the segment of ``part`` on, each chain of l segments of the difference x has at most l - 1 bits."""
    ring = segments(radius)
    tests = F.lit(False)
    for i in range(len(ring)):
        ok, total = F.lit(True), F.lit(0)
        for length in range(len(ring)):
            total = total + F.bit_count(x.bitwiseAND(F.lit(_mask(*ring[(i + length) % len(ring)])).cast("long")))
            ok = ok & (total <= length)
        tests = F.when(part == i, ok).otherwise(tests)
    return tests


def near(a: Column, b: Column, part: Column, radius: int) -> Column:
    x = a.bitwiseXOR(b)
    return chain_holds(x, part, radius) & (F.bit_count(x) <= radius)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(node, root) of the components of fingerprints (column fp, each once) that have a partner within the radius."""
    members = distinct.select("fp", F.inline(ring_keys(F.col("fp"), radius)))
    spread = F.xxhash64("fp")
    picked = members.groupBy("id").agg(
        F.first("part").alias("part"),
        F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.array(F.min("fp"), F.max("fp"), F.min_by("fp", spread), F.max_by("fp", spread))).alias("picks"),
    )
    shared = write_out(picked.where("n > 1"), "simhash-keys")
    rows = members.select("fp", "id")
    inside = write_out(spread_lookup(rows, shared, "id", "n", spread, ROWS_PER_TASK), "simhash-members")

    first = inside.select("fp", "part", F.explode("picks").alias("pick")).where(
        (F.col("fp") != F.col("pick")) & near(F.col("fp"), F.col("pick"), F.col("part"), radius)
    )
    stars = components(first, "fp", "pick")
    stars = write_out(stars, "simhash-stars")

    # What is left: keys with members in several components, beyond those that were all compared.
    open_keys = inside.where(F.col("n") > F.size("picks")).select("id", "fp", "part")
    placed = open_keys.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "id", "fp", "part", F.coalesce("root", "fp").alias("root")
    )
    placed = write_out(placed, "simhash-open")
    sizes = placed.groupBy("id", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("id").agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), F.max("n").alias("top"), F.count(F.lit(1)).alias("roots"))
    mixed = mixed.where("roots > 1").withColumn("blocks", F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int"))
    mixed = write_out(mixed.select("id", "main", "blocks", "n"), "simhash-mixed")
    crowd = spread_lookup(placed, mixed, "id", "n", spread, ROWS_PER_TASK)
    crowd = write_out(crowd, "simhash-crowd")
    outer = crowd.where("root <> main").select(
        "id", F.pmod(spread, F.col("blocks")).cast("int").alias("block"), "part", F.col("fp").alias("fp_a"), F.col("root").alias("root_a")
    )
    every = crowd.select("id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
    across = (
        outer.join(every, ["id", "block"])
        .where((F.col("root_a") != F.col("root_b")) & near(F.col("fp_a"), F.col("fp_b"), F.col("part"), radius))
        .select("root_a", "root_b")
        .distinct()
    )
    merged = components(across, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    whole = stars.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = merged.join(stars, F.col("top").isNotNull() & (merged["root"] == stars["node"]), "left_anti")
    return whole.unionByName(alone.select(F.col("root").alias("node"), F.col("top").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int, radius: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the class), key and first for each row. ``first`` marks the
    row that stands for its class: the smallest id, rows without one last, and of these the smallest key."""
    prints = write_out(fingerprints(docs, shingle, doc_id, text), "simhash-prints")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    distinct = write_out(prints.groupBy("fp").agg(head.alias("head"), F.count(F.lit(1)).alias("copies")), "simhash-distinct")
    if radius < 1:
        classes = distinct
    else:
        found = links(distinct.select("fp"), radius).withColumnRenamed("node", "fp")
        rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        tops = rooted.groupBy("root").agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n"))
        classes = spread_lookup(rooted.drop("head"), tops, "root", "n", F.xxhash64("fp"), ROWS_PER_TASK)
    classes = classes.select("fp", "copies", F.col("head.doc_id").alias("component_id"), F.col("head.key").alias("head_key"))
    mixer = F.xxhash64("key", F.spark_partition_id())
    found = spread_lookup(prints, classes, "fp", "copies", mixer, ROWS_PER_TASK)
    return found.select("doc_id", "fp", "component_id", "key", (F.col("key") == F.col("head_key")).alias("first"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``near_duplicates``, that marked as first; all columns stay. Rows are told apart by id
    and text, so rows of one id in several classes are judged each, and a row without an id stays if it stands for its
    class. Of rows that repeat both, any one stays: each task keeps one, so a shuffle meets at most one a task."""
    heads = classes.where("first").groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
    heads = write_out(heads, "simhash-heads")
    ids, texts = docs.columns.index(doc_id), docs.columns.index(text)

    def run(batches):
        met = set()
        for batch in batches:
            keys = list(map(row_key, batch.column(ids).to_pylist(), batch.column(texts).to_pylist()))
            fresh = [not (k in met or met.add(k)) for k in keys]
            names = [*batch.schema.names, "__key"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=names).filter(pa.array(fresh, pa.bool_()))

    keyed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__key", T.BinaryType())]))
    kept = keyed.join(heads, "__key", "left_semi")
    if not heads.where("__rows > 1").isEmpty():
        kept = kept.dropDuplicates(["__key"])
    return kept.drop("__key")
