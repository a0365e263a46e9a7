"""The text operators against brute force, the tokenizers' own libraries, and odd tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tallyrisk.llm import byte_bpe, common, components, decontaminate, licenses, sharding, simhash_dedup, suffix_dedup
from tallyrisk.llm import syncmers, token_count, toxicity, warc

COUNT_FILE = public_tokenizers.path("word_bpe_49k.json")
BPE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "word salad with éèü and ... " * 3000
ODD = [
    (1, "Same text twice, here.", "x"),
    (2, "Same text twice, here.", None),
    (2, "Same text twice, here.", None),
    (3, None, "x"),
    (4, "", "y"),
    (None, "No id at all", "z"),
    (5, LONG, "x"),
    (6, "  \t\n ", None),
    (7, "MIT License. SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "x"),
    (8, "日本語 <|endoftext|> ΑΣ İ ½", "x"),
]
OPERATORS = {
    "count": lambda d: token_count.flag_long(token_count.count_tokens(d, COUNT_FILE), 5),
    "bpe": lambda d: byte_bpe.decode_ids(byte_bpe.encode_texts(d, BPE_FILE, public_tokenizers.PATTERN), BPE_FILE),
    "licenses": licenses.scan_licenses,
    "simhash": lambda d: simhash_dedup.near_duplicates(d, 4, 4),
    "suffix": lambda d: suffix_dedup.remove_repeats(d, 100),
    "shards": lambda d: sharding.assign_shards(d, 3),
    "syncmers": syncmers.edited_fingerprints,
    "toxicity": lambda d: toxicity.score(d, toxicity.ToxicityModel(0.0, np.zeros(1 << toxicity.BITS, np.float32))),
}


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    # Columns with the names that operators use themselves.
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id long, text string, digest string, place int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(odd, name):
    rows = OPERATORS[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_token_counts(odd, spark):
    library = tokenizers.Tokenizer.from_file(COUNT_FILE)
    got = {r["doc_id"]: r for r in OPERATORS["count"](odd).collect()}
    for doc_id, text, _ in ODD:
        assert got[doc_id]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[doc_id]["n_bytes"] == len((text or "").encode())


def test_byte_bpe(odd):
    ranks = byte_bpe.read_ranks(BPE_FILE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in OPERATORS["bpe"](odd).collect():
        text = next(t for i, t, _ in ODD if i == r["doc_id"]) or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert r["text"] == text
    own, rng = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(5)
    for text in ["".join(rng.choice("abeéthing") for _ in range(20_000)), "=" * 9999, *("".join(rng.choice("abeéthing ") for _ in range(30)) for _ in range(300))]:
        assert np.frombuffer(own.packed(text), "<u4").tolist() == library.encode_ordinary(text)


def test_utf8_machine():
    rng = random.Random(2)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(12))
        text, held = byte_bpe.utf8_step(b"", data)
        assert text + ("�" if held else "") == data.decode("utf-8", "replace")


def test_licenses(odd):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(odd).collect()}[7]
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (1, 0, 0, "mit")
    assert (got["labels"], got["score"], got["permissive"]) == ("apache,gpl,mit", 1.0, False)
    assert licenses.evaluate(licenses.to_postfix("MIT OR GPL-3.0-only")) == ({"mit", "gpl"}, True)
    assert licenses.to_postfix("MIT OR") is None and licenses.to_postfix("(MIT") is None
    places = licenses.scan("mit license, MIT-License; the mit mit license", licenses.build_automaton())
    assert (places["n_base"], places["first_word"], places["last_word"]) == (3, 0, 6)
    names = {"MITRE-x": "mitre-x", "ISCX": "iscx", "MIT-0": "mit", "mit": "mit", "Unlicensed": "unlicensed", "GPL-2.0-only": "gpl", "GPLv2": "gplv2", "CC-BY-SA-4.0": "cc-by"}
    assert {n: licenses.family(n)[0] for n in names} == names


def test_license_places_by_brute_force(spark):
    """Random texts of the phrases' words, near misses and separators, against a walk over all places."""
    rng = random.Random(21)
    parts = ["mit", "MIT", "license", "License", "apache", "general", "public", "GENERAL", "é", "mité", "licenses", "x1", "lesser"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", "-", ".\n", "", ", "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["mit license " * 5000, ""]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, text in enumerate(texts):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for k in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))


def brute_classes(prints, radius):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                root[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_simhash_links(spark):
    """Dense and chained clusters of fingerprints, all links between different ones."""
    rng, values = random.Random(7), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
        for _ in range(10):
            for b in rng.sample(range(64), 4):
                centre ^= 1 << b
            values.add(centre)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {r["node"]: r["root"] for r in simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4).collect()}
    want = brute_classes(signed, 4)
    groups = lambda f: {frozenset(v for v in signed if f(v) == r) for r in {f(v) for v in signed}}
    assert groups(lambda v: found.get(v, v)) == groups(lambda v: want[v])


def test_simhash_copies_and_empty(odd):
    got = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(odd, 4, 4).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1
    assert got[3]["fp"] == got[4]["fp"] == got[6]["fp"] == 0 and got[6]["component_id"] == 3
    kept = simhash_dedup.keep_first(odd, simhash_dedup.near_duplicates(odd, 4, 4))
    assert kept.columns == odd.columns and sorted(str(r[0]) for r in kept.collect()) == ["1", "3", "5", "7", "8", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}


def brute_repeats(rows, width):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if data[p : p + width] in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(data[p : p + width])
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc_id] = (sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g))
    return out


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 8)  # groups spread over chunks
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 2000)
    rng = random.Random(3)
    base = ["".join(rng.choice("abc ") for _ in range(500)) for _ in range(4)]
    rows = [(300, ""), (301, "a" * 700), (302, "q" * 99), (303, "é" * 150)]
    for i in range(150):
        start = rng.randrange(300)
        piece = rng.choice(base)[start : start + rng.randint(50, 300)]
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) + piece + rng.choice([piece, "", "ab" * 150])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df, 100).collect()}
    assert got == brute_repeats(rows, 100)


def test_suffix_repeated_rows(spark, monkeypatch):
    """Rows that repeat an id and a text are one text: many of them cost one row each, spread over tasks."""
    monkeypatch.setattr(suffix_dedup, "ROWS_PER_TASK", 3000)
    rng = random.Random(31)
    text, other = ("".join(rng.choice("abcdef ") for _ in range(3000)) for _ in range(2))
    few = spark.createDataFrame([(1, text), (2, text[:700] + other), (None, other[100:900]), (3, "x" + text)], "doc_id long, text string")
    want = brute_repeats([(1, text), (2, text[:700] + other), (3, "x" + text), (9, other[100:900])], 100)
    for copies in (1, 50_000):
        rows = few.unionByName(spark.range(copies).select(F.lit(3).cast("long").alias("doc_id"), F.lit("x" + text).alias("text")))
        got = suffix_dedup.remove_repeats(rows, 100).withColumn("part", F.spark_partition_id())
        sums = got.groupBy("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))
        sums = {r["doc_id"] or 9: r for r in sums.collect()}
        assert {d: (r["n_removed"], r["n_spans"]) for d, r in sums.items()} == {d: w[:2] for d, w in want.items()}
        assert all(r["kept"] == hashlib.sha256(want[d][2]).hexdigest() for d, r in sums.items())
        assert sums[3]["n"] == copies + 1 and (copies == 1 or sums[3]["parts"] > 1)


def test_suffix_classes():
    """Suffix order and classes against sorting, for widths within and beyond the texts."""
    rng = np.random.default_rng(9)
    for width in (2, 5, 7, 33):
        for n in (1, 2, 40, 900):
            symbols = rng.integers(97, 99, n).astype(np.int16)
            symbols[rng.integers(0, n, n // 50)] = 256
            symbols[-1] = 256
            order, classes = suffix_dedup.equal_classes(symbols, width)
            strings = {int(p): tuple(symbols[p : p + width].tolist()) for p in order}
            whole = [(strings[int(p)], c) for p, c in zip(order, classes) if len(strings[int(p)]) == width and 256 not in strings[int(p)]]
            assert sorted(order.tolist()) == list(range(n)) and [w for w, _ in whole] == sorted(w for w, _ in whole)
            assert len(set(whole)) == len({w for w, _ in whole}) == len({c for _, c in whole})


def test_suffix_stretches(monkeypatch):
    """A text in stretches has the anchors and contexts of the text as a whole, whatever its length is to their multiples."""
    width, rng = 100, np.random.default_rng(4)
    found = suffix_dedup.Anchors(width)
    for stretch in (256, 300):
        for length in [m * stretch + d for m in (1, 2, 3) for d in range(-2, 203)]:
            data = rng.integers(97, 123, length).astype(np.uint8)
            monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 22)
            whole = found.of(data)
            monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
            parts = found.of(data)
            assert all(np.array_equal(a, b) for a, b in zip(whole, parts)), (stretch, length)


def test_cut_documents_keeps_columns(odd):
    got = suffix_dedup.cut_documents(odd, 100)
    assert got.columns == odd.columns and got.count() == len(ODD)


def test_decontamination(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for i in range(30)] + [(90, None), (91, "a few words")]
    docs = []
    for i in range(120):
        own = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        leak = rng.choice(items[:30])[1].split()
        if i % 3 == 0 and rng.random() < 0.5:
            leak[-1] = "changed"
        docs.append((i, " ".join(own + (leak if i % 3 == 0 else []) + own[:20]).upper()))
    docs += [(500, None), (501, ""), (502, "A few, words!")]
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), block_bytes=4000
    )
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found.collect()}
    want = {}
    for item_id, item in items:
        size = len((item or "").split())
        width = min(5, size)
        if not size:
            continue
        mine = decontaminate.Counter(decontaminate.shingles(decontaminate.word_hashes(item), width).tolist())
        for doc_id, text in docs:
            hashes = decontaminate.shingles(decontaminate.word_hashes(text or ""), width)
            n = min(size - width + 1, len(hashes))
            best = max((decontaminate.similarity(mine, decontaminate.Counter(hashes[s : s + n].tolist())) for s in range(len(hashes) - n + 1)), default=0)
            if best >= 0.8:
                want[doc_id, item_id] = round(best, 9)
    assert got == want and (502, 91) in got


def test_sharding(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 400) + str(rng.randint(0, 60)) for _ in range(500)] + ["hot" * 50] * 250 + [None, ""]
    rows = list(enumerate(texts))
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 7).collect()
    assert len(got) == len(rows)
    shard_of, slots, sizes = {}, {}, {}
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text) + 1 and shard_of.setdefault(text, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len(t or "") + 1
    order = [groups[t] for t in sorted(groups, key=lambda t: hashlib.sha256(t.encode()).digest())]

    def fits(capacity):
        used, room = 1, capacity
        for g in order:
            if g > capacity:
                return False
            if g > room:
                used, room = used + 1, capacity
            room -= g
        return used <= 7

    assert max(sizes.values()) == next(c for c in range(1, sum(order) + 1) if fits(c))


def test_sharding_refines_its_grid(monkeypatch, spark):
    monkeypatch.setattr(sharding, "GRID", 8)
    rng = random.Random(6)
    ends = np.cumsum([rng.randint(1, 90) for _ in range(2000)]).tolist()
    cuts = sharding.find_cuts(spark.createDataFrame([(e,) for e in ends], "end_bytes long"), 9)
    exact = sharding.Grid(ends, [])
    assert cuts == exact.cuts(exact.smallest(9, ends[-1], False), 9, False)[:-1]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x\r\n\r\ny" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) and index.count() == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3), (5, "response", None)]
    assert {r["payload_digest"] for r in got} == {warc.base32_sha1((h or "").encode()) for _, _, h in rows}
    one = warc.read_records(index.where("page_id = 5")).first()
    assert bytes(one["payload"]) == b"x\r\n\r\ny" * 9
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_warc_ranges():
    near, far = 10, 10 + warc.GAP * 2
    assert warc.ranges([(0, 10), (near, 5), (far + 5, 7)]) == [(0, 15, 2), (far + 5, 7, 1)]


def test_syncmers_are_context_free(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(400))
    df = spark.createDataFrame([(text, "abc" + text[100:300] + "zz")], "a string, b string")
    a, b = df.select(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).first()
    k = syncmers.S + syncmers.SPAN - 1
    inside = {(p - 100, h) for p, h in a if 100 <= p <= 300 - k}
    assert inside and inside <= {(p - 3, h) for p, h in b}


def test_syncmer_pairs(spark):
    rows = [(i * 7, "".join(random.Random(i).choice("abcdé ") for _ in range(i * 9 % 70))) for i in range(50)]
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, (doc_id, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(k + 1) % 50][1][:half]
        assert got[doc_id]["n_chars"] == len(text)
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc_id]["near_edited"] <= 1 and (edited != text or got[doc_id]["near_edited"] == 1)


def test_syncmers_keep_all_anchors(spark):
    """Fingerprints and likenesses against the anchors of the whole texts; a short passage that two long texts share is found."""
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passage = make(300)
    texts = [make(20_000) + passage + make(9_000), make(7_000) + passage + make(30_000), make(5_000), make(13), "ab", "", make(40), make(41)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(df.repartition(3)).collect()}
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    frame = spark.createDataFrame(list(enumerate(zip(texts, edited))), "doc_id long, t struct<a: string, b: string>")
    found = frame.select("doc_id", syncmers.anchors(F.col("t.a")), syncmers.anchors(F.col("t.b"))).collect()
    linked = lambda a: {(x[1], *((y[1], y[0] - x[0]) if y else ())) for x, y in zip(a, [*a[1:], None])}
    split = lambda prints: [(x >> 32, x & syncmers.HASH) for x in prints]
    for i, a, b in found:
        assert a == [] or split(got[i]["fingerprint"]) == [tuple(x) for x in a]
        assert b == [] or split(got[i]["edited_fingerprint"]) == [tuple(x) for x in b]
    own = {i: linked(split(r["fingerprint"])) for i, r in got.items()}
    for i, r in got.items():
        for name, other in (("near_edited", linked(split(r["edited_fingerprint"]))), ("near_next", own[(i + 1) % len(texts)])):
            assert r[name] == pytest.approx(len(own[i] & other) / len(own[i] | other) if own[i] | other else 1.0)
    assert len(got[0]["fingerprint"]) > 5000 and got[0]["near_next"] > 0


def test_toxicity_learns(spark):
    rng = random.Random(1)
    make = lambda bad: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) + (" nasty" if bad else "")
    docs = spark.createDataFrame([(i, make(i % 4 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(9999, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit_on_labels(docs, labels)).withColumn("out", toxicity.held_out()).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in rows if r["out"])
    one = toxicity.fit(docs.withColumn("label", F.lit(0)))
    assert 0 < one.score(np.zeros(0, np.int32)) < 0.1
    assert toxicity.fit(docs.limit(0).withColumn("label", F.lit(0))).bias == 0.0


def test_closed_syncmers_by_brute_force(spark):
    """Which k-mers are chosen, in plain Python: the least s-mer hash of each stands at one of its ends."""
    rng = random.Random(31)
    texts = ["".join(rng.choice("abcé日😀 ") for _ in range(n)) for n in (0, 4, 11, 12, 13, 60, 700)] + ["a" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", syncmers.anchors(F.col("t")).alias("a")).collect()
    for text, found in got:
        hashes = [xxhash.xxh64_intdigest(text[i : i + syncmers.S].encode("utf-32-be"), 42) for i in range(len(text) - syncmers.S + 1)]
        signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
        windows = [signed[i : i + syncmers.SPAN] for i in range(len(text) - syncmers.K + 1)]
        assert [x["place"] for x in found] == [i for i, w in enumerate(windows) if min(w) in (w[0], w[-1])]


def test_rows_without_an_id_are_dealt_out(spark, monkeypatch):
    """Half of the rows have no id, a third of these one text: no task of op3, op5 and op8 gets them all, and no row is lost."""
    monkeypatch.setattr(syncmers, "BLOCK_BYTES", 2000)
    rows = [(None if i % 2 else i, "one text" if i % 3 == 0 else f"text number {i}", i) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(6)
    largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    chunks = common.write_out(sharding.in_order(docs, "doc_id", "text"), "chunks").groupBy("chunk").count().collect()
    assert sum(r["count"] for r in chunks) == 1200 and max(r["count"] for r in chunks) < 500
    assert sharding.assign_shards(docs, 5).count() == 1200
    pairs = syncmers.edited_pairs(docs)
    assert pairs.count() == 1200 and largest(pairs) < 200
    assert pairs.where("next is null").count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    dealt = warc.with_originals(pages, "page_id", "url", "html", 0)
    assert dealt.count() == 1200 and largest(dealt) < 500
    assert dealt.where("page_id is null and refers_to is not null").count() == 0


def test_archives_are_read_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 2000)
    monkeypatch.setattr(warc, "STRETCH", 2000)
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 4) for i in range(300)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    read = warc.read_records(index)
    assert read.select(F.spark_partition_id()).distinct().count() > 4 and read.count() == 300
