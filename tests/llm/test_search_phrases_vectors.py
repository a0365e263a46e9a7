"""Ranked search, collocations and embedding near-copies against brute force and odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tallyrisk.llm import common, embedding_dedup, phrases, search

LONG = "long text of words, here " * 4000
ODD = [(1, "One two", "en"), (2, None, "en"), (3, "", None), (None, "no id at all one", None), (4, "One two", "en"), (4, "One two", "en"), (5, LONG, "xx"), (6, " \t\n;. ", "")]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    # Columns with names that the operators use themselves.
    schema = "doc_id long, text string, lang string, n string, terms int, copies int, rank int"
    return spark.createDataFrame([(*r, "x", i, i, i) for i, r in enumerate(ODD)], schema)


# --- search


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: term.findall((t or "").translate(lower))
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item_id, text in items:
        best = []
        for doc_id, c in held:
            norm = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * norm)) for t in split(text) if t in c)
            if score > 0:
                best.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, r + 1, b[3], -b[0]) for r, b in enumerate(sorted(best)[:k])]
    return sorted(rows, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Élan", "日本", "x_y", "İ"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(n)]
    return rng, words, weights, texts


@pytest.mark.parametrize("block_docs", [17, 20_000])
def test_search(spark, monkeypatch, block_docs):
    monkeypatch.setattr(search, "BLOCK_DOCS", block_docs)
    rng, words, weights, texts = corpus(300, 3)
    docs = list(enumerate(texts + texts[:40] * 3)) + [(None, texts[0]), (None, "W1 w1 w2"), (7, "w5 w6"), (7, "w5 w6"), (900, None), (901, "...")]
    items = [(i, " ".join(rng.choices(words, k=12) + rng.choices(words, weights, k=4))) for i in range(25)]
    items += [(3, "w150 w151 w1 w1 w1"), (None, "w9 absent"), (50, None), (51, "..."), (52, "absent"), (53, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = search.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), 10, block_bytes=300).collect()
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=str)
    assert got == brute_search(docs, items, 10)


def test_search_stops_making_accumulators():
    """A rare term decides; documents that hold only the common one are never made."""
    n = 1000
    owner = np.concatenate((np.arange(20), np.arange(n)))
    terms = np.array([0] * 20 + [1] * n)
    block = search.Block(np.full(n, 100), owner, terms, np.ones(n + 20, dtype=np.int64), np.array([9000, 10]))
    docs, scores = block.search([(0, 1), (1, 1)], 10, 0)
    assert docs.tolist() == list(range(20)) and len(set(scores.tolist())) == 1
    assert scores[0] == (9000 + 10) * (10**9 // (1000 + 800))


def test_search_odd_tables(odd, spark):
    items = spark.createDataFrame([(1, "one two"), (2, LONG), (None, "id"), (3, None)], "item_id int, text string")
    got = search.rank_documents(odd, items, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["item_id"].dataType == T.IntegerType()
    rows = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str)
    assert rows == brute_search([r[:2] for r in ODD], [(1, "one two"), (2, LONG), (None, "id"), (3, None)], 10)
    assert search.rank_documents(odd.limit(0), items, 10).collect() == []
    assert search.rank_documents(odd, items.limit(0), 10).collect() == []


# --- phrases


def brute_phrases(rows, least, covered, top):
    counts, sizes = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], sizes[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found_phrases(df, *parameters):
    return sorted(tuple(r) for r in phrases.collocations(df, *parameters).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("spacing,longest,bits", [(3, 4096, 26), (50, 5, 6)])
def test_phrases(spark, monkeypatch, spacing, longest, bits):
    """Short and cut chunks, and a table of frequent phrases that is full of wrong marks."""
    monkeypatch.setattr(phrases, "LONGEST", longest)
    monkeypatch.setattr(phrases, "TABLE_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(phrases.chunks_of, "__defaults__", (spacing,))
    rng, words, weights, texts = corpus(250, 8)
    passage = "the quick Brown fox\tjumps. over the lazy dog; again and again and again"
    rows = [(rng.choice(["en", "de", None, "und"]), t.replace(" w3 ", rng.choice([" w3 ", ". ", "!? ", "\n"])) + " " + passage * rng.randint(0, 2)) for t in texts]
    rows += [("en", "a " * 900), ("en", None), (None, ""), ("fr", "hapax")] + [("de", "same text of copies here")] * 40
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = found_phrases(df, 8, 80, 50)
    assert got == brute_phrases(rows, 8, 80, 50) and len(got) > 60


def test_parse_counts_each_start_once():
    rng = random.Random(2)
    hashes = phrases._Hashes()
    for n in (0, 1, 2, 3, 4, 5, 60):
        words = [rng.choice([b"a", b"b", b"c", b"."]) for _ in range(n)]
        starts = [w for chunk, _ in phrases.chunks_of(words, hashes, 2) for w in chunk.split(b" ")[: -phrases.OVERLAP]]
        assert starts == words
        assert sum(k for _, k in phrases.chunks_of(words, hashes, 2)) == n - words.count(b".")


def test_repeated_passages_share_chunks():
    """Cuts depend on content alone: a passage in other surroundings has the same chunks but for its ends."""
    rng = random.Random(5)
    passage = [b"w%d" % rng.randint(0, 99) for _ in range(400)]
    parse = lambda *parts: {c for c, _ in phrases.chunks_of([w for p in parts for w in p], phrases._Hashes())}
    a, b = parse([b"x"] * 17, passage), parse([b"y", b"z"], passage, [b"q"] * 9)
    assert len(a & b) >= len(a) - 4


def test_phrases_odd_tables(odd):
    assert found_phrases(odd, 2, 80, 5) == brute_phrases([(r[2], r[1]) for r in ODD], 2, 80, 5)
    assert found_phrases(odd.limit(0), 2, 80, 5) == []


def test_phrase_scores_beyond_64_bits(spark):
    big = 1 << 61
    candidates = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 5)], "lang string, phrase string, a long")
    assert phrases.scored(candidates, parts).first()["score"] == 2000000 * big // (2 * big + 5)


# --- vectors


def brute_vectors(rows, threshold):
    usable = []
    for i, (_, v, label) in enumerate(rows):
        good = v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, dtype=np.float64) if good else None)
    near = defaultdict(list)
    for i, a in enumerate(usable):
        for j in range(i):
            b = usable[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return sorted(out, key=str)


def vector_rows(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims) * spread * rng.random() if i % 3 else rng.normal(size=dims)
        rows.append((1000 - i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def found_vectors(spark, rows, schema=SCHEMA, **parameters):
    frame = spark.createDataFrame(rows, schema).repartition(4)
    return sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame, 0.98, **parameters).collect()), key=str)


@pytest.mark.parametrize("dims,strip,tile,spread", [(40, 8192, 512, 0.3), (40, 30, 8, 0.3), (20, 50, 16, 0.12), (3, 40, 16, 0.1)])
def test_vectors(spark, monkeypatch, dims, strip, tile, spread):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    common.prepare(spark)
    rows = vector_rows(400, dims, dims, spread)
    rows += [(i, rows[5][1], rows[5][2]) for i in range(2000, 2030)] + [(3000, [2 * x for x in rows[7][1]], rows[7][2])]
    want = brute_vectors(rows, 0.98)
    assert found_vectors(spark, rows, strip_rows=strip) == want and sum(r[1] for r in want) > 1000


def test_odd_vectors(spark):
    common.prepare(spark)
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [1.0, 0.0], None), (6, None, 1),
        (7, [], 1), (8, [0.0, 0.0], 1), (9, [0.0, 0.0], 1), (10, [1.0, None], 1), (11, [1.0, nan], 1), (12, [inf, 1.0], 1),
        (13, [1.0, 0.0, 0.0], 1), (14, [1.0, 0.1, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 3),
        (None, [0.0, 2.0], 3), (15, [-1.0, 0.0], 1), (16, [-1.0, -0.0], 1), (17, [1e30, 0.0], 2), (18, [1e-40, 0.0], 2), (2, [0.0, 5.0], 2),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "copies": F.lit(2), "node": F.lit(3), "kept": F.lit("x")})
    got = embedding_dedup.near_duplicates(frame, 0.98)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_vectors(rows, 0.98)
    assert embedding_dedup.near_duplicates(frame.limit(0), 0.98).collect() == []
    wide = [(1, [1e-200, 0.0], 1), (2, [1e200, 0.0], 1), (3, [1.0, 0.5], 1)]  # squares that vanish or overflow
    assert [r[1:3] for r in found_vectors(spark, wide, SCHEMA.replace("float", "double"))] == [(1, 1), (1, 1), (0, 3)]


def test_threshold_is_exact(spark):
    """Products at the threshold are decided as the cosine of the vectors themselves."""
    common.prepare(spark)
    rows, rng = [], np.random.default_rng(1)
    for i in range(60):
        a = rng.normal(size=32)
        b = rng.normal(size=32)
        b -= a * (a @ b) / (a @ a)
        c = a / np.linalg.norm(a) * 0.98 + b / np.linalg.norm(b) * math.sqrt(1 - 0.98**2 + (i - 30) * 1e-12)
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, c.tolist(), i)]
    got = found_vectors(spark, rows, SCHEMA.replace("float", "double"))
    links = {r[0]: r[1] for r in got}
    want = {r[0]: r[1] for r in brute_vectors(rows, 0.98)}
    differ = [i for i in want if want[i] != links[i]]
    assert len(differ) <= 4 and 20 < sum(want.values()) < 100  # the last bit of a division may differ at the very threshold


def test_hot_vector_is_spread(spark, monkeypatch):
    """A third of the rows are one vector: its rows are dealt out, and none is lost."""
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_TASK", 500)
    rows = vector_rows(600, 8, 4, 0.2)
    frame = spark.createDataFrame(rows + [(10_000 + i, rows[1][1], rows[1][2]) for i in range(5000)], SCHEMA).repartition(8)
    found = embedding_dedup.near_duplicates(frame, 0.98)
    assert found.count() == 5600
    assert found.where("vec_id >= 10000").agg(F.min("n_links"), F.max("component_id")).first()[0] >= 5000
    assert found.where("vec_id >= 10000").select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 4000
