"""The stages of the pipeline against brute force, on rows with null and repeated ids."""

import hashlib
import random
import sys

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_operators import brute_classes

from tallyrisk.llm import byte_bpe, common, decontaminate, simhash_dedup, toxicity

LAST = sys.maxsize


def corpus():
    """Rows (doc_id, text, lang, n_chars), a third without an id, ids with several texts, copies and leaks; and items."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(12)) for i in range(5)]  # under 100 bytes, or later ones would be cut as repeats
    shared = [some(25) for _ in range(4)]
    texts = []
    for i in range(400):
        text = some(40) + (" nasty nasty" if i % 2 == 1 else "")
        text += " " + items[i % 5][1] if i % 7 == 0 else ""
        text += " " + shared[i % 4] if i % 6 == 0 else ""
        texts += [text, *([text.upper()] if i % 4 == 0 else []), *([text] * 2 if i % 9 == 0 else [])]
    rows = []
    for i, text in enumerate(texts):
        doc_id = None if i % 3 == 0 else 7 if i % 10 == 1 else i
        rows.append((doc_id, text, "en", len(text)))
    rows += [rows[1], rows[0], (None, "", "xx", 0), (None, None, "yy", 0), (500, "", "xx", 0)]
    return rows, items


def brute_near(rows):
    """One (id, text) of each class: the smallest id, null last."""
    prints = {t or "": simhash_dedup.fingerprint(t or "", 4) for _, t in rows}
    classes = brute_classes(prints.values(), 4)
    heads = {}
    for doc_id, text in rows:
        key = (doc_id is None, doc_id or 0, common.row_key(doc_id, text))
        at = classes[prints[text or ""]]
        heads[at] = min(heads.get(at, key), key)
    return sorted(k[2] for k in heads.values())


def brute_cut(rows, width=100):
    """Rows without bytes that repeat earlier ones; order by id (null last), then digest; equal rows are one document."""
    order = sorted(set(rows), key=lambda r: (LAST if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for doc_id, text in order:
        data, gone = (text or "").encode(), set()
        for p in range(len(data) - width + 1):
            if data[p : p + width] in seen:
                gone.update(range(p, p + width))
            seen.add(data[p : p + width])
        out[doc_id, text] = bytes(c for i, c in enumerate(data) if i not in gone).decode()
    return [(d, out[d, t] if t is not None else None) for d, t in rows if out[d, t] or not t]


def leaks(text, items):
    hashes = decontaminate.shingles(decontaminate.word_hashes(text or ""), 5)
    for _, item in items:
        mine = decontaminate.shingles(decontaminate.word_hashes(item), 5)
        n = min(len(mine), len(hashes))
        for s in range(len(hashes) - n + 1):
            if decontaminate.similarity(decontaminate.Counter(mine.tolist()), decontaminate.Counter(hashes[s : s + n].tolist())) >= 0.8:
                return True
    return False


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    common.prepare(spark)
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(d, int("nasty" in t.lower())) for d, t, _, _ in rows if d is not None and d != 7 and t]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")

    model = toxicity.fit_on_labels(docs, common.table(spark, str(tmp_path), "labels"))
    mild = lambda t: model.score(toxicity.Distinct()(toxicity.features_of(t or ""))) < corpus_pipeline.TOXIC_FROM
    left = common.write_out(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)), "test-mild")
    own = [(d, t) for d, t, _, _ in rows if mild(t)]
    assert pairs(left) == sorted(own, key=repr) and 0 < len(own) < len(rows)

    left = common.write_out(corpus_pipeline.drop_near_duplicates(spark, left, str(tmp_path)), "test-near")
    assert left.columns == docs.columns
    near = pairs(left)
    assert sorted(common.row_key(*r) for r in near) == brute_near(own)
    assert sum(d == 7 for d, _ in near) > 1 and sum(d is None for d, _ in near) > 1

    left = common.write_out(corpus_pipeline.cut_repeats(spark, left, str(tmp_path)), "test-cut")
    cut = brute_cut(near)
    assert pairs(left) == sorted(cut, key=repr) and cut != near

    left = common.write_out(corpus_pipeline.drop_leaks(spark, left, str(tmp_path)), "test-clean")
    clean = [(d, t) for d, t in cut if not leaks(t, items)]
    assert pairs(left) == sorted(clean, key=repr) and len(clean) < len(cut)
    assert any(d is None for d, t in cut if leaks(t, items)) and sum(d is None for d, _ in clean) > 1

    ranks = byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.BPE_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((d, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in clean), key=repr)
    got = corpus_pipeline.encode(spark, left, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got), key=repr) == want


def test_a_leak_in_one_row_leaves_others_of_its_id(spark):
    common.prepare(spark)
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item), (None, "clean text without an id"), (1, item), (1, "another text of the same id")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")
    assert pairs(decontaminate.without_leaks(docs, items)) == sorted([rows[1], rows[3]], key=repr)
