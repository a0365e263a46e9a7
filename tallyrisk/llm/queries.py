"""Registered queries of the subpackage: each applies its operator to the whole table, with production
parameters, and derives the digest columns from the operator's own output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyrisk.llm import byte_bpe, decontaminate, embedding_dedup, licenses, phrases, search, sharding, simhash_dedup, suffix_dedup
from tallyrisk.llm import syncmers, token_count, toxicity, warc
from tallyrisk.llm.common import prepare, table

QUERIES = {}
SQL = {}

# Production parameters.
TOKEN_LIMIT = 2048
COUNT_FILE = "word_bpe_49k.json"
BPE_FILE = "byte_bpe_multi_50k.tiktoken"
TOXIC_FROM = 0.3
SIMHASH_SHINGLE = 4
SIMHASH_RADIUS = 4
REPEAT_BYTES = 100
SHARDS = 16
BEST_DOCUMENTS = 10
PHRASE_LEAST, PHRASE_COVERED, PHRASE_TOP = 30, 80, 2000
SAME_VECTOR = 0.98


def query(fn):
    """Register under the function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query
def op2_token_counts(spark, sf_dir):
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_FILE))
    return token_count.flag_long(counts, TOKEN_LIMIT)


@query
def op3_sharding(spark, sf_dir):
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path(BPE_FILE)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_records(index, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 takes five bits a character: four characters from each five hexadecimal digits of the digest.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)
SQL["op5_warc"] = f"""
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM payloads
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


@query
def op6_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_simhash_dedup(spark, sf_dir):
    classes = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_RADIUS)
    return classes.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_syncmers(spark, sf_dir):
    found = syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: syncmers.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


@query
def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_suffix_dedup(spark, sf_dir):
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), REPEAT_BYTES)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_search(spark, sf_dir):
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BEST_DOCUMENTS)


# Terms end at ASCII characters that are no letters or digits; only A to Z are lowered.
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL["op11_search"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents
), held AS (
    SELECT row_no, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held
), norms AS (
    SELECT row_no, doc_id, 25 + (75 * n * n_docs) // n_terms AS norm FROM held, totals
), counts AS (
    SELECT row_no, term, count(*)::BIGINT AS tf FROM (SELECT row_no, unnest(terms) AS term FROM held) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
    FROM counts, totals GROUP BY term
), items AS (
    SELECT item_no, item_id, unnest(terms) AS term
    FROM (SELECT row_number() OVER () AS item_no, item_id, {_TERMS} AS terms FROM benchmark)
), scores AS (
    SELECT item_no, item_id, row_no, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * norm)))::BIGINT AS score
    FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (row_no)
    GROUP BY ALL HAVING score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores)
WHERE rank <= {BEST_DOCUMENTS}
"""


@query
def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), PHRASE_LEAST, PHRASE_COVERED, PHRASE_TOP)


_LONGER = [("w1 || ' ' || w2", 2), ("w2 || ' ' || w3", 3), ("w3 || ' ' || w4", 4), ("w1 || ' ' || w2 || ' ' || w3", 3), ("w2 || ' ' || w3 || ' ' || w4", 4)]
SQL["op12_phrases"] = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_no, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS piece_no
    FROM (SELECT lang, row_number() OVER () AS row_no, string_split_regex({_LOWERED}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents)
), words AS (
    SELECT lang, row_no, piece_no, unnest(found) AS w1, generate_subscripts(found, 1) AS place
    FROM (SELECT lang, row_no, piece_no, regexp_extract_all(piece, '[^\\x20\\x09]+') AS found FROM pieces)
), starts AS (
    SELECT lang, w1, lead(w1, 1) OVER own AS w2, lead(w1, 2) OVER own AS w3, lead(w1, 3) OVER own AS w4 FROM words
    WINDOW own AS (PARTITION BY row_no, piece_no ORDER BY place)
), grams AS (
    SELECT lang, w1, NULL AS w2, NULL AS w3, NULL AS w4, 1 AS size, count(*) AS a FROM starts GROUP BY ALL
    UNION ALL SELECT lang, w1, w2, NULL, NULL, 2, count(*) FROM starts WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, w1, w2, w3, NULL, 3, count(*) FROM starts WHERE w3 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, w1, w2, w3, w4, 4, count(*) FROM starts WHERE w4 IS NOT NULL GROUP BY ALL
), frequent AS (
    SELECT *, concat_ws(' ', w1, w2, w3, w4) AS phrase FROM grams WHERE a >= {PHRASE_LEAST}
), sizes AS (
    SELECT lang, count(*) AS n FROM words GROUP BY lang
), inner_phrases AS (
    {" UNION ALL ".join(f"SELECT lang, {text} AS phrase, a FROM frequent WHERE size > {2 if text.count('||') == 2 else 3} AND size >= {needs}" for text, needs in _LONGER)}
), longest AS (
    SELECT lang, phrase, max(a) AS longer_a FROM inner_phrases GROUP BY ALL
), cuts AS (
    SELECT lang, phrase, a, size, 1 AS k, w1 AS head, concat_ws(' ', w2, w3, w4) AS tail FROM frequent WHERE size >= 2
    UNION ALL SELECT lang, phrase, a, size, 2, w1 || ' ' || w2, concat_ws(' ', w3, w4) FROM frequent WHERE size >= 3
    UNION ALL SELECT lang, phrase, a, size, 3, w1 || ' ' || w2 || ' ' || w3, w4 FROM frequent WHERE size = 4
), scored AS (
    SELECT c.*, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
    FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.head JOIN frequent r ON r.lang = c.lang AND r.phrase = c.tail
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank
    FROM lowest s LEFT JOIN longest USING (lang, phrase)
    WHERE longer_a IS NULL OR 100::HUGEINT * longer_a < {PHRASE_COVERED}::HUGEINT * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {PHRASE_TOP}
"""


@query
def op13_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), SAME_VECTOR)


SQL["op13_embedding_dedup"] = f"""
WITH RECURSIVE usable AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.row_no <> b.row_no AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= {SAME_VECTOR}
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
