"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

One pass over the documents counts the terms that any item of the query set has; document frequencies and lengths come from
that table. A second pass takes the documents in blocks, each with its own inverted lists, and evaluates every item term by
term, the rarest first. A document gets an accumulator when a term of it is met. Before each term the greatest scores
that the remaining terms can add in the block are summed: once this bound is below the k-th best partial score (or the k-th best score of
the blocks before), no new document can be among the best, and no accumulator is made any more; those that
exist are updated exactly to the end. Each task returns its k best documents of each item, and the best of these are the result.

The query set is taken in blocks of bounded bytes, each against all documents, so what is broadcast does not grow with it.

Scores are whole numbers: the weight of a term is floor(1000 ln((2N+2)/(2df+1))), a document's norm is
100-75+((75 n N) div L), and a term adds weight * ((10^9 tf) div (1000 tf + 8 norm)).

Defined cases: a null or empty text has no terms, so such a document is never counted or found and such an item has no rows; of
equal scores the smaller id comes first, null ids last; rows with repeated ids are documents of their own; items are ranked
each for itself, also if their ids repeat; an empty table of either kind gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyrisk.llm.common import PerWorker, field_type, map_arrow, write_out

# Bytes of the items that are searched for in one pass, and documents and postings of a block.
ITEM_BYTES = 4 << 20
BLOCK_DOCS = 20_000
BLOCK_POSTINGS = 4_000_000

# A term is a run of ASCII letters and digits and of any characters beyond ASCII; A to Z become a to z.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the vocabulary's terms with their counts, for each document that has a term."""
    shared = PerWorker(docs.sparkSession, vocabulary, lambda v: v)

    def run(batch):
        place = shared.get()
        known, sizes, found, counts = place.__contains__, [], [], []
        for text in batch.column(1).to_pylist():
            terms = terms_of(text)
            met = Counter(filter(known, terms))
            sizes.append(len(terms))
            found.append([place[t] for t in met])
            counts.append(list(met.values()))
        return {"doc_id": batch.column(0), "n": sizes, "terms": found, "counts": counts}

    schema = T.StructType([T.StructField("doc_id", field_type(docs, "doc_id")), *T.StructType.fromDDL("n long, terms array<int>, counts array<long>")])
    return map_arrow(docs, run, schema).where("n > 0")


class Block:
    """Inverted lists of some documents, with what each posting adds to a score."""

    def __init__(self, norms: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        self.size = len(norms)
        order = np.argsort(terms, kind="stable")  # within a term by document
        terms, counts, self.docs = terms[order], counts[order], owner[order]
        self.adds = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * norms[self.docs]))
        heads = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
        ends = np.concatenate((heads[1:], [len(terms)])) if len(heads) else heads
        most = np.maximum.reduceat(self.adds, heads) if len(heads) else heads
        self.lists = {t: (a, b, m) for t, a, b, m in zip(terms[heads].tolist(), heads.tolist(), ends.tolist(), most.tolist())}

    def search(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best and their scores. ``query``: (term, times), rarest first;
        ``floor``: a score that k documents are known to reach (0: none)."""
        met = [(*self.lists[t], times) for t, times in query if t in self.lists]
        left = sum(most * times for _, _, most, times in met)
        total = np.zeros(self.size, dtype=np.int64)
        made = np.zeros(self.size, dtype=bool)
        survivors = scores = None
        for a, b, most, times in met:
            docs, adds = self.docs[a:b], self.adds[a:b] * times
            if survivors is None:
                partial = total[made]
                kth = max(floor, int(np.partition(partial, -k)[-k]) if len(partial) >= k else 0)
                if left < kth:
                    survivors = np.flatnonzero(made)
                    scores = total[survivors]
            if survivors is None:
                total[docs] += adds
                made[docs] = True
            elif len(survivors):
                at = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                scores += np.where(docs[at] == survivors, adds[at], 0)
            left -= most * times
        if survivors is None:
            survivors = np.flatnonzero(made)
            scores = total[survivors]
        return survivors, scores


def _order(best: tuple) -> tuple:
    score, doc_id = best
    return -score, doc_id is None, 0 if doc_id is None else doc_id


class Searcher:
    """The k best documents of each query over the blocks of a task."""

    def __init__(self, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries, self.weights, self.n_docs, self.n_terms, self.k = queries, weights, n_docs, n_terms, k
        self.best: list[list[tuple]] = [[] for _ in queries]

    def add(self, ids: list, sizes: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        norms = np.array([25 + 75 * n * self.n_docs // self.n_terms for n in sizes.tolist()], dtype=np.int64)
        block = Block(norms, owner, terms, counts, self.weights)
        for i, query in enumerate(self.queries):
            best = self.best[i]
            found, scores = block.search(query, self.k, best[-1][0] if len(best) == self.k else 0)
            if len(scores) > self.k:
                top = scores >= np.partition(scores, -self.k)[-self.k]
                found, scores = found[top], scores[top]
            new = [(s, ids[d]) for d, s in zip(found.tolist(), scores.tolist()) if s > 0]
            self.best[i] = sorted(best + new, key=_order)[: self.k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, sizes, owner, terms, counts) of the documents of some batches."""

    def joined(held: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [table.column(c).combine_chunks() for c in ("terms", "counts")]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        terms, counts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        owner = np.repeat(np.arange(table.num_rows), np.diff(lists[0].offsets.to_numpy()))
        return table.column("doc_id").to_pylist(), table.column("n").to_numpy(), owner, terms, counts

    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield joined(held)
            held, docs, postings = [], 0, 0
    if docs:
        yield joined(held)


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items (id, terms with their times) in blocks; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        terms = Counter(terms_of(row["text"]))
        if terms:
            block.append((row["item_id"], terms))
            size += sum(map(len, terms))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple], k: int, schema: T.StructType) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    counted = write_out(term_counts(docs, vocabulary), "search-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term at most
        frequency[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], dtype=np.int64)
    queries = [sorted(((vocabulary[t], times) for t, times in terms.items()), key=lambda q: (frequency[q[0]], q[0])) for _, terms in block]
    item_ids = [item_id for item_id, _ in block]
    shared = PerWorker(docs.sparkSession, (queries, weights, n_docs, n_terms, item_ids), lambda x: x)
    fields = to_arrow_schema(schema)

    def run(batches):
        *plan, names = shared.get()
        searcher = Searcher(*plan, k)
        for part in _blocks(batches):
            searcher.add(*part)
        rows = [(i, names[i], doc_id, score) for i, best in enumerate(searcher.best) for score, doc_id in best]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)

    found = counted.where(F.size("terms") > 0).mapInArrow(run, schema)
    line = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, fewer if fewer score above 0."""
    schema = T.StructType([
        T.StructField("item", T.IntegerType()),
        T.StructField("item_id", field_type(items, "item_id")),
        T.StructField("doc_id", field_type(docs, "doc_id")),
        T.StructField("score", T.LongType()),
    ])
    chosen = docs.select("doc_id", "text")
    names = ["item_id", "rank", "doc_id", "score"]
    result = None
    for block in _item_blocks(items.select("item_id", "text"), block_bytes):
        found = write_out(_search_block(chosen, block, k, schema).select(names), "search-found")
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1)).select(names)
    return result
