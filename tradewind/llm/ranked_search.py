"""Ranked lexical search: term at a time, rarest first, with a limit on accumulators.

The documents' terms that queries ask for are stored once, a row per document. Spark counts documents, terms and the
documents of each term, and finds the highest part a term can add to a score. Then every task inverts its documents, a batch
at a time, and works off the terms of a query from the rarest on: a posting opens an accumulator or adds to one. As
soon as the parts of the remaining terms together cannot reach the k-th best partial score, no accumulator is opened any
more; those that are open are updated to the end, so their scores are exact. A task carries its best k over its batches,
which closes accumulators early; Spark merges the best k of all tasks. A document that never got an accumulator
cannot be among the best, so results equal those of a full evaluation.

Queries are worked off in blocks of ``BLOCK_CHARS`` characters, so what is sent to the tasks is bounded by that and the
longest query. All documents and all their terms count, in every block.

Null text has no terms; a null query has no results. Equal scores are ranked by ascending id, null ids first; rows with
the same id are ranked one by one. Ids of documents are whole numbers, ids of queries of any type. Empty tables give empty results; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tradewind.llm.common import bounded_batches, pick
from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CHARS = 4_000_000
# Letters, digits and all that is not ASCII make up terms; only A-Z are folded.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SCALE = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _document_terms(docs: DataFrame, numbers) -> DataFrame:
    """Per document: id, number of its terms, and which of the asked terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            lengths, held, often = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                found = Counter(map(known.get, words))
                found.pop(None, None)
                lengths.append(len(words))
                held.append(list(found))
                often.append(list(found.values()))
            arrays = [batch.column("doc"), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tf array<bigint>")


def _ends_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class _Batch:
    """Inverted documents: for each term the documents that hold it and what it adds to their scores."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, total: int):
        self.ids = batch.column("doc")
        n = batch.column("n").to_numpy()
        lists = batch.column("terms")
        sizes = pa.compute.list_value_length(lists).to_numpy()
        term, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(len(n)), sizes)[order]
        longness = 10 + (90 * n.astype(object) * documents // max(total, 1)).astype(np.int64)
        part = _SCALE * tf // (1000 * tf + 8 * np.repeat(longness, sizes))
        self.part = (weights[term] * part)[order]
        self.begins = _ends_of(np.bincount(term, minlength=len(weights)))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begins[term], self.begins[term + 1]
        return self.doc[a:b], self.part[a:b]

    def best(self, query: np.ndarray, remaining: np.ndarray, k: int, least: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with an accumulator for the query and their scores. ``remaining[i]`` is the most that the terms from
        the i-th on can add, ``least`` what the best so far demand, ``scores`` an array of zeros that is left so."""
        opened, closed = np.zeros(0, np.int64), False
        for i, term in enumerate(query):
            docs, part = self.postings(term)
            if not closed and len(opened) >= k:
                partial = scores[opened]
                least = max(least, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            closed = closed or remaining[i] < least
            if closed and not len(opened):
                break
            if not closed:
                opened = np.concatenate([opened, docs[(scores[docs] == 0) & (part > 0)]])
                scores[docs] += part
            else:
                # Survivors are updated exactly; what has no accumulator gets none.
                held = scores[docs] > 0
                scores[docs[held]] += part[held]
        found = scores[opened]
        scores[opened] = 0
        return opened, found


def _ranked(stored: DataFrame, plan, k: int, schema: T.StructType) -> DataFrame:
    item_type = to_arrow_type(schema["item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, highest, documents, total = plan.value
        bounds = [np.concatenate([np.cumsum((weights[q] * highest[q])[::-1])[::-1], [0]]) for _, q in queries]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            inverted = _Batch(batch, weights, documents, total)
            missing = inverted.ids.is_null().to_numpy(zero_copy_only=False)
            ids = inverted.ids.fill_null(0).to_numpy()
            scores = np.zeros(batch.num_rows, np.int64)
            for number, (_, query) in enumerate(queries):
                old_ids, old_scores, old_missing = best[number]
                least = int(old_scores[-1]) if len(old_scores) == k else 1
                docs, found = inverted.best(query, bounds[number], k, least, scores)
                enough = found >= least
                docs, found = docs[enough], found[enough]
                if not len(docs):
                    continue
                all_ids, all_scores, all_missing = np.append(old_ids, ids[docs]), np.append(old_scores, found), np.append(old_missing, missing[docs])
                order = np.lexsort((all_ids, ~all_missing, -all_scores))[:k]
                best[number] = all_ids[order], all_scores[order], all_missing[order]
        for (item, _), (ids, scores, missing) in zip(queries, best):
            if len(ids):
                arrays = [pa.array([item] * len(ids), item_type), pa.array(ids, mask=missing), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return stored.mapInArrow(run, schema)


def _blocks(queries: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """The queries in blocks, in an order that every reading of the table gives; a task's rows at a time reach the driver."""
    block, size = [], 0
    for row in queries.toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``query_id_col``, ``rank``, ``id_col`` and ``score`` of the ``k`` documents with the highest scores above 0 for each query.

    A term of weight w = floor(1000 ln((2 N + 2) / (2 df + 1))) that a document of n terms holds tf times adds
    w * (1000000000 tf div (1000 tf + 8 m)) with m = 10 + 90 n N div L; N documents have terms, L in all."""
    spark = bounded_batches(docs)
    rows = pick(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("bigint"))
    asked = pick(queries, item=query_id_col, text=query_col).filter("text IS NOT NULL")
    item_type = asked.schema["item"].dataType
    schema = T.StructType([T.StructField("item", item_type), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    results = [spark.createDataFrame([], schema)]
    for block in _blocks(asked, block_chars):
        words = [dict.fromkeys(terms(text)) for _, text in block]
        numbers: dict[bytes, int] = {}
        for word in (w for ws in words for w in ws):
            numbers.setdefault(word, len(numbers))
        sent = spark.sparkContext.broadcast(numbers)
        stored = stage(_document_terms(rows, sent), "document-terms")
        documents, total = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        sent.destroy()
        held = stored.select(F.posexplode("terms").alias("i", "term"), "n", "tf").withColumn("tf", F.expr("tf[i]"))
        longness = F.expr(f"10 + 90 * n * {documents} DIV {max(total, 1)}")
        part = F.expr(f"{_SCALE} * tf DIV (1000 * tf + 8 * m)")
        counted = held.withColumn("m", longness).groupBy("term").agg(F.count("*").alias("df"), F.max(part).alias("highest")).collect()
        weights, highest = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for row in counted:
            weights[row["term"]] = int(np.floor(1000 * np.log((2 * documents + 2) / (2 * row["df"] + 1))))
            highest[row["term"]] = row["highest"]
        plan = []
        for (item, _), own in zip(block, words):
            query = np.array([numbers[w] for w in own], np.int64)
            query = query[weights[query] > 0] if len(query) else query
            plan.append((item, query[np.lexsort((query, -weights[query]))]))
        sent = spark.sparkContext.broadcast((plan, weights, highest, documents, total))
        results.append(stage(_ranked(stored, sent, k, schema), "ranked-block"))
        sent.destroy()
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    ranked = reduce(DataFrame.unionByName, results).withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(query_id_col), "rank", F.col("doc").alias(id_col), "score")
