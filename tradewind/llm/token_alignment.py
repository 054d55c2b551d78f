"""Alignment of the tokens of two tokenizers, with a fast path for tokens of the same bytes.

Both tokenizers see a blank and the text (the second one adds the blank itself). Where a token of each ends at the same
byte, the text is cut into groups, and all pairs of one token of either side in a group are linked. How many documents
hold a pair linked says how well two ids correspond.

Most groups are one token of either side with the same bytes. For these an array, made once, gives the second
tokenizer's id for each of the first one's, and their documents are counted in vectors as long as the vocabulary.
Pairs of other groups are irregular; only they enter a shuffle, counted by chunk of documents first, and their counts
come back to the chunk as rows. Texts are not shuffled, and encoded once.

Neither tokenizer joins across the blank after a character that is not white space; the text is cut there into units, and
each distinct unit is encoded and aligned once per task (``REMEMBERED`` of them are kept, beyond that a task starts anew).
A text in which a unit's tokens do not spell the unit has no tokens.

Null and empty texts have no tokens. Every row is a document, also rows with the same id. Empty tables give empty
results; a text of any length is one row; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tradewind.llm.common import bounded_batches, pick
from tradewind.llm.trie_bpe import byte_symbols
from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Units a task remembers and their characters in all.
REMEMBERED = 200_000
REMEMBERED_CHARS = 6_000_000
_WORD_MARK = "▁"
# Rows cut and aligned at a time; bounds the memory of a task and changes no result.
ROWS_AT_ONCE = 200
# How the byte-level vocabulary file cuts a text, and the same as a pattern.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(r"(?<=\S) ")


def units(text: str) -> list[str]:
    """The blank and the text, cut before every blank that follows a character that is not white space."""
    return [" " + part for part in _CUT.split(text)] if text else []


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the second one's id with the same bytes for each id of the first."""

    def __init__(self, first: str, second: bytes):
        file = json.loads(first)
        vocab, split = file["model"]["vocab"], file["pre_tokenizer"]
        merges = (m.split(" ", 1) if isinstance(m, str) else m for m in file["model"]["merges"])
        symbols = byte_symbols()
        special = {t["content"] for t in file["added_tokens"]}
        plain = {bytes(symbols[c] for c in name): i for name, i in vocab.items() if name not in special}
        # With ids in the order of the merges, the same vocabulary as ranks gives the same tokens.
        if split != _BYTE_LEVEL or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("a byte-level vocabulary whose ids follow its merges is needed")
        self.first = tiktoken.Encoding("first", pat_str=_PATTERN, mergeable_ranks=plain, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.first_bytes = [b""] * (max(plain.values()) + 1)
        for name, i in plain.items():
            self.first_bytes[i] = name
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        if any(regex.search(f"[^{_WORD_MARK}]{_WORD_MARK}", self.second.id_to_piece(i)) for i in range(len(self.second_bytes))):
            raise ValueError("the second vocabulary joins words, so texts cannot be cut before blanks")
        lowest: dict[bytes, int] = {}
        for i, piece in enumerate(self.second_bytes):
            if piece and not self.second.is_byte(i):
                lowest.setdefault(piece, i)
        self.same = np.array([lowest.get(b, -1) for b in self.first_bytes], np.int64)
        self.first_sizes, self.second_sizes = (np.array([len(b) for b in side], np.int64) for side in (self.first_bytes, self.second_bytes))

    def _piece(self, i: int) -> bytes:
        if self.second.is_control(i) or self.second.is_unknown(i):
            return b""
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(_WORD_MARK, " ").encode()

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Tokens of both sides for each unit, and whether they spell it; those that do not have none."""
        firsts = [self.first.encode_ordinary(part) for part in parts]
        seconds = self.second.encode([part[1:] for part in parts], num_threads=1)
        spelt = []
        for i, part in enumerate(parts):
            if part == " ":  # the end of a text; nothing is added to an empty string
                seconds[i] = [self.second.piece_to_id(_WORD_MARK)]
            whole = part.encode()
            same = b"".join([self.first_bytes[t] for t in firsts[i]]) == whole == b"".join([self.second_bytes[t] for t in seconds[i]])
            spelt.append(same)
            if not same:
                firsts[i], seconds[i] = [], []
        return firsts, seconds, spelt


class _Units:
    """Aligned units by number: figures, written groups, and links as flat arrays (id pairs as one number)."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.chars = 0
        self.figures = np.zeros((0, 4), np.int64)
        self.regular = self.pairs = np.zeros(0, np.int64)
        self.regular_ends = self.pair_ends = np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.written) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def learn(self, parts: list[str]) -> None:
        """Align new units, all at once: their bytes laid end to end, a group ends where a token of either side does."""
        known, n = self.tokenizers, len(parts)
        firsts, seconds, spelt = known.encode(parts)
        n_a, n_b = (np.fromiter(map(len, side), np.int64, n) for side in (firsts, seconds))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (firsts, seconds))
        end_a, end_b = np.cumsum(known.first_sizes[a]), np.cumsum(known.second_sizes[b])
        both = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.int8)
        both[end_a] += 1
        both[end_b] += 1
        before = np.cumsum(both == 2)
        group_a, group_b = before[end_a] - (both[end_a] == 2), before[end_b] - (both[end_b] == 2)
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        unit_a = np.repeat(np.arange(n), n_a)
        begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        unit = unit_a[begin_a] if len(a) else np.zeros(0, np.int64)
        links = size_a * size_b

        # All links, in the order of the first side.
        times = size_b[group_a] if len(a) else np.zeros(0, np.int64)
        link_a, link_unit = np.repeat(a, times), np.repeat(unit_a, times)
        skip = np.repeat(np.cumsum(times) - times, times)
        link_b = b[np.repeat(begin_b[group_a], times) + np.arange(len(link_a)) - skip] if len(a) else link_a
        same = known.same[link_a] == link_b
        self.regular = np.append(self.regular, link_a[same])
        self.pairs = np.append(self.pairs, (link_a << 32 | link_b)[~same])
        self.regular_ends = np.append(self.regular_ends, self.regular_ends[-1] + np.cumsum(np.bincount(link_unit[same], minlength=n)))
        self.pair_ends = np.append(self.pair_ends, self.pair_ends[-1] + np.cumsum(np.bincount(link_unit[~same], minlength=n)))
        sums = [np.where(spelt, n_a, -1), n_b, np.bincount(unit, minlength=n), np.bincount(unit, links, minlength=n).astype(np.int64)]
        self.figures = np.append(self.figures, np.stack(sums, axis=1), axis=0)

        texts = []
        for x, y, i, j, k, l in zip(size_a.tolist(), size_b.tolist(), a[begin_a].tolist(), b[begin_b].tolist(), begin_a.tolist(), begin_b.tolist()):
            if x == y == 1:
                texts.append(f"{i}|{j}")
            else:
                texts.append(",".join(map(str, a[k : k + x].tolist())) + "|" + ",".join(map(str, b[l : l + y].tolist())))
        ends = np.cumsum(sums[2]).tolist()
        for part, begin, end in zip(parts, [0, *ends], ends):
            self.number[part] = len(self.written)
            self.chars += len(part)
            self.written.append(";".join(texts[begin:end]))


def _counted(values: np.ndarray, ends: np.ndarray, unit: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of the units of a document and how often each is linked there."""
    sizes = ends[unit + 1] - ends[unit]
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.repeat(ends[unit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    found, place = np.unique(values[at], return_inverse=True)
    return found, np.bincount(place, np.repeat(times, sizes)).astype(np.int64)


_DOCUMENT = "chunk bigint, key {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, regular array<int>, regular_links array<int>, pairs array<int>, pair_links array<int>, chunk_regular array<int>, chunk_regular_docs array<int>, chunk_pairs array<bigint>, chunk_pair_docs array<int>"


def _aligned(rows: DataFrame, first, second, with_groups: bool) -> DataFrame:
    """A row per document with its links; the first row of a chunk has the documents of its regular ids and of its pairs.
    ``pairs`` are places in the chunk's pairs."""
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = [part.split(" ")[0] for part in _DOCUMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Units(Tokenizers(first.value, second.value))
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            vector = np.zeros(len(known.tokenizers.same), np.int64)
            columns: dict[str, list] = {name: [] for name in names[2:12]}
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                if known.full():
                    known.forget()
                cut = [units(text or "") for text in batch.column("text").slice(begin, ROWS_AT_ONCE).to_pylist()]
                if new := list(dict.fromkeys(u for parts in cut for u in parts if u not in known.number)):
                    known.learn(new)
                for parts in cut:
                    unit = np.array([known.number[u] for u in parts], np.int64)
                    if len(unit) and known.figures[unit, 0].min() < 0:
                        unit = unit[:0]
                    sums = known.figures[unit].sum(axis=0).tolist()
                    written = ";".join([known.written[u] for u in unit.tolist()])
                    distinct, times = np.unique(unit, return_counts=True)
                    ids, id_links = _counted(known.regular, known.regular_ends, distinct, times)
                    own, own_links = _counted(known.pairs, known.pair_ends, distinct, times)
                    vector[ids] += 1
                    digest = hashlib.sha256(written.encode()).hexdigest() if written else ""
                    for name, value in zip(columns, [*sums, digest, written if with_groups else None, ids, id_links, own, own_links]):
                        columns[name].append(value)
            sizes = [len(p) for p in columns["pairs"]]
            chunk_pairs, place, pair_docs = np.unique(np.concatenate(columns["pairs"]), return_inverse=True, return_counts=True)
            columns["pairs"] = np.split(place, np.cumsum(sizes)[:-1])
            rest = [None] * (batch.num_rows - 1)
            used = np.flatnonzero(vector)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), *[ints] * 4]
            chunk = pa.array([(partition << 32) + number] * batch.num_rows, pa.int64())
            arrays = [chunk, batch.column("key"), *[pa.array(c, kind) for c, kind in zip(columns.values(), kinds)]]
            arrays += [pa.array([x, *rest], kind) for x, kind in ((used, ints), (vector[used], ints), (chunk_pairs, longs), (pair_docs, ints))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, _DOCUMENT.format(key=rows.schema["key"].dataType.simpleString()))


def _vector(rows, length: int) -> np.ndarray:
    vector = np.zeros(length, np.int64)
    for i, value in rows:
        vector[i] = value
    return vector


def align(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Per document its id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in as many documents as
    any pair of its first id), ``count_sum`` (documents of the pair, over all links), ``groups_sha256`` and, if wanted, the ``groups``
    as text: ``a1,a2|b1;a3|b2,b3``, first side before second.

    ``first`` is a byte-level vocabulary file, ``second`` a piece model; their content (a few MB, fixed) is sent to the tasks."""
    spark = bounded_batches(df)
    rows = pick(df, key=id_col, text=text_col)
    content = Path(first).read_text(encoding="utf-8"), Path(second).read_bytes()
    length = len(Tokenizers(*content).same)
    stored = stage(_aligned(rows, *map(spark.sparkContext.broadcast, content), with_groups), "aligned")

    regular = stored.select(F.arrays_zip("chunk_regular", "chunk_regular_docs").alias("z")).select(F.inline("z"))
    vector = _vector(regular.groupBy("chunk_regular").agg(F.sum("chunk_regular_docs")).collect(), length)
    zipped = F.arrays_zip("chunk_pairs", "chunk_pair_docs")
    pairs = stored.filter("size(chunk_pairs) > 0").select("chunk", F.posexplode(zipped).alias("place", "z")).select("chunk", "place", F.col("z.chunk_pairs").alias("pair"), F.col("z.chunk_pair_docs").alias("docs"))
    counts = stage(pairs.withColumn("count", F.sum("docs").over(Window.partitionBy("pair"))).select("chunk", "place", "pair", "count"), "pair-counts")
    highest = _vector(counts.groupBy(F.shiftright("pair", 32).cast("int")).agg(F.max("count")).collect(), length)
    # Both are as long as the vocabulary.
    sent = spark.sparkContext.broadcast((vector, np.maximum(vector, highest)))

    figures = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    used = ["chunk", "key", *figures, "regular", "regular_links", "pairs", "pair_links"]
    result = T.StructType([T.StructField(n, stored.schema[n].dataType) for n in ["key", *figures]] + [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")])

    def counted(documents: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        regular_count, best = sent.value
        found = found.sort_values("place")
        count = found["count"].to_numpy()
        is_best = count == best[found["pair"].to_numpy() >> 32]
        regular_best = regular_count == best
        n_best, count_sum = [], []
        for ids, links, own, own_links in zip(*(documents[c] for c in used[-4:])):
            n_best.append(int(links[regular_best[ids]].sum() + own_links[is_best[own]].sum()))
            count_sum.append(int(links @ regular_count[ids] + own_links @ count[own]))
        return documents[["key", *figures]].assign(n_best=n_best, count_sum=count_sum)

    joined = stored.select(*used).groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(counted, result)
    return joined.withColumnRenamed("key", id_col)
