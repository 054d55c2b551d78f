"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case without punctuation, with single blanks. A benchmark item is searched as a whole, or
in overlapping segments if it is long, so that a part of it is found as well: of an item with more than 62 characters
every excerpt of at least 64 (segment plus step less one) is found, of shorter ones the whole. Items below the least
length for edits are found as exact sequences of whole words, however few. A segment of m characters that stands
in a document with at most e edits shares at least m + 1 - q (e + 1) of its q-grams with the document, and these lie
on diagonals (place in the document less place in the segment) that differ by at most e. So shared q-grams are
counted in diagonal bands of width 2e that overlap by half; every window of e + 1 diagonals lies in one of them.
Only bands that reach the bound are aligned, with dynamic programming inside the band, and kept if the best alignment
of the segment needs at most e edits.

Documents are read once and nothing is shuffled but what was found. The benchmark is sent to all tasks in blocks of a
bounded size, one pass each. Shared q-grams are counted before they are listed: where a text and the items repeat
themselves, so that there are many, the text is halved (halves overlap by more than a match) and then the items, until
a bounded number is left; items are held in parts of a bounded length. Parts that have been found whole, without edits, are not
searched any further.

Null or empty texts and items match nothing. Ids may be of any type; items without an id are found under the null id.
Equal items are found each under their own id, equal documents each in their own row. Long texts are searched whole, in
pieces that overlap. An empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tradewind.llm.common import pick
from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Length of q-grams, edits per character of a segment, length of segments and their step, least length of an item that
# may have edits (from there on the lemma's bound is positive).
Q, EDIT_RATE, SEGMENT, STEP, LEAST = 10, 0.08, 60, 5, 40
# Characters of benchmark items in one block, which bounds what a task holds.
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 24
_CHUNK = 1_000_000
# Alignments done at once.
_ALIGNED = 4096
# Segments in one part of an item, shared q-grams listed at once, characters of a text that no match exceeds.
_PART, _LISTED, _OVERLAP = 400, 1_000_000, 2 * (SEGMENT + STEP)

_PARTS = re.compile(r"\w+").findall


def normal(text: str | None) -> str:
    """Lower case, words and digits only, single blanks."""
    return " ".join(_PARTS((text or "").lower()))


def edits_allowed(length: int) -> int:
    return int(length * EDIT_RATE)


def shared_needed(length: int) -> int:
    """The bound of the q-gram lemma for a segment of that length."""
    return length + 1 - Q * (edits_allowed(length) + 1)


def segments(text: str) -> list[tuple[int, str]]:
    """Place and text of an item's segments; the last one ends with the item."""
    if len(text) <= SEGMENT + STEP // 2:
        return [(0, text)]
    starts = [*range(0, len(text) - SEGMENT, STEP), len(text) - SEGMENT]
    return [(s, text[s : s + SEGMENT]) for s in starts]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Rolling 64-bit hashes of the q-grams."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, c = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for i in range(Q):
        total = total * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Q-grams of a block of items, taken in parts of at most ``_PART`` segments, each with the parts that hold it and
    its places there."""

    def __init__(self, items: list[tuple[object, str]]):
        # Per part: item, place in the item, text, places of segments in the part, their length.
        self.items, self.places, self.texts, self.starts, lengths = [], [], [], [], []
        for item, text in items:
            if len(text) < LEAST:
                continue
            codes, own = _codes(text), segments(text)
            places, length = np.array([place for place, _ in own], np.int64), len(own[0][1])
            for some in (places[i : i + _PART] for i in range(0, len(places), _PART)):
                self.items.append(item)
                self.places.append(int(some[0]))
                self.texts.append(codes[some[0] : some[-1] + length])
                self.starts.append(some - some[0])
                lengths.append(length)
        self.lengths = np.array(lengths, np.int64)
        self.edits = np.array([edits_allowed(n) for n in lengths], np.int64)
        self.needed = np.array([max(1, shared_needed(n)) for n in lengths], np.int64)
        hashes = [grams(t) for t in self.texts]
        counts = [len(h) for h in hashes]
        self.hashes, gram = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]), return_inverse=True)
        # Entries by q-gram and part, so that those of a range of parts lie together.
        entries = (gram << 32) + np.repeat(np.arange(len(hashes)), counts)
        order = np.argsort(entries, kind="stable")
        self.entries = entries[order]
        self.place = np.concatenate([*(np.arange(n) for n in counts), np.empty(0, np.int64)])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # Short items between blanks: per length the hashes, and the items of each text.
        self.short: dict[bytes, list] = {}
        for item_id, text in items:
            if 0 < len(text) < LEAST:
                self.short.setdefault(_codes(f" {text} ").tobytes(), []).append(item_id)
        by_length: dict[int, list[np.ndarray]] = {}
        for key in self.short:
            by_length.setdefault(len(key) // 4, []).append(np.frombuffer(key, np.uint32))
        self.short_hashes = {n: np.unique([window_hashes(c, np.zeros(1, np.int64), n)[0] for c in found]) for n, found in by_length.items()}

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text of q-grams that items have, and which ones these are."""
        at = np.nonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])[0]
        gram = np.searchsorted(self.hashes, hashes[at])
        same = self.hashes[np.minimum(gram, len(self.hashes) - 1)] == hashes[at]
        return at[same], gram[same]

    def entries_of(self, gram: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """First entry of each q-gram in the parts ``low`` to ``high`` (exclusive), and how many there are."""
        first = np.searchsorted(self.entries, (gram << 32) + low)
        return first, np.searchsorted(self.entries, (gram << 32) + high) - first


def window_hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the windows of one length that begin at ``starts``."""
    total = np.zeros(len(starts), np.uint64)
    for i in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[starts + i]
    return total


def short_matches(codes: np.ndarray, index: Index) -> Iterator[tuple[object, int, int]]:
    """(item, length, end in the text without its first blank) of short items that are whole words of ``codes``, a
    normalised text between blanks; the first place only."""
    blanks = np.nonzero(codes == 32)[0]
    for n, hashes in index.short_hashes.items():
        starts = blanks[blanks + n <= len(codes)]
        starts = starts[codes[starts + n - 1] == 32]
        found = window_hashes(codes, starts, n)
        places = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        seen = set()
        for start in starts[hashes[places] == found].tolist():
            key = codes[start : start + n].tobytes()
            if key not in seen:
                seen.add(key)
                for item in index.short.get(key, ()):
                    yield item, n - 2, start + n - 2


def banded_edits(text: np.ndarray, parts: np.ndarray, firsts: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of an alignment of each whole segment (a row of ``parts``) inside its band, and where it ends in the text.

    Row i of a band holds the text ends ``first + i + 0 .. width``; the alignment may begin anywhere on the first row.
    """
    best, at = np.full(len(parts), most + 1), np.full(len(parts), -1)
    alive = np.arange(len(parts))
    slide = np.arange(width + 1)
    ends = firsts[:, None] + slide
    row = np.where((ends >= 0) & (ends <= len(text)), 0, most + 1)
    for i in range(parts.shape[1]):
        ends = ends + 1
        inside = (ends >= 1) & (ends <= len(text))
        equal = inside & (text[np.clip(ends - 1, 0, len(text) - 1)] == parts[alive, i][:, None])
        step = row + ~equal  # a character against a character
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # one of the segment left out
        step = np.where((ends >= 0) & (ends <= len(text)), step, most + 1)
        row = np.minimum.accumulate(step - slide, axis=1) + slide  # further ones of the text
        left = row.min(axis=1) <= most
        if not left.all():
            alive, ends, row = alive[left], ends[left], row[left]
            if not len(alive):
                return best, at
    place = row.argmin(axis=1)
    best[alive], at[alive] = row[np.arange(len(alive)), place], ends[np.arange(len(alive)), place]
    return best, at


def matches(codes: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(part, place of the segment in it, edits, end in the text) of every segment found in a normalised text, its best
    place only."""
    at, gram = index.shared(grams(codes))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(at):
        return
    # Segments of each part not yet found without edits.
    missing = np.array([len(starts) for starts in index.starts])
    todo = [(0, len(codes), 0, len(missing))]
    while todo:
        first, last, low, high = todo.pop()
        rows = slice(*np.searchsorted(at, (first, last)))
        if at[rows].size < index.needed.min() or not missing[low:high].any():
            continue
        begin, many = index.entries_of(gram[rows], low, high)
        if many.sum() <= _LISTED or (last - first <= 4 * _OVERLAP and high - low == 1):
            listed = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            _match(codes, index, np.repeat(at[rows], many), index.entries[listed] & 0xFFFFFFFF, index.place[listed], best, missing)
        elif last - first > 4 * _OVERLAP:
            middle = (first + last) // 2
            todo += [(middle, last, low, high), (first, middle + _OVERLAP, low, high)]
        else:
            middle = (low + high) // 2
            todo += [(first, last, middle, high), (first, last, low, middle)]
    for (k, start), (edits, end) in best.items():
        yield k, start, edits, end


def _match(
    codes: np.ndarray, index: Index, rows: np.ndarray, item: np.ndarray, place: np.ndarray, best: dict, missing: np.ndarray
) -> None:
    """Adds what the shared q-grams (places in the text, parts, places there) lead to to ``best``."""

    def keep(k: int, start: int, found: tuple[int, int]) -> None:
        known = best.get((k, start), (SEGMENT, 0))
        missing[k] -= known[0] > 0 and found[0] == 0
        best[k, start] = min(known, found)

    half = np.maximum(index.edits, 1)
    diagonal = rows - place
    # Band b holds the diagonals [b * half, (b + 2) * half); each diagonal is in two of them.
    keys = (item << 32) + np.floor_divide(diagonal, half[item]) + (1 << 30)
    keys = np.concatenate([keys, keys - 1])
    unique, counts = np.unique(keys, return_counts=True)
    full = unique[counts >= index.needed[unique >> 32]]
    if not len(full):
        return
    place, diagonal = np.concatenate([place, place]), np.concatenate([diagonal, diagonal])
    order = np.nonzero(np.isin(keys, full))[0]
    order = order[np.lexsort((place[order], keys[order]))]
    low, high = np.searchsorted(keys[order], full, "left"), np.searchsorted(keys[order], full, "right")
    open_: dict[int, list[tuple[int, int, int]]] = {}
    for key, a, z in zip(full.tolist(), low, high):
        k, b = key >> 32, (key & 0xFFFFFFFF) - (1 << 30)
        if not missing[k]:
            continue
        own, m = order[a:z], int(index.lengths[k])
        # The bound holds for each segment: shared q-grams that lie inside it.
        starts = index.starts[k]
        shared = np.searchsorted(place[own], starts + m - Q, "right") - np.searchsorted(place[own], starts, "left")
        starts = starts[shared >= index.needed[k]]
        if not len(starts):
            continue
        straight = int(np.bincount(diagonal[own] - diagonal[own].min()).argmax() + diagonal[own].min())
        text = index.texts[k]
        at = np.arange(len(text)) + straight
        differ = (at < 0) | (at >= len(codes)) | (codes[np.clip(at, 0, len(codes) - 1)] != text)
        differ = np.concatenate([[0], np.cumsum(differ)])
        for start, n in zip(starts.tolist(), (differ[starts + m] - differ[starts]).tolist()):
            if not n:
                keep(k, start, (0, straight + start + m))
            elif best.get((k, start), (1, 0))[0]:
                open_.setdefault(m, []).append((k, start, b))
    for m, some in open_.items():
        e = edits_allowed(m)
        some = [x for x in some if best.get(x[:2], (1, 0))[0]]
        for i in range(0, len(some), _ALIGNED):
            now = some[i : i + _ALIGNED]
            parts = np.array([index.texts[k][start : start + m] for k, start, _ in now])
            firsts = np.array([start + b * max(e, 1) - e for _, start, b in now])
            for (k, start, _), edits, end in zip(now, *(x.tolist() for x in banded_edits(codes, parts, firsts, 2 * max(e, 1) + 2 * e, e))):
                if edits <= e:
                    keep(k, start, (edits, end))


def _search(sent, names: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                codes = _codes(f" {normal(text)} ")
                best: dict[tuple[int, int], tuple[int, int]] = {}
                short: dict[object, tuple[int, int]] = {}
                # Long texts in pieces that overlap by more than the longest match.
                for start in range(0, max(1, len(codes) - _OVERLAP), _CHUNK):
                    piece = codes[start : start + _CHUNK + _OVERLAP]
                    for item, length, end in short_matches(piece, index):
                        short.setdefault(item, (length, start + end))
                    for k, place, edits, end in matches(piece, index):
                        best[k, place] = min(best.get((k, place), (edits, start + end - 1)), (edits, start + end - 1))
                found += [(i, index.items[k], index.places[k] + place, int(index.lengths[k]), e, end) for (k, place), (e, end) in best.items()]
                found += [(i, item, 0, length, 0, end) for item, (length, end) in short.items()]
            columns = list(zip(*found)) or [[]] * 6
            rows = batch.take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("text_hash"), pa.array(columns[1], kind),
                 *[pa.array(c, pa.int32()) for c in columns[2:]]],
                names=names,
            )

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, streamed through the driver; only one block is held at a time."""
    block, size = [], 0
    for row in pick(benchmark, id=id_col, text=text_col).filter("text IS NOT NULL").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        block.append((row["id"], text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and segment found in it: ``id``, ``text_hash``, ``item_id``, the ``place`` and ``length`` of
    the segment in the normalised item, ``edits``, and where it ends in the normalised document."""
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    names = ["id", "text_hash", "item_id", "place", "length", "edits", "end"]
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"id {kind}, text_hash long, item_id {item_kind.simpleString()}, place int, length int, edits int, end int"
    result = None
    for block in benchmark_blocks(benchmark):
        sent = df.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_search(sent, names, to_arrow_type(item_kind)), schema)
        result = found if result is None else result.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if result is None else result


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item: ``id``, ``text_hash``, ``item_id``, ``segments`` found and the fewest ``edits``."""
    found = find_passages(df, benchmark, id_col, text_col)
    return found.groupBy("id", "text_hash", "item_id").agg(F.count_distinct("place").alias("segments"), F.min("edits").alias("edits"))


def without_passages(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text holds a benchmark passage; clean rows stay, with all columns."""
    found = find_passages(df, benchmark, id_col, text_col).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    found = stage(found, "passages")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    return df.join(found, same, "left_anti")
