"""Documents with a high Jaccard similarity of their word n-grams, by adaptive multi-match prefixes.

All shingles stand in one global order, rare ones first. If two sets have at least ``o`` shingles in common, their
prefixes of length ``n - o + k`` have at least ``k`` in common, for every k. For k = 1 that is the usual prefix filter.
A document takes a longer prefix (a larger k) where its prefix holds frequent shingles and the estimated number of
candidates falls by more than the longer prefix costs; a pair is then a candidate if it shares as many prefix shingles
as the smaller k of the two asks for. What two sets of known sizes must share is more than ``o``; so a shared shingle
counts for a pair only if enough shingles follow it in both sets, and a posting is dropped where that holds for no
partner of its list. Candidates are verified on the whole sets.

The order needs frequencies only to be good, not to be right: shingles are counted into a fixed number of buckets over
all documents (with copies counted once per task), and the order is by the count of the bucket, then by the hash. What
a count exceeds the usual one of a bucket by estimates the frequency.

Equal sets are one node from the start. In a posting list nodes are first compared with one leader, that with the
largest share of frequent or shared shingles, as the original of edited copies has; those that are alike become a component, and lists whose nodes all belong to one component are done. So a group of copies costs as
much as it has members, not pairs. What is left, pairs of different components in one list, is listed in full and
verified, so that no link between two components is lost. Frequent shingles are dealt out over lists of a bounded
length whose leaders are compared as well.

Shingles are 64-bit hashes of word sequences, and sets are known by a 64-bit hash of theirs.

Null or empty text, or text of white space, has no shingles and is linked with nothing. Each row is a document; rows
with the same id are told apart by their texts. A row without an id takes part and is in the component of the
smallest id that it reaches, null if it reaches none. Columns that are not named are ignored.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import bounded_batches
from tradewind.llm.components import connected
from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Buckets of the frequency counts (a power of two) and the parts in which tasks send them.
BUCKETS, PARTS = 1 << 21, 64
# The largest number of shared shingles a document may ask for, and what verifying a pair costs in reads of a posting.
# Asking for more lets shingles count that have fewer others after them, so that texts around one frequent passage meet.
MOST_MATCHES, VERIFY_COST = 2, 8.0
# Shingles whose estimated frequency is higher are dealt out over lists of about that length.
SPLIT_AT = 20_000
# Postings of one group of lists, which a task holds at once, and postings a task gathers before it sends them.
GROUPED, GATHERED = 1_000_000, 1_000_000
# Rounds with leaders before the rest is listed, and the number of pairs per posting that counts as few.
LEADER_ROUNDS, FEW_PAIRS = 1, 8
# Documents whose ids are sent to all tasks to pick their texts; 8 bytes each.
BROADCAST_IDS = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the last step of a well-known generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all sequences of ``words`` words; of the whole text, if it has fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    size = min(words, len(found))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    total = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        total += each[i : len(found) - size + 1 + i] * _POWERS[i]
    return np.unique(_mixed(total))


def set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def overlap_needed(size: int, percent: int) -> int:
    """Least number of shared shingles with any partner."""
    return -(-size * percent // 100)


def _profile(words: int):
    """Per document its size and set hash; per task the bucket counts of its distinct sets."""
    names = ["id", "text_hash", "n", "sid", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(BUCKETS, np.uint32), set()
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            sizes, sids, new = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                sizes.append(len(hashes))
                sids.append(set_hash(hashes))
                if sids[-1] not in seen:
                    seen.add(sids[-1])
                    new.append(hashes)
                if len(new) > 500:
                    _count(counts, new)
            _count(counts, new)
            empty = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), *empty], names=names
            )
        if id_type is not None:
            coded = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(PARTS, -1)]
            empty = [pa.nulls(PARTS, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(PARTS), pa.int32()), pa.array(coded, pa.binary())], names=names)

    return run


def _count(counts: np.ndarray, new: list[np.ndarray]) -> None:
    if new:
        np.add.at(counts, _bucket(np.concatenate(new)), np.uint32(1))
        new.clear()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of each part, one task's counts at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, coded in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(zlib.decompress(coded), np.uint32)
            sums[part] = sums[part] + own if part in sums else own.astype(np.uint64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"]
    )


def bucket_excess(profile: DataFrame) -> tuple[np.ndarray, float]:
    """By how much the count of each bucket exceeds the usual one, and what of that may be chance.

    The counts have a fixed size (16 MB) whatever the input, so they may pass through the driver."""
    sent = profile.filter("part IS NOT NULL").select("part", "counts")
    rows = sent.repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").collect()
    counts = np.zeros((PARTS, BUCKETS // PARTS))
    for row in rows:
        counts[row["part"]] += np.frombuffer(row["counts"], np.uint64)
    usual = np.median(counts)
    return (counts.ravel() - usual).astype(np.float32), float(4 * np.sqrt(usual))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix(hashes: np.ndarray, excess: np.ndarray, chance: float, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The document's prefix in the global order, the estimated frequencies, and the number of matches it asks for."""
    needed = overlap_needed(len(hashes), percent)
    own = excess[_bucket(hashes)]
    order = np.lexsort((hashes, own))
    frequency = np.maximum(1, own[order] - chance)
    most = min(MOST_MATCHES, needed)
    lengths = len(hashes) - needed + np.arange(1, most + 1)
    reads = np.cumsum(frequency, dtype=np.float64)[lengths - 1]
    best = int(np.argmin(reads + VERIFY_COST * reads / np.arange(1, most + 1)))
    return hashes[order[: lengths[best]]], frequency[: lengths[best]], best + 1


def _postings(words: int, percent: int, excess, chance: float, groups: int):
    """Prefix shingles of each distinct set, packed by ``group``, a range of shingles.

    A row per posting would be shuffled with all its columns; most postings have no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(excess.value, np.float32)
        seen, rows, count = set(), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                n, sid = len(hashes), set_hash(hashes)
                # Sets that only an equal set can match are settled by their hash.
                if sid in seen or n * 100 < percent * (n + 1):
                    continue
                seen.add(sid)
                tokens, own, asked = prefix(hashes, table, chance, percent)
                core = int(255 * np.mean(table[_bucket(hashes)] > chance))
                # A frequent shingle has several lists; which one a set is in is chance, but the same in all tasks.
                number = np.where(own >= SPLIT_AT, np.ceil(own / max(1, SPLIT_AT)), 0).astype(np.uint64)
                chosen = np.where(number > 0, 1 + _mixed(np.uint64([sid & _ALL])) % np.maximum(number, np.uint64(1)), 0)
                rows.append((tokens, chosen.astype(np.uint32), sid, n, (core << 8) + asked))
                count += len(tokens)
                if count >= GATHERED:
                    yield _packed(rows, groups)
                    rows, count = [], 0
        if rows:
            yield _packed(rows, groups)

    return run


_ALL = (1 << 64) - 1
# What a packed group holds: of each posting the step from the posting before it, the list, the place in the set's order
# and the set; of each set its hash, size and tag.
_OF_POSTING, _OF_SET = (np.uint64, np.uint32, np.uint32, np.uint32), (np.int64, np.uint32, np.uint32)


def _spread(lists: np.ndarray) -> np.ndarray:
    """What is added to the shingles of these lists, so that the lists of one shingle fall into different groups."""
    return _mixed(lists.astype(np.uint64))


def _packed(rows: list[tuple], groups: int) -> pa.RecordBatch:
    """``group`` and ``packed`` of the postings of some sets (shingles, lists, hash, size and tag of each)."""
    lengths = [len(row[0]) for row in rows]
    lists = np.concatenate([row[1] for row in rows])
    keys = np.concatenate([row[0] for row in rows]) + _spread(lists)
    places = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
    of_set = np.repeat(np.arange(len(rows)), lengths)
    sets = [np.array(column, kind) for column, kind in zip(list(zip(*rows))[2:], _OF_SET)]
    order = np.argsort(keys)
    group = (((keys[order] >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
    ends = [*(np.nonzero(np.diff(group))[0] + 1).tolist(), len(group)]
    found, packed, start = [], [], 0
    for end in ends:
        own = order[start:end]
        used, set_ = np.unique(of_set[own], return_inverse=True)
        columns = [np.diff(keys[own], prepend=np.uint64(0)), lists[own], places[own], set_.astype(np.uint32)]
        # Bytes of equal weight stand together, as the high ones are mostly zero.
        parts = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in [*columns, *[c[used] for c in sets]]]
        found.append(int(group[start]))
        packed.append(zlib.compress(np.array([len(own), len(used)], np.uint32).tobytes() + b"".join(parts), 1))
        start = end
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(packed, pa.binary())], names=["group", "packed"])


def _unpacked(packed: bytes) -> list[np.ndarray]:
    """Shingles, lists, places, set hashes, sizes and tags of the postings of a packed group."""
    data = zlib.decompress(packed)
    counts = np.frombuffer(data, np.uint32, 2)
    at, columns = 8, []
    for count, kinds in zip(counts.tolist(), (_OF_POSTING, _OF_SET)):
        for kind in kinds:
            width = np.dtype(kind).itemsize
            part = np.frombuffer(data, np.uint8, count * width, at).reshape(width, count)
            columns.append(np.ascontiguousarray(part.T).view(kind).ravel())
            at += count * width
    steps, lists, places, set_, *sets = columns
    return [np.cumsum(steps, dtype=np.uint64) - _spread(lists), lists, places, *[c[set_] for c in sets]]


_LISTS = "token long, list long, sid long, info long, tag int, lead long, lead_info long, lead_tag int"


def _listed(percent: int):
    """The posting lists of a group: of each posting ``token``, ``list``, ``sid``, ``info`` (size and place of the shingle, 32 bits
    each), ``tag`` (the share of frequent shingles and the matches asked for) and the same of the list's leader. Lists of one
    set are left out, and postings that count for no partner, but for lists of frequent shingles."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_unpacked(packed) for packed in group.column("packed").to_pylist()]
        token, list_, place, sid, size, tag = (np.concatenate(column) for column in zip(*parts))
        del parts
        order = np.lexsort((sid, tag >> 8, list_, token))
        token, list_, place, sid, size, tag = (c[order] for c in (token, list_, place, sid, size, tag))
        same = (token[1:] == token[:-1]) & (list_[1:] == list_[:-1])
        once = np.concatenate([[True], ~(same & (sid[1:] == sid[:-1]))])
        token, list_, place, sid, size, tag = (c[once] for c in (token, list_, place, sid, size.astype(np.int64), tag))
        starts = np.nonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (list_[1:] != list_[:-1])]))[0]
        lengths = np.diff(starts, append=len(token))
        least = np.repeat(np.minimum.reduceat(size, starts), lengths)
        lead = np.repeat(starts + lengths - 1, lengths)
        partner = np.maximum(least, np.ceil(size * percent / 100.0 - 1e-9))
        shared = np.ceil(percent * (size + partner) / (100.0 + percent) - 1e-9)
        useful = size - place >= shared - (tag & 255) + 1
        kept = (np.repeat(lengths, lengths) > 1) & useful | (list_ > 0)
        info, tag, lead = (size << 32) + place, tag.astype(np.int32), lead[kept]
        columns = [token.view(np.int64)[kept], list_[kept].astype(np.int64), sid[kept], info[kept], tag[kept], sid[lead], info[lead], tag[lead]]
        return pa.table(columns, names=["token", "list", "sid", "info", "tag", "lead", "lead_info", "lead_tag"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sids, sets = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                sid = set_hash(hashes)
                if sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "hashes"])

    return run


def _size(info: str) -> Column:
    return F.shiftright(info, 32)


def _after(info: str) -> Column:
    """Shingles from this one to the end of the order."""
    return F.shiftright(info, 32) - F.col(info).bitwiseAND(F.lit(0xFFFFFFFF))


def _asked(tag: str) -> Column:
    return F.col(tag).bitwiseAND(F.lit(255))


def _core(tag: str) -> Column:
    return F.shiftright(tag, 8).bitwiseAND(F.lit(255))


def _shared_needed(size_a: Column, size_b: Column, percent: int) -> Column:
    """Shingles that sets of these sizes share at least."""
    return F.ceil(percent * (size_a + size_b) / F.lit(100.0 + percent) - 1e-9)


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a`` < ``b``) that share enough prefix shingles and whose sizes allow the similarity."""
    size_a, size_b = _size("info_a"), _size("info_b")
    asked = F.least(_asked("tag_a"), _asked("tag_b"))
    # Of the shingles a similar pair shares, the first ``asked`` have that many after them.
    enough = F.least(_after("info_a"), _after("info_b")) >= _shared_needed(size_a, size_b, percent) - asked + 1
    fitting = pairs.filter((100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & enough)
    counted = fitting.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(asked).alias("asked"))
    return counted.filter("shared >= asked").select("a", "b")


def _useful(least: Column, percent: int) -> Column:
    """Whether a posting can count for any partner, all of which have at least ``least`` shingles."""
    size = _size("info")
    partner = F.greatest(least, F.ceil(size * percent / 100.0 - 1e-9))
    return _after("info") >= _shared_needed(size, partner, percent) - _asked("tag") + 1


def _ordered(left: str, right: str) -> list:
    """The pair (left, right) with the smaller node as ``a``."""
    swap = F.col(left) > F.col(right)
    pick = lambda x, y, suffix="": F.when(swap, F.col(y + suffix)).otherwise(F.col(x + suffix))
    return [
        pick(left, right).alias("a"),
        pick(right, left).alias("b"),
        *[pick(left, right, f"_{c}").alias(f"{c}_a") for c in ("info", "tag")],
        *[pick(right, left, f"_{c}").alias(f"{c}_b") for c in ("info", "tag")],
    ]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b`` and whether their sets are similar enough."""
    left = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    alike = 100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)
    return pairs.join(left, "a").join(right, "b").select("a", "b", alike.alias("alike"))


def profiles(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    rows = _rows(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_profile(words), f"id {kind}, text_hash long, n long, sid long, part int, counts binary")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))


def similar_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """Per row: ``id``, ``text_hash``, ``n_shingles``, ``component_id``, the smallest id reachable by links, and ``first``,
    whether the row is the first of its component (rows that are equal are first together).

    Two documents are linked if ``100 * shared >= percent * united`` for their sets of shingles of ``words`` words.
    """
    spark = bounded_batches(df)
    profile = stage(profiles(df, id_col, text_col, words), "profiles")
    docs = profile.filter("part IS NULL").select("id", "text_hash", "n", "sid")
    excess, chance = bucket_excess(profile)
    excess = spark.sparkContext.broadcast(excess.tobytes())
    texts = _rows(df, id_col, text_col).select("id", "text")

    # Groups grow in number with the postings, so that what a task holds does not grow.
    expected = docs.agg(F.sum(F.col("n") * (100 - percent) / 100 + MOST_MATCHES)).first()[0] or 0
    groups = 1 + math.ceil(expected / GROUPED)
    sent = texts.select("text").mapInArrow(_postings(words, percent, excess, chance, groups), "group long, packed binary")
    lists = sent.groupBy("group").applyInArrow(_listed(percent), _LISTS)
    lists = stage(lists, "postings")

    # First round: every node with the leader of its list, and the leaders of the lists of a frequent shingle.
    of_node = ["sid", F.col("info").alias("sid_info"), F.col("tag").alias("sid_tag")]
    own = lists.filter("sid <> lead").select(*of_node, "lead", "lead_info", "lead_tag")
    leaders = lists.filter("list > 0 AND sid = lead").select("token", *of_node).distinct()
    heads = leaders.groupBy("token").agg(F.max(F.struct(_core("sid_tag").alias("core"), "sid", "sid_info", "sid_tag")).alias("head"))
    among = leaders.join(heads, "token").filter("sid <> head.sid").select(
        "sid", "sid_info", "sid_tag", F.col("head.sid").alias("lead"), F.col("head.sid_info").alias("lead_info"), F.col("head.sid_tag").alias("lead_tag")
    )
    pairs = _candidates(own.unionByName(among).select(*_ordered("lead", "sid")), percent)
    known = [_check(pairs, docs, texts, words, percent)]
    # The number of shared postings of a node tells how central it is.
    members = lists.select("token", "sid", "info", "tag")
    least = members.groupBy("token").agg(F.min(_size("info")).alias("least"))
    members = members.join(least, "token").filter(_useful(F.col("least"), percent)).drop("least")
    members = stage(members.join(lists.groupBy("sid").agg(F.count("*").alias("core")), "sid"), "members")
    for round_ in range(1, LEADER_ROUNDS + 2):
        roots = connected(_union(known).filter("alike").select("a", "b"))
        nodes = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        per_root = nodes.groupBy("token", "root").agg(F.count("*").alias("c"))
        per_token = per_root.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("roots"))
        several = per_token.filter("roots > 1").select("token", "c", "squares")
        open_ = stage(nodes.join(several, "token"), "open-postings")
        # The pairs to list, over all postings that are still open.
        size = open_.agg(F.count("*"), F.sum((F.col("c") * F.col("c") - F.col("squares")) / (2 * F.col("c")))).first()
        if not size[0]:
            break
        last = round_ > LEADER_ROUNDS or size[1] <= FEW_PAIRS * size[0]
        pairs = _open_pairs(open_, None if last else round_)
        pairs = _candidates(pairs, percent).join(_union(known).select("a", "b"), ["a", "b"], "left_anti")
        known.append(_check(pairs, docs, texts, words, percent))
        if last:
            roots = connected(_union(known).filter("alike").select("a", "b"))
            break

    # The first document of each set, of each component, and back; documents without an id come last.
    this = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    by_set = docs.filter("n > 0").groupBy("sid").agg(F.min(this).alias("first"))
    by_set = by_set.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    by_root = by_set.groupBy("root").agg(F.min("first").alias("first"))
    of_set = by_set.select("sid", "root").join(by_root, "root").select("sid", "first")
    found = docs.join(of_set, "sid", "left")
    return found.select(
        "id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n") == 0) | (this == F.col("first"))).alias("first"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each component, the one with the smallest id (and hash of its text); documents
    without shingles stay. All columns stay."""
    found = stage(similar_documents(df, id_col, text_col, **options), "components")
    id_, hash_ = F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    same = id_.eqNullSafe(F.col("__id")) & (hash_ == F.col("__hash"))
    keys = [F.col("id").alias("__id"), F.col("text_hash").alias("__hash")]
    others = stage(found.filter("NOT first").select(*keys).distinct(), "other-copies")
    # Ids of a checked number (16 bytes each) go to all tasks, and the texts are not shuffled; more are joined.
    if others.count() <= BROADCAST_IDS and dict(others.dtypes)["__id"] in ("bigint", "int"):
        others = F.broadcast(others)
    kept = df.join(others, same, "left_anti")
    repeated = found.filter("first AND n_shingles > 0").groupBy(*keys).count().filter("count > 1").drop("count")
    repeated = stage(repeated, "repeated-rows")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _open_pairs(open_: DataFrame, round_: int | None) -> DataFrame:
    """Pairs of different components in one list: each node with another leader than before, or all of them."""
    def named(name):
        return ["token", F.col("sid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("info", "tag", "root")]]

    left = open_.select(*named("x"))
    if round_ is None:
        pairs = left.join(open_.select(*named("y")), "token").filter("x < y AND x_root <> y_root")
    else:
        # The most central node, then nodes at random.
        order = F.col("core") if round_ == 1 else F.xxhash64("sid", F.lit(round_))
        first = F.max(F.struct(order.alias("order"), "sid", "info", "tag", "root"))
        heads = open_.groupBy("token").agg(first.alias("lead"))
        heads = heads.select("token", "lead.*").select(*named("y"))
        pairs = left.join(heads, "token").filter("x <> y AND x_root <> y_root")
    return pairs.select(*_ordered("x", "y"))


def _check(pairs: DataFrame, docs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Verify the candidates on the sets of their documents; no other text is turned into a set again."""
    pairs = stage(pairs, "pairs")
    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    chosen = stage(docs.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id")), "chosen")
    ids = chosen.select(F.col("id").alias("chosen_id")).distinct()
    # Ids of a checked number (8 bytes each) go to all tasks, and the texts are not shuffled; more are joined.
    if chosen.count() <= BROADCAST_IDS and dict(ids.dtypes)["chosen_id"] in ("bigint", "int"):
        ids = F.broadcast(ids)
    rows = texts.join(ids, F.col("id").eqNullSafe(F.col("chosen_id")), "left_semi")
    made = rows.select("text").mapInArrow(_sets(words), "sid long, hashes array<long>")
    # Other texts of the same ids have no pair.
    sets = stage(made, "sets").dropDuplicates(["sid"])
    return stage(_verified(pairs, sets, percent), "checked")
