"""Fixity audit of archive replicas with Merkle trees over offset ranges.

A record's leaf is the hash of its bytes. Leaves are put into ranges of offsets, 64 KiB each, and a range's hash is that
of its leaves in the order of their offsets; sixteen ranges make the next larger one, up to a root per file. Roots
of two replicas are compared first; below a pair that differs the next ranges are compared, and so on, so that only
the branches with damage are read, down to the records.

A group holds the records of one range or sixteen hashes, however large a file is. Ranges are by offset, so a record that
was lost or put in changes one path of the tree only.

Null payloads count as empty; records without an offset take no part; a null file name is a file of its own. Several
records at one offset are compared as a whole. Files that only one replica has differ in all their records. An empty
replica is one that lost everything. Columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import stage

# Bits of an offset inside a range of the lowest level; ranges per larger range, in bits.
RANGE_BITS, FAN_BITS = 16, 4


def warc_record(url: Column, payload: Column) -> Column:
    """The bytes of a response record."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def laid_out(records: DataFrame, file: str = "file", order: str = "place", record: str = "record") -> DataFrame:
    """``file``, ``place``, ``offset``, ``length`` and ``hash`` of the records of each file, one after the other.

    Records of the same place, or without one, stand in the order of their hashes, in every replica the same.
    Records are hashed where they are read; only hashes and lengths are shuffled. Files are bounded by their writer, so
    one file's lengths are summed by one task."""
    bytes_ = F.coalesce(F.col(record).cast("binary"), F.lit(b""))
    each = records.select(F.col(file).alias("file"), F.col(order).alias("place"), F.octet_length(bytes_).cast("long").alias("length"), F.sha2(bytes_, 256).alias("hash"))
    before = Window.partitionBy("file").orderBy("place", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def leaves(records: DataFrame) -> DataFrame:
    """One leaf per ``file`` and ``offset`` from a replica's ``file``, ``offset``, ``length`` and ``hash``."""
    each = records.filter("offset IS NOT NULL").select("file", F.col("offset").cast("long").alias("offset"), "length", "hash")
    # Records at the same offset become one leaf; copies collapse in the tasks that read them.
    one = each.groupBy("file", "offset", "length", "hash").agg(F.count("*").alias("n"))
    whole = one.groupBy("file", "offset").agg(
        F.max("length").alias("length"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.concat_ws(":", "hash", "n"))).alias("hashes")
    )
    return whole.select("file", "offset", "length", F.when(F.col("n") == 1, F.substring(F.get("hashes", F.lit(0)), 1, 64)).otherwise(F.sha2(F.array_join("hashes", ","), 256)).alias("hash"))


def tree(of: DataFrame, height: int) -> list[DataFrame]:
    """The levels above the leaves, each with ``file``, ``range`` and ``hash``; the last one has one range per file."""
    levels, place, bits = [], "offset", RANGE_BITS
    for level in range(height):
        parts = of.groupBy("file", F.shiftright(place, bits).alias("range")).agg(F.sort_array(F.collect_list(F.struct(place, "hash"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p[place], p["hash"])), ",")
        of = stage(parts.select("file", "range", F.sha2(joined, 256).alias("hash")), f"tree-{level}")
        levels.append(of)
        place, bits = "range", FAN_BITS
    return levels


def _height(*replicas: DataFrame) -> int:
    """Levels until one range holds the largest offset."""
    largest = max((r.agg(F.max("offset")).first()[0] or 0 for r in replicas), default=0)
    height = 1
    while largest >> (RANGE_BITS + FAN_BITS * (height - 1)):
        height += 1
    return height


def _different(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
    """Rows of either side whose hash the other side does not have in that place."""
    left = a.select(F.col("file").alias("file_a"), F.col(place).alias("place_a"), F.col("hash").alias("hash_a"), *([F.col("length").alias("length_a")] if place == "offset" else []))
    right = b.select(F.col("file").alias("file_b"), F.col(place).alias("place_b"), F.col("hash").alias("hash_b"), *([F.col("length").alias("length_b")] if place == "offset" else []))
    same = F.col("file_a").eqNullSafe(F.col("file_b")) & (F.col("place_a") == F.col("place_b"))
    both = left.join(right, same, "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return both.withColumn("file", F.when(F.col("place_a").isNull(), F.col("file_b")).otherwise(F.col("file_a"))).withColumn("place", F.coalesce("place_a", "place_b"))


def _below(rows: DataFrame, place: str, bits: int, differing: DataFrame) -> DataFrame:
    """The rows in ranges that differ."""
    wanted = differing.select(F.col("file").alias("file_"), F.col("place").alias("place_"))
    return rows.join(wanted, F.col("file").eqNullSafe(F.col("file_")) & (F.shiftright(place, bits) == F.col("place_")), "left_semi")


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """``file``, ``offset``, ``length`` (of the first replica's record, else of the other's) and ``status`` of every record that differs:
    ``changed``, ``missing`` (only the first replica has it) or ``extra`` (only the other has it)."""
    a, b = stage(leaves(replica_a), "leaves-a"), stage(leaves(replica_b), "leaves-b")
    height = _height(a, b)
    trees = list(zip(tree(a, height), tree(b, height)))
    differing = stage(_different(*trees[-1], "range"), "differing")
    for nodes_a, nodes_b in reversed(trees[:-1]):
        differing = stage(_different(_below(nodes_a, "range", FAN_BITS, differing), _below(nodes_b, "range", FAN_BITS, differing), "range"), "differing")
    records = _different(_below(a, "offset", RANGE_BITS, differing), _below(b, "offset", RANGE_BITS, differing), "offset")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return records.select("file", F.col("place").alias("offset"), F.coalesce("length_a", "length_b").alias("length"), status.alias("status"))
