"""Secrets in texts, told apart by how many owners have them.

Every text is scanned for credential patterns. The hash of each candidate value is then counted over the corpus: by
(value, owner, repository), from these rows by (value, owner), and at last by value, so that copies collapse in the
tasks that read them. A value that several owners have is an example that was copied around; a value of one owner
that looks random is a live credential. A private key reaches from its first line to its last, or to the end of its
base64 lines, and its value is their characters, however they are wrapped; a first line without any is no credential.

Null text counts as empty. Rows without an owner or repository count as those of one unnamed owner or repository.
Equal rows give equal results. An empty table gives an empty result. Columns that are not named are ignored. Rows with
the same id are told apart by the hash of their texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import pick
from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The kinds, their patterns, the group that holds the value and its least length.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "forge_token")
BASE_KINDS = KINDS[:3]
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    "web_token": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    "forge_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
}
# Short values cannot have more bits a character than log2 of their length; this share of it is enough for them.
ENTROPY_SHARE = 0.75
PLACEHOLDERS = r"example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|1234567|abcdefg"

SPAN = "array<struct<kind:string,start:int,end:int,value_start:int,value_end:int,value:string,random:boolean>>"
_SPAN_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()),
               ("value_end", pa.int32()), ("value", pa.string()), ("random", pa.bool_())])
)


def entropy(value: str) -> float:
    """Bits per character of the value's own character frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


# What ends a private key; else its base64 lines, plain, quoted or with escaped line ends, after header lines if any.
_KEY_END = re.compile(r"-----(?:(BEGIN)|END) [A-Z ]{0,20}PRIVATE KEY-----")
_GAP = r"""(?:\s|\\[nrt]|["',;>\#*|]|\+(?=\s))"""
_KEY_LINES = re.compile(
    rf"(?:{_GAP}*+[A-Z][A-Za-z-]+:\x20[^\n\\]*+(?=\n|\\[nr]))*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})+(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{1,2}})?"
)
_KEY_HEADER = re.compile(r"^[^\w\n]*[A-Z][A-Za-z-]+:\x20.*$", re.MULTILINE)


def _key_body(text: str, at: int) -> tuple[int, str]:
    """Where the private key ends whose first line ends at ``at``, and its base64 characters."""
    end = _KEY_END.search(text, at)
    if end and not end[1]:
        words = text[at : end.start()].replace("\\r", "\n").replace("\\n", "\n").split()
        coded = sum(len(w) for w in words if len(w) >= 16 or re.search("[0-9+/=]|[a-z][A-Z]", w))
        # Not where a text only speaks of the first and the last line.
        last = end.end() if len(words) <= 8 or 2 * coded >= sum(map(len, words)) else None
    else:
        last = None
    if last is None:
        lines = _KEY_LINES.match(text, at)
        last = lines.end() if lines else at
        inner = text[at:last]
    else:
        inner = text[at : end.start()]
    inner = re.sub(r"\\[nrt]", "\n", inner)
    return last, "".join(re.findall("[A-Za-z0-9+/=]+", _KEY_HEADER.sub("", inner)))


def scanner(least_entropy: float):
    """A function from a text to its spans: leftmost matches of each kind that do not overlap, by start and kind.

    A value looks random from ``least_entropy`` bits a character, or from a share of what its length allows."""
    found_by = [
        (kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least)
        for kind, (pattern, group, least) in PATTERNS.items()
    ]
    placeholder = re.compile(PLACEHOLDERS, re.IGNORECASE)

    def scan(text: str) -> list[dict]:
        spans = []
        for order, (kind, pattern, group, least) in enumerate(found_by):
            for m in pattern.finditer(text):
                value, end, value_end = m[group], m.end(), m.end(group)
                if len(value) < least:
                    continue
                if kind == "private_key":
                    end, body = _key_body(text, end)
                    value, value_end, random = body or value, end, bool(body)
                else:
                    bound = min(least_entropy, ENTROPY_SHARE * math.log2(len(value)))
                    random = entropy(value) >= bound and not placeholder.search(value)
                spans.append((m.start(), order, {
                    "kind": kind, "start": m.start(), "end": end, "value_start": m.start(group),
                    "value_end": value_end, "value": hashlib.sha256(value.encode()).hexdigest(), "random": random,
                }))
        return [span for *_, span in sorted(spans, key=lambda s: s[:2])]

    return scan


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: Column | None = None,
    least_entropy: float = 3.0,
) -> DataFrame:
    """Per row: ``id``, ``text_hash``, ``owner``, ``repository`` and ``spans``; positions count code points and ends
    are exclusive. ``value`` is the hash of the credential, never the credential itself."""
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
        F.coalesce((F.col(f"`{owner_col}`") if repository_col is None else repository_col).cast("string"), F.lit("")).alias("repository"),
        F.col(f"`{text_col}`").alias("text"),
    )
    kept = ["id", "text_hash", "owner", "repository"]
    schema = T.StructType([rows.schema[c] for c in kept]).add("spans", T.DataType.fromDDL(SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(least_entropy)
        for batch in batches:
            spans = pa.array([scan(t or "") for t in batch.column("text").to_pylist()], _SPAN_ARROW)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], spans], names=[*kept, "spans"])

    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame, example_owners: int = 3) -> DataFrame:
    """Per candidate value: ``n_docs``, ``n_repositories``, ``n_owners`` and its ``class``.

    ``example``: at least ``example_owners`` owners have it, or it does not look random; ``live``: one owner has it and
    it looks random; ``shared``: between the two."""
    values = found.select("id", "text_hash", "owner", "repository", F.explode("spans").alias("span")).select(
        "owner", "repository", F.col("span.value").alias("value"), F.col("span.random").alias("random")
    )
    by_repository = values.groupBy("value", "owner", "repository").agg(
        F.count("*").alias("n_spans"), F.max("random").alias("random")
    )
    by_owner = by_repository.groupBy("value", "owner").agg(
        F.sum("n_spans").alias("n_spans"), F.count("*").alias("n_repositories"), F.max("random").alias("random")
    )
    by_value = by_owner.groupBy("value").agg(
        F.sum("n_spans").alias("n_spans"),
        F.sum("n_repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"),
        F.max("random").alias("random"),
    )
    kind = F.when((F.col("n_owners") >= example_owners) | ~F.col("random"), "example")
    return by_value.withColumn("class", kind.when(F.col("n_owners") == 1, "live").otherwise("shared"))


def classified_spans(found: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per text that has candidates: ``__id``, ``__hash`` and ``classed``, its spans with their classes.

    Few texts have candidates, and of a value with very many spans the spans, not its one row, are dealt to many
    tasks by the split of skewed joins."""
    spans = found.select("id", "text_hash", F.explode("spans").alias("span")).distinct()
    joined = spans.withColumn("value", F.col("span.value")).join(owners.select("value", "class", "n_owners"), "value")
    return joined.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.sort_array(F.collect_list(F.struct("span.start", "span.kind", "span.value_start", "span.value_end", "class", "n_owners"))).alias("classed")
    )


def audit(df: DataFrame, example_owners: int = 3, **columns) -> DataFrame:
    """Per row of ``df``: ``id``, ``spans`` as found and ``classed``, the spans with their classes and owner counts."""
    found = stage(find_secrets(df, **columns), "secrets")
    classed = classified_spans(found.filter(F.size("spans") > 0), ownership(found, example_owners))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    return found.join(classed, same, "left").select(
        "id", "owner", "repository", "spans", F.coalesce("classed", F.array().cast(classed.schema["classed"].dataType)).alias("classed")
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", example_owners: int = 3, mark: str = "[SECRET]", **columns) -> DataFrame:
    """``df`` with every live credential of its text replaced by ``mark``; all rows and columns stay.

    Widely copied examples stay in the text. Null text stays null."""
    found = stage(find_secrets(df, id_col, text_col, **columns).filter(F.size("spans") > 0), "secrets")
    classed = classified_spans(found, ownership(found, example_owners))
    live = classed.select(
        "__id",
        "__hash",
        F.expr("transform(filter(classed, s -> s.class = 'live'), s -> struct(s.value_start AS a, s.value_end AS b))").alias("__live"),
    ).filter(F.size("__live") > 0)
    live = stage(live.withColumn("__live", F.array_sort("__live")), "live-secrets")
    text = F.col(f"`{text_col}`")
    joined = df.join(
        live, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__hash")), "left"
    )
    # Spans may overlap: a value that two kinds found is marked once.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    marked = F.aggregate(
        "__live",
        start,
        lambda done, s: F.when(
            s["a"] >= done["at"],
            F.struct(F.concat(done["out"], F.substring(text, done["at"] + 1, s["a"] - done["at"]), F.lit(mark)).alias("out"), s["b"].alias("at")),
        ).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["at"], s["b"]).alias("at"))),
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )
    return joined.select(
        *[F.when(F.col("__live").isNull(), text).otherwise(marked).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    )
