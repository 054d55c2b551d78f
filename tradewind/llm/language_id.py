"""Language of documents by fusing evidence: text, declared language, address suffix and host.

Text: a model of letter trigrams per language, fitted on a bounded sample of the rows whose declared language is
known. Declared language and address suffix: the probability of seeing that value given the true language, from counts
over all rows, where the most likely language by the text alone stands for the true one. Host: the share of each
language on the host, smoothed towards that of its parent domain, which is smoothed towards the share in the whole
table. The four are combined by Bayes' rule.

A document is rejected if it has no letters, if no language reaches the least probability, or if its text fits the best
language's model worse than random letters would.

Null text counts as empty (rejected, language by the other evidence). Null declared values and suffixes are a value of
their own, null hosts one host. Equal rows give equal results, an empty table an empty one. Columns that are not
named are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import bounded_batches
from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANGUAGES = ("de", "en", "es", "fr")
# Trigram buckets; the expected number of sample documents per language (the bound of the fit).
BUCKETS, SAMPLE_PER_LANGUAGE = 1 << 16, 4000
# Weight of the text: its mean per trigram counts like that many independent ones at most.
TEXT_WEIGHT = 60.0
# Rows that a parent domain, and the whole table, count for in the shares below them.
HOST_SMOOTHING, DOMAIN_SMOOTHING, VALUE_SMOOTHING = 20.0, 20.0, 1.0
_CHUNK = 100_000
_LETTERS = 0x3000


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_LETTERS)])


def _buckets(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bucket of each trigram; characters other than letters count as blanks, trigrams of blanks have bucket 0."""
    known = np.where(codes < _LETTERS, letters[np.minimum(codes, _LETTERS - 1)], True)
    c = np.where(known, codes, 32).astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B185EBCA87) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    bucket = (mixed >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    bucket[(c[:-2] == 32) & (c[1:-1] == 32) & (c[2:] == 32)] = 0
    return bucket.astype(np.int64)


def _pieces(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the text and its characters in lower case between blanks; long texts in overlapping pieces."""
    for i, text in enumerate(texts):
        codes = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for start in range(0, len(codes) - 2, _CHUNK):
            yield i, codes[start : start + _CHUNK + 2]


def _chunks(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of a batch put together up to a size: the number of the text and where its piece begins, per piece."""
    numbers, pieces, size = [], [], 0
    for i, codes in _pieces(texts):
        numbers.append(i)
        pieces.append(codes)
        size += len(codes)
        if size >= _CHUNK:
            yield np.array(numbers), pieces
            numbers, pieces, size = [], [], 0
    if pieces:
        yield np.array(numbers), pieces


def trigram_counts(rows: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Counts per language and bucket, summed by Spark; of a fixed size whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, counts = _letters(), np.zeros((len(languages), BUCKETS))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            label = np.array(batch.column("label").to_pylist())
            for numbers, pieces in _chunks(texts):
                for i, codes in zip(numbers, pieces):
                    counts[label[i]] += np.bincount(_buckets(codes, letters), minlength=BUCKETS)
        counts[:, 0] = 0
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(counts[at])], names=["label", "bucket", "n"])

    sums = rows.mapInArrow(run, "label long, bucket long, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    for row in sums.collect():
        counts[row["label"], row["bucket"]] = row["n"]
    return counts


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, languages: Sequence[str], sample: int = SAMPLE_PER_LANGUAGE) -> np.ndarray:
    """Log probability of each trigram bucket per language, from about ``sample`` rows of each, chosen by the hash of
    their ids. Classes are equally likely whatever their number of rows."""
    label = F.col(f"`{label_col}`")
    known = df.filter(label.isin(*languages)).select(
        (F.array_position(F.array(*map(F.lit, languages)), label) - 1).alias("label"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(sample / max(n, 1))) for k, n in counts.items()], F.lit(0.0))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    found = trigram_counts(chosen.select("label", "text"), languages)
    # Half an occurrence for a bucket that was not seen.
    return np.log((found + 0.5) / (found.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def score(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` (id, text and others) with ``n`` trigrams and ``fit``, the mean log probability per language, for text."""
    blank = np.arange(model.shape[1]) > 0  # bucket 0 says nothing
    sent = rows.sparkSession.sparkContext.broadcast((model * blank).astype(np.float32).tobytes())
    kept = [c for c in rows.columns if c != "text"]
    n_languages = len(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.float32).reshape(n_languages, -1)
        letters = _letters()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            total, n = np.zeros((len(texts), n_languages)), np.zeros(len(texts), np.int64)
            for numbers, pieces in _chunks(texts):
                for i, codes in zip(numbers, pieces):
                    found = _buckets(codes, letters)
                    n[i] += np.count_nonzero(found)
                    total[i] += [np.take(row, found).sum(dtype=np.float64) for row in table]
            mean = total / np.maximum(n, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(mean.ravel()), n_languages).cast(pa.list_(pa.float64()))],
                names=[*kept, "n", "fit"],
            )

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, n long, fit array<double>")


def _best(scores: Column) -> Column:
    """Number of the largest value, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _shares(counts: list[Column], n: Column, above: Column, weight: float) -> Column:
    """Shares of the languages, smoothed towards those of the level above."""
    return F.transform(F.array(*counts), lambda c, i: (c + weight * F.get(above, i)) / (n + weight))


def _per_language(group: DataFrame, k: int) -> list[Column]:
    return [F.sum(F.when(F.col("by_text") == i, 1).otherwise(0)).cast("double").alias(f"c{i}") for i in range(k)]


def _given_language(scored: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """Per value of ``column`` the log probability of the value given each language, from counts over all rows."""
    counts = scored.groupBy(column).agg(*_per_language(scored, k))
    totals = counts.agg(F.count("*").alias("values"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(k)])
    v = VALUE_SMOOTHING
    logs = [F.log((F.col(f"c{i}") + v) / (F.col(f"t{i}") + v * F.col("values"))) for i in range(k)]
    row = totals.first()
    known = counts.select(F.col(column), *[F.col(f"c{i}") for i in range(k)], *[F.lit(row[c]).alias(c) for c in totals.columns])
    return known.select(F.col(column).alias(f"{column}_value"), F.array(*logs).alias(name))


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    languages: Sequence[str] = LANGUAGES,
    model: np.ndarray | None = None,
    label_col: str = "lang",
    least_probability: float = 0.5,
) -> DataFrame:
    """Per row: ``id``, ``text_hash``, ``declared``, ``host``, ``language``, ``probability``, ``by_text`` (the language by the text
    alone) and ``accepted``.

    ``suffix`` is what the address says about the language, ``host`` the host; dots separate parent domains. Without a
    ``model`` one is fitted on a sample of ``df`` by ``label_col``."""
    # Arrow's buffers lie outside the heap, and every task holds several.
    bounded_batches(df).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    k = len(languages)
    if model is None:
        model = fit(df, id_col, text_col, label_col, languages)
    none = F.lit(None).cast("string")
    text = F.col(f"`{text_col}`")
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        F.coalesce((none if declared is None else declared).cast("string"), F.lit("")).alias("declared"),
        F.coalesce((none if suffix is None else suffix).cast("string"), F.lit("")).alias("suffix"),
        F.coalesce((none if host is None else host).cast("string"), F.lit("")).alias("host"),
        text.alias("text"),
    )
    scored = stage(score(rows, model), "language-scores")
    scored = scored.withColumn("by_text", F.when(F.col("n") > 0, _best(F.col("fit"))))
    scored = scored.withColumn("domain", F.when(F.col("host").contains("."), F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(""))

    # Shares: the whole table (one row), each parent domain, each host.
    by_host = scored.groupBy("host", "domain").agg(F.count("by_text").cast("double").alias("n"), *_per_language(scored, k))
    by_host = stage(by_host, "language-hosts")
    sums = [F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]]
    whole = by_host.agg(*sums).first()
    n = whole["n"] or 0.0
    top = F.array(*[F.lit(((whole[f"c{i}"] or 0.0) + 1.0) / (n + k)) for i in range(k)])
    counts = [F.col(f"c{i}") for i in range(k)]
    domains = by_host.groupBy("domain").agg(*sums).select("domain", _shares(counts, F.col("n"), top, DOMAIN_SMOOTHING).alias("domain_share"))
    hosts = by_host.join(domains, "domain").select("host", _shares(counts, F.col("n"), F.col("domain_share"), HOST_SMOOTHING).alias("host_share"))

    joined = (
        scored.join(hosts, "host", "left")
        .join(_given_language(scored, "declared", k, "of_declared"), F.col("declared") == F.col("declared_value"), "left")
        .join(_given_language(scored, "suffix", k, "of_suffix"), F.col("suffix") == F.col("suffix_value"), "left")
    )
    weight = F.least(F.col("n").cast("double"), F.lit(TEXT_WEIGHT))
    logs = F.transform(
        "fit",
        lambda x, i: weight * x + F.log(F.get(F.col("host_share"), i)) + F.get(F.col("of_declared"), i) + F.get(F.col("of_suffix"), i),
    )
    joined = joined.withColumn("logs", logs)
    best = F.array_max("logs")
    total = F.aggregate(F.transform("logs", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*map(F.lit, languages))
    random = float(np.log(1 / (BUCKETS - 1)))
    found = joined.select(
        "id", "text_hash", "declared", "host",
        F.get(names, _best(F.col("logs"))).alias("language"),
        F.round(1 / total, 6).alias("probability"),
        F.get(names, F.col("by_text")).alias("by_text"),
        (F.col("n") > 0).alias("letters"),
        (F.array_max("fit") >= random).alias("fits"),
    )
    accepted = F.col("letters") & F.col("fits") & (F.col("probability") >= least_probability)
    return found.withColumn("accepted", accepted).drop("letters", "fits")


def accepted_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", **options) -> DataFrame:
    """``df`` without the rejected documents, with the language found in ``declared_col``; all other columns stay.

    Only decisions that change something are joined with the documents."""
    columns = {"declared": F.col(f"`{declared_col}`"), "host": F.col(f"`{host_col}`")}
    found = identify(df, id_col, text_col, label_col=declared_col, **columns, **options)
    changes = found.filter("NOT accepted OR language <> declared").select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("declared").alias("__declared"), F.col("host").alias("__host"),
        F.col("language").alias("__language"), F.col("accepted").alias("__accepted"),
    ).distinct()
    changes = stage(changes, "language-changes")
    same = (
        F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
        & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col("__hash"))
        & (F.coalesce(columns["declared"].cast("string"), F.lit("")) == F.col("__declared"))
        & (F.coalesce(columns["host"].cast("string"), F.lit("")) == F.col("__host"))
    )
    joined = df.join(changes, same, "left").filter("__accepted IS NULL OR __accepted")
    return joined.select(*[F.coalesce("__language", F.col(f"`{c}`")).alias(c) if c == declared_col else F.col(f"`{c}`") for c in df.columns])
