"""Token alignment, repeated strings and ranked search against brute force, with nulls, ties, repeated rows, long and odd texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm import queries, ranked_search, suffix_dedup, token_alignment

FIRST, SECOND = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
DOCUMENTS = "doc_id long, text string, spans int, kept string, rank int, score string, chunk int, of int"


def documents(spark, rows):
    """Rows of id and text, with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3, 4) for i, t in rows], DOCUMENTS)


# Token alignment ------------------------------------------------------------------------------------------------------


def aligned_by_hand(rows):
    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    symbols = token_alignment.byte_symbols()

    def piece(i):
        text = second.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if second.is_byte(i) else text.replace("▁", " ").encode()

    found, documents_of = [], Counter()
    for doc, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            parts = [bytes(symbols[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
            if not b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
                a, b = [], []
        if a:
            ends = [[sum(map(len, side[: i + 1])) for i in range(len(side))] for side in parts]
            cut = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                own = [[t for t, e in zip(tokens, side) if cut < e <= end] for tokens, side in zip((a, b), ends)]
                groups.append(own)
                links += [(x, y) for x in own[0] for y in own[1]]
                cut = end
        documents_of.update(set(links))
        found.append((doc, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in documents_of.items():
        best[x] = max(best[x], n)
    result = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        counts = [documents_of[x] for x in links]
        result.append((doc, n_a, n_b, len(groups), len(links), sum(n == best[x[0]] for n, x in zip(counts, links)), sum(counts), digest, text))
    return sorted(result, key=repr)


ODD_TEXTS = [
    None, "", " ", "  ", "a", "a ", "a  ", "a \nb", "a\n b", "a\n  b", " x", "\n", "\t a", "a\xa0 b", "a▁b", "▁", "x<|endoftext|>y", "<s> </s> <0x41>",
    "日本語 テキスト です", "\x00 a\x01", "é é ﬁ", "🙂 🙂🙂 ok", "it's we'll  'S", "a\x85 b", "a\x1c b", "12345 67 8", "a" * 3000, " ".join(["ab"] * 2000),
    "\r\n \r\n", "a   b    c", "٣٤ ४५", "ａ　ｂ", "the cat the cat sat",
]
ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_alignment_equals_brute_force(spark):
    rows = [*enumerate(ODD_TEXTS), (5, "the cat"), (5, "the cat"), (None, "the cat sat")]
    found = token_alignment.align(documents(spark, rows), FIRST, SECOND).select(*ALIGNED).collect()
    assert sorted(map(tuple, found), key=repr) == aligned_by_hand(rows)


def test_alignment_over_many_chunks(spark, monkeypatch):
    """Counts are of all documents, whatever batches and tasks they are in, and forgetting units changes nothing."""
    monkeypatch.setattr(token_alignment, "REMEMBERED", 5)
    monkeypatch.setattr(token_alignment, "ROWS_AT_ONCE", 3)
    chance = random.Random(1)
    words = ["theresan", "erblest", "über", "naïveté", "don't", "foo-bar", "42"]
    rows = [(i, " ".join(chance.choices(words, k=chance.randint(0, 9)))) for i in range(60)]
    found = token_alignment.align(documents(spark, rows).repartition(7), FIRST, SECOND).select(*ALIGNED).collect()
    assert sorted(map(tuple, found), key=repr) == aligned_by_hand(rows)


def test_alignment_of_nothing(spark):
    assert token_alignment.align(documents(spark, []), FIRST, SECOND).collect() == []


def test_alignment_keeps_the_type_of_ids(spark):
    rows = spark.createDataFrame([("x", "a b")], "name string, body string")
    found = token_alignment.align(rows, FIRST, SECOND, "name", "body").collect()
    assert [(r["name"], r["n_a"]) for r in found] == [("x", 2)]


# Repeated strings -----------------------------------------------------------------------------------------------------


def kept_by_hand(rows, least):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - least + 1) if doc is not None else ():
            string = data[p : p + least]
            first[string] = min(first.get(string, doc), doc)
    result = []
    for doc, text in rows:
        data = (text or "").encode()
        removed = bytearray(len(data))
        for p in range(len(data) - least + 1) if doc is not None else ():
            if first[data[p : p + least]] < doc:
                removed[p : p + least] = b"\1" * least
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", removed))
        result.append((doc, spans, bytes(x for x, r in zip(data, removed) if not r)))
    return sorted(result, key=repr)


def without_repeats(df, least):
    found = suffix_dedup.without_repeats(df, least=least).collect()
    return sorted(((r["doc_id"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in found), key=repr)


@pytest.mark.parametrize("least", [50, 23, 8, 3])
def test_repeats_equal_brute_force(spark, least):
    """Random copies with changed bytes over few letters, so that strings meet in many ways."""
    chance = random.Random(least)
    base = ["".join(chance.choices("ab é", k=300)) for _ in range(4)]
    rows = []
    for i in range(60):
        a, b = chance.choice(base), "".join(chance.choices("abcdefgh ", k=chance.randint(0, 120)))
        begin = chance.randint(0, 250)
        rows.append((i, b + a[begin : begin + chance.randint(0, 200)] + b[::-1]))
    rows += [(60, None), (61, ""), (None, base[0]), (None, base[0]), (5, base[1]), (5, base[1]), (5, "x" * 49), (62, "z" * 400), (63, "z" * 70), (-4, base[2])]
    assert without_repeats(documents(spark, rows).repartition(5), least) == kept_by_hand(rows, least)


def test_repeats_over_blocks(spark, monkeypatch):
    """A long text is worked off in blocks that never cut a run, wherever the texts of a batch begin."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 61)
    chance = random.Random(3)
    text = "".join(chance.choices("abcdefghij", k=2000))
    rows = [(0, text), (1, "q" + text[500:1500]), (2, text[100:160] + "Q" + text[161:400]), (3, "a" * 333), (4, "b" + "a" * 200)]
    assert without_repeats(documents(spark, rows).coalesce(1), 50) == kept_by_hand(rows, 50)


def test_repeats_of_nothing(spark):
    assert without_repeats(documents(spark, []), 50) == []
    assert without_repeats(documents(spark, [(1, None)]), 50) == [(1, (), b"")]


def test_covers_that_go_on_in_the_next_batch():
    """Judging sorted rows gives the same however they are cut into batches."""
    import pyarrow as pa

    rows = [(1, 1, 3), (1, 1, 3), (1, 1, 5), (2, 4, 1), (2, 5, 1), (2, 5, 9), (3, 1, 1), (4, 7, 2), (4, 8, 3), (4, 8, 4), (4, 9, 1)]

    def judged(size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["rank", "cover", "doc"]) for part in parts]
        return sorted((r["doc"], r["cover"], r["whole"]) for b in suffix_dedup._judged(iter(batches)) for r in b.to_pylist())

    expected = sorted([(5, 1, True), (9, 5, True), (4, 8, True), (1, 4, False), (1, 5, False), (2, 7, False), (3, 8, False), (1, 9, False)])
    assert all(judged(size) == expected for size in range(1, 12))


# Ranked search --------------------------------------------------------------------------------------------------------


def ranked_by_hand(docs, items, k=10):
    def words(text):
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    counted = [(doc, Counter(words(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    result = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        result += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(result, key=repr)


def searched(docs, items, **options):
    return sorted(map(tuple, ranked_search.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark):
    """Zipf-like words, ties, repeated ids and rows, a long text, odd characters."""
    chance = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "ä", "ſ", "日本", "A1", "a1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, ", ".join(chance.choices(vocabulary, weights, k=chance.randint(0, 40)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "!?"), (None, "w1 w40 w41"), (7, "w40 w41"), (7, "w40 w41"), (3, "w40 w41"), (300, "w5 " * 5000 + "w50")]
    items = [(i, " ".join(chance.choices(vocabulary, k=12))) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (53, "W40-w41 w40"), (53, "w1")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items if i != 53 or t != "w1"], "item_id int, text string, rank int, doc_id int")
    expected = ranked_by_hand(docs, items[:-1])
    frame = documents(spark, docs).repartition(6)
    assert searched(frame, asked) == expected
    assert searched(frame, asked, block_chars=40) == expected


def test_search_stops_opening_accumulators(spark):
    """With few rare matches ahead, common terms open nothing: the documents that hold only them never get a score."""
    import numpy as np
    import pyarrow as pa

    term, tf = [[0, 1]] * 3 + [[1]] * 50, [[1, 1]] * 3 + [[1]] * 50
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(53)), pa.array([2] * 53), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc", "n", "terms", "tf"]
    )
    weights = np.array([3000, 10])
    inverted = ranked_search._Batch(batch, weights, 53, 106)
    docs, scores = inverted.best(np.array([0, 1]), np.array([3010 * 10**6, 10 * 10**6, 0]), 3, 1, np.zeros(53, np.int64))
    assert sorted(docs.tolist()) == [0, 1, 2] and len(set(scores.tolist())) == 1


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert searched(documents(spark, [(1, "a")]), empty) == []
    assert searched(documents(spark, []), some) == []


def test_queries_equal_brute_force_on_a_table(spark):
    """The registered queries over a whole small table."""
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_prefix_doubling(spark, folder)
    expected = sorted((d, sum(e - s for s, e in spans) + len(kept), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, spans, kept in kept_by_hand(rows, 50))
    assert sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == expected
    found = queries.op11_identity_alignment(spark, folder).collect()
    assert sorted(map(tuple, found)) == [r[:-1] for r in sorted(aligned_by_hand(rows))]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op13_limited_accumulators(spark, folder).collect())) == sorted(ranked_by_hand(rows, items))
    assert spark.read.parquet(f"{folder}/documents.parquet").agg(F.count("*")).first()[0] == len(rows)
