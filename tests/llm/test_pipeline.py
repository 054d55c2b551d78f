"""The pipeline against its stages done plainly on a small fixture."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import VOCABULARY

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    r = random.Random(8)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(x) for x in table.collect()]
    items = [(1, " ".join(f"item{r.randrange(50)}" for _ in range(30))), (2, None)]
    first, other = rows[0], [" ".join(reversed(rows[i][1].split())) for i in (1, 2)]
    rows += [
        (5_001, None, "en", "s", None), (5_002, "123 456", "en", "s", 7), (5_003, first[1] + " end", first[2], "s", 0),
        (5_004, f"{other[0]} {items[0][1].upper()}", "en", "s", 0), first,
        (5_005, other[1] + " password: Tr0ub4dor9xQ27", rows[2][2], "lone", 0), (None, "the of and " * 30, "en", "s", 330),
    ]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rows, items = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # Language: only what has no letters goes.
    assert len(kept["language"]) == len(rows) - 2
    # Near duplicates: the first of each component.
    left = [(r["doc_id"], r["text"]) for r in kept["language"]]
    ids = sorted({c for _, n, c in brute.components(left) if n}, key=str)
    assert sorted((r["doc_id"] for r in kept["near_duplicates"]), key=str) == ids
    # Passages: the document with the item goes, and those of the table's own benchmark stay as it is not given.
    gone = set(ids) - {r["doc_id"] for r in kept["decontamination"]}
    assert gone == {5_004}
    # Secrets: no document goes; live ones are marked.
    texts = {r["doc_id"]: r for r in kept["secrets"]}
    assert len(texts) == len(kept["decontamination"])
    assert texts[5_005]["text"].endswith("password: [SECRET]") and texts[5_005]["n_chars"] == len(texts[5_005]["text"])
    library = Tokenizer.from_file(VOCABULARY)
    for r in kept["tokens"]:
        assert r["ids"] == library.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in whole.collect()) == sorted((r["doc_id"] or 0, r["n_tokens"]) for r in kept["tokens"])


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
