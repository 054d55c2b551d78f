"""BPE encoding and decoding with a vocabulary file, by depth-first traversal of a trie of distinct words.

The last token of every prefix's encoding is unique. Going down the trie of the distinct words of a batch, the
state of a node is that last token: the one vocabulary entry that ends there and may follow the state of the node
where it starts. Two tokens may follow one another if merging their joined symbols gives just these two; a sequence
is the encoding if that holds for all its neighbours. So the encoding of a prefix that words share is computed once,
and a word is read off by following the states back. The trie is held as its words in sorted order, which is its
depth-first order; the states of the current path are the only ones in memory.

Results equal those of the ``tokenizers`` library for files with the same settings (composed form, lower case, white
space dropped, byte symbols, a suffix at the end of a word).

Null text counts as empty: no tokens. An empty table gives an empty result; equal rows give equal results; all
columns but the two that are named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tradewind.llm.common import bounded_batches, pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space of the vocabulary's patterns (Unicode's property; str.isspace has four control characters more).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pattern of the vocabulary file.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words and pairs a task remembers; beyond that it starts anew, which costs time and changes no result.
REMEMBERED = 400_000


def byte_symbols() -> dict[str, int]:
    """Printable character of each byte in a byte-level vocabulary: Latin-1 where that prints, else from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The vocabulary as bytes: tokens inside a word, tokens that end a word, and the merges by rank."""

    def __init__(self, content: str):
        file = json.loads(content)
        model, self.suffix = file["model"], file["model"]["end_of_word_suffix"]
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or not self.suffix or pattern != _FILE_PATTERN or file["decoder"] is not None:
            raise ValueError("a BPE vocabulary with a word suffix, the known pattern and no decoder is needed")
        symbols = byte_symbols()

        def plain(token: str) -> bytes:
            return bytes(symbols[c] for c in token)

        self.strings: dict[int, str] = {i: s for s, i in model["vocab"].items()}
        self.inside: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        self.parts: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            ends = token.endswith(self.suffix)
            word = plain(token.removesuffix(self.suffix) if ends else token)
            (self.ending if ends else self.inside)[word] = i
            self.parts[i] = word
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {
            (model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.ends = set(self.ending.values())
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.longest = max(map(len, self.parts.values()))
        self.memory: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: int) -> list[int]:
        part = self.parts[token]
        own = [self.inside[part[i : i + 1]] for i in range(len(part))]
        if token in self.ends:
            own[-1] = self.ending[part[-1:]]
        return own

    def merged(self, tokens: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first, until none is left; for the few symbols of one or two tokens."""
        while len(tokens) > 1:
            found = [(self.merges[p][0], i) for i, p in enumerate(pairwise(tokens)) if p in self.merges]
            if not found:
                break
            _, i = min(found)
            tokens = [*tokens[:i], self.merges[tokens[i], tokens[i + 1]][1], *tokens[i + 2 :]]
        return tokens

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before``; 'before' is -1 at the start of a word."""
        known = self.memory.get((before, token))
        if known is None:
            wanted = [token] if before < 0 else [before, token]
            known = self.merged([s for t in wanted for s in self._symbols(t)]) == wanted
            if len(self.memory) > 5 * REMEMBERED:
                self.memory.clear()
            self.memory[before, token] = known
        return known

    def _state(self, word: bytes, end: int, tokens: dict[bytes, int], last: list[int]) -> tuple[int, int]:
        """The token that ends at ``end`` and where it starts."""
        for start in range(max(0, end - self.longest), end):
            token = tokens.get(word[start:end])
            if token is not None and self.follows(last[start], token):
                return token, start
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Every distinct word with its tokens, in depth-first order of the trie."""
        last, back, path = [-1], [0], b""  # states by depth, where their tokens start, the current path
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word), len(last) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            path = word
            for depth in range(shared + 1, len(word)):
                token, start = self._state(word, depth, self.inside, last)
                last.append(token)
                back.append(start)
            token, at = self._state(word, len(word), self.ending, last)
            ids = [token]
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            yield word, ids

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, token strings are joined by blanks; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


class WordSplitter:
    """Words of a text in lower case, as bytes; the strings of special tokens are found before all else.

    Scripts in which newer Unicode versions add letters are split by the library's own normalizer and pattern,
    because Python's tables are of another version; elsewhere the tables agree.
    """

    def __init__(self, content: str):
        file = Tokenizer.from_str(content)
        self.normalize = file.normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(_FILE_PATTERN), "removed", invert=True).pre_tokenize_str
        self.words = regex.compile(_FILE_PATTERN.replace(r"\s", _SPACE)).findall
        self.other_scripts = regex.compile("[\u0530-\u1fff\u2070-\U0010ffff]").search
        special = [t["content"] for t in json.loads(content)["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def pieces(self, text: str) -> Iterator[str | list[str]]:
        """Special strings as text, what is between them as lists of words."""
        for i, piece in enumerate(self.special.split(text) if "<|" in text else [text]):
            if i % 2:
                yield piece
            elif piece.isascii():
                yield self.words(piece.lower())
            elif self.other_scripts(piece) or "Σ" in piece:
                # Python lower-cases a capital sigma by its neighbours, the library does not.
                yield [word for word, _ in self.split(self.normalize(piece))]
            elif piece:
                yield self.words(unicodedata.normalize("NFC", piece).lower())


_KINDS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def _column(kind: str, coded: list[bytes], decoded: list[bytes]) -> pa.Array:
    if kind == "n_tokens":
        return pa.array([len(c) // 4 for c in coded], pa.int64())
    if kind == "ids":
        ends = np.cumsum([0, *[len(c) // 4 for c in coded]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
    if kind == "decoded":
        return pa.array([d.decode() for d in decoded], pa.string())
    return pa.array([hashlib.sha256(c).hexdigest() for c in (coded if kind == "ids_sha256" else decoded)], pa.string())


def encode(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """``id_col`` and, for each row, what ``columns`` names: ``n_tokens``, ``ids``, ``decoded`` (the ids decoded),
    ``ids_sha256`` (of the ids as unsigned 32-bit little-endian numbers) and ``decoded_sha256`` (of UTF-8).

    ``vocabulary`` is a file the driver can read; its content (a few MB, fixed) is sent to the tasks.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = bounded_batches(df).sparkContext.broadcast(file.read())
    rows = pick(df, **{"key": id_col, "text": text_col})
    key_type = rows.schema["key"].dataType
    schema = T.StructType([T.StructField(id_col, key_type)] + [T.StructField(c, _KINDS[c]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(content.value)
        splitter = WordSplitter(content.value)
        special = {s: (i.to_bytes(4, "little"), s.encode()) for s, i in vocab.special.items()}
        known: dict[str, tuple[bytes, bytes]] = {}
        for batch in batches:
            texts = [list(splitter.pieces(t or "")) for t in batch.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = {w for pieces in texts for p in pieces if isinstance(p, list) for w in p} - known.keys()
            by_bytes = {w.encode(): w for w in new}
            for word, ids in vocab.encode_words(by_bytes):
                coded = b"".join(i.to_bytes(4, "little") for i in ids)
                known[by_bytes[word]] = coded, vocab.decode(ids).encode()
            coded, decoded = [], []
            for pieces in texts:
                parts = []
                for p in pieces:
                    parts += [special[p]] if isinstance(p, str) else map(known.__getitem__, p)
                coded.append(b"".join([p[0] for p in parts]))
                if {"decoded", "decoded_sha256"} & set(columns):
                    decoded.append(b" ".join([p[1] for p in parts]))
            arrays = [batch.column("key"), *[_column(c, coded, decoded) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *columns])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``, the token strings of ``ids_col`` joined by blanks as the library does; ids that the
    vocabulary lacks are left out. Null ids count as none."""
    with open(vocabulary, encoding="utf-8") as file:
        content = bounded_batches(df).sparkContext.broadcast(file.read())
    rows = pick(df, **{"key": id_col, "ids": ids_col})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(content.value)
        for batch in batches:
            texts = [vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["key"].dataType), T.StructField("decoded", T.StringType())]))
