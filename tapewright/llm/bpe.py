"""Byte-level BPE encoding and decoding by a prefix-sharing trie.

A byte-pair encoding has this property: the last token of the encoding of a
prefix, together with the encoding of what stands before that token, *is* the
encoding of the prefix. So one token per prefix is enough, and a trie of the
distinct words holds every shared prefix once: walking it depth first, each
node gets its last token from its ancestors, and a word is read off backwards,
last token by last token. Sorted distinct words are the trie in pre-order; the
stack that the walk keeps is the path from the root.

Which of the tokens that end at a node is its last one: exactly one of them is
compatible with the last token of the node where it starts, meaning that the
two stay apart when their joint bytes are merged on their own.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read_table, text_of

# Fixed values of the byte-level scheme: the pre-tokenizer's pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words that each of a worker's two generations of encodings holds; a word met again moves to the younger.
CACHE_BYTES = 2_500_000
#: A word is kept from its second sight on; first sights leave one byte in a table of so many (a power of two).
SIGHTS = 1 << 21
#: Pairs of tokens whose compatibility is remembered.
MOST_PAIRS = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Reads a byte-level BPE file on the driver; a few MB whatever the corpus, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = lambda s: bytes(byte[c] for c in s)
    tokens = {plain(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {"tokens": tokens, "ranks": {(plain(a), plain(b)): r for r, (a, b) in enumerate(pairs)}, "special": special}


class Codec:
    """Encodes and decodes whole texts; one per Python worker."""

    def __init__(self, vocabulary: dict):
        self.tokens, self.ranks, self.special = vocabulary["tokens"], vocabulary["ranks"], vocabulary["special"]
        self.bytes_of = {i: b for b, i in self.tokens.items()} | {i: s.encode() for s, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.starts = {b[:k] for b in self.tokens for k in range(len(b) + 1)}  # what a token can begin with
        self.state_of: dict[bytes, int] = {b"": 0}
        self.states: list[bytes] = [b""]
        self.endings: list[list[tuple[int, int]]] = [[]]  # of each state, the tokens that end there, longest first
        self.step: dict[int, int] = {}  # state * 256 + byte -> state, filled as met
        self.apart: dict[int, bool] = {}
        self.forget()
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def forget(self) -> None:
        """Drops all words: number of ids, ids as text, bytes decoded from the ids."""
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.held, self.sights = 0, bytearray(SIGHTS)

    def merged(self, piece: bytes) -> list[bytes]:
        """The pieces left after merging by rank, lowest first, leftmost first."""
        part = [piece[i : i + 1] for i in range(len(piece))]
        while len(part) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(part, part[1:])))
            if rank == 1 << 60:
                break
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def compatible(self, key: int) -> bool:
        """Whether two tokens, packed in one key, stay apart when merged together."""
        a, b = self.bytes_of[key >> 20], self.bytes_of[key & 0xFFFFF]
        if len(self.apart) > MOST_PAIRS:
            self.apart.clear()
        found = self.apart[key] = self.merged(a + b) == [a, b]
        return found

    def follow(self, key: int) -> int:
        """The state after a byte: the longest start of a token that the text now ends with."""
        piece = self.states[key >> 8] + bytes([key & 255])
        while piece not in self.starts:
            piece = piece[1:]
        if piece not in self.state_of:
            self.state_of[piece] = len(self.states)
            self.states.append(piece)
            self.endings.append([(len(x), self.tokens[x]) for k in range(len(piece)) if (x := piece[k:]) in self.tokens and self.merged(x) == [x]])
        found = self.step[key] = self.state_of[piece]
        return found

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, str, bytes]]:
        """Encodes distinct words in one depth-first walk of their trie."""
        out = {}
        step, endings, apart, size = self.step, self.endings, self.apart, {i: len(b) for i, b in self.bytes_of.items()}
        last, path = [-1], [0]  # at each depth of the path: the last token, the state of token endings
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            n, shared = len(raw), 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], path[shared + 1 :]
            state = path[-1]
            for end in range(shared + 1, n + 1):
                key = state << 8 | raw[end - 1]
                state = step.get(key, -1)
                if state < 0:
                    state = self.follow(key)
                path.append(state)
                for length, token in endings[state]:
                    if length == end:
                        break
                    key = last[end - length] << 20 | token
                    ok = apart.get(key)
                    if ok or ok is None and self.compatible(key):
                        break
                last.append(token)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            out[word] = self.record(ids[::-1])
            before = raw
        return out

    def record(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(self.text_of.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def keep(self, word: str, record: tuple[int, str, bytes]) -> None:
        """Remembers a word; when the younger generation is full it becomes the older, and what only that one had goes."""
        if self.held > CACHE_BYTES:
            self.older, self.words, self.held, self.sights = self.words, {}, 0, bytearray(SIGHTS)
        self.words[word] = record
        self.held += len(record[2])

    def records(self, texts: list[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """What is known of each word of each text. Special tokens' strings become their ids, as the library does."""
        split = self.split.findall
        pieces: list[list[str]] = []
        for text in texts:
            if self.marks and self.marks.search(text):
                pieces.append([w for i, x in enumerate(self.marks.split(text)) for w in ([x] if i % 2 else split(x))])
            else:
                pieces.append(split(text))
        met, here = set().union(*pieces), {}
        for w in met:
            if (r := self.words.get(w)) is not None:
                here[w] = r
            elif (r := self.older.get(w)) is not None:
                here[w] = r
                self.keep(w, r)
        here |= {s: self.record([self.special[s]]) for s in met & self.special.keys()}
        new = self.learn(met.difference(here))
        for w, r in new.items():
            at = hash(w) & SIGHTS - 1
            if self.sights[at]:
                self.keep(w, r)
            else:
                self.sights[at] = 1
        here |= new
        return ([here[w] for w in got] for got in pieces)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [[int(i) for r in got for i in r[1].split(",")] for got in self.records(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become the replacement character; unknown ids raise KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(path: str, shared) -> Codec:
    """The worker's codec of a vocabulary file, kept from task to task; its tables and words are bounded."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(shared.value)
    return _codecs[path]


def _chunks(batch: pa.RecordBatch, column: str, most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in slices of bounded size."""
    at, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= most_chars:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def encode(spark: SparkSession, df: DataFrame, vocabulary_path: str, keep: list[str], text: str = "text", decode_too: bool = True) -> DataFrame:
    """Columns ``keep`` plus ``ids array<int>`` and, if asked, ``decoded string``. Null text: no ids.

    One narrow pass over the input: no shuffle, memory bounded by a batch and
    the caches. Repeated rows are encoded each for itself.
    """
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode_too)

    def run(batches):
        codec = _codec(vocabulary_path, shared)
        for b in batches:
            for at, texts in _chunks(b, "__text"):
                ids = codec.encode_batch(texts)
                cols = {k: b.column(k).slice(at, len(texts)) for k in keep_order} | {"ids": pa.array(ids, pa.list_(pa.int32()))}
                if decode_too:
                    cols["decoded"] = pa.array([codec.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    keep_order = [f.name for f in df.schema.fields if f.name in keep]
    return df.select(*keep_order, text_of(text).alias("__text")).mapInArrow(run, schema)


def digests(spark: SparkSession, df: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256, from ids and text that really were made.

    Same pass as ``encode``, but the ids (several times the text) stay in the worker.
    """
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        codec = _codec(vocabulary_path, shared)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        gc.disable()  # the caches hold no cycles; walking them again and again is all that a collection would do
        try:
            for b in batches:
                for at, texts in _chunks(b, "__text"):
                    out = []
                    for got in codec.records(texts):
                        decoded = b"".join([r[2] for r in got]).decode("utf-8", "replace")
                        out.append((sum([r[0] for r in got]), sha(",".join([r[1] for r in got])), sha(decoded)))
                    yield pa.RecordBatch.from_arrays([b.column(key).slice(at, len(texts)), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string())))], schema.names)
        finally:
            gc.enable()

    return df.select(key, text_of(text).alias("__text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded.

    Nulls and empty texts: no tokens, digests of the empty string. Repeated
    rows: one result row each. Empty table: no rows. Extra columns: ignored.
    """
    return digests(spark, read_table(spark, sf_dir, "documents"), default_vocabulary())
