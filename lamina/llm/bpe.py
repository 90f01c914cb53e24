"""Byte-level BPE encoding and decoding by a prefix-sharing trie walk.

The distinct pre-tokens of a batch are put in byte order, which is the
depth-first order of their trie. The walk keeps, for each node on the current
path, the last token of the encoding of that prefix: the one token that ends
there and may follow the encoding of what precedes it. A prefix that words
share is thus encoded once, and the ids of a word are read back from the
states on its path.

Edge cases: a null or empty text has no ids and decodes to the empty string;
repeated rows are encoded alike; texts of any length are read in bounded runs
of pre-tokens; columns other than the key and the text are not touched.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm._session import arrow_map, named

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = 200_000
CACHE = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file (its JSON text)."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        letters = byte_letters()
        known = spec["model"]["vocab"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in known}
        self.ids = {as_bytes[t]: i for t, i in known.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = known[a], known[b], known[a + b]
            self.rank[left, right] = r
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = (left, right), r
        self.longest = max(map(len, self.ids))
        self.sizes = {i: len(t) for i, t in self.tokens.items()} | {-1: 0}
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.follows: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both keeps the border between them.

        Undoes the merges of both sides from the last one back; the border
        falls if at any time a merge across it had been due before the next
        merge that was done.
        """
        key = (left, right)
        if (known := self.follows.get(key)) is not None:
            return known
        rank, halves, made = self.rank, self.halves, self.made
        before = 1 << 60  # merges across the border must not come before this one
        good = True
        while True:
            across = rank.get((left, right))
            if across is not None and across < before:
                good = False
                break
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                before, left = a, halves[left][1]
            else:  # of equal merges the one further left, which is the border's, comes first
                before, right = b + 1, halves[right][0]
        if len(self.follows) > CACHE:
            self.follows.clear()
        self.follows[key] = good
        return good

    def learn(self, words: set[str]) -> None:
        """Encodes words by one depth-first walk over their trie."""
        get, longest, may_follow, sizes = self.ids.get, self.longest, self.may_follow, self.sizes
        packed = self.packed
        last: list[int] = [-1]
        path = b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            depth, most = 0, min(len(path), len(raw))
            if path[:most] == raw[:most]:
                depth = most
            else:
                while path[depth] == raw[depth]:
                    depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, len(raw) + 1):
                # one token only fits; most often the last one grown by a byte, or the byte alone
                start = end - 1 - sizes[last[-1]]
                token = get(raw[start:end])
                if token is None or (start and not may_follow(last[start], token)):
                    for start in range(end - 1, max(-1, end - 1 - longest), -1):
                        token = get(raw[start:end])
                        if token is not None and (not start or may_follow(last[start], token)):
                            break
                last.append(token)
            path, at, found = raw, len(raw), []
            while at:
                found.append(packed[last[at]])
                at -= sizes[last[at]]
            found.reverse()
            self.words[word] = b"".join(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pattern, out = regex.compile(PATTERN), []
        parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pending: list[list] = []

        def runs(text: str) -> Iterator[list[str]]:
            if len(text) <= RUN:
                yield pattern.findall(text)
                return
            found = pattern.finditer(text)
            while run := [m[0] for m in itertools.islice(found, RUN)]:
                yield run

        def flush() -> None:
            new = set().union(*(run for _, run in pending if isinstance(run, list))) - self.words.keys()
            if len(self.words) + len(new) > CACHE:
                self.words.clear()
                new = set().union(*(run for _, run in pending if isinstance(run, list)))
            self.learn(new)
            get = self.words.__getitem__
            for k, run in pending:
                out[k].append(run if isinstance(run, bytes) else b"".join(map(get, run)))
            pending.clear()

        waiting = 0
        for k, text in enumerate(texts):
            out.append([])
            for piece in (parts.split(text) if parts and parts.search(text) else [text]) if text else []:
                if piece in self.special:
                    pending.append([k, self.special[piece].to_bytes(4, "little")])
                    continue
                for run in runs(piece):
                    pending.append([k, run])
                    waiting += len(run)
                    if waiting > RUN:
                        flush()
                        waiting = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def read_text(spark, path: str) -> str:
    """A tokenizer file of fixed size, read once on the driver from a local path or by Spark."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The worker's vocabulary, by the digest of the file it was read from: workers live on and may serve another file."""
    digest, text = shared.value
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = Vocabulary(text)
    return _loaded[digest]


def shared_text(spark, path: str):
    text = read_text(spark, path)
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the token ids of a text column as little-endian unsigned 32-bit integers (binary).

    Returns the columns `keep` (by default doc_id) and `into`. No shuffle; the
    tokenizer file, whose size does not depend on the data, is broadcast.
    """
    spark = docs.sparkSession
    shared = shared_text(spark, tokenizer)
    keep = ["doc_id"] if keep is None else keep
    frame = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = vocabulary.encode(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*[f"k{i}" for i in range(len(keep))], "ids"])
        vocabulary.words.clear()  # the worker lives on
        vocabulary.follows.clear()

    out = arrow_map(frame, run, T.StructType([*frame.schema.fields[:-1], T.StructField("ids", T.BinaryType())]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(into))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids, special tokens kept."""
    spark = encoded.sparkSession
    shared = shared_text(spark, tokenizer)
    at = encoded.columns.index(ids)
    names = [f"k{i}" for i in range(len(encoded.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [vocabulary.decode(x) if x else "" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    frame = encoded.toDF(*names)
    out = arrow_map(frame, run, T.StructType([*frame.schema.fields, T.StructField("decoded", T.StringType())]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, encoded.columns, strict=True)], F.col("decoded").alias(into))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (by default doc_id), ids and decoded: encode() and decode() by one pass of one worker, so a task holds one vocabulary and texts go to Python once."""
    spark = docs.sparkSession
    shared = shared_text(spark, tokenizer)
    keep = ["doc_id"] if keep is None else keep
    frame = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = vocabulary.encode(part.column(len(keep)).to_pylist())
                texts = [vocabulary.decode(x) if x else "" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[*[f"k{i}" for i in range(len(keep))], "ids", "decoded"])
        vocabulary.words.clear()  # the worker lives on
        vocabulary.follows.clear()

    out = arrow_map(frame, run, T.StructType([*frame.schema.fields[:-1], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    out = round_trip(docs, tokenizer)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
