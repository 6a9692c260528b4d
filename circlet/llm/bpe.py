"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts texts where their content says so, hence equal passages give equal chunks wherever
they stand. Chunks are counted over all documents by a digest of 128 bits; one that occurs twice or more is encoded once,
by the text with the smallest hash that has it, and its ids go to all texts that share it. Other chunks are encoded where
they stand. At every joint the text is encoded anew from the last boundary between pre-tokens that the joint cannot have
moved, over a window that grows until one of its own boundaries is also a boundary of the next chunk; from there the
chunk's ids hold. What is put together this way equals an encoding of the whole text, byte for byte of it.

Edge cases: null is the empty text (0 ids, the digest of the empty string); a special token's text is that token, as
in the library, and no cut falls inside it; a text without a cut is one chunk; repeated rows give repeated results;
an empty table gives none; columns but doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import binary, discard, pieces, staged, utf8
from circlet.llm.wordpiece import byte_letters

#: Chunks are about 2 ** CHUNK_BITS bytes.
CHUNK_BITS = 11
SPAN = 16
#: A boundary this many bytes before an end does not depend on what follows (white space looks 1 ahead, contractions 2).
MARGIN = 8
#: Fixed value: the pattern that byte-level vocabularies of this kind split texts by.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which no two regex engines differ, in words and gaps of fewer than 400.
PLAIN = regex.compile(r"(?:[\t\n\r ]{1,400}+|[!-~\u00a1-\u024f\u2010-\u2027]{1,400}+(?![!-~\u00a1-\u024f\u2010-\u2027]))*+")


def cuts(data: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places where chunks begin: every row's start, and wherever the hash of the 16 bytes before says so, at a character."""
    out = [offsets[:-1]]
    if len(data) > SPAN:
        m = len(data) - SPAN + 1
        one = np.ndarray((m,), "<u8", data, strides=(1,))
        two = np.ndarray((m,), "<u8", data[8:], strides=(1,))
        h = (one * np.uint64(0x9E3779B97F4A7C15)) ^ (two * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(32)
        at = np.flatnonzero((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits) == 0) + SPAN
        for _ in range(3):
            at = np.where((at < len(data)) & ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80), at + 1, at)
        row = np.searchsorted(offsets, at - SPAN, "right") - 1
        out.append(at[at < offsets[np.minimum(row + 1, len(offsets) - 1)]])
    return np.unique(np.concatenate(out))


class Encoder:
    """Encodes and decodes with one tokenizer file, chunk by chunk."""

    def __init__(self, path: str, bits: int = CHUNK_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bits = Tokenizer.from_file(path), bits
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        letters, special = byte_letters(), {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {s.encode(): i for s, i in special.items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        digits = [str(i).encode() + b"," for i in range(len(self.bytes))]
        self.digits = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in digits), np.uint8).reshape(-1, 8)
        self.kept: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.narrow = np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32
        self.starts = np.array([len(b) > 1 and b[:1] == b" " and 32 < b[1] < 127 for b in self.bytes])
        self.plain = self._ranks()

    def _ranks(self):
        """The same merges in a faster encoder, if the vocabulary's ids are the merges' ranks; else nothing."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if i < 256 + len(merges)}
        return tiktoken.Encoding("same", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the token number and byte place of places where a pre-token surely starts.

        A space stands first in a pre-token or among white space only, so a token of a space and more starts one.
        Texts with rare characters, special tokens or endless words go through the library as they are.
        """
        out = []
        for text in texts:
            string = text.decode("utf-8")
            if self.plain and PLAIN.fullmatch(string) and not any(m in text for m in self.special):
                ids = np.array(self.plain.encode_ordinary(string), np.uint32)
            else:
                ids = np.array(self.tokenizer.encode(string, add_special_tokens=False).ids, np.uint32)
            out.append(self.bounded(ids))
        return out

    def bounded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, size = np.flatnonzero(self.starts[ids]), self.size[ids]
        return ids, first, (np.cumsum(size) - size)[first]

    def learn(self, chunks: list[bytes], given: dict[bytes, bytes]) -> None:
        """The parts of these chunks: from given ids (by digest), else encoded, each once."""
        new, self.kept = [], {}
        for chunk in dict.fromkeys(chunks):
            ids = given.get(xxhash.xxh3_128_digest(chunk)) if given else None
            if ids is None:
                new.append(chunk)
            else:
                self.kept[chunk] = self.bounded(np.frombuffer(ids, self.narrow).astype(np.uint32))
        self.kept.update(zip(new, self.encode_all(new)))

    def join(self, text: bytes, places: list[int]) -> np.ndarray:
        """The ids of the text whose chunks begin at `places` (the first is 0)."""
        ends = [*places[1:], len(text)]
        segments: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for number, (c, end) in enumerate(zip(places, ends)):
            ids, first, at = self.kept[text[c:end]]
            if not number:
                segments.append((c, ids, first, at))
                continue
            start = 0
            while segments:
                base, own, own_first, own_at = segments.pop()
                k = int(np.searchsorted(own_at, c - MARGIN - base, "right")) - 1
                if k >= 0:
                    start = base + int(own_at[k])
                    segments.append((base, own[: own_first[k]], own_first[:k], own_at[:k]))
                    break
            reach = 32
            while True:
                reach *= 2
                r = int(np.searchsorted(at, reach))
                stop = c + int(at[r]) if r < len(at) else end
                ids2, first2, at2 = self.encode_all([text[start:stop]])[0]
                if stop == end:
                    segments.append((start, ids2, first2, at2))
                    break
                ok = (at2 + start >= c) & (at2 + start <= stop - MARGIN)
                both = np.intersect1d(at2[ok] + start, at + c)
                if len(both):
                    k, j = int(np.searchsorted(at2, both[0] - start)), int(np.searchsorted(at, both[0] - c))
                    segments.append((start, ids2[: first2[k]], first2[:k], at2[:k]))
                    segments.append((c, ids[first[j] :], first[j:] - first[j], at[j:]))
                    break
        return np.concatenate([s[1] for s in segments]) if segments else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        wide = self.digits[ids]
        return wide[wide != 0].tobytes()[:-1]

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, given: dict[bytes, bytes] | None = None):
        """ids of every row. given: ids of chunks by digest."""
        rows = list(chunked(data, offsets, self.special, self.bits))
        self.learn([text[a:b] for text, places in rows for a, b in zip(places, [*places[1:], len(text)])], given or {})
        for text, places in rows:
            yield text, self.join(text, places)


def special_tokens(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        return [t["content"].encode() for t in json.load(f).get("added_tokens", [])]


def split(text: bytes, places: list[int], special) -> list[int]:
    """places without those inside a special token."""
    for mark in special:
        if len(mark) > 1 and mark in text:
            at, inside = text.find(mark), set()
            while at >= 0:
                inside.update(range(at + 1, at + len(mark)))
                at = text.find(mark, at + len(mark))
            places = [p for p in places if p not in inside]
    return places


def chunked(data: np.ndarray, offsets: np.ndarray, special, bits: int = CHUNK_BITS):
    """Each row's text and the places where its chunks begin."""
    begin = cuts(data, offsets, bits)
    cut = np.searchsorted(begin, offsets)
    whole = data.tobytes()
    for r in range(len(offsets) - 1):
        text = whole[offsets[r] : offsets[r + 1]]
        yield text, split(text, (begin[cut[r] : cut[r + 1]] - offsets[r]).tolist(), special) if text else [0]


def digested(data: np.ndarray, offsets: np.ndarray, special, bits: int):
    """Each row's chunks as (digest, chunk)."""
    for text, places in chunked(data, offsets, special, bits):
        yield [(xxhash.xxh3_128_digest(text[a:b]), text[a:b]) for a, b in zip(places, [*places[1:], len(text)])] if text else []


def counted(rows: DataFrame, path: str, bits: int) -> DataFrame:
    """rows(k, text) -> staged (k, c, n): the digests of each text's chunks and how often they occur; k is the text's hash."""

    def run(batches):
        special = special_tokens(path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            k = batch.column("k").to_numpy()
            for a, b in pieces(offsets):
                found = [[c for c, _ in row] for row in digested(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], special, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k[a:b], [len(x) for x in found])), binary([c for x in found for c in x])], ["k", "c"])

    return staged(rows.mapInArrow(run, "k long, c binary").groupBy("k", "c").agg(F.count("*").alias("n")))


def encoded_once(rows: DataFrame, owners: DataFrame, path: str, bits: int) -> DataFrame:
    """rows(k, text), owners(k, cs: digests) -> (c, ids) of these chunks. Rows of one k meet in one task, which encodes a chunk once."""

    def run(batches):
        encoder, done = Encoder(path, bits), set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            wanted = batch.column("cs").to_pylist()
            for a, b in pieces(offsets):
                todo = {}
                for want, row in zip(wanted[a:b], digested(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], encoder.special, bits)):
                    want = set(want) - done
                    todo |= {c: chunk for c, chunk in row if c in want}
                done |= todo.keys()
                ids = [parts[0].astype(encoder.narrow).tobytes() for parts in encoder.encode_all(list(todo.values()))]
                yield pa.RecordBatch.from_arrays([binary(list(todo)), binary(ids)], ["c", "ids"])

    return rows.select("k", "text").join(owners.hint("shuffle_hash"), "k").mapInArrow(run, "c binary, ids binary")


def with_shared(rows: DataFrame, path: str, bits: int) -> DataFrame:
    """rows(k, text, ...) with known: digests and ids of the text's chunks that occur elsewhere too (null for none)."""
    each = counted(rows, path, bits)
    shared = each.groupBy("c").agg(F.sum("n").alias("n"), F.min("k").alias("owner")).where("n > 1").select("c", "owner")
    hits = staged(each.select("k", "c").join(shared, "c").select("k", "c", (F.col("k") == F.col("owner")).alias("own")))
    discard(each)
    owners = hits.where("own").groupBy("k").agg(F.collect_list("c").alias("cs"))
    # Once more by chunk, should a task that was split have encoded one twice.
    ids = staged(encoded_once(rows, owners, path, bits).groupBy("c").agg(F.min("ids").alias("ids")))
    known = hits.join(ids, "c").groupBy("k").agg(F.collect_list(F.struct("c", "ids")).alias("known"))
    return rows.join(known.hint("shuffle_hash"), "k", "left")


def digests(docs: DataFrame, path: str, bits: int = CHUNK_BITS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256. path: the tokenizer's file on every executor."""

    def run(batches):
        encoder = Encoder(path, bits)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            known = batch.column("known")
            n, one, two = [], [], []
            for a, b in pieces(offsets):
                flat = known.slice(a, b - a).flatten()
                given = dict(zip(flat.field("c").to_pylist(), flat.field("ids").to_pylist()))
                for _, ids in encoder.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], given):
                    n.append(len(ids))
                    one.append(hashlib.sha256(encoder.listed(ids)).hexdigest())
                    two.append(hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("k"))
    return with_shared(rows, path, bits).select("doc_id", "text", "known").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (array of int)."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                ids = [x.astype(np.int32) for _, x in encoder.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text; null ids give a null text."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
