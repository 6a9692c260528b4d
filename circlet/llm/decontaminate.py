"""Benchmark decontamination by Wu-Manber search for many word windows at once.

A text is written as its lower-cased words with one space before, between and after them, so a window of words is a
string with a space at either end, and occurs as a string where its words stand consecutively. Windows are searched
together by classes of their length. In a class whose shortest string has m bytes, a table says for every block of 8
bytes how far a search position may move: all the way past it if no window has the block in its first m bytes, else to
where it could end them. Where the shift is 0, the bucket of that block and a hash of the first m bytes select the
windows to test: for each length among them the whole string is looked up by its hash and compared byte by byte. Many
stretches of a batch of texts are searched in step.

The windows of a benchmark go to the tasks in tables of at most SHARD windows, each built in a task of its own and
broadcast; with more windows than that, every table has a pass of its own over the texts and the passes are put together
by text. Long items are cut into pieces that overlap by a window less a word, so no table depends on an item's length.

Edge cases: null or wordless texts have no words and no hits; a null or wordless item has no window; equal item_ids are
one item, and items of a null item_id hit words but are neither counted nor listed; a window that many items have hits for
all of them; repeated documents are judged each; an empty table on either side gives no hits; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import ascii_lower, binary, discard, pieces, staged, utf8

#: Bytes of words, once lower-cased: the complement of \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
LETTER = np.ones(256, bool)
LETTER[0x00:0x30] = LETTER[0x3A:0x61] = LETTER[0x7B:0x80] = False
WORDS = 10
#: Windows in one broadcast table (about 60 MB at most), and of one piece of a long item.
SHARD, PIECE = 1 << 20, 4096
#: Classes of windows: by their length in bytes, from one bound up to the next.
CLASSES = (0, 8, 16, 32)
BLOCK, LANE = 8, 256
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
EMPTY = hashlib.sha256(b"").hexdigest()


class Words:
    """The words of whole rows as bytes with single spaces: row by row, each word after a space, a space more at a row's end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = ascii_lower(data)
        letter = LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], letter[:-1]]) if len(data) else letter
        after = np.concatenate([letter[1:], [False]]) if len(data) else letter
        start, end = np.flatnonzero(letter & (~before | edge[:-1])), np.flatnonzero(letter & (~after | edge[1:])) + 1
        self.size = end - start
        self.row = np.searchsorted(offsets, start, "right") - 1
        self.n = np.bincount(self.row, minlength=len(offsets) - 1) if len(start) else np.zeros(len(offsets) - 1, np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.at = np.cumsum(self.size + 1) - self.size + self.row
        self.text = np.full(int((self.size + 1).sum()) + len(self.n), 32, np.uint8)
        place = np.zeros(len(self.text) + 1, np.int8)
        place[self.at] += 1
        place[self.at + self.size] -= 1
        self.text[np.cumsum(place[:-1], dtype=np.int8).astype(bool)] = data[letter]

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of every window of `words` words; a row of fewer, but not none, is one window."""
        count = np.where(self.n == 0, 0, np.maximum(self.n - words + 1, 1))
        of = np.repeat(np.arange(len(self.n)), count)
        first = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + self.first[of]
        return first, np.minimum(words, self.n[of])

    def strings(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, with the space before them, and their length, with the space after them."""
        last = first + words - 1
        return self.at[first] - 1, self.at[last] + self.size[last] + 2 - self.at[first]


def powers(n: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE to the powers 0 to n, and their inverses, of 64 bits; kept from call to call."""
    if len(kept.get("up", ())) <= n:
        for name, x in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            factors = np.full(n + n // 4 + 1, x, np.uint64)
            factors[0] = 1
            kept[name] = np.cumprod(factors)
    return kept["up"], kept["down"]


class Hashes:
    """Hashes of any range of bytes from running sums."""

    def __init__(self, text: np.ndarray):
        up, self.down = powers(len(text))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def blocks_of(text: np.ndarray, size: int) -> np.ndarray:
    """A view of the `size` (8 at most) bytes from every place on as a number; longer reads are masked by the caller."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))


def mask_of(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def spread(block: np.ndarray, bits: int) -> np.ndarray:
    block = block * SPREAD
    return ((block ^ (block >> np.uint64(32))) * BASE) >> np.uint64(64 - bits)


def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, where: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a from `at` on and b from `where` on have the same bytes for the length, range by range."""
    out = np.zeros(len(at), bool)
    for lo in range(0, len(at), 1 << 15):
        x, y, n = at[lo : lo + (1 << 15)], where[lo : lo + (1 << 15)], length[lo : lo + (1 << 15)]
        base = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(base, n)
        out[lo : lo + len(x)] = np.logical_and.reduceat(a[np.repeat(x, n) + step] == b[np.repeat(y, n) + step], base)
    return out


class Shifts:
    """Wu-Manber tables of windows of similar length."""

    def __init__(self, text: np.ndarray, hashes: Hashes, start: np.ndarray, length: np.ndarray, number: np.ndarray):
        self.m = int(length.min())
        self.block = min(BLOCK, self.m)
        self.most = self.m - self.block + 1
        self.bits = int(min(24, max(12, (4 * len(start) * self.most).bit_length())))
        view, mask = blocks_of(text, self.block), mask_of(self.block)
        self.shift = np.full(1 << self.bits, self.most, np.uint8 if self.most < 256 else np.int32)
        # Later blocks of the first m bytes allow smaller shifts and are entered over earlier ones.
        for j in range(self.most):
            self.shift[spread(view[start + j] & mask, self.bits)] = self.most - 1 - j
        last = spread(view[start + self.most - 1] & mask, self.bits)
        key = self.key(last, hashes(start, self.m))
        # Bucket and prefix with each length there, then whole windows by hash.
        entry = np.unique(np.rec.fromarrays([key, length], names="key,length"))
        self.keys, self.lengths = entry["key"].copy(), entry["length"].astype(np.int64)
        whole = hashes(start, length)
        order = np.argsort(whole, kind="stable")
        self.whole, self.start, self.length, self.number = whole[order], start[order], length[order], number[order]

    def key(self, bucket: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return (bucket << np.uint64(40)) | (prefix >> np.uint64(24))

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window may begin and the bucket of each: stretches of LANE end positions are searched in step."""
        view, mask, back = blocks_of(text, self.block), mask_of(self.block), self.most - 1
        begin = np.arange(0, max(0, len(text) - self.m + 1), LANE)
        end = np.minimum(begin + LANE, len(text) - self.m + 1)
        places, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(begin):
            bucket = spread(view[begin + back] & mask, self.bits)
            move = self.shift[bucket].astype(np.int64)
            hit = move == 0
            if hit.any():
                places.append(begin[hit])
                buckets.append(bucket[hit])
            begin = begin + np.maximum(move, 1)
            going = begin < end
            begin, end = begin[going], end[going]
        return np.concatenate(places), np.concatenate(buckets)

    def occurrences(self, text: np.ndarray, hashes: Hashes, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence; own: the text that the windows are cut from."""
        at, bucket = self.candidates(text)
        key = self.key(bucket, hashes(at, self.m))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        at, entry = expanded(at, low, high)
        length = self.lengths[entry]
        inside = at + length <= len(text)
        at, length = at[inside], length[inside]
        whole = hashes(at, length)
        low, high = np.searchsorted(self.whole, whole, "left"), np.searchsorted(self.whole, whole, "right")
        where = np.arange(len(at))
        where, window = expanded(where, low, high)
        fits = self.length[window] == length[where]
        at, window = at[where[fits]], window[fits]
        equal = same(text, at, own, self.start[window], self.length[window])
        return at[equal], self.number[window[equal]]


def expanded(what: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of `what` with every number from low up to high."""
    n = high - low
    return np.repeat(what, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)


class Table:
    """Distinct windows of some items, their tables by class, and which items have them (as numbers of distinct sets)."""

    def __init__(self, ids: list, texts: list, words: int):
        column = pa.array(texts, pa.large_string())
        own = Words(*utf8(column))
        first, count = own.windows(words)
        start, length = own.strings(first, count)
        raw, number, holders = own.text.tobytes(), {}, []
        pick = []
        for i, (s, n, row) in enumerate(zip(start.tolist(), length.tolist(), own.row[first].tolist())):
            at = number.setdefault(raw[s : s + n], len(holders))
            if at == len(holders):
                holders.append(set())
                pick.append(i)
            if ids[row] is not None:
                holders[at].add(ids[row])
        sets: dict = {}
        self.set_of = np.array([sets.setdefault(tuple(sorted(h)), len(sets)) for h in holders], np.int64)
        self.sets = list(sets)
        self.text, self.words = own.text, count[pick]
        start, length, hashes = start[pick], length[pick], Hashes(own.text)
        kind = np.searchsorted(CLASSES, length, "right")
        self.classes = [Shifts(self.text, hashes, start[k], length[k], np.flatnonzero(k)) for c in np.unique(kind) for k in [kind == c]]

    def found(self, own: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit: of each word, and row and set of items, each pair once)."""
        hashes = Hashes(own.text)
        turn = np.zeros(len(own.at) + 1, np.int64)
        rows, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for kind in self.classes:
            at, window = kind.occurrences(own.text, hashes, self.text)
            word = np.searchsorted(own.at, at + 1)
            np.add.at(turn, word, 1)
            np.add.at(turn, word + self.words[window], -1)
            rows.append(own.row[word])
            sets.append(self.set_of[window])
        pair = np.unique(np.concatenate(rows) * max(1, len(self.sets)) + np.concatenate(sets))
        return np.cumsum(turn[:-1]) > 0, pair // max(1, len(self.sets)), pair % max(1, len(self.sets))


def cut_items(benchmark: DataFrame, words: int, piece: int) -> DataFrame:
    """benchmark(item_id, text) -> (id, text) of pieces of at most `piece` windows; equal pieces of an item are one."""

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            data, offsets = utf8(batch.column("text"))
            own = Words(data, offsets)
            raw = own.text.tobytes()
            for i, n, first in zip(batch.column("id").to_pylist(), own.n.tolist(), own.first.tolist()):
                for w in range(0, max(n - words + 1, 1) if n else 0, piece):
                    last = first + min(n, w + piece + words - 1) - 1
                    ids.append(i)
                    texts.append(raw[own.at[first + w] : own.at[last] + own.size[last]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items.mapInArrow(run, "id string, text string").distinct()


def tables(benchmark: DataFrame, words: int, shard: int, piece: int) -> DataFrame:
    """(blob): staged pickled tables of about `shard` windows each; no row if there is no window."""
    items = staged(cut_items(benchmark, words, piece))
    windows = items.agg(F.sum(F.greatest(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 2 - words, F.lit(1)))).first()[0] or 0
    shards = max(1, -(-windows // shard))

    def build(batches):
        ids, texts = [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([binary([pickle.dumps(Table(ids, texts, words), 5)])], ["blob"])

    at = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")
    built = staged(items.repartitionById(shards, at).mapInArrow(build, "blob binary"))
    discard(items)
    return built


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, spans (of words, from and up to), n_hit, n_items, items_sha256."""
    spark = docs.sparkSession
    built = tables(benchmark, words, shard, piece)
    # A table at a time passes the driver: its size is bounded by `shard`.
    sent = [spark.sparkContext.broadcast(row["blob"]) for row in built.toLocalIterator()]
    discard(built)
    texts = docs.select("doc_id", "text")
    if len(sent) <= 1:
        return searched(texts, sent[0] if sent else None)
    keyed = staged(texts.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")))
    distinct = keyed.select("key", "text").dropDuplicates(["key"])
    parts = [searched(distinct, one, listed=True) for one in sent]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    whole = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    joined = F.aggregate(F.array_sort("spans"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= x["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(done, F.array(x))))
    whole = whole.withColumn("spans", joined)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    whole = whole.select("key", "n_words", "spans", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return keyed.select("doc_id", "key").join(whole, "key").drop("key")


def searched(rows: DataFrame, sent, listed: bool = False) -> DataFrame:
    """rows(doc_id or key, text) searched for one broadcast table's windows; listed: with the items' ids instead of their digest."""
    name = "key" if listed else "doc_id"

    def run(batches):
        table: Table | None = pickle.loads(sent.value) if sent else None
        digests: dict = {}

        def digest(key: tuple):
            if key not in digests:
                ids = sorted({i for s in key for i in table.sets[s]})
                digests[key] = ids if listed else (len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
                if len(digests) > 10_000:
                    digests.pop(next(iter(digests)))
            return digests[key]

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                own = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows_n = b - a
                hit, row, which = table.found(own) if table else (np.zeros(len(own.at), bool), np.zeros(0, int), np.zeros(0, int))
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                # A run of hit words goes on into the next row only by chance of place: cut it there.
                start, end = cut_at_rows(start, end, own)
                at = own.row[start]
                count = np.bincount(at, minlength=rows_n)
                base = own.first[at]
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["a", "b"]))
                sets = np.split(which, np.cumsum(np.bincount(row, minlength=rows_n))[:-1]) if rows_n else []
                out = [digest(tuple(s.tolist())) if len(s) else ([] if listed else (0, EMPTY)) for s in sets]
                n_hit = np.bincount(own.row[hit], minlength=rows_n).astype(np.int64)
                tail = [pa.array(out, pa.list_(pa.string()))] if listed else [pa.array(n_hit), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(name).slice(a, rows_n), pa.array(own.n.astype(np.int64)), spans, *tail], names)

    tail = "ids array<string>" if listed else "n_hit long, n_items long, items_sha256 string"
    kind = dict(rows.dtypes)[name]
    schema = f"{name} {kind}, n_words long, spans array<struct<a:bigint,b:bigint>>, {tail}"
    names = [name, "n_words", "spans", *(["ids"] if listed else ["n_hit", "n_items", "items_sha256"])]
    return rows.select(name, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def cut_at_rows(start: np.ndarray, end: np.ndarray, own: Words) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words, cut where a row ends."""
    inner = own.first[(own.n > 0) & (own.first > 0)]
    run = np.searchsorted(start, inner, "right") - 1
    inside = (run >= 0) & (start[np.maximum(run, 0)] < inner) & (inner < end[np.maximum(run, 0)]) if len(start) else np.zeros(len(inner), bool)
    return np.sort(np.concatenate([start, inner[inside]])), np.sort(np.concatenate([end, inner[inside]]))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = decontaminate(docs, benchmark)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
