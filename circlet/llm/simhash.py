"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints within 3 bits meet at a variant: one flips at most one bit, the other at most two. Distance 3
joins an even with an odd number of set bits, so only odd fingerprints need pairs of flips; and since two of any
three bits lie in the same half, pairs within a half are enough. An even fingerprint thus emits 65 variants, an
odd one 65 + 2 * C(32, 2) = 1057, whatever the data. Flips of two bits leave one half alone, so the shuffle deals
fingerprints out by a half of their variants and four bits more (74 rows of an even, 86 of an odd fingerprint), and the
variants are made where they meet; both sides of the join are hashed and spill. Where variants collide, every
fingerprint is linked with the smallest one that reached the variant with at most one flip (members of such a
group are within 3 bits of it, by parity), each link is verified, and components follow from the links. A variant
collects at most 2081 fingerprints and groups are linked as stars, so there are no hot keys and no pairs of a group.

Edge cases: null or blank texts have no words and fingerprint zero; one or two words are one shingle; equal texts
share a fingerprint and are handled once; a null doc_id never is a component's id unless all its ids are null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import ascii_lower, discard, pieces, staged, utf8
from circlet.llm.components import connected_components

#: XXH64, fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SEED = 42
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges at once. Ranges of 32 bytes or more go to the library one by one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    h = np.uint64(seed) + P5 + length.astype(np.uint64)
    at = start.copy()
    for n in (8, 16, 24):
        i = np.flatnonzero((length >= n) & (length < 32))
        k = _rot(eight[at[i]] * P2, 31) * P1
        h[i] = _rot(h[i] ^ k, 27) * P1 + P4
        at[i] += 8
    i = np.flatnonzero(length & 4)
    h[i] = _rot(h[i] ^ (four[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
    at[i] += 4
    for n in (1, 2, 3):
        i = np.flatnonzero((length & 3) >= n)
        h[i] = _rot(h[i] ^ (padded[at[i]].astype(np.uint64) * P5), 11) * P1
        at[i] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(length >= 32)
    if len(long):
        whole = data.tobytes()
        h[long] = np.array([xxhash.xxh64_intdigest(whole[s : s + n], seed) for s, n in zip(start[long].tolist(), length[long].tolist())], np.uint64)
    return h


def word_shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of whole rows as ranges (start, length) of space-joined text, with the row of each; rows' order is kept."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(data) else word
    after = np.concatenate([word[1:], [False]]) if len(data) else word
    starts, ends = np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    text = np.full(int((size + 1).sum()), 32, np.uint8)
    place = np.ones(len(text), bool)
    place[at + size] = False
    text[place] = data[word]
    row = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    first = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    of = np.repeat(np.arange(len(n)), count)
    i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    j = np.minimum(i + words, first[of] + n[of]) - 1
    return text, at[i], at[j] + size[j] - at[i], of


def majority(h: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the bits that are set in over half of its hashes. 16-bit lanes sum four bits at once, for up to 60,000 hashes."""
    out = np.zeros(rows, np.uint64)
    if not len(h):
        return out
    n = np.bincount(of, minlength=rows)
    first = np.cumsum(n) - n
    cuts = np.unique(np.concatenate([first[n > 0], *(np.arange(first[r], first[r] + n[r], 60_000) for r in np.flatnonzero(n > 60_000))]))
    part = of[cuts]
    for bit in range(16):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0001000100010001), cuts)
        for lane in range(4):
            total = np.bincount(part, ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.float64), rows)
            out |= (2 * total > n).astype(np.uint64) << np.uint64(bit + 16 * lane)
    return out


def simhash(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text[, key]) -> doc_id, fp[, key]: the 64-bit fingerprint of the lower-cased text's word shingles, repeats included."""
    more = [c for c in ("key",) if c in docs.columns]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            prints = [np.zeros(0, np.uint64)]
            for a, b in pieces(offsets):
                own = ascii_lower(data[offsets[a] : offsets[b]])
                text, start, length, of = word_shingles(own, offsets[a : b + 1] - offsets[a], words)
                prints.append(majority(xxh64(text, start, length), of, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(prints).view(np.int64)), *map(batch.column, more)], ["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in more)]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LOW = (1 << 32) - 1
#: A half's further split: so many bits of the other half, those on top.
SPLIT = 4
REST = 32 - SPLIT
ONE = [1 << i for i in range(32)]
#: Flips of at most two bits of the top of a half, and of what is left of it.
TOP_ONE, TOP_TWO = [1 << i for i in range(SPLIT)], [1 << i | 1 << j for i in range(SPLIT) for j in range(i + 1, SPLIT)]
REST_ONE, REST_TWO = [1 << i for i in range(REST)], [1 << i | 1 << j for i in range(REST) for j in range(i + 1, REST)]


def longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


def halves(side: Column, fp: Column) -> tuple[Column, Column]:
    """The half that side deals by (1: the low one) and the other."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 32)
    return F.when(side == 1, low).otherwise(high), F.when(side == 1, high).otherwise(low)


def seeds(prints: DataFrame) -> DataFrame:
    """(side, half, top, fp): where a fingerprint's variants lie, by a half of theirs and the top of their other half.

    With a bit of the half flipped, the other half is as it is; with the half as it is, at most two bits of the top are
    flipped, and at most one if the fingerprint is even.
    """
    sides = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half, other = halves(F.col("side"), F.col("fp"))
    top = F.shiftright(other, REST)
    flips = F.when(F.bit_count("fp") % 2 == 0, longs([0, *TOP_ONE])).otherwise(longs([0, *TOP_ONE, *TOP_TWO]))
    away = F.transform(longs(ONE), lambda m: F.struct(m.bitwiseXOR(half).alias("half"), top.alias("top")))
    here = F.transform(flips, lambda m: F.struct(half.alias("half"), m.bitwiseXOR(top).alias("top")))
    return sides.select("side", "fp", F.explode(F.concat(here, away)).alias("at")).select("side", "at.half", "at.top", "fp")


def variants(rows: DataFrame, near: bool) -> DataFrame:
    """seeds -> (side, half, top, variant, fp), variant being the other half. near: of one flip at most; else of any number."""
    own, other = halves(F.col("side"), F.col("fp"))
    turned = F.shiftright(other, REST).bitwiseXOR(F.col("top"))
    left = F.when(own != F.col("half"), 0).otherwise(F.when(F.lit(near) | (F.bit_count("fp") % 2 == 0), 1).otherwise(2) - F.bit_count(turned))
    masks = F.when(left == 0, longs([0])).when(left == 1, longs([0, *REST_ONE])).when(left == 2, longs([0, *REST_ONE, *REST_TWO]))
    start = other.bitwiseXOR(F.shiftleft(turned, REST))
    return rows.select("side", "half", "top", "fp", start.alias("start"), F.explode(masks).alias("m")).select("side", "half", "top", F.col("start").bitwiseXOR(F.col("m")).alias("variant"), "fp")


def ball_links(prints: DataFrame) -> DataFrame:
    """prints(fp: long, distinct) -> staged links (a, b) within 3 bits; not all pairs, but the same components.

    The seeds are dealt out by half and top, and no row moves after that: the session of its own says that a join may
    keep a partitioning by some of its keys.
    """
    spark = prints.sparkSession
    alone = spark.newSession()
    alone.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own = staged(prints.select("fp"), alone)
    rows = seeds(own).repartition("side", "half", "top")
    keys = ["side", "half", "top", "variant"]
    centre = variants(rows, near=True).groupBy(*keys).agg(F.min("fp").alias("a"))
    pairs = variants(rows, near=False).join(centre.hint("shuffle_hash"), keys)
    links = staged(pairs.where("fp <> a and bit_count(fp ^ a) <= 3").select("a", F.col("fp").alias("b")).distinct(), spark)
    discard(own)
    return links


def rooted(marks: DataFrame) -> DataFrame:
    """marks(doc_id, fp) -> staged (fp, least_id, root): each fingerprint's smallest doc_id and its component."""
    prints = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    links = ball_links(prints.select("fp"))
    roots = connected_components(links)
    discard(links)
    return staged(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id: the smallest doc_id that links within 3 bits lead to."""
    marks = staged(simhash(docs, words))
    roots = rooted(marks)
    ids = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marks.join(roots.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs, marks(doc_id, key: hash of the text, root) of all their rows -> of each root the first row by doc_id (null last), then key.

    A null doc_id is a member like any other; rows equal in doc_id and text count as one.
    """
    own = {c: f"_own{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    lead = marks.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("lead"))
    keep = staged(lead.select(F.col("lead.doc_id").alias("_id"), F.col("lead.key").alias("_key")))
    out = docs.withColumnsRenamed(own).withColumn("_k", F.xxhash64("text")).join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left_semi")
    repeated = marks.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi").count() > keep.count()
    out = out.dropDuplicates(["doc_id", "_k"]) if repeated else out
    return out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs without near copies by fingerprint: one row of every group, see one_of_each."""
    marks = staged(simhash(docs.withColumn("key", F.xxhash64("text"))))
    return one_of_each(docs, marks.join(rooted(marks), "fp").select("doc_id", "key", "root"))
