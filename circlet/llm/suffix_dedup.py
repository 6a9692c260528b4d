"""Suffix-array de-duplication: bytes that belong to a 50-byte string of a document with a smaller doc_id go.

1. Anchors. In every 50-byte window one 20-byte gram is chosen by its hash alone, so equal windows choose equal grams at
   equal places; about one position in 16 is an anchor of a run of windows. Grams are counted by document with partial
   aggregation; only those of two or more documents go on.
2. Contexts. The documents that have such grams cut out, per anchor, the text that its windows cover (at most 80 bytes)
   and the symbols on either side of it. Occurrences of one context are one leaf of the tree, however many they are.
3. Common-prefix interval trees. The contexts of a gram meet in one task and form a suffix array of window starts with
   the lengths of common prefixes; a stack scan yields its intervals of 50 bytes or more, a leaf of several occurrences
   among them, and those whose occurrences differ to the left are maximal repeats. Each repeat gives all its
   occurrences, not neighbours only, the smallest document of the group; nothing else does. A gram of over SPLIT contexts
   is dealt out to tasks by longer prefixes, with the same result: a passage that very many documents share ends in as
   many different contexts, and all of them would meet in one task otherwise.
4. `spans`: documents take over their windows' smallest documents; what is larger than one is cut from the text.
5. `repeat_groups`: a repeat that goes on beyond a context is put together again. Its first window has occurrences that
   differ to the left and its last one to the right, so all runs of repeated text between two such places are candidates,
   and those of equal content meet by hash of 128 bits: the maximal repeats of the whole corpus, at full length, with all
   occurrences. They cover the bytes that the intervals around anchors cover, hence `spans` doesn't need them.

Edge cases: null is the empty text; a text under 50 bytes stays whole; rows with a null doc_id come after all others (and
so does the doc_id 2^63 - 1, which counts as null) and don't remove from each other, as rows that repeat a doc_id don't;
rows that repeat a doc_id and a text are searched once and get equal results, and are one document of `repeat_groups`,
where repeats within a document count; an empty table gives none; extra columns, whatever their names, are carried along
by `without_repeats` and not read otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import discard, pieces, small, staged, utf8

LENGTH, GRAM = 50, 20
#: Contexts of a gram that go to one task together, and of all grams of a group.
SPLIT = 2000
BUCKET = 4000
#: Places of the anchor in a window that a group too large for one task is dealt out by, one after the other; the last is 1.
STEPS = (8, 2, 1)
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first and last window start, anchor place, gram hash. 16 <= gram <= 24."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    m = n - gram + 1
    h = np.ndarray((m,), "<u8", data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += np.ndarray((m,), "<u8", data[8:], strides=(1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= np.ndarray((m,), "<u8", data[gram - 8 :], strides=(1,)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    # Hash above, place below: the smallest key of a window is its leftmost smallest gram.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span, have = length - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    fits = np.repeat(offsets[:-1], size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    row = np.repeat(np.arange(len(size)), size)
    place = at[fits]
    change = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = np.append(change[1:], len(fits)) - 1
    return (row[change], fits[change], fits[last], place[change], h[place[change]]) if len(fits) else (row, fits, fits, place, h[:0])


def keyed(docs: DataFrame) -> DataFrame:
    """d: doc_id with null last; t: the text's hash, so that rows that repeat a doc_id with another text stay apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("t"), "text")


def once(rows: DataFrame) -> DataFrame:
    """keyed rows, each (d, t) once; only the texts of those that repeat are moved."""
    repeated = small(rows.groupBy("d", "t").count().where("count > 1").select("d", "t"))
    if not repeated.limit(1).count():
        return rows
    return rows.join(repeated, ["d", "t"], "left_anti").union(rows.join(repeated, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]))


def grams(rows: DataFrame) -> DataFrame:
    """(g, d, t) of every anchor."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            d, t = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for a, b in pieces(offsets):
                row, _, _, _, g = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(d[a + row]), pa.array(t[a + row])], ["g", "d", "t"])

    return rows.mapInArrow(run, "g long, d long, t long")


def contexts(rows: DataFrame) -> DataFrame:
    """rows(d, t, text, gs) -> (g, d, t, a, off, l, r, c): per anchor whose gram is in gs, the text c from byte a that its windows cover.

    off: the anchor's place in c; l and r: the bytes before and after c, -1 at the text's ends.
    """
    spread = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            d, t = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            sets = batch.column("gs")
            for a, b in pieces(offsets):
                own = data[offsets[a] : offsets[b]]
                row, first, last, place, g = anchors(own, offsets[a : b + 1] - offsets[a])
                wanted = sets.slice(a, b - a)
                of = np.repeat(np.arange(b - a), wanted.value_lengths().to_numpy())
                # A pair that collides with a wanted one adds a context without a match, no more.
                keep = np.isin(g ^ (row.astype(np.uint64) * spread), wanted.flatten().to_numpy().view(np.uint64) ^ (of.astype(np.uint64) * spread))
                row, first, last, place, g = (x[keep] for x in (row, first, last, place, g))
                whole = own.tobytes()
                begin, end = offsets[a + row] - offsets[a], offsets[a + row + 1] - offsets[a]
                l = np.where(first > begin, own[np.maximum(first - 1, 0)].astype(np.int16), -1)
                r = np.where(last + LENGTH < end, own[np.minimum(last + LENGTH, len(own) - 1)].astype(np.int16), -1) if len(own) else np.zeros(0, np.int16)
                text = pa.array([whole[x:y] for x, y in zip(first.tolist(), (last + LENGTH).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(d[a + row]), pa.array(t[a + row]), pa.array(first - begin), pa.array((place - first).astype(np.int32)), pa.array(l.astype(np.int16)), pa.array(r.astype(np.int16)), text], ["g", "d", "t", "a", "off", "l", "r", "c"])

    return rows.mapInArrow(run, "g long, d long, t long, a long, off int, l short, r short, c binary")


def words(text: np.ndarray, at: np.ndarray, rest: np.ndarray, first: int, last: int) -> list[np.ndarray]:
    """Bytes first to last of suffixes as numbers of 8 bytes; bytes from the suffix's end on are zero. text is padded."""
    out = []
    eight = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    for b in range(first, last, 8):
        word = eight[at + b].astype(np.uint64)
        have = np.clip(np.minimum(rest, last) - b, 0, 8)
        if len(have) and have.min() < 8:
            word = np.where(have > 0, word >> (np.uint64(8) * np.minimum(8 - have, 7).astype(np.uint64)) << (np.uint64(8) * np.minimum(8 - have, 7).astype(np.uint64)), np.uint64(0))
        out.append(word)
    return out


def common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of numbers of 8 bytes."""
    n = np.zeros(len(x), np.int64)
    for shift in range(0, 64, 8):
        n += (x >> np.uint64(shift)) == 0
    return n


def suffix_array(text: np.ndarray, at: np.ndarray, rest: np.ndarray, group: np.ndarray, least: int, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of `rest` bytes at places of a padded text, within groups.

    Suffixes whose first `least` bytes no other one has are in no interval, unless they are a leaf that is one itself;
    those are told by a hash and left out before the sort, which is by the bytes themselves. lcp[i] is of suffixes i - 1
    and i, 0 where it is below `least`.
    """
    head = words(text, at, rest, 0, least)
    h = group.astype(np.uint64)
    for word in head:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    again = np.sort(by[np.append(same, False) | np.append(False, same) | leaf[by]]) if len(by) else by
    keys = [group[again], *(w[again] for w in head)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(again), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(again) else False
    again, run = again[order], np.cumsum(new)
    longest = int(rest[again].max(initial=least))
    tail = words(text, at[again], rest[again], least, longest)
    order = np.lexsort([rest[again], *tail[::-1], run])
    again, run, tail = again[order], run[order], [w[order] for w in tail]
    lcp = np.zeros(len(again), np.int64)
    alike = run[1:] == run[:-1]
    lcp[1:][alike] = least
    for word in tail:
        both = common_bytes(word[1:] ^ word[:-1])
        lcp[1:] += np.where(alike, both, 0)
        alike = alike & (both == 8)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[again][1:], rest[again][:-1]))
    return again, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int, leaf: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Intervals (first, last, length) of a suffix array whose suffixes share `length` >= least symbols and differ before.

    lcp[i]: common prefix of suffixes i - 1 and i (lcp[0] = 0); left: the symbol before each suffix of sa, -1 if
    there is none that can be known; leaf: the length of each suffix that occurs several times, and so is an interval by
    itself, 0 of the others. The stack holds the open intervals of the tree, each with its left symbol, -1 once two differ.
    """
    leaf = np.zeros(len(lcp), np.int64) if leaf is None else leaf
    near = np.append(lcp >= least, False)
    lone = np.flatnonzero((leaf >= least) & (left < 0) & ~near[:-1] & ~near[1:])
    out = [(i, i, n) for i, n in zip(lone.tolist(), leaf[lone].tolist())]
    runs = np.flatnonzero(lcp >= least)
    if not len(runs):
        return out
    breaks = np.flatnonzero(np.diff(runs) > 1)
    for a, b in zip(runs[np.concatenate([[0], breaks + 1])].tolist(), runs[np.concatenate([breaks, [len(runs) - 1]])].tolist()):
        lengths, symbols, leaves = lcp[a : b + 1].tolist(), left[a - 1 : b + 1].tolist(), leaf[a - 1 : b + 1].tolist()
        stack: list[list[int]] = []  # length, first, symbol
        for i, length in enumerate([*lengths, 0]):
            first, symbol = a - 1 + i, symbols[i]
            if leaves[i] >= least:
                if stack and stack[-1][0] == leaves[i]:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol and symbol >= 0 else -1
                else:
                    stack.append([leaves[i], first, symbol])
            while stack and stack[-1][0] > length:
                top = stack.pop()
                top[2] = top[2] if top[2] == symbol and symbol >= 0 else -1
                if top[2] < 0:
                    out.append((top[1], a - 1 + i, top[0]))
                first, symbol = top[1], top[2]
            if stack and stack[-1][0] == length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol and symbol >= 0 else -1
            elif length >= least:
                stack.append([length, first, symbol])
    return out


class Contexts:
    """Contexts end to end, and the suffixes that begin at their windows."""

    def __init__(self, pdf: pd.DataFrame, least: int = LENGTH):
        c = pdf["c"].tolist()
        size = np.fromiter(map(len, c), np.int64, len(c))
        self.text = np.frombuffer(b"".join(c) + bytes(96), np.uint8)
        self.windows = size - least + 1
        self.base = np.cumsum(self.windows) - self.windows
        self.of = np.repeat(np.arange(len(c)), self.windows)
        self.start = np.arange(len(self.of)) - self.base[self.of]
        self.at = (np.cumsum(size) - size)[self.of] + self.start
        self.rest = size[self.of] - self.start
        self.group = np.unique(pdf["g"].to_numpy(), return_inverse=True)[1][self.of]
        # What begins within a context has one symbol before it, so only a whole context can differ to the left by itself.
        self.leaf = (self.start == 0) & (pdf["m"] < pdf["most"]).to_numpy()[self.of]
        self.order, self.lcp = suffix_array(self.text, self.at, self.rest, self.group, least, self.leaf)

    def repeats(self, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal repeats as occurrences (repeat, suffix, length). What begins with its context may go on before it and counts."""
        before = np.where(self.start > 0, self.text[np.maximum(self.at - 1, 0)].astype(np.int64), -1)[self.order]
        leaf = np.where(self.leaf, self.rest, 0)[self.order]
        found = np.array(maximal_repeats(self.order, self.lcp, before, least, leaf), np.int64).reshape(-1, 3)
        count = found[:, 1] - found[:, 0] + 1
        number = np.repeat(np.arange(len(found)), count)
        entry = np.repeat(found[:, 0], count) + (np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count))
        return number, self.order[entry], found[number, 2]


def settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Contexts (g, k, c, m, most) of whole grams -> runs of windows (lo, hi) with the smallest document m that has them.

    A window has its own last document to begin with, and others from the tree's intervals alone. Runs that no document
    of the context can lose are left out.
    """
    here = Contexts(pdf)
    m, most = pdf["m"].to_numpy(), pdf["most"].to_numpy()
    smallest = np.repeat(most, here.windows)
    number, suffix, length = here.repeats()
    if len(number):
        group = np.full(int(number.max()) + 1, LAST)
        np.minimum.at(group, number, m[here.of[suffix]])
        wide = length - LENGTH + 1
        cell = np.repeat(suffix, wide) + (np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide))
        np.minimum.at(smallest, cell, np.repeat(group[number], wide))
    change = np.flatnonzero((np.diff(here.of, prepend=-1) != 0) | (np.diff(smallest, prepend=-1) != 0))
    last = np.append(change[1:], len(here.of)) - 1
    change, last = (x[smallest[change] < most[here.of[change]]] for x in (change, last))
    at = here.of[change]
    return pd.DataFrame({"g": pdf["g"].to_numpy()[at], "k": pdf["k"].to_numpy()[at], "lo": here.start[change], "hi": here.start[last], "m": smallest[change]})


def turns(pdf: pd.DataFrame) -> pd.DataFrame:
    """Contexts -> windows (lo, hi = lo) of two occurrences or more, and whether these differ to the left and to the right."""
    here = Contexts(pdf)
    column = {c: pdf[c].to_numpy(np.int64) for c in ("n", "l_lo", "l_hi", "r_lo", "r_hi")}
    left = np.where(here.start > 0, here.text[np.maximum(here.at - 1, 0)].astype(np.int64), 0)
    right = here.text[here.at + LENGTH].astype(np.int64)
    first, final = here.start == 0, here.rest == LENGTH
    sides = [np.where(first, column["l_lo"][here.of], left), np.where(first, column["l_hi"][here.of], left), np.where(final, column["r_lo"][here.of], right), np.where(final, column["r_hi"][here.of], right)]
    node = np.arange(len(here.of))
    head = np.maximum.accumulate(np.where(here.lcp < LENGTH, np.arange(len(here.order)), 0))
    node[here.order] = here.order[head]
    total = np.bincount(node, column["n"][here.of], len(node))
    low, high = [], []
    for lo, hi in (sides[:2], sides[2:]):
        least, most = np.full(len(node), 1 << 20), np.full(len(node), -2)
        np.minimum.at(least, node, lo)
        np.maximum.at(most, node, hi)
        low.append(least[node])
        high.append(most[node])
    keep = np.flatnonzero(total[node] > 1)
    differ = [((low[i] < high[i]) | (low[i] < 0))[keep] for i in (0, 1)]
    of = here.of[keep]
    return pd.DataFrame({"g": pdf["g"].to_numpy()[of], "k": pdf["k"].to_numpy()[of], "lo": here.start[keep], "hi": here.start[keep], "left": differ[0], "right": differ[1]})


def found_contexts(rows: DataFrame, within: bool = False) -> DataFrame:
    """Steps 1 and 2: the staged contexts (g, k, d, t, a, off, c) of grams that two or more documents have; k: hash of the context.

    within: of grams that occur twice or more, in one document or several, and with the symbols l and r on either side.
    """
    counted = grams(rows).groupBy("g").agg(F.min("d").alias("one"), F.max("d").alias("two"), F.count("*").alias("n"))
    shared = staged(counted.where("n > 1" if within else "one < two").select("g"))
    hits = staged(grams(rows).join(shared.hint("shuffle_hash"), "g", "left_semi").groupBy("d", "t").agg(F.collect_list("g").alias("gs")))
    discard(shared)
    sides = ["l", "r"] if within else []
    found = staged(contexts(rows.join(hits, ["d", "t"])).select("g", F.xxhash64("c", "off").alias("k"), "d", "t", "a", "off", *sides, "c"))
    discard(hits)
    return found


def folded(sides: bool) -> list[Column]:
    """What occurrences of one context, or of one window, come to: smallest and largest document; number and symbols around."""
    all_of = (("m", F.min), ("most", F.max), ("n", F.sum), ("l_lo", F.min), ("l_hi", F.max), ("r_lo", F.min), ("r_hi", F.max))
    return [f(c).alias(c) for c, f in (all_of if sides else all_of[:2])]


def in_buckets(each: DataFrame, *by: str) -> DataFrame:
    """Adds `bucket`: all rows of equal `by`, about BUCKET rows each."""
    return each.withColumn("bucket", F.pmod(F.xxhash64(*by, F.lit(7)), F.lit(max(1, -(-each.count() // BUCKET)))))


def dealt_out(held: DataFrame, crowded: DataFrame, step: int, sides: bool) -> DataFrame:
    """Contexts of crowded groups -> their pieces, one for each range of `step` places that windows can have the anchor at.

    held: (g: the group, g0, k0, whole: the context, around: place of its anchor, first, final: the group's range, and what
    is folded). Windows are equal only if the anchor is at one place in both, and all windows of a range have the bytes
    from the range's least distance before the anchor to its least distance behind it; those bytes and the range name the
    new group. A piece is the text of a context's windows in the range: (g, k, c, off) with `from`, its place in the context.
    """
    low, c = F.col("first"), F.col("whole")
    byte = lambda at: F.conv(F.hex(F.substring(c, at, F.lit(1))), 16, 10).cast("int")
    rows = held.join(crowded, "g", "left_semi").withColumn("last", F.col("final"))
    rows = rows.withColumn("first", F.explode(F.sequence(low, F.col("last"), F.lit(step)))).withColumn("final", F.least(low + step - 1, F.col("last"))).drop("last")
    near, far = F.greatest(low, F.col("around") - F.length(c) + LENGTH), F.least(F.col("final"), F.col("around"))
    rows = rows.withColumns({"near": near, "off": far}).where("near <= off").withColumn("from", F.col("around") - F.col("off"))
    begin, end = F.col("from"), F.col("around") - F.col("near") + LENGTH
    if sides:
        rows = rows.withColumns({x: F.when(begin == 0, F.col(x)).otherwise(byte(begin)) for x in ("l_lo", "l_hi")} | {x: F.when(end == F.length(c), F.col(x)).otherwise(byte(end + 1)) for x in ("r_lo", "r_hi")})
    shared = F.substring(c, F.col("around") - low + 1, LENGTH - F.col("final") + low)
    rows = rows.withColumns({"g": F.xxhash64(shared, "first"), "c": F.substring(c, begin + 1, F.col("off") - F.col("near") + LENGTH)})
    return rows.withColumn("k", F.xxhash64("c", "off")).drop("near")


def trees(found: DataFrame, work, columns: str, split: int = SPLIT) -> DataFrame:
    """Step 3, staged: work(contexts) -> (g, k, lo, hi, columns) about their windows, over all contexts of whole groups.

    A gram's contexts are a group to begin with. One of over `split` is dealt out by longer prefixes (`dealt_out`): windows
    go by ranges of 8, then 2, then 1 of the 31 places that the anchor can have, each time only where a group is still too
    large, and equal pieces fold before they move. Groups of one place are equal windows, hence one piece.
    """
    sides = "l" in found.columns
    single = {"m": F.col("d"), "most": F.col("d")} | ({"n": F.lit(1), "l_lo": F.col("l"), "l_hi": F.col("l"), "r_lo": F.col("r"), "r_hi": F.col("r")} if sides else {})
    facts = [*single]
    each = staged(found.withColumns(single).groupBy("g", "off", "c").agg(*folded(sides)).withColumn("k", F.xxhash64("c", "off")))
    schema = f"g long, k long, lo long, hi long, {columns}"
    run = lambda key, pdf: work(pdf)
    tree = lambda rows: in_buckets(rows, "g").groupBy("bucket").applyInPandas(run, schema)
    large = lambda rows: small(rows.groupBy("g").agg(F.count("*").alias("contexts")).where(F.col("contexts") > split).select("g"))
    crowded = large(each)
    out = tree(each.join(crowded, "g", "left_anti").select("g", "k", "c", *facts))
    held = each.select("g", F.col("g").alias("g0"), F.col("k").alias("k0"), F.col("c").alias("whole"), F.col("off").alias("around"), F.lit(0).alias("first"), F.lit(LENGTH - GRAM).alias("final"), *facts)
    for step in STEPS:
        if not crowded.limit(1).count():
            break
        parts = dealt_out(held, crowded, step, sides)
        ones = staged(parts.groupBy("g", "k", "c").agg(*folded(sides)))
        crowded = large(ones)
        done = tree(ones if step == 1 else ones.join(crowded, "g", "left_anti"))
        names = parts.select("g", "k", "g0", "k0", F.col("from").cast("long").alias("from"))
        out = out.union(done.join(names, ["g", "k"]).select(F.col("g0").alias("g"), F.col("k0").alias("k"), (F.col("lo") + F.col("from")).alias("lo"), (F.col("hi") + F.col("from")).alias("hi"), *done.columns[4:]))
        held = parts.select(*held.columns)
    out = staged(out)
    discard(each)
    return out


def spans(docs_keyed: DataFrame, split: int = SPLIT) -> DataFrame:
    """(d, t, spans): per document with removed bytes, its removed ranges (a, z), which may overlap."""
    found = found_contexts(once(docs_keyed))
    members = found.select("g", "k", "d", "t", "a")
    runs = trees(found, settle, "m long", split)
    ranges = members.join(runs, ["g", "k"]).where("m < d").select("d", "t", F.struct((F.col("a") + F.col("lo")).alias("a"), (F.col("a") + F.col("hi") + LENGTH).alias("z")).alias("s"))
    out = staged(ranges.groupBy("d", "t").agg(F.collect_list("s").alias("spans")))
    discard(found)
    discard(runs)
    return out


def stretches(rows: DataFrame) -> DataFrame:
    """rows(d, t, text, turns: list of (at, left, right)) -> (d, length, id, start, l, r): candidates for maximal repeats.

    A document's windows in `turns` are its repeated ones; a candidate begins at one that turns to the left, ends with one
    that turns to the right, and has repeated windows all the way. As many come out as there are such pairs.
    """

    def run(batches):
        for batch in batches:
            for d, text, places in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist(), batch.column("turns").to_pylist()):
                text = text.encode()
                places = sorted({(p["at"], p["left"], p["right"]) for p in places})
                at = np.array([p[0] for p in places])
                island = np.cumsum(np.diff(at, prepend=at[0]) > 1)
                left, right = (np.array([p[i] for p in places]) for i in (1, 2))
                out = []
                for x in np.flatnonzero(left).tolist():
                    ends = np.flatnonzero(right & (island == island[x]) & (at >= at[x]))
                    for y in ends.tolist():
                        a, z = int(at[x]), int(at[y]) + LENGTH
                        out.append((d, z - a, xxhash.xxh3_128_digest(text[a:z]), a, text[a - 1] if a else -1, text[z] if z < len(text) else -1))
                    if len(out) > 50_000:
                        yield candidates(out)
                        out = []
                yield candidates(out)

    return rows.mapInArrow(run, "d long, length long, id binary, start long, l int, r int")


def candidates(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["d", "length", "id", "start", "l", "r"])


def repeat_groups(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """The maximal repeats of 50 bytes or more of all texts: (repeat, length, doc_id, start) of every occurrence.

    The work grows with the places where repeats begin and end in a stretch of repeated text, begins times ends: as the
    number of maximal repeats does, which in a large group of near copies may be the square of its edits.
    """
    rows = keyed(docs).distinct()
    found = found_contexts(rows, within=True)
    windows = trees(found, turns, "left boolean, right boolean", split)
    places = found.select("g", "k", "d", "t", "a").join(windows, ["g", "k"]).groupBy("d", "t").agg(F.collect_list(F.struct((F.col("a") + F.col("lo")).alias("at"), "left", "right")).alias("turns"))
    some = staged(stretches(rows.join(places, ["d", "t"])))
    discard(found)
    discard(windows)
    groups = some.groupBy("length", "id").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in "lr" for n, f in (("lo", F.min), ("hi", F.max))])
    whole = groups.where("n > 1 and (l_lo < l_hi or l_lo < 0) and (r_lo < r_hi or r_lo < 0)").select("length", "id")
    out = some.join(whole, ["length", "id"])
    return out.select(F.hex("id").alias("repeat"), "length", F.when(F.col("d") < LAST, F.col("d")).alias("doc_id"), "start")


def removed(offsets: np.ndarray, ranges: pa.ListArray) -> np.ndarray:
    """True at the bytes that go, over rows laid end to end; ranges: each row's list of (a, z), null for none."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    base = np.repeat(offsets[:-1], ranges.value_lengths().fill_null(0).to_numpy())
    flat = ranges.flatten()
    for name, step in (("a", 1), ("z", -1)):
        edge += step * np.bincount(base + flat.field(name).to_numpy(), minlength=len(edge))
    return np.cumsum(edge)[:-1] > 0


def with_spans(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs with _sx_spans; docs has no column named like it, nor _sx_d or _sx_t."""
    ranges = spans(keyed(docs), split)
    d, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    out = docs.withColumns({"_sx_d": d, "_sx_t": t}).join(ranges.select(F.col("d").alias("_sx_d"), F.col("t").alias("_sx_t"), F.col("spans").alias("_sx_spans")), ["_sx_d", "_sx_t"], "left")
    return out.drop("_sx_d", "_sx_t")


def report(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ranges = batch.column("_sx_spans")
            for i, j in pieces(offsets, 1 << 20):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                gone = removed(at, ranges.slice(i, j - i))
                begins = np.diff(gone.astype(np.int8), prepend=0) == 1
                begins[at[:-1][at[:-1] < len(own)]] = gone[at[:-1][at[:-1] < len(own)]]
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (gone, begins)]
                kept, left = own[~gone].tobytes(), at - np.concatenate([[0], np.cumsum(gone)])[at]
                digest = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(left[:-1].tolist(), left[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.array(sums[0]), pa.array(sums[1]), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(narrow, split).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut from text (characters that lose a byte go whole) and n_chars set anew, if there."""

    @F.arrow_udf("string")
    def kept(text: pa.Array, ranges: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        null, out = text.is_null().to_pylist(), []
        for i, j in pieces(offsets, 1 << 20):
            at = offsets[i : j + 1] - offsets[i]
            gone = removed(at, ranges.slice(i, j - i))
            left, whole = at - np.concatenate([[0], np.cumsum(gone)])[at], data[offsets[i] : offsets[j]][~gone].tobytes()
            out += [None if null[i + n] else whole[x:y].decode("utf-8", "ignore") for n, (x, y) in enumerate(zip(left[:-1].tolist(), left[1:].tolist()))]
        return pa.array(out, pa.string())

    own = {c: f"_own{i}_{c}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = with_spans(docs.withColumnsRenamed(own)).withColumn("text", kept("text", "_sx_spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn(own["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
