"""Runs: stretches of words that repeat with a period, found by longest common extensions on a difference cover.

A text's words are numbered, texts lie end to end with a number of its own between any two. Suffixes are sorted only at
places whose remainder by 31 lies in a difference cover: for any two places some shift below 31 takes both to sampled
ones, so the longest common extension of two places is a few words compared directly, then the least common prefix
between two ranks, read from a sparse table. Sampled suffixes are sorted by their first 31 words, then by doubling
steps of 31 (a sampled place leads to sampled places); the names of each step also give the common prefixes of neighbours.

A run of period p and 2p words or more matches itself p words on for p words or more, so one of the places 0, p, 2p, ...
lies in the match: the grid of all periods has n log n places, of which those with unequal words fall away at once.
From the others the match is extended both ways. A stretch found with several periods has the smallest.

Edge cases: a null or blank text has no words and no runs; ties for the longest run go to the smallest start, then period;
repeated rows are judged each, by their own doc_id and text; texts of any length are taken whole, one text is one row's
work; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import pieces, utf8

#: A perfect difference cover: every number below CYCLE is a difference of two of COVER, modulo CYCLE.
CYCLE, COVER = 31, (0, 1, 3, 8, 12, 18)
LEAST = 12
#: Grid places looked at in one go.
GRID = 1 << 21


def _shifts() -> np.ndarray:
    """At [i % CYCLE, j % CYCLE]: the smallest shift that takes both to the cover."""
    inside = np.isin(np.arange(2 * CYCLE) % CYCLE, COVER)
    out = np.zeros((CYCLE, CYCLE), np.int64)
    for i in range(CYCLE):
        for j in range(CYCLE):
            out[i, j] = next(s for s in range(CYCLE) if inside[i + s] and inside[j + s])
    return out


SHIFT = _shifts()


class Extensions:
    """Longest common extensions of any two places of a sequence of numbers, to the right."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        self.n = n
        # Past the end every place differs from all others.
        self.word = np.concatenate([word, word.max(initial=0) + 1 + np.arange(2 * CYCLE)])
        residue = np.isin(np.arange(CYCLE), COVER)
        at = np.flatnonzero(residue[np.arange(n) % CYCLE])
        place = np.full(n + 1, -1)
        place[at] = np.arange(len(at))
        self.place = place
        name, order = self.first_names(at)
        names, step = [name], 1
        follow = lambda k: np.where(at + k * CYCLE < n, place[np.minimum(at + k * CYCLE, n)], -1)
        while len(at) and name[order[-1]] + 1 < len(at):
            after = follow(step)
            second = np.where(after >= 0, name[after], -1)
            # Only what is still tied is sorted again; names are first ranks of equal prefixes.
            order, name = self.refined(name, second, order)
            names.append(name)
            step *= 2
        self.rank = np.zeros(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        self.table = self.sparse(self.common(at, order, names))

    def first_names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names (dense ranks) of sampled places by their first CYCLE words, and the places in that order."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = int(self.word.max()).bit_length()
        per = max(1, 62 // max(1, bits))
        keys = []
        for lo in range(0, CYCLE, per):
            key = np.zeros(len(at), np.int64)
            for j in range(lo, min(CYCLE, lo + per)):
                key = (key << bits) | self.word[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(new)
        return name, order

    @staticmethod
    def refined(name: np.ndarray, second: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks = name[order]
        tied = np.zeros(len(order), bool)
        tied[1:] = ranks[1:] == ranks[:-1]
        tied[:-1] |= ranks[1:] == ranks[:-1]
        some = order[tied]
        order = order.copy()
        order[tied] = some[np.lexsort((second[some], name[some]))]
        new = np.zeros(len(order), bool)
        new[1:] = (name[order[1:]] != name[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        out = np.empty_like(name)
        out[order] = np.cumsum(new)
        return order, out

    def common(self, at: np.ndarray, order: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of neighbours in the order: by steps of CYCLE from the largest down, then word by word."""
        if len(at) < 2:
            return np.zeros(0, np.int64)
        i, j = at[order[:-1]], at[order[1:]]
        length = np.zeros(len(i), np.int64)
        for level in range(len(names) - 1, -1, -1):
            step = CYCLE << level
            inside = np.flatnonzero(np.maximum(i, j) + length < self.n)
            x, y = self.place[i[inside] + length[inside]], self.place[j[inside] + length[inside]]
            equal = names[level][x] == names[level][y]
            length[inside[equal]] += step
        return length + self.direct(i + length, j + length, np.full(len(i), CYCLE))

    def direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words in common from i and j on, compared one by one, `most` at most."""
        out = np.zeros(len(i), np.int64)
        going = np.flatnonzero(most > 0)
        for k in range(CYCLE):
            x, y = i[going] + k, j[going] + k
            ok = (np.maximum(x, y) < self.n) & (self.word[np.minimum(x, self.n)] == self.word[np.minimum(y, self.n)])
            going = going[ok]
            out[going] = k + 1
            going = going[most[going] > k + 1]
            if not len(going):
                break
        return out

    @staticmethod
    def sparse(values: np.ndarray) -> list[np.ndarray]:
        """Minima over 1, 2, 4, ... values from each place on."""
        table, step = [values], 1
        while 2 * step <= len(values):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from i and j on (i <> j)."""
        shift = SHIFT[i % CYCLE, j % CYCLE]
        out = self.direct(i, j, shift)
        on = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        x, y = self.rank[self.place[i[on] + shift[on]]], self.rank[self.place[j[on] + shift[on]]]
        low, width = np.minimum(x, y), np.abs(x - y)
        level = np.frexp(width.astype(float))[1] - 1
        least = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(self.table[k][low[at]], self.table[k][low[at] + width[at] - (1 << int(k))])
        out[on] += least
        return out


def grid(first: np.ndarray, n: np.ndarray, word: np.ndarray):
    """(place, period) on the grids of texts at `first` of n words, where the word recurs one period on; in parts of about GRID places."""
    periods = n // 2
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (n[text] - 1) // period
    done = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + GRID, "right")))
        c = count[lo:hi]
        p = np.repeat(period[lo:hi], c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        i = np.repeat(first[text[lo:hi]], c) + k * p
        equal = word[i] == word[i + p]
        yield i[equal], p[equal]
        lo = hi


def runs(word: np.ndarray, first: np.ndarray, n: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of `least` words or more, by start and period. word: texts with single numbers between."""
    right = left = None
    found = []
    for i, p in grid(first, n, word):
        if not len(i):
            continue
        if right is None:
            right, left = Extensions(word), Extensions(word[::-1].copy())
        after = right(i, i + p)
        # Backwards from the places before; a text's first word has none.
        mirror = len(word) - i
        some = np.flatnonzero(i > 0)
        before = np.zeros(len(i), np.int64)
        before[some] = left(mirror[some], mirror[some] - p[some])
        match = after + before
        ok = match + p >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([(i - before)[ok], (match + p)[ok], p[ok]]), axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words of the text, with the repeat that the contract of the query puts into some; none without a doc_id."""
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def plain(words: list[bytes], doc_id) -> list[bytes]:
    return words


def periodic_runs(docs: DataFrame, least: int = LEAST, change=plain) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs (array of start, length, period, by start and period), collapsed (text).

    Words are what ASCII white space separates. collapsed: the words that no run holds after its first period, joined
    by single spaces. change(words, doc_id) -> the words to judge.
    """

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            raw = data.tobytes()
            for a, b in pieces(offsets):
                texts = [change(raw[offsets[r] : offsets[r + 1]].split(), ids[r]) for r in range(a, b)]
                n = np.array([len(t) for t in texts], np.int64)
                first = np.cumsum(n + 1) - n - 1
                number: dict = {}
                word = np.empty(int((n + 1).sum()), np.int64)
                for t, at in zip(texts, first.tolist()):
                    word[at : at + len(t)] = [number.setdefault(w, len(number)) for w in t]
                word[first + n] = len(number) + np.arange(len(n))
                start, length, period = runs(word, first, n, least)
                turn = np.zeros(len(word) + 1, np.int64)
                np.add.at(turn, start + period, 1)
                np.add.at(turn, start + length, -1)
                kept = (np.cumsum(turn[:-1]) == 0).tolist()
                text = [b" ".join([w for w, k in zip(t, kept[at : at + len(t)]) if k]) for t, at in zip(texts, first.tolist())]
                row = np.searchsorted(first, start, "right") - 1
                count = np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(start - first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), found, pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """The runs of every text with its planted repeat, as counts, the longest one and digests."""
    rows = periodic_runs(docs, change=planted)
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = rows.withColumn("best", best).withColumn("q", -F.col("best.period"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        F.col("q").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("q")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
