"""Runs of words against a plain search of every period, and common extensions against comparison word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__

if not __spark_entry__.corpus:
    pytest.skip("no corpus subpackage", allow_module_level=True)

from circlet.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, collapsed string, start string"


def plain_runs(w, least=12):
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(w, doc_id):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(WORD.findall(text or ""), doc_id)
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    rng = random.Random(5)
    say = lambda n, abc="abcdefgh": [rng.choice(abc) for _ in range(n)]
    out = [" ".join(say(rng.randint(0, 80), "ab")) for _ in range(30)]
    out += [" ".join(say(rng.randint(20, 200))) for _ in range(60)]
    for _ in range(20):
        unit = say(rng.randint(1, 45))
        out.append(" ".join(say(rng.randint(0, 9)) + (unit * 5)[: rng.randint(2 * len(unit), 5 * len(unit))] + say(rng.randint(0, 9))))
    nested = (say(3) * 5 + say(2)) * 4
    out += [" ".join(nested), "a " * 300, "a b " * 100 + "a", "", None, " \t\n", "a", "a " * 11, "a " * 12, "x\x0by\x0cz " * 20, "é b   c " * 9, "w" * 4000 + " " + "v " * 13, " ".join(say(1500, [str(i) for i in range(400)]) * 3)]
    return out


def test_report(spark):
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts())]
    rows += [rows[95], (None, "a b " * 9, "", "", "")]
    got = periodic.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert periodic.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_interface(spark):
    rows = spark.createDataFrame([(1, "x " + "a b c " * 4 + "y", "", "", "")], SCHEMA)
    (row,) = periodic.periodic_runs(rows).collect()
    assert [tuple(x) for x in row["runs"]] == [(1, 12, 3)] and row["collapsed"] == "x a b c y"


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_common_extensions(letters):
    rng = np.random.default_rng(letters)
    for n in (2, 30, 31, 32, 100, 700):
        word = rng.integers(0, letters, n)
        word[n // 2 :] = word[: n - n // 2]
        both = periodic.Extensions(word)
        i, j = rng.integers(0, n, 500), rng.integers(0, n, 500)
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i, j, both(i, j)):
            k = 0
            while max(a, b) + k < n and word[a + k] == word[b + k]:
                k += 1
            assert got == k
