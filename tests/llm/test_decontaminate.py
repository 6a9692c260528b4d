"""Benchmark windows in documents, against a plain search word by word."""

import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__

if not __spark_entry__.corpus:
    pytest.skip("no corpus subpackage", allow_module_level=True)

from circlet.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, item_id string, row string", "item_id long, text string, key string, id string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plainly(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[a : a + 10]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                held = wins.get(tuple(w[a : a + k]))
                if held is not None:
                    hit.update(range(a, a + k))
                    ids |= {str(i) for i in held if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    say = lambda n: [rng.choice("the of a in Data set été 漢字 x1 k9 paths".split()) + rng.choice(["", rng.choice("abcd")]) for _ in range(n)]
    items = [say(rng.randint(10, 40)) for _ in range(12)]
    joined = [" ".join(x) for x in items]
    table = [(i, t) for i, t in enumerate(joined)]
    table += [(3, joined[4]), (20, joined[0]), (20, joined[0]), (None, joined[1]), (None, "only nobody has these words in this order as it seems"), (21, None), (22, " .,; "), (23, "x1"), (24, "K9 paths"), (25, joined[2] + " tail"), (26, " ".join(say(400)))]
    docs = [" ".join(say(rng.randint(0, 60))) for _ in range(20)]
    for x in (joined[0], joined[5].upper(), "[" + "], [".join(items[6]) + "]", joined[7] + joined[8], " ".join(items[9][:9]), " ".join(items[9][1:11]), table[-1][1], table[16][1]):
        docs.append(" ".join(say(rng.randint(0, 9))) + " " + x + "\n" + " ".join(say(rng.randint(0, 9))))
    docs += ["", None, "...", "x1", "x1 k9 paths k9", joined[2] + " " + joined[3] + " tail", "ab " * 5000 + joined[4], "q" * 3000, docs[20], "only nobody has these words in this order as it seems", "a\x00b " + joined[0]]
    return [(i, t) for i, t in enumerate(docs)] + [(None, joined[1]), (20, docs[20])], table


@pytest.mark.parametrize(("shard", "piece"), [(1 << 20, 4096), (60, 7)])
def test_hits(spark, shard, piece):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS).repartition(2)
    rows = decontaminate.decontaminate(d, b, shard=shard, piece=piece)
    got = [(*(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256")), r["n_hit"] > 0) for r in rows.collect()]
    assert sorted(got, key=str) == plainly(docs, items)
    for r in rows.collect():
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_hit"]
        assert all(x["b"] < y["a"] for x, y in zip(r["spans"], r["spans"][1:]))


def test_report_and_empty_tables(spark):
    docs, items = cases()
    d, b = spark.createDataFrame([(i, t, "", "") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "", "") for i, t in items], ITEMS)
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.report(d, b).collect()]
    assert sorted(got, key=str) == plainly(docs, items)
    clean = decontaminate.report(d, b.where("false")).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)
    assert decontaminate.report(d.where("false"), b).count() == 0


def test_positions_are_skipped():
    """A text without blocks of the windows is searched in far fewer steps than it has bytes."""
    rng = random.Random(1)
    text = lambda abc, n: " ".join("".join(rng.choice(abc) for _ in range(6)) for _ in range(n))
    table = decontaminate.Table(["1"], [text("abcdefg", 40)], 10)
    looked = []
    kind = table.classes[0]
    shift = kind.shift

    class Counted:
        def __getitem__(self, at):
            looked.append(len(at))
            return shift[at]

    kind.shift = Counted()
    other = np.frombuffer(text("uvwxyz", 20_000).encode(), np.uint8)
    own = decontaminate.Words(other, np.array([0, len(other)]))
    assert not table.found(own)[0].any()
    assert sum(looked) < len(other) / 20
