"""Near copies of the pipeline against brute force on planted edits; one row of every group, null ids included."""

import random

import pytest

pytest.importorskip("circlet.llm")

import corpus_pipeline
from circlet.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or (len(a & b) / len(a | b) >= 0.8 if a | b else True)


def groups(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def planted(seed=3):
    """Texts with one to three edited words, chains of edits, and mere neighbours that share half."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for n in (8, 20, 60, 60, 90, 150, 400):
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(6):
            edit = list(base)
            for _ in range(rng.randint(1, max(1, n // 40))):
                edit[rng.randrange(n)] = word()
            out.append(" ".join(edit))
            base = edit if rng.random() < 0.4 else base
        out.append(" ".join(base[: n // 2] + [word() for _ in range(n // 2)]))
    return [*out, "one two", "One  two\n", "", None, " \t"]


def test_groups_are_those_of_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = groups([shingles(t) for t in texts])
    got = {r.doc_id: r.root for r in near_copies.rooted(docs).collect()}
    assert len(set(zip(want, (got[i] for i in range(len(texts)))))) == len(set(want)) == len(set(got.values()))
    first = {}
    for i, g in enumerate(want):
        first.setdefault(g, i)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(set(prints.values())) > len(first)  # what the fingerprints within 3 bits leave apart
    assert near_copies.one_per_group(docs.where("doc_id < 0")).count() == 0


def test_groups_without_a_star(spark):
    """A ring of near copies in which most pairs are below the bound, with all of them meeting in one band."""
    sets = {i: list(range(100 + 5 * i, 200 + 5 * i)) for i in range(12)}
    meets = spark.createDataFrame([(0, 0, i, 100) for i in sets], "band int, bucket long, node long, n long")
    frame = spark.createDataFrame(list(sets.items()), "node long, hashes array<long>")
    got = near_copies.alike_components(meets, frame, 0.8).collect()
    assert sorted((r[0], r[1]) for r in got) == [(i, 0) for i in range(1, 12)]
    far = near_copies.alike_components(meets, frame, 0.95).collect()
    assert far == []


@pytest.mark.parametrize("one", [near_copies.one_per_group])
def test_null_ids_and_repeated_ids_lose_no_text(spark, one):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, "x"), (None, b, "x"), (1, c, "x"), (1, d, "x"), (2, c, "x"), (None, d, "x"), (0, b, "x"), (1, c, "x")]
    got = one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, a), (0, b), (1, c), (1, d)], key=str)


@pytest.mark.parametrize("one", [near_copies.one_per_group])
def test_a_row_does_not_stay_for_another_of_its_id(spark, one):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = one(spark.createDataFrame([(5, a, "x"), (5, b, "x"), (1, b, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, b), (5, a)]


@pytest.mark.parametrize("chunk", [512, 5])
def test_buckets_of_many_nodes_are_compared_whole(spark, chunk):
    """One bucket of sets of all similarities, dealt out in chunks or not, against all pairs."""
    rng = random.Random(8)
    sets = {}
    for i in range(40):
        base = [1000 * (i % 3) + k for k in range(60)]
        sets[i] = sorted(rng.sample(base, rng.randint(48, 60)))
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if alike(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    left = spark.createDataFrame([(0, 7, i, len(sets[i]), i) for i in sets], "band int, bucket long, node long, n long, root long")
    links = near_copies.bucket_links(left, spark.createDataFrame(list(sets.items()), "node long, hashes array<long>"), 0.8, chunk)
    parts = {r.node: r.component for r in near_copies.connected_components(links).collect()}
    assert {i: parts.get(i, i) for i in sets} == root
