"""The pipeline's near copies meet by SimHash: fingerprints, balls and groups against brute force."""

import numpy as np
import pytest

pytest.importorskip("circlet.llm")

import corpus_pipeline
from circlet.llm import near_copies, simhash

WORD = (1 << 64) - 1


def prints_of(hashes, i):
    """A fingerprint bit by bit: set if over half of the mixed hashes have it."""
    count = [0] * 64
    for h in hashes:
        x = ((h ^ int(near_copies.MIX[0, i])) * int(near_copies.MIX[1, i])) & WORD
        x = ((x ^ (x >> 32)) * int(simhash.P2)) & WORD
        x ^= x >> 29
        for bit in range(64):
            count[bit] += x >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * count[bit] > len(hashes))


def sketches(sets):
    n = np.array([len(s) for s in sets])
    _, segments, tiny = near_copies.dealing(len(sets))
    return near_copies.sketch(np.concatenate([np.sort(s) for s in sets]), n, segments, tiny)


def pairs_at(rng, n, shared):
    """Two sets of hashes that share so many of n altogether."""
    h = rng.integers(0, 1 << 63, n).astype(np.uint64)
    left = (n - shared) // 2
    return h[: shared + left], np.concatenate([h[:shared], h[shared + left :]])


def test_stage_is_simhash(spark):
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "simhash_near_dedup"
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 4, 0, 5, 6, 31, 200)]
    for s, n, own in zip(sets, *(x.to_pylist() for x in sketches(sets)[1:])):
        assert n == len(s) and len(own) == (25 if 0 < n <= 5 else 18 if n else 0)
        for i in {0, 3, len(own) - 1} if n else ():
            assert own[i] & WORD == prints_of(s.tolist(), i)


@pytest.mark.parametrize("n,shared", [(5, 4), (15, 12), (60, 48), (180, 144)])
def test_pairs_at_the_bound_meet(n, shared):
    rng = np.random.default_rng(n)
    sets = [s for _ in range(400) for s in pairs_at(rng, n, shared)]
    prints = [np.array(p, np.int64).view(np.uint64) for p in sketches(sets)[2].to_pylist()]
    bits = near_copies.dealing(len(sets))[0]
    for a, b in zip(prints[::2], prints[1::2]):
        m = min(len(a), len(b))
        x = (a[:m] ^ b[:m]).view(np.uint32)
        assert ((x >> np.uint32(32 - bits) == 0) & (np.bitwise_count(x & np.uint32(65535)) <= 3)).any()
        far = near_copies.TINY_FAR if n <= near_copies.TINY else near_copies.FAR
        assert np.bitwise_count(a[:4] ^ b[:4]).sum() <= far


def noisy(rows, centres, noise, seed):
    rng = np.random.default_rng(seed)
    flips = rng.random((rows, 5, 64)) < noise
    return rng.integers(0, 1 << 62, (centres, 5))[rng.integers(0, centres, rows)] ^ np.bitwise_or.reduce(flips.astype(np.int64) << np.arange(64), axis=2), rng.integers(90, 115, rows)


def components(size, links):
    label = list(range(size))
    for _ in range(size):
        before = list(label)
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            return label


@pytest.mark.parametrize("rows,centres,noise", [(300, 200, 0.1), (300, 1, 0.13), (200, 8, 0.12), (1, 1, 0)])
@pytest.mark.parametrize("at_once,crowded", [(1 << 21, 32), (100, 2)])
def test_balls_against_all_pairs(monkeypatch, rows, centres, noise, at_once, crowded):
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    words, n = noisy(rows, centres, noise, rows + centres)
    low, held = (words[:, 4] & 65535).astype(np.int32), np.ascontiguousarray(words[:, :4]).view(np.uint64)
    x, y = np.triu_indices(rows, 1)
    near = (np.bitwise_count(low[x] ^ low[y]) <= 3) & (np.bitwise_count(held[x] ^ held[y]).sum(1, dtype=int) <= near_copies.FAR)
    near &= np.minimum(n[x], n[y]) / np.maximum(n[x], n[y]) >= 0.8
    assert near_copies.ball_components(low, held, n, 0.8).tolist() == components(rows, list(zip(x[near].tolist(), y[near].tolist())))


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 8])
def test_groups_dealt_out_lose_no_meeting(spark, crowd):
    """Pairs that agree in a segment's top bits and meet in its ball share a bucket, also where a group is dealt out in chunks."""
    words, n = noisy(60, 6, 0.08, 9)
    nodes = spark.createDataFrame([(i, int(n[i]), w) for i, w in enumerate(words.tolist())], "node long, n long, prints array<long>")
    buckets = {}
    for r in near_copies.met(nodes, 60, 0.8, crowd).collect():
        assert r.n == n[r.node]
        buckets.setdefault((r.band, r.bucket), set()).add(r.node)
    together = {(band, x, y) for (band, _), own in buckets.items() for x in own for y in own if x < y}
    bits, parts = near_copies.dealing(60)[0], words.view(np.uint64)
    want = set()
    for x in range(60):
        for y in range(x + 1, 60):
            close = min(n[x], n[y]) / max(n[x], n[y]) >= 0.8 and np.bitwise_count(parts[x, :4] ^ parts[y, :4]).sum() <= near_copies.FAR
            for band in range(10):
                a, b = (int(p[band // 2]) >> 32 * (1 - band % 2) & 0xFFFFFFFF for p in (parts[x], parts[y]))
                if close and a >> 32 - bits == b >> 32 - bits and ((a ^ b) & 65535).bit_count() <= 3:
                    want.add((band, x, y))
    assert want and want <= together


@pytest.mark.parametrize("chunk", [512, 10])
def test_a_settled_component_is_not_compared_with_itself(spark, monkeypatch, chunk):
    """A bucket of one large component and few other nodes: every link is found, in rows that grow with its size only."""
    base = list(range(100))
    sets = {i: base[: 90 + i % 11] + [1000 + i] for i in range(200)} | {i: [5000 * i + k for k in range(50)] for i in range(200, 206)}
    sets |= {i: base[:84] + [2000 + i] for i in range(206, 209)}
    left = [(0, 7, i, len(s), 0 if i < 200 else i) for i, s in sets.items()]
    made, here = [], near_copies.staged
    monkeypatch.setattr(near_copies, "staged", lambda df: made.append(here(df)) or made[-1])
    counts = []
    monkeypatch.setattr(near_copies, "discard", lambda df: counts.append(df.count()))
    links = near_copies.bucket_links(spark.createDataFrame(left, "band int, bucket long, node long, n long, root long"), spark.createDataFrame(list(sets.items()), "node long, hashes array<long>"), 0.8, chunk)
    parts = {r.node: r.component for r in near_copies.connected_components(links).collect()}
    assert {i for i in parts if parts[i] == 0} == {206, 207, 208} and len(parts) == 3
    assert max(counts[:1]) <= 200 + 9 * (1 + -(-200 // chunk))
