"""Centroid clustering, the similarity join of sets and the prefix trie against plain versions; nulls, ties, repeats, empty tables."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import centroids, partenum, trie

# --- centroids ------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, width, scale=64):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for c in range(len(now)):
            own = [v for (_, v), m in zip(kept, mine) if m == c]
            if own:
                now[c] = tuple(sum(x) // len(own) for x in zip(*own))
    last = [near(v) for _, v in kept]
    of = {c: sum(d for d, m in last if m == c) for c in range(len(now))}
    return [(i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last)]


def vectors(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * rng.choice([0.01, 1, 30]) for _ in range(width)]) for i in range(n)]
    return rows + rows[:5] + [(None, [0.5] * width), (n, None), (n + 1, [0.1] * (width - 1)), (n + 2, [None] + [0.1] * (width - 1)), (n + 3, [float("nan")] + [0.1] * (width - 1)), (n + 4, [float("inf")] * width), (n + 5, [-0.001] * width)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(spark, kind):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], "clash", 1) for i, v in vectors(150, 5, 1)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, distance int").repartition(3)
    got = sorted(map(tuple, centroids.cluster(df, k=6, width=5).collect()), key=repr)
    assert got == sorted(plain_clusters([r[:2] for r in rows], 6, 3, 5), key=repr)


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, centroids.cluster(df, width=2).collect()))
    assert got == sorted(plain_clusters([(1, [0.0, 1.0]), (2, [0.0, 1.0])], 16, 3, 2))
    assert centroids.cluster(df.limit(0), width=2).collect() == []
    assert centroids.cluster(df).collect() == []


def test_a_component_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df, width=2).collect()


# --- sets -----------------------------------------------------------------------------------------------------------


def plain_sets(rows, k=3, least=Fraction(9, 10)):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set())
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low[root(a)] = root(b)
    groups = {}
    for a, (i, _) in enumerate(rows):
        groups.setdefault(root(a), []).append(i)
    return [(i, len(sets[a]), i if not sets[a] else min((x for x in groups[root(a)] if x is not None), default=None)) for a, (i, _) in enumerate(rows)]


def near_texts(seed, groups=12):
    """Groups of texts with a few words changed, so that similarities lie on both sides of the limit; chains, copies, odd texts."""
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "A", "a b", "b a", "one two three", "ONE two\nthree", "x " * 40, "x " * 400, "ÉLAN élan ı İ", "w" * 3000]
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([9, 12, 20, 40, 90, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            out.append(" ".join(words))
            if rng.random() < 0.7:
                for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                    words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
                if rng.random() < 0.3:
                    words += [f"t{rng.randrange(10**6)}"]
    rng.shuffle(out)
    return out


def sets_of(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "clash", 1, "c") for i, t in rows], "doc_id long, text string, node string, n int, grp string").repartition(4)
    return sorted((tuple(r) for r in partenum.similar_sets(df, **more).collect()), key=repr)


@pytest.mark.parametrize(("seed", "similarity"), [(1, 0.9), (2, 0.9), (3, 0.8)])
def test_sets(spark, seed, similarity, monkeypatch):
    monkeypatch.setattr(partenum, "CHUNK", 3000)
    rows = list(enumerate(near_texts(seed)))
    rows += [rows[3], rows[20], (5, "repeats an id with another text " * 3), (None, rows[25][1]), (None, None)]
    assert sets_of(spark, rows, similarity=similarity) == sorted(plain_sets(rows, least=Fraction(str(similarity))), key=repr)


def test_large_groups_by_signature_and_in_tiles(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = sorted(plain_sets(rows), key=repr)
    assert len({r[2] for r in want}) > 3
    monkeypatch.setattr(partenum, "TILE", 20)
    assert sets_of(spark, rows) == want
    monkeypatch.setattr(partenum, "WHOLE", 10)
    assert sets_of(spark, rows) == want


def test_similar_sets_share_a_signature():
    rng = random.Random(9)
    bands = partenum.Bands(Fraction(9, 10), 3000)
    for _ in range(400):
        n = rng.choice([10, 19, 20, 57, 100, 333, 1000])
        a = sorted({rng.getrandbits(64) for _ in range(n)})
        gone = rng.randint(0, n // 19)
        b = sorted({*rng.sample(a, n - gone), *(rng.getrandbits(64) for _ in range(rng.randint(0, max(0, n // 19 - gone) + 1)))})
        if set(a) == set(b) or 10 * len(set(a) & set(b)) < 9 * len(set(a) | set(b)):
            continue
        sig, owner = partenum.signatures(np.array(a + b, np.uint64), np.array([len(a), len(b)]), bands)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.similar_sets(df).collect() == []
    assert sets_of(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


# --- trie -----------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talks.setdefault(c, []).append(((turn is not None, turn or 0, key), role, text))
    talks = {c: [(r, t) for _, r, t in sorted(v)] for c, v in talks.items()}
    paths = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(talks.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    words = lambda t: len([w for w in t.encode().split() if w])
    kids, own = {}, {}
    for node in members:
        own[node] = (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        for d in range(len(node) + 1):
            saved[node[:d]] += own[node]
            leaves[node[:d]] += node not in kids
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 300), 120):
        n = rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13, 40])
        turns = [(k, rng.choice(["user", "assistant"]), f"{rng.choice('ab')} word" if rng.random() < 0.7 else f"{rng.random()}") for k in range(n)]
        rows += [(c, k, r, t) for k, r, t in turns]
    same = [(k, "user", f"same {k} a b c") for k in range(11)]
    rows += [(c, *t) for c in range(1000, 1030) for t in same[: rng.choice([11, 11, 7])]]
    return rows + [(77777, None, None, None), (77777, 3, "user", None), (77777, 3, "user", None), (77777, 3, "a", "tie"), (None, 1, "user", "of none"), (40, 5, "\x00", "long " * 5000)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 1), (3, 7)])
def test_trie(spark, seed, block, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = talks(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, pos int").repartition(5)
    assert sorted(map(tuple, trie.prefix_trie(df, block).collect()), key=repr) == plain_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    df = spark.createDataFrame([(c, 0, "user", "only turn")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.prefix_trie(df).collect())) == plain_trie([(c, 0, "user", "only turn")])
    assert trie.prefix_trie(df.where(F.lit(False))).collect() == []
