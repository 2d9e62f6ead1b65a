"""SimHash, whitening and clustering against brute force."""

import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from plumbline.llm import centroids, registry, simhash, vectors, whitening
from plumbline.llm.components import components
from tests.llm.test_text_operators import EDGES, docs

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def rows_of(spark, rows, kind="array<double>"):
    """Vectors with columns that carry the operators' own names."""
    extra = [(k, v, 7, "x") for k, v in rows]
    return spark.createDataFrame(extra, f"vec_id long, embedding {kind}, cluster int, code string")


# SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints):
    """The smallest of the prints that each one reaches in steps of two bits or fewer."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {p: find(p) for p in root}


def signed(p):
    return p - (p >> 63 << 64)


def brute_simhash(rows):
    prints = [brute_print(t) for _, t in rows]
    of = joined(set(prints))
    least = {}
    for (k, _), p in zip(rows, prints):
        if k is not None:
            least[of[p]] = min(k, least.get(of[p], k))
    return sorted(((k, f"{p:016x}", least.get(of[p])) for (k, _), p in zip(rows, prints)), key=str)


def test_simhash_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = registry.op11_simhash_pigeonring(spark, SF).collect()
    assert sorted(map(tuple, found), key=str) == brute_simhash(rows)


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [*EDGES, (20, "A b"), (21, "a B"), (21, "a B"), (22, long), (23, long + " end"), (None, long), (None, "alone x y z")]
    found = simhash.simhash_duplicates(docs(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == brute_simhash(rows)
    assert simhash.simhash_duplicates(docs(spark, [])).collect() == []


def test_fingerprint_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    r = random.Random(4)
    for n in (1, 2, 3, 4, 8, 9, 10, 40):
        text = " ".join(r.choice(["a", "b", "cé", "ddd"]) for _ in range(n))
        assert simhash.fingerprint(simhash.split_words(text)) == brute_print(text)


def test_every_close_pair_has_a_chain():
    r = random.Random(5)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.choice([0, 1, 2, 2, 2])):
            b ^= 1 << bit
        at = np.array([a] * 5, np.uint64), np.array([b] * 5, np.uint64)
        assert simhash.chain_holds(*at, np.arange(5)).any()
    far = np.array([0], np.uint64), np.array([1 << 1 | 1 << 30 | 1 << 60], np.uint64)
    assert not any(simhash.chain_holds(*far, np.array([s])).any() for s in range(5))


@pytest.mark.parametrize("crowd", [2, 16])
def test_links_join_all_close_prints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(6)
    prints = {0, 2**63, 2**64 - 1, 2**64 - 2}
    for centre in (r.getrandbits(64) for _ in range(4)):  # crowds that vary in a few bits
        bits = r.sample(range(64), 14)
        for _ in range(120):
            p = centre
            for bit in r.sample(bits, r.randint(0, 6)):
                p ^= 1 << bit
            prints.add(p)
    for _ in range(200):  # pairs and chains
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 4)):
            prints.add(p)
            for bit in r.sample(range(64), r.randint(1, 4)):
                p ^= 1 << bit
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"))
    pairs = {tuple(x) for x in found.collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    groups = {x.node: x.component for x in components(found).collect()}
    expected = joined(prints)
    same = {}
    for p in prints:
        same.setdefault(expected[p], set()).add(groups.get(signed(p), ("alone", p)))
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


# Whitening


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for high in (3, 2**15 - 1, 2**15, 2**31, 2**40):
        matrix = r.integers(-high - 1, high + 1, (50, 5))
        matrix[0] = [high, -high - 1, 0, 1, -1]
        assert (vectors.decode(vectors.encode(matrix), 5) == matrix).all()
    assert len(set(vectors.encode(np.array([[1, 2], [1, 2], [2**20, 0]])))) == 2
    assert vectors.decode(vectors.encode(np.zeros((3, 0), np.int64)), 0).shape == (3, 0)


@pytest.mark.parametrize("high", [1, 200, 2**20, 2**35])
def test_plane_products_are_exact(high):
    r = np.random.default_rng(2)
    matrix = r.integers(0, high, (150, 6))
    matrix[:, 2] = 0
    planes = np.array([int(c.max()).bit_length() for c in matrix.T])
    found = whitening.plane_products(matrix, planes)
    exact = matrix.astype(object).T @ matrix.astype(object)
    assert (found == np.triu(exact)).all()


def brute_covariance(x):
    """Of the distinct rows, exactly; and n and the sums."""
    fit = sorted(set(map(tuple, x.tolist())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dims = range(len(sums))
    cov = [[float(sum(Fraction(n * v[i] - sums[i], n) * Fraction(n * v[j] - sums[j], n) for v in fit) / n) for j in dims] for i in dims]
    return n, sums, np.array(cov), np.array(fit, float)


def check_whitening(rows, x_of, components=4):
    x = np.array([x_of[k] for k in sorted(x_of)])
    n, sums, cov, fit = brute_covariance(x)
    values, axes = np.linalg.eigh(cov)
    white = {k: {} for k in x_of}
    for r in rows:
        white[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert int(r.deviation) == sum((n * int(v) - s) ** 2 for v, s in zip(x_of[r.vec_id], sums))
        assert abs(r.explained / (values[-r.component] / np.trace(cov)) - 1) < 1e-9
    for c in range(1, components + 1):
        signs = set()
        for k, v in x_of.items():
            expected = (np.array(v, float) - np.array(sums) / n) @ axes[:, -c] / np.sqrt(values[-c])
            got = white[k][c].whitened
            assert abs(abs(got) - abs(expected)) < 1e-7
            if abs(expected) > 1e-3:
                signs.add(np.sign(got * expected))
        assert len(signs) == 1


def test_whitening_equals_brute_force(spark):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(120).collect()}
    x_of = {k: [int(np.floor(256 * v[i])) for i in range(5)] for k, v in source.items()}
    again = {10**6 + k: v for k, v in list(source.items())[:10]}
    df = rows_of(spark, [(k, v[:5]) for k, v in (source | again).items()], "array<float>")
    x_of |= {10**6 + k: x_of[k] for k in list(source)[:10]}
    found = whitening.whiten(df).collect()
    assert len(found) == 4 * len(x_of)
    check_whitening(found, x_of)


def test_whitening_of_the_whole_table(spark):
    rows = registry.op12_bit_sliced_whitening(spark, SF).collect()
    x = np.floor(256 * np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()])).astype(int)
    fit = np.unique(x, axis=0)
    values = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    assert len(rows) == 4 * len(x) and {r.n for r in rows} == {len(fit)}
    first = {r.component: r for r in rows if r.vec_id == 0}
    for c in range(1, 5):
        assert abs(first[c].explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and first[c].identity_error < 1e-9
    assert first[1].deviation == sum((len(fit) * int(v) - int(s)) ** 2 for v, s in zip(x[0], fit.sum(axis=0)))


def test_whitening_edges(spark):
    r = np.random.default_rng(3)
    good = [(i, (r.normal(size=3) * [1, 50, 1000]).tolist()) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [NAN, 1.0, 2.0]), (53, [1.0, INF, 2.0]), (54, [])]
    plane = [(60 + i, r.normal(size=2).tolist()) for i in range(8)]
    rows = good + bad + plane + [(70, [1.0]), (71, [1.0]), (None, good[0][1]), (3, good[3][1])]
    found = whitening.whiten(rows_of(spark, rows)).collect()
    three = [x for x in found if x.dims == 3]
    assert {x.vec_id for x in three} == {k for k, _ in good} | {None} and len(three) == 3 * 42
    x_of = {k: [int(np.floor(256 * c)) for c in v] for k, v in good}
    check_whitening([x for x in three if x.vec_id is not None], x_of, 3)
    assert len([x for x in found if x.dims == 2]) == 2 * 8 and {x.dims for x in found} == {2, 3}
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    assert whitening.whiten(rows_of(spark, bad)).collect() == []


def test_whitening_of_dependent_columns_and_large_entries(spark):
    r = np.random.default_rng(5)
    rows = [(i, [a, a, b * 1e9]) for i, (a, b) in enumerate(r.normal(size=(30, 2)).tolist())]
    found = whitening.whiten(rows_of(spark, rows), components=3).collect()
    assert {x.component for x in found} <= {1, 2} and 1 in {x.component for x in found}
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert {x.vec_id: int(x.deviation) for x in found} == {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    with pytest.raises(Exception, match="not below"):
        whitening.whiten(rows_of(spark, [(1, [1e30])])).collect()


# Clusters


def brute_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    size = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        of = [min((size(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if step < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), (_, m) in zip(kept, of) if m == n]
                if own:
                    centres[n] = [sum(c) // len(own) for c in zip(*own)]
    inertia = {n: sum(d for d, m in of if m == n) for n in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, m, d, inertia[m], sum(inertia.values()), digest[m]) for (i, _), (d, m) in zip(kept, of)), key=str)


def test_clusters_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = registry.op13_drift_bounded_clusters(spark, SF).collect()
    assert sorted(map(tuple, found), key=str) == brute_clusters(rows)


def test_cluster_edges(spark):
    r = np.random.default_rng(7)
    good = [(i, r.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)]  # ties and equal vectors
    bad = [(90, None), (91, [1.0, 2.0]), (92, [1.0, None, 3.0]), (93, [NAN, 1.0, 1.0]), (94, [1.0, -INF, 0.0]), (95, [])]
    rows = good + bad + [(5, good[5][1]), (6, [9.0, 9.0, 9.0]), (None, [0.5, 0.25, -7.0])]
    for k in (1, 5, 16, 100):
        found = centroids.cluster_vectors(rows_of(spark, rows), dims=3, clusters=k).collect()
        if k < 100:
            assert sorted(map(tuple, found), key=str) == brute_clusters(rows, k, dims=3)
        assert len(found) == 63
    assert centroids.cluster_vectors(rows_of(spark, [])).collect() == []
    assert centroids.cluster_vectors(rows_of(spark, bad)).collect() == []
    assert centroids.cluster_vectors(rows_of(spark, [(None, [1.0])]), dims=1).first().cluster == 0
    with pytest.raises(Exception, match="does not fit"):
        centroids.cluster_vectors(rows_of(spark, [(1, [1e12, 0.0]), (2, [0.0, 0.0])]), dims=2).collect()


def test_approach_bounds_every_point_of_the_ball():
    r = np.random.default_rng(8)
    tighter = 0
    for _ in range(400):
        centre, start = r.normal(size=(2, 6)) * r.choice([0.1, 1, 10])
        end = start + r.normal(size=6) * r.choice([0.01, 0.5, 5])
        radius = r.choice([0, 0.1, 1, 4])
        away = r.normal(size=(300, 6))
        points = centre + radius * away / np.linalg.norm(away, axis=1)[:, None] * r.choice([1.0, 0.5], (300, 1))
        nearer = np.linalg.norm(points - start, axis=1) - np.linalg.norm(points - end, axis=1)
        bound, drift = centroids.approach(centre, radius, start, end), np.linalg.norm(end - start)
        assert nearer.max() <= bound <= drift * (1 + 1e-6) + 1e-6
        tighter += bound < 0.9 * drift
    assert tighter > 100
    assert centroids.approach(np.zeros(3), 1.0, np.ones(3), np.ones(3)) == 0
    # in the plane, the bound is close to what the disc allows
    angle = np.linspace(0, 2 * np.pi, 100_000)
    disc = np.stack([3 + np.cos(angle), 1 + np.sin(angle)], axis=1)
    best = (np.linalg.norm(disc - [0, 0], axis=1) - np.linalg.norm(disc - [0, 2], axis=1)).max()
    assert 0 <= centroids.approach(np.array([3.0, 1.0]), 1.0, np.zeros(2), np.array([0.0, 2.0])) - best < 0.05


def test_bounds_save_comparisons_and_change_nothing():
    r = np.random.default_rng(9)
    middles = r.integers(-500, 500, (8, 16))
    x = middles[r.integers(0, 8, 3000)] + r.integers(-40, 40, (3000, 16))
    before = middles + r.integers(-30, 30, middles.shape)
    cluster, distance, lower = centroids._scanned(x, before)
    radii = np.array([np.sqrt(distance[cluster == c].max()) for c in range(8)])
    after = np.array([x[cluster == c].sum(axis=0) // (cluster == c).sum() for c in range(8)])
    give = centroids.loosening(before.astype(float), after.astype(float), radii)
    found, exact, lower, scanned = centroids.reassigned(x, cluster, lower, after, give)
    every = ((x[:, None] - after) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (exact == every.min(axis=1)).all() and scanned.mean() < 0.2
    rest = np.sqrt(np.where(np.arange(8) == found[:, None], np.inf, every).min(axis=1))
    assert (lower <= rest).all()
    drift = np.sqrt(((after - before) ** 2).sum(axis=1))
    assert all(give[c] < np.delete(drift, c).max() for c in range(8))
