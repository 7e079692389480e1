"""The Jaccard join against brute force, on real rows and on hard ones."""

import random

import numpy as np
import pytest
from brute import by_key, components_of, plain_set
from tallyweave.llm import jaccard


def check(df, rows):
    sets = [plain_set(t) for _, t in rows]
    want = components_of([(i, s) for (i, _), s in zip(rows, sets, strict=True)])
    got = by_key(jaccard.jaccard_components(df))
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == sorted((repr(i), len(s), repr(w)) for (i, _), s, w in zip(rows, sets, want, strict=True))


def test_documents(spark, documents):
    check(documents, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_odd_rows(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_empty_table(empty):
    assert jaccard.jaccard_components(empty).count() == 0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def families(rng):
    """A large family of near copies, chains at the threshold, a passage in all texts, many sizes."""
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    passage = [f"common{k}" for k in range(60)]
    rows = [(k, edited(rng, base, rng.randrange(4))) for k in range(150)]
    chain = [f"c{rng.randrange(5000)}" for _ in range(100)]
    for k in range(40):
        chain = list(chain)
        chain[rng.randrange(100)] = f"new{k}"
        rows.append((200 + k, " ".join(chain)))
    rows += [(300 + k, " ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 400)))])) for k in range(80)]
    rows += [(500 + k, " ".join(f"s{x}" for x in range(rng.randrange(1, 9)))) for k in range(30)]
    for n in (1500, 6000):
        big = [f"b{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(600 + n + k, edited(rng, big, n // 60)) for k in range(5)]
    return rows


@pytest.mark.parametrize("chunk,shingles", [(4096, 4 << 20), (16, 4 << 20), (4096, 5000)])
def test_families(spark, monkeypatch, chunk, shingles):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", shingles)
    rows = families(random.Random(5))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_pairs_at_the_threshold(spark):
    """Overlap of exactly 80 of 100, and of 79 of 99."""
    words = [f"x{k}" for k in range(104)]
    rows = [(1, " ".join(words[:94])), (2, " ".join(words[10:104]))]  # 90 and 90 shingles, 80 in both
    rows += [(3, " ".join(f"y{k}" for k in range(93))), (4, " ".join(f"y{k}" for k in range(10, 103)))]  # 89 and 89, 79 in both
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_tree_prunes_no_link():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (300, jaccard.GROUPS))
    points[150:] = points[:150] + (rng.random((150, jaccard.GROUPS)) < 0.1)
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    for one in range(0, 300, 7):
        want = np.flatnonzero(jaccard.may_link(np.minimum(points, points[one]).sum(axis=1), sizes + sizes[one]))
        assert sorted(tree.query(points[one], int(sizes[one]))) == want.tolist()


def test_count_vectors_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n in (10, 3000, 30000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        groups = jaccard.groups_of(len(a))
        x, y = jaccard.count_vector(a, groups), jaccard.count_vector(b, groups)
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b)) and (jaccard.fold(x, jaccard.GROUPS) == jaccard.count_vector(a)).all()


def test_linked_sets_share_a_prefix():
    rng, level = random.Random(1), np.zeros(jaccard.SKETCH, np.uint8)
    level[::3] = 4
    for _ in range(200):
        base = np.array(sorted(rng.sample(range(2**40), 60)), np.uint64)
        a, b = (np.sort(np.array(rng.sample(base.tolist(), rng.randrange(48, 61)), np.uint64)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard._prefix(a, level), jaccard._prefix(b, level)))


def test_spanning_links_reach_all():
    rng = np.random.default_rng(4)
    links = {tuple(sorted(p)) for p in rng.integers(0, 60, (50, 2)).tolist() if p[0] != p[1]}
    check = lambda one, others: np.array([tuple(sorted((one, int(x)))) in links for x in others])
    found = jaccard.spanning_links(np.ones((60, jaccard.GROUPS), int), np.full(60, jaccard.GROUPS), check)
    label = components_of([(k, set()) for k in range(60)], links)
    assert components_of([(k, set()) for k in range(60)], found) == label and len(found) == 60 - len(set(label))


def test_merged_lists_are_cut(spark, monkeypatch):
    """Lists that are short by themselves but long when merged by their least class."""
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    rng = random.Random(8)
    base = [f"m{k}" for k in range(60)]
    rows = [(k, edited(rng, base, 2)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    profiles = jaccard._profiles(df.selectExpr("doc_id as k", "text as t"), np.zeros(jaccard.SKETCH, np.uint8))
    sizes = [r["count"] for r in jaccard._lists(profiles).groupBy("g").count().collect()]
    assert max(sizes) <= 6 * jaccard.CHUNK  # two chunks by hash, which vary in size
    check(df, rows)


def test_sets_with_one_hash_stay_apart(spark, monkeypatch):
    """Different sets whose first hashes are equal are told by the second."""
    real = jaccard._class_of
    monkeypatch.setattr(jaccard, "_class_of", lambda s: (real(s)[0] % 3, real(s)[1]))
    rng = random.Random(9)
    rows = [(k, " ".join(f"h{rng.randrange(40)}" for _ in range(rng.randrange(3, 12)))) for k in range(60)] + [(100 + k, "one text that stands here more than once") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sets = [plain_set(t) for _, t in rows]
    want = components_of([(i, s) for (i, _), s in zip(rows, sets, strict=True)])
    profiles = jaccard._profiles(df.selectExpr("doc_id as k", "text as t"), np.zeros(jaccard.SKETCH, np.uint8))
    assert want[-1] == 100 and profiles.select("other").distinct().count() == len({frozenset(s) for s in sets})


def test_tree_compares_few_points():
    """Clusters of like points: a query compares a small share of all pairs, at every number of levels."""
    rng = np.random.default_rng(3)
    centres = rng.poisson(4, (60, jaccard.GROUPS)) * rng.integers(1, 40, 60)[:, None]
    points = np.repeat(centres, 40, axis=0) + rng.integers(0, 2, (2400, jaccard.GROUPS))
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    assert len(tree.levels) == 2
    for one in range(0, 2400, 17):
        found = tree.query(points[one], int(sizes[one]))
        want = np.flatnonzero(jaccard.may_link(np.minimum(points, points[one]).sum(axis=1), sizes + sizes[one]))
        assert sorted(found) == want.tolist()
    assert tree.tested < 0.25 * 2400 * len(range(0, 2400, 17))
