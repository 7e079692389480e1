"""Decontamination against brute force over all windows, and the index's guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import LOWER
from pyspark.sql import functions as F
from tallyweave.llm import decontaminate

GAPS = re.compile(r"[\s!-/:-@\[-`{-~]+", re.ASCII)


def plain(text):
    return [w for w in GAPS.split((text or "").translate(LOWER)) if w]


def brute(docs, items):
    """{(doc, item): best similarity} over every window of each item's size."""
    out = {}
    for d, text in docs:
        w = plain(text)
        for i, item in items:
            own = plain(item)
            if not own:
                continue
            width = min(5, len(own))
            grams = lambda x: Counter(tuple(x[k : k + width]) for k in range(len(x) - width + 1))  # noqa: E731,B023
            want = grams(own)
            for start in range(max(1, len(w) - len(own) + 1)):
                got = grams(w[start : start + len(own)])
                both = sum((want & got).values())
                like = both / max(1, sum(want.values()) + sum(got.values()) - both)
                if like >= 0.8 and like > out.get((d, i), 0):
                    out[d, i] = like
    return out


def found(docs, items):
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, items).collect()}


def test_planted_passages(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 12, 30, 60])))) for k in range(20)] + [(20, "same same same same same same same"), (21, ""), (22, None)]
    docs = []
    for d in range(60):
        own = [word() for _ in range(rng.randrange(0, 150))]
        if d % 3 == 0:
            passage = items[rng.randrange(21)][1].split()
            if d % 2 and len(passage) > 8:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w.upper() if d % 4 == 0 else w for w in passage]
        docs.append((d, (", " if d % 5 == 0 else " ").join(own)))
    want = brute(docs, items)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_documents(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r.item_id: " ".join(plain(r.text)) for r in items.collect()}
    rows = documents.select("doc_id", "text").collect()
    whole = {(r.doc_id, i) for r in rows for i, t in texts.items() if t in " ".join(plain(r.text))}
    got = found(documents, items)
    assert whole and whole <= got.keys()
    flagged = documents.filter(decontaminate.is_contaminated(documents, items, F.col("text"))).select("doc_id")
    assert {r.doc_id for r in flagged.collect()} == {d for d, _ in got}


def test_items_in_blocks(spark, sf_dir, documents, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = found(documents, items)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert found(documents, items) == whole


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text here for all of these rows"), (2, None), (None, "one"), (3, "two words"), (4, "theta alpha beta gamma delta epsilon")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect())
    assert got == [(4, 4), (6, 3), (6, 3), (7, 1), (8, 1), (8, 1)]
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert odd.filter(decontaminate.is_contaminated(odd, items, F.col("text"))).count() == 6


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    index = decontaminate.HammingIndex(prints)
    for distance in range(0, 30):
        one = int(prints[distance])
        for bit in rng.choice(64, distance, replace=False):
            one ^= 1 << int(bit)
        hits = dict(zip(*next(((f.tolist(), d.tolist()) for _, f, d in index.search(np.array([one], np.uint64))), ([], [])), strict=True))
        want = {k: int(d) for k, d in enumerate(np.bitwise_count(prints ^ np.uint64(one))) if d <= decontaminate.RADIUS}
        assert hits == want


@pytest.mark.parametrize("n", [12, 40])
def test_fingerprints_of_similar_windows_are_in_the_radius(n):
    rng = np.random.default_rng(n)
    far = []
    for _ in range(300):
        a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        b = a.copy()
        b[: max(1, n // 10)] = rng.integers(0, 2**63, max(1, n // 10)).astype(np.uint64)
        far.append(int(np.bitwise_count(decontaminate.simhash(a) ^ decontaminate.simhash(b))))
    assert max(far) <= decontaminate.RADIUS


@pytest.mark.parametrize("words", [5, 6, 9, 14, 20, 50, 100, 200])
def test_least_similar_windows_are_in_the_radius(words):
    """Recall at a similarity of just 0.8 or more, for items of 5 to 200 words: no fingerprint is beyond the radius."""
    rng = np.random.default_rng(words)
    n = words - 4
    same = -(-16 * n // 18)  # s / (2 n - s) >= 0.8
    draw = lambda k: rng.integers(0, 2**63, (1000, k)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (1000, k)).astype(np.uint64)
    a = draw(n)
    b = np.concatenate([a[:, :same], draw(n - same)], axis=1)
    prints = [np.array([decontaminate.simhash(row) for row in x]) for x in (a, b)]
    assert np.bitwise_count(prints[0] ^ prints[1]).max() <= decontaminate.RADIUS
