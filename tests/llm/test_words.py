"""The numpy word kernels, components, filters and slicing, against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyweave.llm import words
from tallyweave.llm.bloom import BlockedBloom
from tallyweave.llm.components import connected_components
from tallyweave.llm.runtime import text_slices

LOWER = {k: k + 32 for k in range(65, 91)}
some_texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b.é中", max_size=40)), max_size=12)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@settings(max_examples=150, deadline=None)
@given(some_texts, st.integers(1, 30))
def test_shingle_sets_are_those_of_plain_words(texts, most):
    found, hashes = [], {}
    for first, end, data, at in text_slices(pa.array(texts, pa.string()), most):
        found += words.shingle_sets(data, at)
    assert [len(s) for s in found] == [len(plain_set(t)) for t in texts]
    for text, s in zip(texts, found, strict=True):
        assert hashes.setdefault(frozenset(plain_set(text)), s.tobytes()) == s.tobytes()
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=100, deadline=None)
@given(some_texts)
def test_words_are_those_of_the_pattern(texts):
    for _, _, data, at in text_slices(pa.array(texts, pa.string())):
        starts, ends, first = words.spans(data, at)
        raw = data.tobytes()
        for r, text in enumerate(texts):
            got = [raw[a:b].decode().translate(LOWER) for a, b in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)]
            assert got == plain_words(text)


def test_slices_of_a_sliced_column():
    column = pa.array(["ab", None, "cdé", "", "x" * 50])
    for part in (column.slice(1, 3), column.slice(2), column.slice(0, 0)):
        got = [(data[a:b].tobytes().decode()) for _, _, data, at in text_slices(part, 4) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [x or "" for x in part.to_pylist()]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(80)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent if x in got} and {x for x in parent if find(x) != x} <= set(got)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long"), "a", "b").count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    bloom = BlockedBloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h", len(keys))
    assert bloom.might_hold(keys).all()
    assert bloom.might_hold(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.02
