import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import ngram_join as j

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        least[find(k)].append(i)
    return sorted((i, len(s), min(least[find(k)]) if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    rows, common = [], rng.choice(words, 20).tolist()
    for i in range(n):
        if i % 3 and rows:
            base = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 4)):
                base[rng.integers(len(base))] = str(rng.choice(words))
        else:
            base = rng.choice(words, rng.integers(6, 80)).tolist() + common
        rows.append((i, " ".join(base)))
    return rows


@pytest.mark.parametrize("seed, block", [(0, 4096), (1, 4), (2, 4096), (3, 3)])
def test_against_all_pairs(spark, seed, block):
    rows = corpus(seed)
    got = j.link_components(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()]
    got = j.link_components(odd.where("doc_id is not null"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert j.link_components(odd).count() == odd.count()
    assert j.link_components(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=14))
def test_trie_finds_every_component(sets):
    arrays = [np.array(sorted(s)) for s in sets]
    trie = j.Trie(arrays, list(range(len(sets))))
    for i in range(len(sets)):
        trie.link(i)
        trie.insert(i)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert [trie.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_shingles_of_bytes():
    data = "One  two\tTHREE four five six".encode() + b"" + "é one".encode()
    cut = len("One  two\tTHREE four five six")
    found, at = j.shingles(np.frombuffer(data, np.uint8), np.array([0, cut, cut, len(data)]))
    assert np.diff(at).tolist() == [2, 0, 1]
    again, _ = j.shingles(np.frombuffer(b"ONE two three four five six", np.uint8), np.array([0, 27]))
    assert again.tolist() == found[:2].tolist()
