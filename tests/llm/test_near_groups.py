"""Links within large groups of near copies, against all pairs."""

from __future__ import annotations

import random

import pytest

from spanweave.llm import oddsketch


def _shingles(text, k):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def _reachable(texts, k, percent):
    """Each id with the smallest id it reaches, over links between all pairs."""
    sets = {n: _shingles(t, k) for n, t in texts.items()}
    top = {n: n for n in sets}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {n: find(n) for n in sets}


def _group(seed, edits, n=120, length=90):
    """Copies of one text with random words replaced, removed or doubled, around the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    texts = {}
    for d in range(n):
        words = list(base)
        for _ in range(rng.choice(edits)):
            at = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.5:
                words[at] = f"x{rng.randrange(40)}"
            elif kind < 0.8:
                del words[at]
            else:
                words.insert(at, words[at])
        texts[d + 1] = " ".join(words)
    return texts


@pytest.mark.parametrize("seed, edits, k, threshold", [(1, (1, 2, 3), 3, 0.85), (2, (2, 3, 4), 3, 0.85), (3, (1, 2), 5, 0.8), (4, (0, 1, 6), 5, 0.8)])
def test_groups_of_near_copies_equal_all_pairs(spark, seed, edits, k, threshold):
    texts = _group(seed, edits)
    wanted = _reachable(texts, k, round(100 * threshold))
    assert len(set(wanted.values())) > 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.component_id for r in oddsketch.near_duplicates(docs, k=k, threshold=threshold).collect()} == wanted


def test_pairs_on_deviations_hold_every_link(spark):
    """The last round alone, with every class in a component of its own."""
    for seed, edits in ((5, (1, 2, 3, 4)), (6, (1, 2, 6))):
        texts = _group(seed, edits, n=60)
        sets = {n: _shingles(t, 3) for n, t in texts.items()}
        rows = [(1, n, len(sets[n]), n) for n in texts]
        members = spark.createDataFrame(rows, "centre long, id long, n long, component long")
        docs = spark.createDataFrame(list(texts.items()), "id long, text string")
        found = {(r.a, r.b) for r in oddsketch._meet_on_deviations(members, docs, 0.85, 3).collect()}
        links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
        # A link with no need of common deviations is reached through the class of least excess.
        allowed = (1 - 0.85) / 1.85
        usual = {w for s in sets.values() for w in s if sum(w in o for o in sets.values()) * 2 > len(sets)}
        excess = {n: len(s ^ usual) - allowed * len(s) for n, s in sets.items()}
        assert {(a, b) for a, b in links if excess[a] + excess[b] > 1e-9} <= found and len(links) > 20
        least = min(excess, key=lambda n: (excess[n], n))
        assert {tuple(sorted((n, least))) for n in excess if n != least and excess[n] + excess[least] <= 0} <= found
        assert len(found) < 0.8 * 60 * 59 / 2


def test_repeated_and_missing_ids(spark):
    rows = [(7, "a b c d"), (7, "z y x w v u"), (8, "z y x w v u"), (9, "a b c d"), (None, "a b c d"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in oddsketch.near_duplicates(docs, k=3, threshold=0.85).collect()}
    assert got == {7: (2, 7), 8: (4, 8), 9: (2, 7)}
