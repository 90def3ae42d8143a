"""Prefixes of the forest that become shorter, against exact similarities."""

import random

import numpy as np

from tests.llm.test_llm import brute_near, docs_of, letters
from vitrina.llm import near_copies


def _chains(seed: int, changed: int) -> list[str]:
    dice, words, texts = random.Random(seed), letters(seed), []
    for _ in range(25):
        text = [dice.choice(words) for _ in range(120)]
        for _ in range(4):
            texts.append(" ".join(text))
            text = list(text)
            for at in dice.sample(range(120), changed):
                text[at] = dice.choice(words)
    return texts


def test_signature_is_the_minimum_of_every_function():
    sets = near_copies.shingles([f"w{k}" for k in range(900)])
    mixed = near_copies._MIX[:, :, 0]
    want = [min(((int(x) * int(m) + int(a)) % 2**64) >> 32 for x in sets) for m, a in mixed.T[:7]]
    assert near_copies.signature(sets)[:7].tolist() == want and near_copies.signature(sets[:1]).dtype == np.uint32


def test_depths():
    assert near_copies.next_depth(1.0, 6, 0.995) == 6 and near_copies.next_depth(0.95, 6, 0.995) == 6
    assert near_copies.next_depth(0.8, 6, 0.995) == 5 and near_copies.next_depth(0.8, 5, 0.9999) == 3
    assert near_copies.next_depth(0.3, 6, 0.995) == near_copies.SHORTEST


def test_weak_links_shorten_prefixes(spark, monkeypatch):
    """With three trees, prefixes at their whole length miss links that the parents in the tries bring together."""
    monkeypatch.setattr(near_copies, "TREES", 3)
    monkeypatch.setattr(near_copies, "_MIX", near_copies._MIX[:, :18])
    monkeypatch.setattr(near_copies, "LINK", 0.2)
    depths, edges = [], near_copies.family_edges

    def noted(texts, depth, families=None):
        depths.append(depth)
        return edges(texts, depth, families)

    monkeypatch.setattr(near_copies, "family_edges", noted)
    texts = _chains(31, 2)
    _, want_links = brute_near(texts)

    def links(target):
        depths.clear()
        rows = near_copies.near_copies(docs_of(spark, texts), target).orderBy("doc_id").collect()
        return [r.n_links for r in rows], list(depths)

    at_once, passes = links(0.0)
    assert passes == [6] and sum(at_once) < sum(want_links)
    got, passes = links(0.97)
    assert len(passes) >= 2 and passes == sorted(passes, reverse=True) and passes[-1] < 6
    assert all(a <= b for a, b in zip(got, want_links)) and sum(at_once) < sum(got) and sum(got) >= 0.97 * sum(want_links)


def test_strong_links_keep_whole_prefixes(spark, monkeypatch):
    depths, edges = [], near_copies.family_edges
    monkeypatch.setattr(near_copies, "family_edges", lambda texts, depth, families=None: depths.append(depth) or edges(texts, depth, families))
    words = letters(8)
    texts = [" ".join(words[k : k + 120]) for k in (0, 0, 1, 130, 131)]
    rows = near_copies.near_copies(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_links for r in rows] == brute_near(texts)[1] and depths == [6]
