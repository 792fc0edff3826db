"""The array automaton against all windows of all items."""

import random
import time

import numpy as np

from tapeloom.llm import automaton


def brute(words, items, window):
    hit, found = set(), set()
    for item, own in items:
        n = min(window, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= {item} - {None}
    return hit, found


def test_hits_and_items_equal_brute_force(monkeypatch):
    random.seed(4)
    for _ in range(3000):
        window, pool = random.choice([1, 2, 3, 5, 13]), [b"w%d" % i for i in range(random.choice([1, 2, 3, 6]))]
        items = [(random.choice([None, str(i), "same"]), random.choices(pool, k=random.randint(0, 25))) for i in range(random.randint(0, 8))]
        texts = [random.choices([*pool, b"x"], k=random.randint(0, 60)) for _ in range(random.randint(0, 6))]
        monkeypatch.setattr(automaton, "LANE", random.choice([1, 2, 7, 256]))
        for text, (runs, found) in zip(texts, automaton.Automaton(items, window).scan(texts)):
            assert ({p for a, b in runs for p in range(a, b)}, found) == brute(text, items, window)
            assert all(a < b for a, b in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_a_long_benchmark_is_one_automaton():
    rng = np.random.default_rng(5)
    vocabulary = [b"t%d" % i for i in range(30_000)]
    draw = lambda n: [vocabulary[i] for i in np.minimum(rng.zipf(1.3, n), 30_000) - 1]
    items = [(str(i), draw(100)) for i in range(5000)]
    began = time.process_time()
    a = automaton.Automaton(items)
    assert time.process_time() - began < 60
    assert len(a.length) <= 2 * 500_000 + 1 and len(a.keys) + len(a.root) <= 3 * 500_000 + len(a.root)
    texts = [draw(50) + items[i][1][20:60] + draw(30) for i in range(0, 5000, 50)]
    for i, (runs, found) in zip(range(0, 5000, 50), a.scan(texts)):
        assert str(i) in found and any(x <= 50 and y >= 90 for x, y in runs)
