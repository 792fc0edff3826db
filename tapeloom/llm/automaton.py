"""A generalised suffix automaton of items' words as NumPy arrays, and batches of texts streamed through it.

Only runs of up to ``window`` words are told apart, so all lengths beyond count as that. A state is a set of runs that end at
the same places of the items. The arrays don't depend on an order of insertion: runs are numbered length by length (a run is
the shorter run that ends with it and one word more in front), neighbours in length with equally many places are one state, and
the edges lead from each state's longest run, or that of ``window - 1`` words, to the run with the next word behind it.

Texts are streamed side by side: stretches of known words are lanes, which overlap by ``window - 1`` words and take a step each
at a time; a lane without an edge follows its links.
"""

from __future__ import annotations

import numpy as np

#: words of a lane
LANE = 256


class Automaton:
    """items: (item_id, words). Items without words are left out; items without an id are hit like any other and not named."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = 13):
        self.window, self.vocabulary, self.ids = window, {}, []
        runs = []
        for item, tokens in items:
            if tokens:
                self.ids.append(item)
                runs.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens], np.int64))
        self.least = min([min(window, len(r)) for r in runs], default=window)
        self._build(runs)

    def _build(self, runs: list[np.ndarray]) -> None:
        window, size = self.window, max(1, len(self.vocabulary))
        word = np.concatenate([*runs, np.zeros(0, np.int64)])
        lengths = np.array([len(r) for r in runs], np.int64)
        item = np.repeat(np.arange(len(runs)), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # in its item
        last = place == lengths[item] - 1
        # the number of the run of d words that ends at each word (-1: the item begins too late), and how often a run occurs
        number, times = [None, word.astype(np.int32)], [None, np.bincount(word, minlength=size)]
        for d in range(2, window + 1):
            at = np.flatnonzero(place >= d - 1)
            _, which = np.unique(number[-1][at].astype(np.int64) * size + word[at - d + 1], return_inverse=True)
            number.append(np.full(len(word), -1, np.int32))
            number[-1][at] = which
            times.append(np.bincount(which))
        length, link, keys, targets, owners = [np.zeros(1, np.int8)], [], [], [], []
        made, longer = 1, np.full(len(word), -1, np.int32)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(window, 0, -1):
            there = place >= d - 1
            same = np.zeros(len(word), bool)  # one state with the run that is a word longer
            if d < window:
                at = np.flatnonzero(number[d + 1] >= 0)
                same[at] = times[d][number[d][at]] == times[d + 1][number[d + 1][at]]
            state = np.where(same, longer, -1).astype(np.int32)
            at = np.flatnonzero(there & ~same)
            kinds, which = np.unique(number[d][at], return_inverse=True)
            state[at] = made + which
            made += len(kinds)
            length.append(np.full(len(kinds), d, np.int8))
            up = np.flatnonzero((longer >= 0) & ~same)
            links.append((longer[up], state[up]))
            if d < window:  # from the runs of d words that end at a word to those of d + 1 at the next one
                at = np.flatnonzero((place[1:] > 0) & there[:-1] & (~same[:-1] | (d == window - 1)))
                key, first = np.unique(state[at].astype(np.int64) * size + word[at + 1], return_index=True)
                keys.append(key)
                targets.append(longer[at[first] + 1])
            ends = np.flatnonzero(there if d == window else last & (place == d - 1))
            owners.append(np.unique(state[ends].astype(np.int64) * max(1, len(runs)) + item[ends]))
            longer = state
            del number[d + 1 :], times[d + 1 :]
        self.root = np.zeros(size, np.int32)
        self.root[word] = longer
        self.length, self.link = np.concatenate(length), np.zeros(made, np.int32)
        for below, above in links:
            self.link[below] = above
        keys, targets = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*targets, np.zeros(0, np.int32)])
        # edges lie in buckets by a hash of state and word, about one in two
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.targets = keys[order], targets[order]
        self.bucket = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(bucket, minlength=1 << self.bits), out=self.bucket[1:])
        pairs = np.sort(np.concatenate(owners))
        owner, self.items = pairs // max(1, len(runs)), (pairs % max(1, len(runs))).astype(np.int32)
        #: where the items of a state begin among all, and the next state with items on the way of its links
        self.begin = np.searchsorted(owner, np.arange(made + 1))
        self.above = np.zeros(made, np.int32)
        for d in range(1, window + 1):
            some = np.flatnonzero(self.length == d)
            up = self.link[some]
            self.above[some] = np.where(self.begin[up + 1] > self.begin[up], up, self.above[up])

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The states that edges lead to; 0 where there is none."""
        bucket, out = self._bucket(keys), np.zeros(len(keys), np.int64)
        p, end = self.bucket[bucket], self.bucket[bucket + 1]
        todo = np.flatnonzero(p < end)
        while len(todo):
            q = p[todo]
            hit = self.keys[q] == keys[todo]
            out[todo[hit]] = self.targets[q[hit]]
            todo = todo[~hit]
            p[todo] += 1
            todo = todo[p[todo] < end[todo]]
        return out

    def _streamed(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state and the length of the longest run (``window`` at most) that ends at each word; -1 parts the texts."""
        state, size = np.zeros(len(known), np.int32), np.zeros(len(known), np.int8)
        gaps = np.flatnonzero(np.r_[True, known < 0, True])
        long = np.flatnonzero(np.diff(gaps) > self.least)
        begin, end = gaps[long], gaps[long + 1] - 1
        if not len(begin) or not len(self.ids):
            return state, size
        # lanes: each own stretch, and the words before it that its first lengths need
        each = -(-(end - begin) // LANE)
        of = np.repeat(np.arange(len(begin)), each)
        own = begin[of] + LANE * (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each))
        first = np.maximum(own - self.window + 1, begin[of])
        until = np.minimum(own + LANE, end[of])
        by = np.argsort(first - until, kind="stable")
        own, first, until = own[by], first[by], until[by]
        spans, words = until - first, len(self.vocabulary)
        s, n = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for t in range(int(spans[0])):
            live = int(np.searchsorted(-spans, -t, "left"))
            at = first[:live] + t
            w = known[at]
            now, run = s[:live], n[:live]
            todo = np.flatnonzero(now)
            while len(todo):
                to = self._next(now[todo] * words + w[todo])
                hit, rest = todo[to > 0], todo[to == 0]
                # a lane that has its next state is told from those still on their way by a negative sign
                now[hit], run[hit] = -to[to > 0], np.minimum(run[hit], self.window - 1) + 1
                now[rest] = self.link[now[rest]]
                run[rest] = self.length[now[rest]]
                todo = rest[now[rest] > 0]
            lost = now == 0
            now[lost], run[lost] = self.root[w[lost]], 1
            np.abs(now, out=now)
            mine = at >= own[:live]
            state[at[mine]], size[at[mine]] = now[mine], run[mine]
        return state, size

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each text the runs [from, to) of words that stand in windows (or whole shorter items), and the items found."""
        numbers = [np.array([-1 if c is None else c for c in map(self.vocabulary.get, t)] + [-1], np.int64) for t in texts]
        if not numbers:
            return []
        begin = np.cumsum([0, *map(len, numbers)])
        state, size = self._streamed(np.concatenate(numbers))
        at, found = np.flatnonzero(size >= self.least), []
        now = state[at]
        change = np.zeros(begin[-1] + 1, np.int64)
        while len(at):
            whole = (self.begin[now + 1] > self.begin[now]) & (size[at] >= self.length[now])
            here, have = at[whole], now[whole]
            np.add.at(change, here + 1 - self.length[have].astype(np.int64), 1)
            np.add.at(change, here + 1, -1)
            text = np.searchsorted(begin, here, "right") - 1
            pairs = np.unique(text * len(self.length) + have)  # each state once a text
            found.append(pairs)
            now = self.above[now]
            at, now = at[now > 0], now[now > 0]
        covered = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
        out: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in texts]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            k = int(np.searchsorted(begin, a, "right")) - 1
            out[k][0].append((a - int(begin[k]), b - int(begin[k])))
        for pair in np.unique(np.concatenate([*found, np.zeros(0, np.int64)])).tolist():
            k, s = divmod(pair, len(self.length))
            out[k][1].update(i for i in (self.ids[x] for x in self.items[self.begin[s] : self.begin[s + 1]].tolist()) if i is not None)
        return out
