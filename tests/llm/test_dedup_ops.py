"""Repeated strings, SimHash, vectors, components: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import repeats, simhash, vectors
from tapeloom.llm.components import components, local_roots
from tapeloom.llm.grouping import suffix_array
from tapeloom.llm.store import Scratch


def roots(n, edges):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_suffix_array_of_small_texts():
    random.seed(1)
    for _ in range(3000):
        t = [random.randint(0, random.choice([0, 1, 2, 4])) for _ in range(random.randint(0, 25))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    t = list(b"ab" * 200 + b"a" * 100)
    assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute_removed(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        cut = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if n[b[p : p + size]] > 1:
                cut[p : p + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if cut[k] and (not k or not cut[k - 1]))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return out


def repeated_rows(seed):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(90), text(150), text(100)]
    rows = [(i, " ".join(random.choice([*shared, text(60), text(20), text(5)]) for _ in range(random.randint(1, 5)))) for i in range(70)]
    edited = list(shared[1])
    edited[len(edited) // 2] = "#"
    long = text(3000)
    rows += [(80, "".join(edited)), (81, "a" * 2500), (82, "ab" * 900), (83, "abc" * 700 + shared[0]), (84, None), (85, ""), (86, "x" * 399), (87, "é" * 600), (88, long), (88, long + "!"), (None, shared[2]), (90, rows[0][1]), (90, rows[0][1])]
    return rows


@pytest.mark.parametrize("room", [256, 1])
def test_removed_bytes_match_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(repeats.repeated_ranges, "__defaults__", (400, room))
    monkeypatch.setattr(repeats, "SLICE", 8192)  # long texts in parts
    rows = repeated_rows(room)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, uid string, ranges int").repartition(5)
    got = [(r.doc_id, r.n_bytes, sum(s["to"] - s["from"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.removed(table).collect()]
    assert sorted(got, key=str) == sorted(brute_removed(rows, 400), key=str)


def brute_passages(rows, size):
    said = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[p : p + size]) for w in said for p in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, said):
        hit = sorted({q for p in range(len(w) - size + 1) if n[tuple(w[p : p + size])] > 1 for q in range(p, p + size)})
        runs = [k for k, q in enumerate(hit) if not k or hit[k - 1] != q - 1]
        out.append((i, [(hit[a], hit[b - 1] + 1) for a, b in zip(runs, [*runs[1:], len(hit)])]))
    return out


@pytest.mark.parametrize("room", [256, 1])
def test_passages_of_words_match_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(repeats.repeated_ranges, "__defaults__", (400, room))
    monkeypatch.setattr(repeats, "SLICE", 1024)  # long texts in parts, long words by themselves
    rows = repeated_rows(room)
    passage = [f"w{k}" for k in range(60)]
    gap = lambda words: "".join(w + random.choice(" \t\n\r\v\f") * random.randint(1, 3) for w in words)
    huge = ["x" * 3000, "y" * 1024, "z" * 1023, "x" * 3000 + "!"]
    own = lambda k, n: [f"o{k}.{j}" for j in range(n)]
    rows += [(100 + k, gap([*own(k, 7 * k), *passage, *own(-k, 30)])) for k in (1, 2)]
    rows += [(110 + k, gap([*own(110 + k, 400 + k), *huge, *passage[5:52], *own(-110 - k, 3)])) for k in (1, 2)]
    rows += [(120, " ".join(own(120, 51))), (121, " " + "\n".join(own(120, 51))), (122, "\u00a0".join(own(120, 51))), (123, " ".join(own(120, 50)))]
    rows += [(130, " ".join(own(130, 60) + own(131, 5) + own(130, 60))), (131, " ".join(own(133, 30) * 20)), (132, " " * 5000), (133, "q" * 5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, [(s["from"], s["to"]) for s in r.passages]) for r in repeats.removed(table, passage=51).collect()]
    assert sorted(got, key=str) == sorted(brute_passages(rows, 51), key=str)
    assert all(spans for i, spans in got if i in (101, 102, 111, 112, 120, 121, 130)) and not any(spans for i, spans in got if i in (122, 123, 132, 133))
    assert repeats.removed(table.limit(0), passage=51).count() == 0


def test_query_tells_passages_of_over_50_words(spark, tmp_path):
    from tapeloom.llm.queries import QUERIES

    random.seed(60)
    say = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(1, 9))) for _ in range(n))
    planted, fifty = say(60), say(50)
    assert len(planted) < 400
    rows = [(1, f"{say(40)} {planted} {say(30)}"), (2, f"{planted}\n{say(90)}"), (3, f"{say(9)} {fifty} {say(9)}"), (4, f"{say(7)} {fifty} {say(7)}"), (5, say(200)), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert {i: (r.n_passages, r.n_passage_words) for i, r in got.items()} == {1: (1, 60), 2: (1, 60), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    assert all(r.n_removed == 0 and r.n_bytes == len((t or "").encode()) for r, t in ((got[i], t) for i, t in rows)), "the 400-byte rule stays"


def test_without_repeats_keeps_other_columns(spark):
    rows = [(1, "é" * 300 + "tail one", "en", 1), (2, "é" * 300 + "other", "de", 2), (3, "a" * 500, None, 3), (4, "a" * 500, None, 3), (5, None, "fr", 0), (6, "", "fr", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in repeats.without_repeats(table).collect()}
    assert set(got) == {1, 2, 5, 6} and got[1].text == "tail one" and got[1].n_chars == 8 and got[2].lang == "de"
    assert repeats.removed(table.limit(0)).count() == 0


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_match_brute_force(spark):
    random.seed(4)
    word = lambda: "".join(random.choices("aBcdÉ-", k=random.randint(1, 5)))
    rows = []
    for g in range(25):
        base = [word() for _ in range(random.choice([2, 5, 40, 200]))]
        for _ in range(random.randint(1, 5)):
            own = list(base)
            for _ in range(random.randint(0, 2)):
                own[random.randrange(len(own))] = word()
            rows.append((1000 - len(rows), " ".join(own)))
    rows += [(1, None), (2, "  "), (3, "one"), (3, "one"), (None, rows[0][1]), (5, "many words here and there " * 3000)]
    table = spark.createDataFrame([(*r, "f", 0) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()), key=str)
    fp = [slow_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    assert got == sorted(((i, f"{f:016x}", low.get(r)) for (i, _), f, r in zip(rows, fp, root)), key=str)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("room", [2048, 8, 1])
def test_ball_links_connect_what_brute_force_connects(spark, room):
    """Clusters of fingerprints that share their leading bits, with and without divided groups."""
    rng = np.random.default_rng(room)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(15)]
    fp = sorted(set(fp))
    table = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fp], "fp long")
    scratch = Scratch(spark, "test")
    linked = {(r.node, r.root) for r in components(simhash.links(table, scratch, room=room), scratch).collect()}
    own = {int(np.array([f], np.uint64).view(np.int64)[0]): i for i, f in enumerate(fp)}
    root = roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    mine = list(range(len(fp)))
    for a, b in linked:
        mine[own[a]] = own[b]
    same = lambda r: {frozenset(i for i in range(len(fp)) if r[i] == k) for k in set(r)}
    assert same(mine) == same(root)


def test_checksum_classes_meet_where_all_values_do():
    """A fingerprint reaches a class exactly if one of its flips leads there, whether classes are few or many."""
    rng = np.random.default_rng(2)
    base, flips = rng.integers(0, 1 << 63, 20, dtype=np.uint64), simhash.flips(54, 2)[2]
    for many in (2, 64, 256, 1 << 20):
        row, cls = simhash.reached(base, simhash.checksum(flips), many)
        got = {}
        for r, c in zip(row.tolist(), cls.tolist()):
            got.setdefault(r, set()).add(c)
        for r, b in enumerate(base):
            want = set((simhash.checksum(b ^ flips) & np.uint64(many - 1)).tolist())
            assert want <= got[r] and (many <= 64 or want == got[r])


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 64, 1000):
        x = vectors.unit(rng.standard_normal((40, dim)) * rng.choice([1e-200, 1.0, 1e200], (40, 1)), dim)
        q, step, off = vectors.sketched(x)
        left, right = vectors.allowed(q, step, off)
        assert (x @ x.T <= left @ right.T + float(off.max()) ** 2 + 1e-5).all()


def test_recall_of_many_vectors(spark, tmp_path):
    """Planted pairs just above the bound among 100,000 vectors: passes, not all pairs, must find them."""
    rng = np.random.default_rng(6)
    n, pairs, dim = 100_000, 1500, 32
    x = rng.standard_normal((n, dim)).astype(np.float32)
    u = x[:pairs] / np.linalg.norm(x[:pairs], axis=1)[:, None]
    side = rng.standard_normal((pairs, dim))
    side -= (side * u).sum(1)[:, None] * u
    side /= np.linalg.norm(side, axis=1)[:, None]
    x[pairs : 2 * pairs] = 0.951 * u + np.sqrt(1 - 0.951**2) * side
    import pyarrow as pa
    import pyarrow.parquet as pq

    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), f"{tmp_path}/v.parquet")
    got = vectors.near_duplicates(spark.read.parquet(f"{tmp_path}/v.parquet").repartition(8)).where(f"vec_id < {2 * pairs} and n_links > 0").count()
    assert got >= 0.99 * 2 * pairs


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_local_roots():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, n // 2))
        assert local_roots(n, a, b).tolist() == roots(n, zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("block", [4096, 64])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors.verified, "__defaults__", (block, 256, 512))
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 16))
    rows = []
    for k, b in enumerate(base):
        for _ in range(1 + 4 * (k % 3 == 0) + 200 * (k == 0)):
            rows.append((b + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.08])).astype(np.float32))
    data = [(5000 - i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [1.0, None] * 8, 0), (6, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (8, [float("inf")] + [1.0] * 15, 0), (None, data[0][1], 0), (5000, data[0][1], 2)]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect()), key=str)
    every = data + odd
    good = [i for i, r in enumerate(every) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    pairs = []
    for dim in {len(every[i][1]) for i in good}:
        own = [i for i in good if len(every[i][1]) == dim]
        x = np.array([every[i][1] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        pairs += [(own[i], own[j]) for i, j in zip(a, b)]
    n, root = Counter(i for p in pairs for i in p), roots(len(every), pairs)
    low = {}
    for i, r in enumerate(root):
        if every[i][0] is not None:
            low[r] = min(every[i][0], low.get(r, every[i][0]))
    want = sorted(((v[0], n[i], low.get(root[i]), v[0] is not None and v[0] == low.get(root[i])) for i, v in enumerate(every)), key=str)
    assert got == want
    assert vectors.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("signs", [5, None])
def test_links_of_a_dense_group_are_whole(spark, signs):
    """Members at a cosine of about 0.9 to each other, true partners far more than 32 rows apart in any order of signs."""
    rng = np.random.default_rng(4)
    mean, n = rng.standard_normal(64), 3000
    mean *= 8 / np.linalg.norm(mean)
    own = rng.standard_normal((n, 64)) / 3
    x = mean + own
    x[n // 2 :] = x[: n // 2] + rng.standard_normal((n // 2, 64)) * 0.25
    x = np.concatenate([x, rng.standard_normal((3000, 64))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    assert len(a) > n // 4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(table, signs=signs).collect()}
    links, root = Counter([*a.tolist(), *b.tolist()]), roots(len(x), list(zip(a.tolist(), b.tolist())))
    assert got == {i: (links[i], root[i]) for i in range(len(x))}


def test_repeated_passages_go_by_words(spark):
    import corpus_pipeline

    random.seed(12)
    say = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(1, 7))) for _ in range(n))
    long, tiny, short = say(51), " ".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51)), say(45)
    assert len(long) < 400 and len(tiny) == 101 and len(short) > 101
    rows = [(k, f"{say(20)}{k} {long} {k}{say(20)}{k} {tiny} {k}{say(20)}{k} {short} {k}{say(9)}") for k in (1, 2)]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, table, "").collect()}
    assert set(got) == {1, 2} and all(long not in t and tiny not in t and short in t for t in got.values())


def test_pipeline_drops_only_members_of_one_group(spark):
    import corpus_pipeline

    random.seed(3)
    say = lambda: " ".join("".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    a, b, c, d = say(), say(), say(), say()
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, d), (None, say()), (3, c)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (None, rows[6][1])], key=str)


def test_pipeline_drops_texts_alike_in_four_of_five_shingles(spark):
    import corpus_pipeline

    random.seed(21)
    say = lambda n: ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, alike, others = [], [], []
    for g in range(40):
        base = say(200)
        rows.append((10 * g, " ".join(base)))
        for k, edits in ((1, 2), (2, 40)):  # of 196 shingles an edit takes five
            own = list(base)
            for at in random.sample(range(200), edits):
                own[at] = "x" + own[at]
            rows.append((10 * g + k, " ".join(own)))
            share = simhash.shingles(rows[-1][1].encode()) & simhash.shingles(" ".join(base).encode())
            (alike if len(share) >= 0.8 * (2 * 196 - len(share)) else others).append(10 * g + k)
    table = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()}
    assert len(alike) == 40 and len(others) == 40
    assert left >= {10 * g for g in range(40)} | set(others)
    assert len(left & set(alike)) <= 8, "at least four of five near copies go"
    assert simhash.alike(b"a b", b"a b") and not simhash.alike(None, None) and not simhash.alike(b"a b c d e f", b"a b c d e g h")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "one two"), (None, "one two"), (5, "one  TWO")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd, "").collect()) == [1, 3, 4]
    assert corpus_pipeline.drop_near_copies(spark, odd.limit(0), "").count() == 0
