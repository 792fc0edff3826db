"""BPE encoding, centroid clustering, source divergence: against the library, brute force and DuckDB, and on rows that are odd."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tapeloom.llm import bpe, clusters, divergence, queries

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    order = lambda d: d[columns].astype(str).sort_values(columns).values.tolist()
    assert order(got) == order(want)


# BPE --------------------------------------------------------------------------------------------------------------------


def exact(text):
    return bpe.coder(bpe.default_path()).tokenizer.encode(text, add_special_tokens=False).ids


def test_trees_of_pieces_equal_the_whole(monkeypatch):
    random.seed(5)
    c = bpe.coder(bpe.default_path())
    pools = ["abcdefg", "ab", " a b", "'sre!. 12", "日本語テキスト", "é ü ", "\n\t  a", [" the", "'re", "<|endoftext|>", "hello"], " 　 a", "a"]
    for k in range(600):
        some = random.choice(pools)
        text = "".join(random.choice(some if random.random() < 0.8 else random.choice(pools)) for _ in range(random.choice([3, 30, 300])))
        monkeypatch.setattr(bpe, "RUN", random.choice([0, 16, 2048]))
        monkeypatch.setattr(bpe, "WINDOW", random.choice([1, 2, 8]))
        pieces = c.cut(text, random.choice([1, 3, 17, 64]))
        assert "".join(pieces) == text
        ids = c.tree([np.array(i, np.int32) for i in c.encode(pieces)])
        assert ids.tolist() == exact(text), repr(text)
        assert c.bytes_of(ids).decode() == text


def test_a_long_run_without_places_is_joined_by_windows_of_tokens(monkeypatch):
    random.seed(6)
    c = bpe.coder(bpe.default_path())
    text = "".join(random.choice("etaoinshr") for _ in range(60_000))
    want, made, merged = exact(text), [], c.merged
    pieces = [np.array(i, np.int32) for i in c.encode(c.cut(text, 7000))]
    monkeypatch.setattr(c, "merged", lambda raw: made.append(len(raw)) or merged(raw))
    assert c.tree(pieces).tolist() == want
    assert made and max(made) < 1000  # no window grows to a piece


def test_the_way_by_ranks_gives_the_ids_of_the_library():
    random.seed(11)
    c = bpe.coder(bpe.default_path())
    assert c.fast is not None
    every = [chr(i) for i in [*range(9, 14), *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    pools = [every, every[:5] + [" "], list("'sre tdlmv"), list("abc 12.,'\n "), ["<|endoftext|>", " ", "a", "'"]]
    texts = ["".join(random.choices(random.choice(pools), k=random.choice([1, 5, 60, 900]))) for _ in range(1500)] + [" " * 2000, "a" * 2000, "".join(every), ""]
    assert all(bpe.PLAIN.fullmatch(t) for t in texts) and not bpe.PLAIN.fullmatch("日") and not bpe.evenly_cut("x" * 1000) and not bpe.evenly_cut(" " * 1001)
    assert c.encode(texts) == [e.ids for e in c.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_token_is_its_own_encoding():
    c = bpe.coder(bpe.default_path())
    assert all([t.id for t in c.model.tokenize(k)] == [i] for k, i in c.tokenizer.get_vocab(with_added_tokens=False).items())


def test_encoded_and_decoded_on_odd_rows(spark):
    long = "word " * 90 + "x" * 400 + " " * 200 + "né<|endoftext|>" * 30
    texts = [None, "", " ", "Hello  world", "<|endoftext|>a<|endoftext|>", long, long, "日" * 500, "a\x00b c"]
    rows = [(i // 2, t, f"own {i}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `ids` string, `a.b` int")
    assert bpe.decoded(bpe.encoded(docs, size=100), text="a.b").columns == ["ids", "doc_id", "a.b"]
    got = bpe.decoded(bpe.encoded(docs, size=100)).collect()
    assert sorted((r["a.b"], list(r.ids), r.decoded) for r in got) == [(i, exact(t or ""), t or "") for i, t in enumerate(texts)]
    assert bpe.encoded(docs.limit(0)).count() == 0
    assert rows_of(bpe.encoded(docs.select("text"), size=50), "ids") == sorted(((exact(t or ""),) for t in texts), key=str)


def test_decoding_is_that_of_the_library(spark):
    random.seed(7)
    tokenizer = bpe.coder(bpe.default_path()).tokenizer
    lists = [[random.randrange(50257) for _ in range(random.randint(0, 40))] for _ in range(200)] + [[50256], [150, 151]]
    got = bpe.decoded(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, ids array<int>")).collect()
    assert {r.n: r.decoded for r in got} == {i: tokenizer.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 64, 99_999, -5])], "n int, ids array<int>")
    assert rows_of(bpe.decoded(odd), "n", "decoded") == [(1, None), (2, ""), (3, "a")]


def test_bpe_query_whole(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_bpe_round_trip"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, text = exact(r.text or ""), r.text or ""
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got.pop(r.doc_id) == (len(ids), digest(",".join(map(str, ids))), digest(text))
    assert not got


# clusters ---------------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=rank)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else m for n, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def test_clusters_equal_plain_rounds_with_ties_and_odd_rows(spark):
    random.seed(8)
    for trial in range(3):
        grid = [[random.randint(-2, 2) / 1024 for _ in range(3)] for _ in range(60)]  # many ties and equal vectors
        rows = [(i, v) for i, v in enumerate(grid)] + [(5, grid[0]), (None, grid[1]), (7, grid[2])]
        odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [0.0, None, 1.0]), (104, [0.0, math.nan, 1.0]), (105, [0.0, math.inf, 1.0]), (106, [-0.5, -1000.0, 3.0])]
        df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, `v.x` string").repartition(3)
        got = clusters.clustered(df, k=5 + trial, rounds=4, dims=3)
        want, c = lloyd(rows + odd, 5 + trial, 4, 3)
        assert rows_of(got, "vec_id", "cluster", "distance") == sorted(want, key=str)
        total = Counter()
        for _, n, d in want:
            total[n] += d
        for r in got.collect():
            assert r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values())
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [float(2**20)] + [0.0] * 63)], schema)
    assert rows_of(clusters.clustered(few), "vec_id", "cluster", "distance") == [(1, 0, 0), (2, 0, 0)]
    assert clusters.clustered(few.limit(0)).collect() == [] and clusters.clustered(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_sort_means_stops_early_and_only_strictly_beyond():
    c = np.array([[0], [4], [100], [1000]], np.int64)
    order, reach = clusters.orders(c)
    assert order[0] == [1, 2, 3] and order[3] == [2, 1, 0]
    found, d = clusters.nearest(np.array([[2], [2], [51], [1]], np.int64), np.array([1, 0, 0, 0]), c, order, reach)
    assert found.tolist() == [0, 0, 1, 0] and d.tolist() == [4, 4, 2209, 1]


# divergence -------------------------------------------------------------------------------------------------------------


def brute_audit(rows, least, most):
    import re

    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        spread = Counter(t for _, w in own for t in set(w))
        kept = sorted((t for t in spread if spread[t] >= least), key=str.encode)
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if spread[t] >= least)
        counts_of_all = sum(counts.values(), Counter())

        def p(c):
            n, v = sum(c.values()), len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        q, of = p(counts_of_all), {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(b, sum(f(of[s][t], of[b][t]) for t in kept)) for b in counts if b != s]
            terms = [(t, f(of[s][t], q[t])) for t in kept if counts[s][t] and of[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < most]
    return sorted(out, key=str)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    random.seed(9)
    words = ["alpha", "Beta", "gämma", "日本", "x", "İ", "delta", "Zeta", "a-b", "q1q", "\U0001f600", "ﬀ"]
    rows = []
    for i in range(260):
        text = " ".join(random.choices(words[: random.choice([3, 12])], k=random.choice([0, 1, 5, 40])))
        rows.append((text, random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "é", None, "s10"])))
    rows += [rows[0]] * 5 + [(None, "en", "lone"), ("", "xx", "one"), (None, "xx", "two"), ("only here", "yy", "solo"), ("alpha " * 400, "en", "s1"), ("日" * 900, "en", "s2")]
    if small:
        monkeypatch.setattr(divergence, "ENTRIES", 2)  # many blocks a language
    df = spark.createDataFrame([(*r, 3, "y") for r in rows], "text string, lang string, source string, n int, `term.x` string").repartition(3)
    assert rows_of(divergence.audited(df, least=4, most=3), *AUDIT) == brute_audit(rows, 4, 3)


def test_counts_that_are_passed_on_early_add_up(monkeypatch):
    random.seed(12)
    for name, n in (("BLOCK", 16), ("TERMS", 3), ("COUNTS", 5)):
        monkeypatch.setattr(divergence, name, n)
    counts, want, docs, rows = divergence.Counts(), Counter(), Counter(), []
    for _ in range(80):
        text = " ".join(random.choices(["alpha", "Beta", "gämma", "日本", "x" * 40, "-", "1"], k=random.choice([0, 3, 60])))
        lang, source = random.choice("ab"), random.choice("st")
        divergence._long(counts, counts.group(lang, source), np.frombuffer(text.encode(), np.uint8))
        found = Counter(t.lower() for t in text.split() if t not in "-1")
        want.update({(lang, source, t): k for t, k in found.items()})
        docs.update((lang, source, t) for t in found)
        docs[lang, source, None] += 1
        if counts.full:
            rows += counts.rows().to_pylist()
            assert not counts.full
    rows += counts.rows().to_pylist()
    got, spread = Counter(), Counter()
    for r in rows:
        got[r["lang"], r["source"], r["term"]] += r["n"]
        spread[r["lang"], r["source"], r["term"]] += r["docs"]
    assert len(rows) > len(spread) and +got == want and +spread == docs


def test_audit_of_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_slices_of_one_hash_are_told_apart_by_their_bytes():
    text = np.frombuffer(b"ab cd AB abc cd", np.uint8)
    low, first, after = divergence.slices(text, np.array([0, 9]))
    for digest in (lambda b: 1, lambda b: len(b)):
        terms, which = divergence.grouped(low, first, after, digest)
        assert [terms[i] for i in which] == [b"ab", b"cd", b"ab", b"abc", b"cd"] and len(terms) == 3


def test_shares_and_divergences_are_exact_for_large_counts():
    random.seed(10)
    for total in (7, 10**6 + 3, 2 * 10**14):
        n = [random.randint(1, total) for _ in range(200)]
        assert divergence.share(np.array(n, np.int64), total).tolist() == [1 + 10**9 * x // total for x in n]
    a, b = np.array([1, 10**9 + 1, 5]), np.array([10**9 + 1, 1, 5])
    assert divergence.apart(a, b).tolist() == [(int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(a, b)]


def test_pipeline_stages_take_columns_of_any_name(spark):
    import corpus_pipeline

    random.seed(13)
    say = lambda: " ".join(random.choices("the of and to in is that for on with as was at by it from or an be this".split(), k=90))
    columns = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `x y` string, cut string, own string, fp long"
    rows = [(i, t, "en", "s", len(t), i, "x", "c", "o", 5) for i, t in enumerate([say() for _ in range(6)])]
    docs = spark.createDataFrame([*rows, (50, rows[0][1], *rows[0][2:])], columns)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {r["a.b"] for r in got.collect()} >= {1, 2, 3}, name
