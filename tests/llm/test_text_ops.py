"""License scan, packing, language ID, decontamination: against brute force, and on rows that are odd."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, language, licences, packing
from tapeloom.llm.tokens import default_path, word_ids
from tapeloom.llm.words import words

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "x"), (4, "x"), (None, "MIT License"), (6, "Ä" * 20000)]
CLASH = "doc_id long, text string, n_words int, score string, fp long, labels string"


def docs(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(*r, 7, "s", 9, "l") for r in rows], CLASH)
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_are_those_of_the_contract():
    for t in ("Ab-c 1ÉÉ_x\x7f9", "", "ß²­ a b", "A" * 5):
        assert [w.decode() for w in words(t.encode())] == brute_words(t)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licence_places_match_brute_force(spark):
    random.seed(2)
    pool = "gnu general public license apache mit cc by nc lesser foo The bar".split()
    rows = [(i, " ".join(random.choices(pool, k=random.randint(0, 60)))) for i in range(150)] + ODD
    got = licences.scanned(docs(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        w, starts, labels = brute_words(t), [], set()
        for p, name in PHRASES.items():
            p = p.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += found
            labels |= {name} if found else set()
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licence_body_needs_its_key_phrase_but_not_every_word(spark):
    body = "Permission is hereby granted, free of charge, to any human obtaining a copy of this program and associated documentation files"
    off = body.replace("hereby granted, free of charge", "gladly given away for nothing").replace("obtaining a copy", "getting one")
    got = {r.doc_id: r for r in licences.scanned(docs(spark, [(1, body), (2, off)])).collect()}
    assert "mit" in got[1].labels.split(",") and got[1].base_labels == "" and 0.7 <= got[1].score < 1
    assert got[2].labels == ""


def test_licences_of_no_rows(spark):
    assert licences.scanned(docs(spark, [])).count() == 0


def test_token_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(default_path()), word_ids(default_path())
    random.seed(3)
    letters = list("aAbB'sS tTrRe _-.,!1203éßÉİΣσ²ª́中文  \n\t\x1c×\U0001f600<|>&%llmdve")
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> it's", "can't WE'LL o'clock"]
    for t in texts:
        assert own.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing_keeps_every_token_in_few_sequences(spark):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = table.union(docs(spark, ODD)).withColumn("piece", F.lit("clash"))
    got = packing.pack_documents(table, size=1024).collect()
    whole, want = Tokenizer.from_file(default_path()), []
    for r in table.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 1024):
            p = np.array(ids[k : k + 1024], "<u4")
            want.append((r.doc_id, k // 1024, k, len(p), zlib.crc32(p.tobytes())))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    bound = -(-sum(w[3] for w in want) // 1024)
    assert len(bins) <= 1.02 * bound + 1


def test_residual_rounds_merge_what_tasks_leave(spark):
    """Many tasks with a few items each: the rounds after the first one must bring them together."""
    from tapeloom.llm.store import Scratch

    random.seed(5)
    rows = [(i, 0, 0, random.randint(1, 250), 0) for i in range(1200)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(64)
    got = packing.pack(pieces, Scratch(spark, "test"), size=1000).collect()
    assert len(got) == 1200
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1000 and len(fill) <= 1.06 * sum(r[3] for r in rows) / 1000 + 1


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit([60, 50, 40, 30, 20], 100)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit([], 10) == []


def test_packed_sequences_round_trip(spark):
    table = docs(spark, [(1, "one two three"), (2, "four"), (3, None)])
    placed = packing.pack_documents(table, size=8)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(table, placed, size=8).collect()}
    own = word_ids(default_path())
    for r in placed.collect():
        ids = np.frombuffer(own.ids({1: "one two three", 2: "four", 3: None}[r.doc_id]), "<u4").tolist() + [1]
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_language_of_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of with " * 9, "en"), ("der die und das " * 9, "de")] * 20)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 ... !", "de"), (None, "und der", None), (104, "die " * 50000, "de")]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[104].lang_pred == "de" and got[None].held_out is False
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identified(none).first().lang_pred == "und"
    assert language.identified(none.limit(0)).count() == 0


def brute_hits(text, items, window=13):
    w, hit, found = brute_words(text), set(), set()
    for item, words_ in items:
        n = min(window, len(words_))
        wins = {tuple(words_[k : k + n]) for k in range(len(words_) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [decontaminate.MOST_WORDS, 40])
def test_contamination_matches_brute_force(spark, monkeypatch, most):
    """With one automaton of all items, and in several passes."""
    monkeypatch.setattr(decontaminate, "MOST_WORDS", most)
    random.seed(most)
    pool = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(random.choices(pool, k=random.choice([3, 5, 14, 20])))) for i in range(12)] + [(90, None), (91, "!!"), (3, "w0 w1 w2")]
    rows = [(i, " ".join(random.choices(pool, k=random.randint(0, 80)))) for i in range(60)]
    rows += [(100 + i, "X " * 30 + (t or "") + " y" * 200) for i, t in items] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(docs(spark, rows, clash=True), bench).collect()
    known = [(i, brute_words(t)) for i, t in items]
    want = [(i, *brute_hits(t, known)) for i, t in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_cleaned_drops_or_cuts(spark):
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"start {item}. end"), (2, "clean text"), (3, None), (4, item + " z" * 2000)]
    kept = {r.doc_id: r.text for r in decontaminate.cleaned(docs(spark, rows), bench).collect()}
    assert kept == {2: "clean text", 3: None, 4: rows[3][1]}
    cut = {r.doc_id: r.text for r in decontaminate.cleaned(docs(spark, rows), bench, cut_spans=True).collect()}
    assert cut[1] == "start . end" and cut[4] == rows[3][1] and len(cut) == 4
    empty = decontaminate.judged(docs(spark, rows), bench.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in empty)


def test_items_without_an_id_are_hit_but_not_named(spark):
    long, short = " ".join(f"w{k}" for k in range(15)), "one two three"
    bench = spark.createDataFrame([(None, long), (None, short), (7, "four five six")], "item_id long, text string")
    table = spark.createDataFrame([(1, f"so {long} so"), (2, f"{short} and"), (3, "x four five six"), (4, "none of it")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items) for r in decontaminate.judged(table, bench).collect()}
    assert got == {1: (15, 0, []), 2: (3, 0, []), 3: (3, 1, ["7"]), 4: (0, 0, [])}
    assert [r.doc_id for r in decontaminate.cleaned(table, bench).collect()] == [4]


def test_lengths_that_cluster_by_partition_are_mixed(spark):
    from tapeloom.llm.store import Scratch

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    make = lambda at, n: spark.createDataFrame([(at + k, 0, 0, n, at + k) for k in range(400)], kind).coalesce(1)
    placed = packing.pack(make(0, 2100).union(make(1000, 1900)), Scratch(spark, "cluster"))
    assert placed.count() == 800 and placed.select("sequence_id").distinct().count() <= 440
