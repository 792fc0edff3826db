"""URL filter, chat formatting, HTML extraction, pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import chat, html, urls

LISTED = (*urls.RULES, ("a.b.example.org", "", "block"), ("b.example.org", "/x", "allow"))


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), h + p, v) for h, p, v in LISTED if fits(h, p)), default=None)
    if best:
        return host, path, best[1], best[2]
    return host, path, None, "block" if any(fits(h, p) for h, p in urls.BLOCKED) else "allow"


URLS = [
    None, "", "no scheme.org/", "http://", "https://EXAMPLE.org/es/1", "https://example.org/es", "https://www.example.org/en/123?x=/es/", "http://x.com/fr/", "http://x.com/de/#a", "http://xcom/fr/", "http://com/fr/",
    "http://org", "http://a.org?/", "http://q.a.b.example.org/x", "http://b.example.org/xy", "ftp://spam-farm.example.com/a", "http://www.spam-farm.example.net", "http://é.org/ñ", "http://a..org/", "http://" + "l." * 300 + "org/" + "p" * 5000, "http://x.com/fr/://y.org/",
]


def test_url_verdicts_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS * 2)] + [(None, URLS[4], "k")] * 2, "page_id long, url string, host string")
    rules, blocked = urls.table(spark, LISTED, ("host", "path", "verdict")), urls.table(spark, urls.BLOCKED, ("host", "path"))
    got = [(r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in urls.filtered(pages, rules, blocked).collect()]
    assert sorted(got, key=str) == sorted([*((i, judged(u)) for i, u in enumerate(URLS * 2)), *[(None, judged(URLS[4]))] * 2], key=str)
    assert urls.filtered(pages.limit(0), rules, blocked).count() == 0
    none = urls.filtered(pages, rules.limit(0), blocked.limit(0)).collect()
    assert len(none) == len(got) and all(r.rule is None and r.verdict == "allow" for r in none)


def test_a_list_of_a_million_keys_goes_through_the_cascade(spark):
    """Its levels have millions of bits, which no plan could hold as constants."""
    rules = spark.range(1_000_000).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".net")).alias("host"), F.lit("/a").alias("path"), F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("verdict"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.h"), F.col("id"), F.lit(".net/ab")).alias("url"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filtered(pages, rules, urls.table(spark, urls.BLOCKED, ("host", "path"))).collect()}
    assert got == {i: (f"h{i}.net/a", "block" if i // 2 % 3 == 0 else "allow") if i % 2 == 0 else (None, "allow") for i in range(2000)}


def test_cascade_is_exact_over_its_universe(spark):
    from tapeloom.llm.store import Scratch

    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    universe = spark.range(0, 40000).select(F.concat(F.lit("k"), F.col("id") % 20000).alias("key"))
    levels = urls.cascade(listed, universe, Scratch(spark, "test"), "t")
    assert len(levels) > 1
    got = {r.key for r in universe.where(urls.member(levels, F.col("key"))).distinct().collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 3)}


def test_a_talk_of_many_turns(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(2001)]
    done = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert [done.formatted[s.start : s.start + s.length] for s in done.loss_spans] == [f"t{k}" for k in range(1, 2001, 2)] and not done.valid


TALKS = [
    (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "b\\b\\c<s"), (1, 0, "user", "a<<SYS>>"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "<"), (2, 3, "user", "[" * 50),
    (3, 0, "tool", "<<END>>x"), (3, 1, None, "n"), (3, 1, None, "n"), (4, 0, "user<</ROLE>>", "é😀"), (5, None, "user", "x"), (5, 2, "assistant", "y" * 70000), (None, 0, "user", "q"), (6, 0, "user", "<<<s>>[[INST]]<</SYS>>\\"), (6, 1, "assistant", "</</s>s>"),
]


def test_chats_read_back_from_their_string(spark):
    table = spark.createDataFrame([(*t, 1) for t in TALKS], "conv_id long, turn long, role string, text string, n_turns int")
    done = chat.formatted(table)
    got = {r.conv_id: r for r in chat.read_back(done).collect()}
    by = {}
    for c, turn, role, text in TALKS:
        by.setdefault(c, []).append((turn if turn is not None else -10**9, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        lost = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (g.loss_chars, g.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest()), c
        assert g.valid == bool(re.fullmatch("s?(ua)+", "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "?") for _, r, _ in turns)))
    for r in done.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    bad = {r.conv_id: r.bad_turn for r in done.collect()}
    assert bad[3] == 0 and bad[1] is None and chat.read_back(chat.formatted(table.limit(0))).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><script>if (a<b) "</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><aside class="x">The side of the story is here to be seen by all of us</aside>
<div class="ad">Buy the thing of the year and be happy with it</div><div class="cookie-notice">We use the cookies</div>
<article><h1>The  title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>goes on.<p>Short.<!-- no --><form><input><button>Go</button></form>
<blockquote>Quoted &lt;b&gt; &copy</blockquote><section class="comments"><p>I am a reader and this is what I think of it</p></section></article>
<footer>&copy; 2020 the owner of it</footer></body></html>"""


def test_article_of_a_page():
    assert html.main_text(PAGE) == "The title & more\n\nFirst bold text goes on.\n\nShort.\n\nQuoted <b> ©"


def test_pages_without_an_article_part_go_by_density():
    long = "This is what the people of the town said when they were asked about it by the man who had come to see them. " * 3
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div><h2>Head</h2><p>{long}</p><p>Yes.</p><p>{long}</p></div><div><a href=3>Three</a></div>"
    assert html.main_text(page) == "\n\n".join(["Head", long.strip(), "Yes.", long.strip()])



RUSSIAN = "Жители города рассказали, что они видели этого человека утром на рынке, где он покупал хлеб и молоко для своей семьи. " * 3


def test_pages_of_other_languages_tables_and_short_paragraphs_are_kept():
    nav = "<nav><a href=1>One</a></nav><div><a href=2>Two</a></div>"
    assert html.main_text(f"{nav}<p>{RUSSIAN}</p><p>Да.</p><p>{RUSSIAN}</p>") == "\n\n".join([RUSSIAN.strip(), "Да.", RUSSIAN.strip()])
    names = ", ".join(f"Smith{k} Jones{k}" for k in range(30))
    said = "This is what the people of the town said when they were asked about it by the man who had come to see them."
    assert html.main_text(f"{nav}<p>{said}</p><p>{names}</p><p>{said}</p>") == "\n\n".join([said, names, said])
    assert html.main_text(f"{nav}<pre>{names}</pre>") == names
    assert html.main_text(f"{nav}<p>It rained.</p><p>We went home.</p>") == "It rained.\n\nWe went home."


def test_teasers_and_part_names():
    said = "This is what the people of the town said when they were asked about it by the man who had come to see them."
    page = f"<div><h1>Head</h1><p>{said}</p><p>Yes.</p><p>{said}</p></div><article><p>Read this.</p></article>"
    assert html.main_text(page).startswith("\n\n".join(["Head", said, "Yes.", said]))
    parts = f'<article><p>{said}</p><section id="discussion"><p>{said}</p></section><div class="social-history"><p>{said}</p></div><div class="comments-area x"><p>{said}</p></div></article>'
    assert html.main_text(parts) == "\n\n".join([said] * 3)


def test_class_names_that_only_hold_a_part_name_drop_nothing():
    said = "This is what the people of the town said when they were asked about it by the man who had come to see them."
    for name in ("no-sidebar", "hentry comments-open", "has-sidebar", "search-results", "content-share"):
        assert html.main_text(f'<div class="{name}"><p>{said}</p><p>{said}</p></div>') == f"{said}\n\n{said}", name


def test_planted_articles_among_planted_rubbish():
    """Pages made of parts whose place is known: all of the article comes out and nothing else."""
    import random

    rng = random.Random(8)
    stop = "the of and to in is that it was for on are as with his they at be this from".split()
    say = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rubbish = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{k}>{say(2)}</a>' for k in range(6))}</ul></nav>", lambda: f"<header><h1>{say(3)}</h1></header>", lambda: f"<footer><p>{say(20)}</p></footer>",
        lambda: f'<div class="sidebar"><p>{say(30)}</p></div>', lambda: f'<div id="cookie-banner">{say(15)}</div>', lambda: f"<form><label>{say(4)}</label><input></form>", lambda: f"<script>{say(9)}</script>",
        lambda: f'<section class="comments"><p>{say(40)}</p><p>{say(9)}</p></section>', lambda: f'<div class="ad">{say(12)}</div>', lambda: f"<p>{''.join(f'<a href=/{k}>{say(3)}</a> ' for k in range(7))}</p>",
    ]
    for depth in (0, 3, 3000):
        for _ in range(20):
            body = [say(rng.choice([4, 30, 60])) for _ in range(rng.randint(3, 8))] + [say(60)]
            article = "".join(f"<p>{t}" for t in body)
            kind = rng.choice(["article", "main", "div"])
            before, after = (" ".join(rng.choice(rubbish)() for _ in range(rng.randint(0, 4))) for _ in range(2))
            page = f"<html><body>{'<div>' * depth}{before}<{kind}>{article}</{kind}>{after}{'</div>' * depth}</body></html>"
            if kind != "div":
                assert html.main_text(page) == "\n\n".join(body)
            else:  # without a mark of the article, short paragraphs at its ends go with their neighbours
                assert set(html.main_text(page).split("\n\n")) <= set(body) and body[-1] in html.main_text(page)


def test_deep_nesting_takes_time_in_proportion():
    import time

    began = time.process_time()
    for page in ("<div>x" * 30000, "<td><div>" + "<b>" * 30000 + "<p>y</p>" * 30000, "<p><b>" * 30000 + "</i>" * 30000):
        html.main_text(page)
    assert time.process_time() - began < 30


def test_odd_pages(spark):
    cut = "<article><p>Whole words</p><p>cut &am"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", cut), (5, "u", cut + "<p cla"), (6, "u", "<article>" + "<p>w x</p>" * 20000), (7, "u", "a < b <3 <b>c</b>"), (7, "u", "<article><p title='a>b'>x</p>")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extracted(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")).collect())
    texts = {(i, t) for i, t, _ in got}
    assert {(1, ""), (2, ""), (4, "Whole words\n\ncut &am"), (5, "Whole words\n\ncut &am"), (7, "x")} <= texts and all(n == len(t) for _, t, n in got)
    assert len(next(t for i, t, _ in got if i == 6).split("\n\n")) == 20000
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import random

    import corpus_pipeline

    random.seed(6)
    say = lambda n, pool: " ".join(random.choice(pool) + random.choice("abcdefgh") * random.randint(0, 3) for _ in range(n))
    en, de = "the of and with this that from which there would about".split(), "der die und das nicht mit sich auf eine für durch".split()
    rows = [(i, say(60, en if i % 2 else de), "en" if i % 2 else "de", "s", 0) for i in range(40)]
    bench_text = say(30, en)
    shared = say(120, en)
    rows += [(50, "123 456", "en", "s", 7), (51, rows[0][1], "de", "s", 0), (52, "intro " + bench_text, "en", "s", 0), (53, say(40, en) + " " + shared + " " + say(30, en), "en", "s", 0), (54, say(50, en) + " " + shared, "en", "s", 0), (55, None, None, "s", None)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench_text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
            seen.append({r.doc_id: r.text for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - set(seen[0]) == {50, 55}
    assert set(seen[0]) - set(seen[1]) == {51}
    assert set(seen[1]) == set(seen[2]) and shared[5:-5] not in seen[2][53] and shared[5:-5] not in seen[2][54]
    assert set(seen[2]) - set(seen[3]) == {52}
    assert {r.doc_id for r in docs.collect()} == set(seen[3])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, docs.collect()))
    spark.createDataFrame([], docs.sparkSession.read.parquet(f"{tmp_path}/documents.parquet").schema).write.mode("overwrite").parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
