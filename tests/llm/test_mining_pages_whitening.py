"""Phrase mining, main text and whitening against brute force and over odd rows."""

import random
import re
import time
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import labelled_pages, maintext, phrases, queries, whitening
from loomstone.llm.dom import Page

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# op11 -------------------------------------------------------------------------------------------------------------
def brute_phrases(docs, least, first):
    count, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    much = {p: c for p, c in count.items() if c >= least}
    within = Counter()
    for (lang, w), c in much.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if 0 < j - i < len(w):
                    within[lang, w[i:j]] = max(within[lang, w[i:j]], c)
    out = []
    for (lang, w), a in much.items():
        if len(w) < 2 or 100 * within[lang, w] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]], n[lang]))
    rows = []
    for lang in n:
        own = sorted(x for x in out if x[0] == lang)[:first]
        rows += [(lang, i, p.decode(), -a, left, right, m, -s) for i, (_, s, a, p, left, right, m) in enumerate(own, 1)]
    return sorted(rows)


def phrase_corpus(n=300, seed=2):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "C", "dé", "e" * 9, "f" * 70, "\x00g", "h-i", "日本"]
    return [(i if i % 7 else None, None if i % 31 == 0 else "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", "\r", ","]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("sample", [1, 4, 5000])
def test_phrases_are_those_of_brute_force(spark, sample):
    """Also where the sample is empty, so that every frequent phrase is a failure of the border."""
    docs = phrase_corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("code", F.lit(1)).withColumn("n", F.lit("x"))
    got = phrases.mine(table, least=12, first=40, sample=sample)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, 12, 40)
    passes = phrases.frequent(phrases.prepared(table), least=12, sample=sample)[1]
    assert passes == 1 if sample == 1 else passes > 1


def test_phrases_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.mine(none).count() == 0
    odd = [(1, None, None), (2, "", "en"), (None, " \t\n.", "en"), (3, "one word. " * 120, "en"), (3, "one word. " * 120, "en"), (4, "x " * 3000, None)]
    assert sorted(map(tuple, phrases.mine(spark.createDataFrame(odd, "doc_id long, text string, lang string")).collect())) == brute_phrases(odd, 100, 2000)


def test_few_proposal_bits_change_no_row(spark, monkeypatch):
    """Bit sets so full that most phrases pass as proposed."""
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300)) + " x y z", "en") for i in range(60)]
    got = phrases.mine(spark.createDataFrame(docs, "doc_id long, text string, lang string"), least=3, first=500)
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs, 3, 500)


def test_counts_past_64_bits_stay_exact(spark):
    """The score's products pass 64 bits: 3,000,000,000 * 9,000,000,000,000 * 1000."""
    row = spark.sql("SELECT 3000000000 AS a, 9000000000000 AS n, 3000000001 AS l, 2999999999 AS r")
    lr = F.col("l").cast("decimal(16,0)") * F.col("r").cast("decimal(16,0)")
    value = row.withColumn("s", F.expr("1000 * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))").cast("decimal(38,0)")).withColumn("lr", lr.cast("decimal(38,0)")).selectExpr("s div lr").first()[0]
    assert value == 1000 * 3000000000 * 9000000000000 // (3000000001 * 2999999999)


def test_phrases_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    want = con.sql(queries.ORACLES["op11_phrases"]).fetchall()
    assert sorted(map(tuple, queries.op11_phrases(spark, SMALL).collect())) == sorted(want) and want


# op12 -------------------------------------------------------------------------------------------------------------
def by_hand(html):
    """Main text of the given pages, whose article is one element without other parts."""
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    blocks = (" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op12_main_text(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.url, r.n_chars) == (by_hand(pages[r.page_id].html), pages[r.page_id].url, len(r.text))


def test_main_text_of_pages_held_out():
    """Layouts of pages that were not learned from."""
    model = maintext.learned()
    held = [Page(labelled_pages.page(i)) for i in range(10**6, 10**6 + 300)]
    f = maintext.forest(held, maintext.Words(model.known))
    right = (maintext.marginals(f, model.weights, model.edges)[0] >= 0.5) == f.label
    assert right[f.leaves].mean() > 0.98


def test_parts_around_an_article_go():
    html = """<html><head><title>t</title><style>p{}</style></head><body class="home"><header class="site-header"><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav></header>
    <div class="cookie-notice"><p>We use cookies.</p><button>Yes</button></div><div id="main"><article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text, see <a href=/x>this</a>.
    <p>Second<br>line.</p><div class="ad">Buy now.</div><ul><li>one thing<li>other thing</ul><script>var x = "<p>no</p>";</script><p>Last one.</p></article>
    <section id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this.</p></div></section></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Some other story</a></ul></aside>
    <form class="newsletter"><label>Mail</label><input><p>Subscribe to our letter.</p></form><footer><p>&copy; 2020 Site</p></footer></body></html>"""
    got = maintext.main_texts([html], maintext.learned(), maintext.Words(maintext.learned().known))[0]
    assert got == "Title & more\nFirst bold text, see this.\nSecond line.\none thing\nother thing\nLast one."


def brute_marginals(parent, potential, pair):
    n = len(parent)
    weight = {}
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        weight[code] = np.exp(sum(potential[i] * y[i] for i in range(n)) + sum(pair[i][y[parent[i]]][y[i]] for i in range(1, n)))
    total = sum(weight.values())
    return [sum(w for c, w in weight.items() if c >> i & 1) / total for i in range(n)], np.log(total)


def test_messages_give_the_marginals_of_brute_force():
    rng = np.random.default_rng(3)
    f = maintext.forest([Page("<div><p>a<p>b</div><ul><li>c</ul>"), Page("<p>x</p>y")], maintext.Words())
    weights, edges = rng.normal(size=f.feature.max() + 1), rng.normal(size=(maintext.EDGES, 2, 2)) * 2
    chance, joint, top = maintext.marginals(f, weights, edges)
    potential = np.bincount(f.node, weights[f.feature], len(f.parent))
    for page in (0, 1):
        own = np.flatnonzero(f.page == page)
        want, total = brute_marginals([int(p) - own[0] for p in f.parent[own]], potential[own], edges[f.edge[own]])
        assert np.allclose(chance[own], want) and np.isclose(top[own[0]], total)
        assert np.allclose(joint[own[1:], :, 1].sum(1), chance[own[1:]])


@pytest.mark.parametrize("unit", ["<b>x", '<a x=">', "<a ", "<p><div>", "<", "</x>", "<li>x", '<p a="b>x', "<table><tr><td>x", "<b><p>y</p>", "<!", "<x y='\"", "<a =   "])
def test_reading_pages_takes_linear_time(unit):
    began = time.perf_counter()
    Page(unit * (200_000 // len(unit)))
    assert time.perf_counter() - began < 3


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "plain text, no tags"), (2, "u", "plain text, no tags"), (3, "u", "<p>a < b & c &lt;d&gt; <"), (4, "u", "<article><p>" + "word " * 300_000 + "</article>"), (5, "u", "<nav><a href=/>x</a></nav>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("z")).withColumn("n_chars", F.lit(None))
    got = maintext.extract(table).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[3].text in ("", "a < b & c <d> <")
    assert by[1].text == by[None].text == by[5].text == "" and by[4].n_chars == 5 * 300_000 - 1
    assert maintext.extract(table.where("false")).count() == 0


# op13 -------------------------------------------------------------------------------------------------------------
def brute_whitened(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    y = x - sums / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    return deviation, y @ basis[:, ::-1], values[::-1]


def held_against(got, vectors, components):
    deviation, turned, values = brute_whitened([v for _, v in vectors])
    want = {k: i for i, (k, _) in enumerate(vectors)}
    signs = {}
    assert len(got) == components * len(vectors)
    for r in got:
        i, c = want[r.vec_id], r.component - 1
        value = turned[i, c] / np.sqrt(values[c])
        sign = signs.setdefault(c, np.sign(value * r.whitened) if abs(value) > 1e-3 else None) or 1
        assert abs(r.whitened * sign - value) < 1e-8 or signs.pop(c) is None
        assert r.n == len(vectors) and int(r.deviation) == deviation[i] and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_whitened_rows_are_those_of_brute_force(spark, block):
    rng = np.random.default_rng(block)
    data = rng.normal(size=(120, 12)) * np.linspace(0.1, 3, 12)
    vectors = [(i, [float(x) for x in r]) for i, r in enumerate(data)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(9)
    held_against(whitening.whiten(table, block=block).collect(), [(i, np.float32(v)) for i, v in vectors], 8)


def test_whitening_of_the_given_vectors(spark):
    got = queries.op13_whitening(spark, TINY).collect()
    rows = spark.read.parquet(f"{TINY}/embeddings.parquet").collect()
    held_against(got, [(r.vec_id, r.embedding) for r in rows], 8)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, component string, n int"
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]
    good = [(6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-3.0, 5.0]), (9, [0.5, 0.25])]
    table = lambda rows: spark.createDataFrame([(*r, "c", 1) for r in rows], schema)
    held_against(whitening.whiten(table(bad + good)).collect(), good, 2)
    assert whitening.whiten(table(bad)).count() == 0 and whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table(good[:1])).count() == 0 and whitening.whiten(table(good[:2])).count() == 0
    line = [(i, [float(i), 2.0 * i]) for i in range(10)]
    assert {r.component for r in whitening.whiten(table(line)).collect()} == {1}
    keyless = whitening.whiten(table([(None, v) for _, v in good] + [(None, good[0][1])])).collect()
    assert len(keyless) == 10 and all(r.vec_id is None for r in keyless)
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(table([(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviations_past_64_bits_stay_exact(spark):
    vectors = [(i, [float((-1) ** i * (i + 1) * 2**24), float(i)]) for i in range(300)]
    got = whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), components=1).collect()
    deviation, _, _ = brute_whitened([v for _, v in vectors])
    assert max(deviation) > 2**64 and [int(r.deviation) for r in sorted(got, key=lambda r: r.vec_id)] == deviation


def test_spectra_after_updates_and_merges():
    rng = np.random.default_rng(1)
    for make in (lambda n: rng.integers(-900, 900, (n, 20)), lambda n: np.repeat(rng.integers(-5, 5, (n, 4)), 5, 1), lambda n: np.ones((n, 20), np.int64)):
        parts = [make(int(n)) for n in (40, 1, 300)]
        whole = whitening.Spectrum.empty(20)
        for rows in parts:
            own = whitening.Spectrum.empty(20)
            own.add(rows)
            whole.merge(own)
        rows = np.concatenate(parts)
        want = (rows - rows.mean(0)).T @ (rows - rows.mean(0))
        size = max(1.0, np.abs(want).max())
        assert np.abs(whole.vectors * whole.values @ whole.vectors.T - want).max() < 1e-11 * size and np.abs(whole.vectors.T @ whole.vectors - np.eye(20)).max() < 1e-12
