"""HTML extraction, Kneser-Ney, quality kNN, and the queries and pipeline as a whole."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import html_blocks, html_extract, kneser_ney, language_id, mixing, quality_knn, queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c&amp;d<br>e<p>f") == ["a bc&d e", "f"]
    assert texts("<!-- x --><head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>';</script>y") == ["xy"]
    assert texts("a < b &lt; c <3 d") == ["a < b < c <3 d"] and texts("x<a href='>'>y</a>") == ["xy"]
    assert texts(None) == texts("") == texts("<p></p> ") == [] and texts("<p>cut <b") == ["cut"] and texts("<p>&copy; &#233;&nbsp;z &unknown;") == ["© é z &unknown;"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("<div hidden>no</div><div style='display:none'>no</div>yes<textarea>no</textarea><p class='hidden x'>seen") == ["yes", "seen"]
    b = html_blocks.blocks('<div class="siteNav main-menu"><a href="x">go</a> on</div>')[0]
    assert b.path == html_blocks.extended(html_blocks.ROOT, ["div", ".site", ".nav", ".main", ".menu"]) and b.path.length == 5 and 0.3 < b.link < 0.6
    assert len(texts("<div>" * 3000 + "x")) == 1
    # What isn't seen, and what the standard doesn't name, leaves the paragraph around it whole.
    assert texts("<p>before <svg><path/><title>T</title><text>LABEL</text></svg> after</p>") == ["before after"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>") == ["so x=2 then"]
    assert texts("<p>one <my-el>two</my-el> three</p><p>four") == ["one two three", "four"]
    assert texts("<p>a <button><div>no</div></button>b</p><svg><g>no<p>c</p>") == ["a b", "c"]
    assert texts('<p class="x" title="a > b" data-x=\'<p>\'>in</p><a href=x"y>z</a>') == ["in", "z"]
    assert texts("<p>a<!-->b<!--->c<!-- d --!>e<!-- f") == ["abce"] and texts('<p>a<a href="cut') == ["a"]


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<div>x", "<p>x", "<li>x", "<foo>x</bar>", "<foo><li>", "</p><b>", "<!--", "<svg><p>", "<table><td>", "<x y='", "<script>", "< ", "&lt", "<p><foo>"])
def test_broken_pages_take_time_in_proportion(part):
    import time

    page = part * ((1 << 20) // len(part))
    began = time.thread_time()
    html_blocks.blocks(page)
    assert time.thread_time() - began < 60  # some seconds at most; anything quadratic takes hours


@pytest.fixture(scope="module")
def labeller():
    return html_extract.trained(html_extract.Settings())


def test_labeller_on_new_pages(labeller):
    pages, labels = html_extract.labelled_pages(150, 1234)
    found = labeller.label(pages)
    wrong = sum((a != (b > 0)).sum() for a, b in zip(found, labels, strict=True))
    assert wrong / sum(map(len, labels)) < 0.02


def test_gradient():
    """The analytic gradient of a small network against differences."""
    x, n = html_extract.pad([np.random.default_rng(i).standard_normal((t, html_extract.PATH + html_extract.WORDS + html_extract.NUMBERS)).astype(np.float32) for i, t in enumerate((3, 5))])
    m = html_extract.Labeller(3, 1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    on = np.arange(5)[None, :] < n[:, None]
    loss = lambda: float((np.where(on, m.logits(x, n), 0) ** 2).sum() / 2)
    z, both, f, b = m.logits(x, n, keep=True)
    d = np.where(on, z, 0)[:, :, None] * m.w["o"]
    grad = {k: np.zeros_like(v) for k, v in m.w.items()}
    m._back(d[:, :, :3], *f, "f", grad)
    m._back(m._flip(d[:, :, 3:], n), *b, "b", grad)
    for k, at in (("hf", (1, 4)), ("xb", (2, 7)), ("bf", (3,)), ("hb", (0, 9))):
        old, e = m.w[k][at], 1e-2
        m.w[k][at] = old + e
        up = loss()
        m.w[k][at] = old - e
        down = loss()
        m.w[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-3)


def test_labels_in_plain_steps(labeller):
    """The padded batches of both directions against one page and one step at a time."""
    pages, _ = html_extract.labelled_pages(6, 77)
    x, w, h = html_extract.features(pages), labeller.w, labeller.h
    sig = lambda v: 1 / (1 + np.exp(-v))
    at = 0
    for page, got in zip(pages, labeller.label(pages), strict=True):
        rows = x[at : at + len(page)].astype(np.float64)
        at += len(page)
        states = {}
        for k, order in (("f", range(len(rows))), ("b", range(len(rows) - 1, -1, -1))):
            s, c, states[k] = np.zeros(h), np.zeros(h), {}
            for i in order:
                a = rows[i] @ w[f"x{k}"] + w[f"b{k}"] + s @ w[f"h{k}"]
                c = sig(a[h : 2 * h]) * c + sig(a[:h]) * np.tanh(a[3 * h :])
                s = states[k][i] = sig(a[2 * h : 3 * h]) * np.tanh(c)
        z = np.array([np.concatenate([states["f"][i], states["b"][i]]) @ w["o"] + w["c"][0] for i in range(len(rows))])
        assert all(g == (v > 0) for g, v in zip(got, z, strict=True) if abs(v) > 1e-3)


def test_extract(spark):
    p = "Some words of the article that are long enough to be read as prose."
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>Title here</h1><p>{p}</p><p>{p}</article><div class="ad">Buy now</div><section class="comments"><h3>Comments</h3><div class="comment"><p>Great post, thanks</p></div></section><footer>&copy; site</footer></body></html>'
    df = spark.createDataFrame([(1, page, 5), (2, None, 5), (3, "", 5), (1, page, 5), (4, "<p>" + "x " * 200_000, 5)], "page_id long, html string, n_chars int")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[1]["text"] == f"Title here {p} {p}" and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == "" and got[3]["n_chars"] == 0
    assert html_extract.extract(df).count() == 5 and html_extract.extract(df.limit(0)).count() == 0


def plain_kneser_ney(train, end="</s>"):
    big, cont, follow = Counter(), defaultdict(set), defaultdict(Counter)
    for t in train:
        w = ["<s>", *t, end]
        for a, b in zip(w, w[1:], strict=False):
            big[a, b] += 1
    for (a, b), n in big.items():
        cont[b].add(a)
        follow[a][b] = n
    count = lambda values: Counter(min(v, 3) if v != 4 else 3 for v in values)
    exactly = lambda values, k: sum(v == k for v in values)
    d = [0, *kneser_ney.discounts(*(exactly(big.values(), k) for k in (1, 2, 3, 4)))]
    types = {b: len(a) for b, a in cont.items()}
    e = [0, *kneser_ney.discounts(*(exactly(types.values(), k) for k in (1, 2, 3, 4)))]
    total, v = sum(types.values()), len(types)
    c = count(types.values())
    unknown = sum(e[k] * c[k] for k in (1, 2, 3)) / total / (v + 1)

    def p(a, b):
        low = unknown + (max(types[b] - e[min(types[b], 3)], 0) / total if b in types else 0)
        if a not in follow:
            return low
        n = sum(follow[a].values())
        c = count(follow[a].values())
        x = follow[a].get(b, 0)
        return max(x - d[min(x, 3)], 0) / n + sum(d[k] * c[k] for k in (1, 2, 3)) / n * low

    return p, v, types


@pytest.mark.parametrize(("shards", "one_level", "kept"), [(4, 512, 1024), (64, 2, 3)])
def test_kneser_ney(spark, monkeypatch, shards, one_level, kept):
    monkeypatch.setattr(kneser_ney, "FLUSH", 700)
    monkeypatch.setattr(kneser_ney, "ONE_LEVEL", one_level)
    monkeypatch.setattr(kneser_ney, "KEPT", kept)
    r = random.Random(2)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    train, i = [], 0
    while i < len(words):
        n = r.randint(0, 12)
        train.append(words[i : i + n])
        i += n + 1
    train += [["hot", "pair"]] * 400 + [["hot"] + ["pair"] * 2000]
    test = [["w1", "w2", "nowhere", "W1"], [], ["nowhere", "nothing"], ["hot", "pair"], *train[:40]]
    p, v, types = plain_kneser_ney(train)
    assert sum(p("w1", b) for b in types) + p("w1", "?") == pytest.approx(1) and sum(p("?", b) for b in types) + p("?", "?") == pytest.approx(1)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(train)], SCHEMA).repartition(3)
    model = kneser_ney.fit(docs, shards=shards)
    assert (model.tokens, model.types) == (sum(len(t) + 1 for t in train), v)
    held = spark.createDataFrame([(k, "\t".join(t), 1) for k, t in enumerate(test)] + [(999, None, 1)], SCHEMA + ", score int")
    c = Counter(b for t in train for b in [*t, "</s>"])
    for x in kneser_ney.score(held, model).collect():
        t = [w.lower() for w in (test[x["doc_id"]] if x["doc_id"] < 999 else [])]
        pairs = list(zip(["<s>", *t], [*t, "</s>"], strict=True))
        assert x["score"] == pytest.approx(sum(np.log10(p(a, b)) for a, b in pairs), rel=1e-9)
        assert x["base_score"] == pytest.approx(sum(np.log10((c[b] + 0.5) / (model.tokens + 0.5 * (v + 1))) for _, b in pairs), rel=1e-9)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(pairs), sum(c[b] > 0 for _, b in pairs), model.tokens)
        assert x["perplexity"] == pytest.approx(10 ** (-x["score"] / len(pairs)))


def test_kneser_ney_without_training(spark):
    model = kneser_ney.fit(spark.createDataFrame([], SCHEMA), shards=2)
    r = kneser_ney.score(spark.createDataFrame([(1, "a b")], SCHEMA), model).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["score"] == r["base_score"] == 0


def test_quality_knn(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 9)))
    good = lambda: " ".join(word() for _ in range(r.randint(5, 80))).capitalize() + "."
    bad = lambda: " ".join(word() + r.choice(["***", "$$$"]) for _ in range(r.randint(5, 80)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(800)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "abc def"), (902, "z" * 300_000)], SCHEMA).withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(5, None)], "doc_id long, quality int")
    model = quality_knn.fit(df, labels)
    got = {x["doc_id"]: x for x in quality_knn.score(df, model).collect()}
    assert np.mean([got[i]["predicted"] == y for i, _, y in rows if i % 3 == 0]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values()) and len(got) == 804
    # Blocked products against plain cosines.
    z = quality_knn._unit(np.random.default_rng(1).standard_normal((3, model.axes.shape[1])))
    for row, s in zip(z, model.vote(z), strict=True):
        c = row @ model.vectors
        near = sorted(range(len(c)), key=lambda i: (-round(c[i], 9), i))[: model.settings.neighbours]
        w = np.maximum(c[near], 1e-6) ** model.settings.power
        assert s == pytest.approx((w * model.labels[near]).sum() / w.sum())
    # The whole way of a text in plain steps: its weights, the axes, all cosines, the vote.
    row = quality_knn.term_counts(np.frombuffer(b"abc DEF *** gh", np.uint8), model.settings.buckets)
    x = np.log1p(row) * model.idf
    z = (x / np.linalg.norm(x)) @ model.axes
    c = np.array([z @ v / np.linalg.norm(z) for v in model.vectors.T])
    near = sorted(range(len(c)), key=lambda i: (-round(c[i], 9), i))[: model.settings.neighbours]
    w = np.maximum(c[near], 1e-6) ** model.settings.power
    assert model.scores(quality_knn.pa.array(["abc DEF *** gh"]))[0] == pytest.approx((w * model.labels[near]).sum() / w.sum())
    none = quality_knn.fit(df, labels.limit(0))
    assert {x["score"] for x in quality_knn.score(df.limit(3), none).collect()} == {0.5}


def test_equal_cosines_go_to_the_earlier_rows():
    for m in (60, 350, 1000):
        c = np.full((2, m), 0.5)
        c[0, 7] = c[1, m - 1] = 0.9
        c[1, :40] = 0.1
        want = [[7, *[i for i in range(m) if i != 7][:24]], [m - 1, *([*range(40, m - 1), *range(40)][:24])]]
        assert quality_knn.nearest(c, 25).tolist() == want


@data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert got
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "labels"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        r = c.execute(queries.ORACLE_SQL[name])
        names = [x[0] for x in r.description]
        want = [tuple(x[names.index(n)] for n in sorted(names)) for x in r.fetchall()]
        assert sorted(names) == sorted(df.columns) and sorted(got, key=repr) == sorted(want, key=repr)


@data
def test_pipeline(spark):
    """Each stage against a plain reading of what it decides."""
    import corpus_pipeline as pipeline
    from test_pairs import plain_components, plain_mix
    from test_text_ops import plain_line_dedup

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, DIR)
        a, b = [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]
        if name != "mix":
            assert after.columns == columns and {r["doc_id"] for r in b} <= {r["doc_id"] for r in a}
        if name == "language_id":
            model = language_id.fit(before.select("doc_id", "text", "lang"))
            known = [(r["doc_id"], r["text"]) for r in a if any(map(str.isalpha, r["text"] or "")) and model.scores(r["text"])[1] >= 0.3]
            assert len(model.labels) == 4 and sorted((r["doc_id"], r["text"]) for r in b) == sorted(known) and len(b) >= 0.99 * len(a)
        elif name == "mix":
            t = mixing.Targets(budget=1.0)
            leaf = lambda r: (f"d{int(hashlib.md5((r['source'] or '(null)').encode()).hexdigest()[:8], 16) % 4}", r["lang"] or "(null)", r["source"] or "(null)")
            want = plain_mix([(r["doc_id"], len((r["text"] or "").encode().split()), leaf(r)) for r in a], t)
            assert sorted((r["doc_id"], r["epoch"]) for r in b) == sorted(want)
        elif name == "line_dedup":
            want = plain_line_dedup([(r["doc_id"], r["text"]) for r in a])
            assert sorted((r["doc_id"], r["text"]) for r in b) == sorted((i, t) for i, t, *_ in want) and all(r["n_chars"] == len(r["text"]) for r in b)
        elif name == "near_dedup":
            want = plain_components([(r["doc_id"], r["text"]) for r in a], 5, 80)
            assert {r["doc_id"] for r in b} == {i for i, c in want.items() if i == c}
        elif name == "decontaminate":
            bench = [x["text"] for x in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            flat = lambda t: " ".join(__import__("re").findall(r"[^\W_]+", t.lower()))
            gone = {r["doc_id"] for r in a if any(f" {flat(x)} " in f" {flat(r['text'])} " for x in bench)}
            assert gone.isdisjoint(r["doc_id"] for r in b) and len(a) - len(b) <= len(gone) + 2
        before = spark.createDataFrame(b, after.schema) if b else after
    assert pipeline.run(spark, DIR).count() == len(b)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, repeated rows, extra columns with the operators' own names; then an empty table."""
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    line = "a line that is long enough to be shared by many documents"
    rows = [(i, f"{line}\nown words number {i} and {i * i} of this text", "en" if i % 2 else "de", f"s{i % 3}", 9) for i in range(12)]
    rows += [rows[0], (None, "some text without an id", None, None, None), (50, None, None, None, None), (51, "", "en", None, 0), (52, "alpha beta gamma delta epsilon zeta", "en", "s1", 1)]
    extra = {"lang_pred": "x", "score": "x", "n_lines": "x", "id": "x", "item_id": "x", "bucket": "x", "component": "x"}
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in extra.items()})
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if name != "mix":
                assert out.columns == docs.columns, name
            out.write.parquet(path := str(tmp_path / f"{empty}-{k}"))
            at = spark.read.parquet(path)
        got = at.collect()
        assert not got if empty else {r["doc_id"] for r in got} and not {50, 51, 52} & {r["doc_id"] for r in got}
