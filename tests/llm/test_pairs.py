"""Near dedup, components, decontamination, mixing against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectrail.llm import components, decontaminate, mixing, near_dedup

SCHEMA = "doc_id long, text string"


def shingles(text, size):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(docs, size, percent):
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in docs if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def family(seed, n, words=60, edits=4):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"e{r.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(spark, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    texts = family(1, 60, edits=9) + family(2, 25, 12, 2) + family(3, 10, 300, 40) + ["Same  Text here\tnow"] * 5 + ["same text HERE now", "one", "One", "", None, " \n", "a b", "a  B", "b a", "x " * 500, "x " * 900]
    r = random.Random(9)
    docs = list(zip(r.sample(range(10_000), len(texts)), texts, strict=True))
    docs += [(docs[0][0], docs[70][1]), (docs[3][0], docs[3][1]), (None, texts[0])]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], SCHEMA + ", id string")
    got = near_dedup.near_components(df, shingle=size).collect()
    want = plain_components(docs, size, 80)
    assert len(got) == len(docs) and {(r["id"], r["component_id"]) for r in got if r["id"] is not None} == set(want.items())
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(t, size)) for _, t in docs)
    kept = near_dedup.keep_one(df, shingle=size)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(want.values()) | {None}
    assert near_dedup.near_components(df.limit(0)).count() == 0


def test_near_copies_with_a_shared_passage(spark):
    r = random.Random(12)
    prose = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for _ in range(150):  # five documents share half their text; the last two are near copies
        passage = prose(60)
        texts += [" ".join(passage + prose(60)) for _ in range(3)]
        own = prose(60)
        texts += [" ".join(passage + own), " ".join(passage + own[:55] + prose(5))]
    docs = list(enumerate(texts))
    got = near_dedup.near_components(spark.createDataFrame(docs, SCHEMA), shingle=2)
    assert {r["id"]: r["component_id"] for r in got.collect()} == plain_components(docs, 2, 80)


def test_a_missing_set_is_an_error(spark):
    sets = near_dedup.shingle_sets(spark.createDataFrame([(1, "a b c")], "id long, text string"), 2)
    with pytest.raises(Exception, match="no shingle set"):
        near_dedup.verified(spark.createDataFrame([(2, 1)], "a long, b long"), sets, 80).collect()
    apart = spark.createDataFrame([(7, 1, 1, 1, 1, 1), (7, 2, 2, 1, 1, 1)], "bucket long, id long, comp long, main long, kq int, km int")
    with pytest.raises(Exception, match="no shingle set"):
        near_dedup._exhaustive(apart, sets, 80).collect()


def test_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    for n in (1, 3, 50, 3000):
        a = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
        x, y = near_dedup.sketch(a[: n + n // 2 + 1], 2048), near_dedup.sketch(a[n // 2 :], 2048)
        p, q = set(a[: n + n // 2 + 1].tolist()), set(a[n // 2 :].tolist())
        assert (x == y).mean() == pytest.approx(len(p & q) / len(p | q), abs=0.06)
        assert (x != 0xFFFFFFFFFFFFFFFF).all()


def test_intersections():
    r = np.random.default_rng(4)
    xs = [np.unique(r.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 6000, 300)]
    got = near_dedup.intersections(xs[:3], xs[1:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in xs[1:]] for a in xs[:3]]


def test_components(spark):
    r = random.Random(6)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in links for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {(x["node"], x["component"]) for x in got.collect()} == {(x, find(x)) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_align(a, b, s):
    h, best = np.zeros((len(a) + 1, len(b) + 1)), 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (s.match if x == y else s.mismatch), h[i - 1, j] + s.gap, h[i, j - 1] + s.gap)
            best = max(best, h[i, j])
    return best


def test_alignment():
    s, r = decontaminate.Settings(), np.random.default_rng(8)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 15)), r.integers(0, 6, r.integers(1, 40))
        got, lo, hi = decontaminate.align(a, b, s)
        assert got == pytest.approx(plain_align(a, b, s))
        assert got == 0 or plain_align(a, b[lo:hi], s) == pytest.approx(got)


def test_words_are_counted_alike(spark):
    """Corpus frequencies of the words that items are split into, without the marks around them."""
    texts = ["the end. The end. ÉTÉ end", "\u201cEnd\u201d of_the été!", None, "", "straße STRASSE ǅ x²y"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    every = [w for t in texts for w in decontaminate.split_words(t)]
    assert decontaminate._frequencies(df, "text", set(every)) == {w: every.count(w) / len(every) for w in every}
    r = random.Random(5)
    more = ["".join(r.choices("abZ9é_.’ß \nΣ", k=r.randint(0, 40))) for _ in range(300)]
    for first, h, bounds in decontaminate.hashed_texts(pa.array(more)):
        for t, lo, hi in zip(more[first:], bounds[:-1], bounds[1:], strict=True):
            assert h[lo:hi].tolist() == decontaminate._hash_words(decontaminate.split_words(t)).tolist()


def test_decontaminate_against_all_alignments(spark):
    """Every item aligned with every whole document: all that scores well is found, and nothing else."""
    s, r = decontaminate.Settings(), random.Random(21)
    prose = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    items = [prose(r.randint(6, 25)) for _ in range(12)] + [["of", "the", "of", "a", "the", "a", "of"]]
    docs = [prose(60) for _ in range(40)]
    for k in range(60):
        w = list(r.choice(items))
        for _ in range(r.randint(0, len(w) // 4)):
            w[r.randrange(len(w))] = "edit"
        docs.append(prose(r.randint(0, 30)) + w + prose(r.randint(0, 30)))
    docs += [["of", "the", "a"] * 30] * 5
    text = lambda x: [(i, " ".join(w)) for i, w in enumerate(x)]
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(spark.createDataFrame(text(docs), SCHEMA), spark.createDataFrame(text(items), "item_id long, text string")).collect()}
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            codes = {w: n for n, w in enumerate({*d, *item})}
            best = decontaminate.align(np.array([codes[w] for w in item]), np.array([codes[w] for w in d]), s)[0] / len(item)
            if best >= 0.6:
                assert (i, j) in got
            if (i, j) in got:
                assert best >= got[i, j] - 1e-6 >= s.threshold - 2e-6


def test_decontaminate(spark):
    r = random.Random(7)
    vocabulary = [f"word{i}" for i in range(800)] + ["the", "of", "and"] * 120
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(20)] + [(20, None), (21, ""), (22, "the of"), (23, "Zebra!")]
    words = lambda i: items[i][1].split()
    edited = words(3)
    for k in range(2, 30, 6):
        edited[k] = "changed"
    gap = words(4)[:14] + ["well", "then"] + words(4)[14:]
    docs = [(i, " ".join(prose(200))) for i in range(200)]
    docs += [(300, " ".join(prose(50) + words(1) + prose(40))), (301, " ".join(prose(50) + edited + prose(3))), (302, " ".join(gap)), (303, ("X, " + items[5][1]).upper() + "."), (304, None), (305, ""), (306, "a zebra ran"), (None, items[6][1])]
    docs += [(400 + i, " ".join(prose(20) + words(7))) for i in range(150)] + [(300, docs[200][1])]
    df, bench = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    pairs = {(x["doc_id"], x["item_id"]) for x in got}
    assert pairs >= {(300, 1), (301, 3), (302, 4), (303, 5), (306, 23), (None, 6)} | {(400 + i, 7) for i in range(150)}
    assert all(d is None or d >= 300 or i == 22 for d, i in pairs) and sum(x["doc_id"] == 300 and x["item_id"] == 1 for x in got) == 2
    x = next(x for x in got if x["doc_id"] == 300)
    assert (x["begin"], x["end"], x["score"]) == (50, 80, 1.0)
    left = decontaminate.without_contaminated(df, bench.where("item_id < 22"))
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(range(200)) | {304, 305, 306, None}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 == decontaminate.contaminated(df, bench.limit(0)).count()


def test_pipeline_judges_each_row_by_its_text(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    items = [(i, " ".join(f"x{i}y{j}" for j in range(12))) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, items[0][1], 1), (None, "clean text", 2), (5, "so " + items[2][1], 3), (5, "another clean text", 4), (6, None, 5), (7, "", 6)]
    df = spark.createDataFrame(docs, SCHEMA + ", k int")
    for most in (decontaminate.BROADCAST_BYTES, 70):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        left = corpus_pipeline.benchmark_leaks(spark, df, str(tmp_path))
        assert left.columns == df.columns and sorted(r["k"] for r in left.collect()) == [2, 4, 5, 6]


def test_benchmark_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"x{i}y{j}" for j in range(12))) for i in range(9)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 150)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == {(i, i) for i in range(9)}


def mix_rows(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", None]), r.choice(["web", "web", "books"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA + ", lang string, source string, domain string")


T = mixing.Targets(domains={"web": 1.0, "books": 3.0}, languages={"en": 2.0}, budget=0.9, max_epochs=2, range_rows=10)


def test_budgets_fill_the_tree(spark):
    rows, df = mix_rows(spark)
    total = sum(len(t.split()) for _, t, *_ in rows)
    small = df.select("domain", F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), mixing.n_words(F.col("text")).alias("tokens"))
    leaves = mixing.leaf_budgets(small, T).collect()
    assert sum(r["budget"] for r in leaves) == pytest.approx(int(total * 0.9), abs=len(leaves) + 1)
    by = defaultdict(lambda: [0, 0])
    for r in leaves:
        assert r["budget"] <= 2 * r["tokens"]
        by[r["domain"]][0] += r["budget"]
        by[r["domain"]][1] += 2 * r["tokens"]
    # Books are short of their three quarters: they are used up, and the rest goes to the web.
    assert by["books"][0] == pytest.approx(min(by["books"][1], 0.75 * total * 0.9), abs=9)


def plain_shares(budget, children):
    """{name: share} of children {name: (weight, capacity)}: full ones are taken out one after the other."""
    left, out = {k: v for k, v in children.items() if v[0] > 0}, dict.fromkeys(children, 0.0)
    while left:
        total = sum(w for w, _ in left.values())
        full = [k for k, (w, c) in left.items() if c <= budget * w / total]
        for k in full or left:
            out[k] = left[k][1] if full else budget * left[k][0] / total
        if not full:
            break
        budget -= sum(left.pop(k)[1] for k in full)
    return out


def plain_mix(rows, t):
    """(id, epoch) of rows (id, tokens, leaf), from the definition: shares down the tree, then seeded epochs."""
    import hashlib

    tokens = defaultdict(int)
    for _, n, leaf in rows:
        tokens[leaf] += n
    weights = (t.domains, t.languages, t.sources)
    weight = lambda leaf: [w.get(x, 1.0) for w, x in zip(weights, leaf, strict=True)]
    usable = {leaf: n * float(t.max_epochs) if all(weight(leaf)) else 0.0 for leaf, n in tokens.items()}

    def flow(budget, prefix):
        depth = len(prefix)
        if depth == 3:
            return {prefix: int(round(budget, 3))}
        below = defaultdict(float)
        for leaf, c in usable.items():
            if leaf[:depth] == prefix:
                below[leaf[depth]] += c
        shares = plain_shares(budget, {x: (weights[depth].get(x, 1.0) if c else 0.0, c) for x, c in below.items()})
        return {k: v for x, s in shares.items() for k, v in flow(s, (*prefix, x)).items()}

    want = []
    for leaf, budget in flow(float(int(sum(tokens.values()) * t.budget)), ()).items():
        if not tokens[leaf] or budget <= 0:
            continue
        own = [(i, n) for i, n, x in rows if x == leaf]
        whole, rest = divmod(budget, tokens[leaf])
        want += [(i, e) for i, _ in own for e in range(whole)]
        upto = 0
        for i, n in sorted(own, key=lambda x: (hashlib.md5(f"{t.seed}:{whole}:{x[0]}".encode()).hexdigest(), str(x[0]))):
            upto += n
            if upto > rest:
                break
            want.append((i, whole))
    return want


@pytest.mark.parametrize("targets", [T, mixing.Targets(domains={"web": 1.0, "books": 2.0}, languages={"en": 0.0}, sources={"b": 0.0, "a": 3.0}, budget=0.7, range_rows=7)])
def test_mix_against_a_plain_version(spark, targets):
    rows, df = mix_rows(spark)
    want = plain_mix([(i, len(t.split()), (d, lang or "(null)", source or "(null)")) for i, t, lang, source, d in rows], targets)
    got = mixing.mix(df, targets)
    assert sorted((r["doc_id"], r["epoch"]) for r in got.collect()) == sorted(want)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "domain", "n_tokens", "epoch"}


def test_weights_of_nothing(spark):
    """What a child of weight 0 can't use goes to the others: the usable budget is handed out whole."""
    rows = [(i, "w " * 2, "en", s, d) for i in range(12) for s, d in [("a", "x")] * (i < 3) + [("b", "x")] * (3 <= i < 9) + [("a", "y")] * (i >= 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, domain string")
    small = df.select("domain", "lang", "source", mixing.n_words(F.col("text")).alias("tokens"))
    t = mixing.Targets(sources={"b": 0.0}, budget=0.75, max_epochs=3)
    leaves = {(r["domain"], r["source"]): r["budget"] for r in mixing.leaf_budgets(small, t).collect()}
    assert leaves == {("x", "a"): 9, ("y", "a"): 9}
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weights"):
            mixing.Targets(domains={"x": bad})


def test_mix_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA + ", lang string, source string")).count() == 0
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "en", "s")], SCHEMA + ", lang string, source string")
    assert mixing.mix(df).count() == 0  # no tokens, no budget
    twice = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "c", "en", "s")], SCHEMA + ", lang string, source string")
    assert sorted(r["doc_id"] for r in mixing.mix(twice, mixing.Targets(budget=1.0)).collect()) == [1, 1, 2]
