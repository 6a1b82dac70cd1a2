"""Hashing, line dedup, token counts, language ID, quality rules, on small cases against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.llm import arrowtext, language_id, line_dedup, quality_rules, token_counts

WS = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbZé😀 \t\n\x0b\f\r\xa0", max_size=20), max_size=6), st.integers(1, 30))
def test_words(texts, chunk):
    got = [[] for _ in texts]
    for w in arrowtext.words(pa.array(texts, pa.string()), chunk=chunk):
        for i in range(w.n_docs):
            for k in range(w.bounds[i], w.bounds[i + 1]):
                got[w.first + i].append((int(w.hash[k]), bytes(w.data[w.start[k] : w.end[k]]).decode()))
    plain = [t.encode().split() for t in texts]
    assert [[x for _, x in g] for g in got] == [[x.decode() for x in p] for p in plain]
    by = {}
    for g in got:
        for h, x in g:
            folded = x.encode().lower()
            assert by.setdefault(h, folded) == folded
    assert len(set(by.values())) == len(by)


def plain_line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(WS))
    where = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                where.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == i]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    long, accents = "The Same Line " * 4, "É" * 39 + "A"
    docs = [(i, f"{i} own line\n \t{long}\f\nend") for i in range(6)] + [(10 + i, accents + ("\n" + accents.lower()) * (i % 2)) for i in range(5)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (None, long), (3, long.upper()), (3, long.upper()), (30, "x" * 39), (31, ("x" * 50 + "\n") * 3000)]
    df = spark.createDataFrame([(a, b, "z", 9) for a, b in docs], SCHEMA + ", line string, n_lines int")
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == {"doc_id", "text", "line", "n_lines", "n_dropped"}
    assert sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == plain_line_dedup(docs)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_token_counts_are_the_library_s(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    r = random.Random(3)
    pool = list("aaab  \n\t\x1c\x85é日😀1½'!#　﻿") + ["<|endoftext|>", " the", "'ll", "ing", "\r\n"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(400)] + ["", None, "a" * 30_000, "ab " * 200_000, "<|endoftext|>" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("N_TOKENS", F.lit("old"))
    got = {x["doc_id"]: x for x in token_counts.count_tokens(df, "byte_bpe_50k.json").collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024)
    with pytest.raises(ValueError):
        token_counts.ByteBPE(public.path("word_bpe_49k.json"))
    assert token_counts.count_tokens(df.limit(0), "byte_bpe_50k.json").count() == 0


def plain_ngrams(text, orders):
    """Counts of the n-grams themselves: letters in lower case, each run of other characters as one space."""
    out, low = [], text.lower()
    for i, c in enumerate(low):
        if c.isalpha() or i == 0 or low[i - 1].isalpha():
            out.append(c if c.isalpha() else " ")
    whole = "".join(out)
    return Counter(whole[i : i + n] for n in orders for i in range(len(whole) - n + 1) if n > 1 or whole[i] != " ")


def test_ngrams_of_blocks_are_those_of_the_whole(monkeypatch):
    assert language_id.ngram_counts("12 ... !", (1, 2), 64) is None
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choices("abé ß  ..\n1", k=r.randint(1, 200)))
        want = sorted(plain_ngrams(text, (1, 2, 3)).values())
        for block in (1, 2, 3, 7, 1 << 18):
            monkeypatch.setattr(language_id, "_BLOCK", block)
            got = language_id.ngram_counts(text, (1, 2, 3), 1 << 22)
            assert got is None if not any(map(str.isalpha, text)) else sorted(got[got > 0].tolist()) == want
    monkeypatch.setattr(language_id, "_BLOCK", 1 << 18)
    tail = "the end of  a very long text, with  wide spaces "
    wide = language_id.ngram_counts("a" * (1 << 18) + " ".join(tail), (1, 2, 3), 1 << 14)
    assert (wide == language_id.ngram_counts("a" * (1 << 18) + "   ".join(tail), (1, 2, 3), 1 << 14)).all()


LANGS = {"en": "the and of that is was with for", "de": "der die und ist nicht ein von zu", "fr": "le la des est une pour dans et"}


def corpus(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(LANGS[lang].split(), k=r.randint(4, 40))), lang) for i in range(n) for lang in [r.choice(list(LANGS))]]


def test_language_id(spark):
    rows = [*corpus(600), (9001, None, "en"), (9002, "123 !!", "de"), (9003, "the and of", None), (9003, "the and of", None), (None, "der die und", None), (9004, "x" * 700_000, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string").withColumn("SCORE", F.lit(7))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.fit(df.where(~held))
    got = language_id.predict(df.select("doc_id", "text", "lang"), model).collect()
    out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert out and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["lang_pred"] == by[9002]["lang_pred"] == "und" and by[9003]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    again = language_id.fit(df.where(~held))
    assert (again.weights == model.weights).all() and again.temperature == model.temperature and (model.weights == 0).mean() > 0.5
    kept = language_id.keep_known(df, model)
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(df.where(~held), settings=language_id.Settings(max_labels=2))
    # The prediction is the softmax of the weights of the text's own n-grams, in plain steps.
    text = "Die   und, the der"
    counts = language_id.ngram_counts(text, (1, 2, 3), model.settings.buckets)
    own = {b: math.log1p(n) * model.idf[b] for b, n in enumerate(counts.tolist()) if n}
    size = math.sqrt(sum(v * v for v in own.values()))
    z = [(sum(v / size * w[b] for b, v in own.items()) + bias) / model.temperature for w, bias in zip(model.weights, model.bias, strict=True)]
    p = [math.exp(v - max(z)) for v in z]
    lang, score = model.scores(text)
    assert score == pytest.approx(max(p) / sum(p)) and lang == model.labels[int(np.argmax(z))]
    assert kept.columns == df.columns and {9001, 9002}.isdisjoint(r["doc_id"] for r in kept.collect())
    empty = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(df.limit(5), empty).collect()} == {"und"}


def test_binomial_tail(spark):
    def exact(n, k, p):
        return 1.0 if n <= 0 or k > n * p else min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1)))

    cases = [(n, k) for n in (0, 1, 10, 500, 4000) for k in (0, 1, 3, 20)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        assert r["p"] == pytest.approx(exact(r["n"], r["k"], 0.01), rel=1e-9)
    large = spark.createDataFrame([(5_000_000, 49_500), (30_000_000, 299_000), (30_000_000, 300_000)], "n long, k long")
    for r in large.withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect():
        assert r["p"] == pytest.approx(exact(r["n"], r["k"], 0.01), rel=1e-6)


def plain_base(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    seen, marked = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(j for i in at for j in range(i, i + 5))
    lines = [x for x in t.split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_quality_measures(spark):
    r = random.Random(5)
    texts = ["", None, " \n", "a", "a b c d e", "a b c d e f a b c d e", "a " * 5000, "x\nx\n \ny\nx", "é# *$\x0b%&|<>\xa0z", "a a a a a a"]
    texts += ["".join(r.choices(["a", "b", " ", "\n", " c", "#"], k=r.randint(0, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA + ", n_words int")
    for x in quality_rules.measured(df).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == plain_base(texts[x["doc_id"]]), texts[x["doc_id"]]


def test_quality_thresholds(spark):
    """Junk is rejected, good documents of the stratum are kept up to the risk, a stratum without labels is kept."""
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    good = lambda: " ".join(word() for _ in range(30))
    junk = lambda: " ".join(word() + "***" for _ in range(30))
    docs = [(i, good() if i % 5 else junk(), "en") for i in range(6000)] + [(i, junk(), "xx") for i in range(6000, 6010)] + [(7000, "few words", None)]
    labels = [(i, int(i % 5 > 0)) for i in range(6000)]
    df, lab = spark.createDataFrame(docs, SCHEMA + ", lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality_rules.judge(df, lab).collect()}
    ok = [got[i]["kept"] for i in range(6000) if i % 5]
    assert sum(ok) >= 0.98 * len(ok) and not any(got[i]["kept"] for i in range(0, 6000, 5)) and got[5]["rule"] == "symbol_ratio"
    assert all(got[i]["kept"] for i in range(6000, 6010)) and got[7000]["base_failed"] and not got[7000]["kept"]
    assert all(x["kept"] for x in quality_rules.judge(df.limit(20), lab.limit(0)).collect())
    assert quality_rules.judge(df.limit(0), lab).count() == 0
