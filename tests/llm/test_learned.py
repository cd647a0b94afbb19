"""Learned operators: held-out quality on the given tables, and defined results for odd rows."""

import re
from html import unescape

import numpy as np
import pytest
from mapstone.llm import html_text, langid, license_scan, mixing, toxicity

from . import plain_license

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [g for g in got if g.held_out]
    assert len(got) == 1000 and 0 < len(held) < 400
    assert np.mean([g.lang == g.lang_pred for g in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in got)


def test_language_odd_rows(spark):
    rows = [(1, "the and of this that with", "en"), (2, "der die das und nicht mit", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !?", None), (None, "the of", "en"), (7, "und der", None)]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    got = langid.language_id(df).collect()
    assert len(got) == len(rows) * 3
    assert all(g.lang_pred == "und" and g.score == 0 for g in got if g.doc_id in (3, 4, 5))
    assert langid.language_id(df.limit(0)).count() == 0
    unlabelled = langid.language_id(df.where("lang IS NULL")).collect()
    assert {g.lang_pred for g in unlabelled} == {"und"}


def test_codebooks_are_apart():
    for n in (2, 3, 4, 7, 12, 30):
        m = langid.codebook(n)
        d = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert min(d) >= 1 and (n < 4 or min(d) >= 3)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [g for g in got if g.held_out]
    assert np.mean([g.toxic == g.predicted for g in held]) > 0.93
    scorer = toxicity.Scorer(model)
    for t in ("what an 1d10t he is", "i d i o t", "you idiooooot", "an i.d.i.o.t", "ID10T!"):
        assert "idiot" in scorer.features(t), t
    assert scorer.score("the plain words of a clean text") < 0.5
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_odd_rows(spark):
    rows = [(i, "bad zzword here" if i % 2 else "good words here", "en") for i in range(60)] + [(100, None, "en"), (101, "", None), (None, "zzword", "en"), (102, "x " * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity.toxicity(docs, labels).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[100].score < 0.5 and got[101].score < 0.5
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {g.predicted for g in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def article_of(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_html_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(html)
    assert all(g.text == article_of(html[g.page_id]) and g.n_chars == len(g.text) for g in got)


def test_html_of_unseen_layouts():
    model, right, total = html_text.trained(), 0, 0
    for root, blocks, answers in html_text.marked_pages(120, 999):
        html_text.decode(root, blocks, model.predict(html_text.features(blocks, root, model.odds)))
        right += sum(x.keep == bool(y) for x, y in zip(blocks, answers, strict=True) if x.own)
        total += sum(bool(x.own) for x in blocks)
        for x in blocks:  # no kept element below a dropped one
            assert not x.keep or x.block.keep or x.block.tag in ("#root", "html")
    assert right / total > 0.98


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("<html><body><article><h1>A &amp; B</h1><p>One  two\n three<p>Four&nbsp;five</article><footer>&copy; x</footer>", "A & B\nOne two three\nFour five"),
        ("<article><p>It is a text of some words, is it not.</p><div class='comments'><p>nice one</p></div></article>", "It is a text of some words, is it not."),
        ("<body><nav><ul><li><a href=/a>Home</a></ul></nav><main><h1>Title here</h1><p>" + "Some words of text, and more. " * 20 + "</main></body>", "Title here\n" + ("Some words of text, and more. " * 20).strip()),
        ("<p>unclosed <b>bold", "unclosed bold"),
    ],
)
def test_html_cases(page, want):
    assert html_text.extract([page], html_text.trained()) == [want]


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>" + "a b " * 50_000, "x"), (3, "u", "<<<>>>&&& <a <b", "x"), (3, "u", "<<<>>>&&& <a <b", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    assert len(got) == 5 and [g.text for g in got if g.page_id in (1, 2)] == ["", ""]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_license_scan_matches_plain_python(spark):
    texts = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.ALIKE
    texts += ["prose\n" + t + "\nmore prose" for t in texts] + [None, "", "no cue at all", "license", "x " * 100_000 + "licensed", "All rights reserved.\nReleased under the MIT License."]
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t, "x") for i, t in enumerate(texts + given)] + [(None, "Released under the MIT License.", "x")]
    got = {g.doc_id: g for g in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = plain_license.scan(t)
        assert {k: getattr(got[i], k) for k in want} == want, t
    assert license_scan.trained()["accuracy"] > 0.95
    for family, ts in license_scan.TEMPLATES.items():
        assert all(plain_license.scan(t)["family"] == family for t in ts), family
    assert all(plain_license.scan(t)["family"] in ("unknown", "none") for t in license_scan.ALIKE)
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def water_fill(children, budget):
    """children: [(name, weight, cap)]; the plain algorithm."""
    share, left = {}, sorted((c for c in children if c[1] > 0), key=lambda c: (c[2] / c[1], c[0]))
    while left:
        weights = sum(c[1] for c in left)
        name, w, cap = left[0]
        if cap * weights > budget * w:
            share |= {n: w * budget // weights for n, w, _ in left}
            break
        share[name], budget, left = cap, budget - cap, left[1:]
    return share


def test_mixing_budgets_and_prefixes(spark):
    rows = [(i, "w" * (4 * (i % 7)), ["en", "de", None][i % 3], f"src{i % 5}", 1) for i in range(300)] + [(None, None, "en", None, 1), (7, "again", "en", "src0", 1), (7, "again", "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")
    measured = mixing.measured(df)
    for share, epochs in ((0.3, 1), (0.9, 1), (1.5, 3), (5.0, 2)):
        leaf = mixing.budgets(measured, mixing.WEIGHTS, share, epochs).collect()
        total = int(sum(r.supply for r in leaf) * share)
        weight = lambda level, v: mixing.WEIGHTS[level].get(v, 1)
        caps = lambda **k: sum(r.supply * epochs for r in leaf if all(r[a] == b for a, b in k.items()))
        want, by_domain = {}, water_fill([(d, weight("domain", d), caps(domain=d)) for d in {r.domain for r in leaf}], total)
        for d, b in by_domain.items():
            by_lang = water_fill([(x, weight("lang", x), caps(domain=d, lang=x)) for x in {r.lang for r in leaf if r.domain == d}], b)
            for x, b2 in by_lang.items():
                got = water_fill([(r.source, 1, r.supply * epochs) for r in leaf if r.domain == d and r.lang == x], b2)
                want |= {(d, x, s): n for s, n in got.items()}
        assert {(r.domain, r.lang, r.source): r.budget for r in leaf} == want
        chosen = mixing.select_epochs(measured, mixing.budgets(measured, mixing.WEIGHTS, share, epochs), 7).collect()
        for r in leaf:
            mine = [c for c in chosen if (c.domain, c.lang, c.source) == (r.domain, r.lang, r.source)]
            assert sum(c.n_tokens for c in mine) <= r.budget
            if r.supply:
                assert all(sum(c.epoch == e for c in mine) == r.docs for e in range(r.budget // r.supply))
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mix_documents(df)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
