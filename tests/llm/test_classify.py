import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from axiloom.llm import html_text, language, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


EXTRA = ["a b c d e a b c d e", "x " * 9, "a\nb\na\n\n \nb", "# $ | <b> & 5%", "a b c d e f a b c d e g b c d e f", "é ü \x0b q", "one\r\ntwo\r\none\r\n"]


def test_statistics(spark, make, corpus):
    texts = [*corpus, *EXTRA]
    rows = {r["doc_id"]: r for r in quality.with_statistics(make(texts).select("doc_id", "text")).collect()}
    got = [tuple(rows[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for k in range(len(texts))]
    assert got == [brute_statistics(t) for t in texts]


def test_rules_are_learned_and_take_effect(spark, make):
    good = [f"a plain text of some length about number {k} and nothing else at all" for k in range(120)]
    bad = [f"sp{k}am$$$ mo{k}re### junk&&& wo{k}rds*** he{k}re%%% an{k}d th{k}ere$$$ al{k}l ov{k}er th{k}is###" for k in range(60)]
    docs = make([*good, *bad, None, ""])
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert all(rows[k]["kept"] for k in range(120)) and not any(rows[k]["kept"] for k in range(120, 182))
    assert rows[180]["base_failed"] and not rows[120]["base_failed"] and rows[120]["rule"] == 1
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(120))
    none = quality.quality(docs, labels.where("false"))
    assert none.where("kept").count() == 180
    assert quality.quality(make([]), labels).count() == 0


def test_covering_grows_and_prunes():
    cells = [((1, 0), (50, 0, 25, 0)), ((1, 1), (40, 1, 20, 0)), ((0, 0), (2, 300, 1, 150)), ((0, 1), (3, 200, 2, 100))]
    found = quality._cover(cells, ["symbols", "echoes"], {"symbols": [0.1], "echoes": [0.2]}, 0.9, 5, 5)
    assert [str(r) for r in found.rules] == ["symbols > 0.1"]


def test_language(spark, make):
    words = {"xx": "the and ing tion ou er", "yy": "der die das ung keit ü", "zz": "ción mente que los ñ a"}
    rng = np.random.default_rng(0)
    texts, langs = [], []
    for k in range(150):
        lang = sorted(words)[k % 3]
        w = words[lang].split()
        texts.append(" ".join("".join(rng.choice(w, 3)) for _ in range(20)))
        langs.append(lang)
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    found = {r["doc_id"]: r for r in language.identify(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([found[k]["lang_pred"] == langs[k] for k in range(1, 150, 2)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = {r["doc_id"]: r for r in language.identify(make([None, "", "123 !?", "½", texts[0], "qqqq wwww"]), model).collect()}
    assert [odd[k]["lang_pred"] for k in range(5)] == ["und"] * 4 + [langs[0]] and odd[0]["score"] == 0
    assert odd[5]["rejected"] and not odd[4]["rejected"]
    empty = language.fit(docs.where("false"))
    assert language.identify(docs, empty).where("lang_pred = 'und'").count() == 150


def test_language_against_one_gram_at_a_time(spark, make, monkeypatch):
    """Cosines from dictionaries of n-grams; with many languages, fewer bits and centroids but the same rule."""
    texts = ["the cat and the hat", "der Hund und die Wand", "el gato y la gata", "Ü 12 ü!", "a", None, "...", "the the " * 500]
    langs = ["en", "de", "es", "de", "en", "en", "es", "en"]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")

    def grams(t, bits):
        c = [ord(x) if x.isalpha() else 32 for x in f" {t.lower()} "]
        out, m = Counter(), 0xFFFFFFFF
        for i, x in enumerate(c):
            if x != 32:
                out[(x * 0x9E3779B1 & m) >> 32 - bits] += 1
            two = (((c[i - 1] * 0x85EBCA6B & m) + x & m) * 0xC2B2AE35 & m) if i else 0
            if i and (c[i - 1] != 32 or x != 32):
                out[two >> 32 - bits] += 1
                if i + 1 < len(c) and (x != 32 or c[i + 1] != 32):
                    out[((two + c[i + 1] & m) * 0x27D4EB2F & m) >> 32 - bits] += 1
        return out

    for most, bits in ((1 << 24, 14), (9 << 11, 11)):
        monkeypatch.setattr(language, "MOST_NUMBERS", most)
        model = language.fit(docs)
        assert model.bits == bits and model.vectors.shape == (1 << bits, len(model.of))
        for r in language.identify(docs, model).collect():
            t = texts[r["doc_id"]]
            if t is None or not any(x.isalpha() for x in t):
                assert r["lang_pred"] == "und"
                continue
            v = {g: (1 + np.log(n)) * model.idf[g] for g, n in grams(t, bits).items()}
            norm = np.sqrt(sum(x * x for x in v.values()))
            best = {}
            for j, k in enumerate(model.of):
                best[k] = max(best.get(k, -1.0), sum(x * model.vectors[g, j] for g, x in v.items()) / norm)
            top = max(sorted(best), key=best.get)
            share = 1 / sum(np.exp(language.SHARPNESS * (x - best[top])) for x in best.values())
            assert r["lang_pred"] == model.languages[top] and abs(r["score"] - share) < 1e-4
    monkeypatch.undo()
    assert language.shape(3, 3) == (14, 3) and language.shape(2000, 3) == (11, 3)
    with pytest.raises(ValueError):
        language.shape(1 << 20, 3)


def test_repeated_and_missing_ids_are_judged_one_by_one(spark, make, corpus):
    """Every classifier gives a row for each row, whatever the ids, and the same verdict as with ids of their own."""
    ids = [None if k % 3 == 0 else 7 for k in range(len(corpus))]
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(len(corpus))], "doc_id long, quality int, toxic int")
    own, shared = make(corpus), make(corpus, ids=ids)
    tagger, rules = toxicity.fit(own, marks), marks.where("false")
    langs = language.fit(own.withColumn("lang", own["keep_id"]))
    pairs = [
        (lambda d: language.identify(d, langs), ["lang_pred", "score"]), (lambda d: toxicity.score(d, tagger), ["score"]), (lambda d: quality.quality(d, rules), ["n_words", "n_repeat_words", "kept"]),
    ]
    for run, columns in pairs:
        one, two = (Counter(tuple(r[c] for c in columns) for r in run(d).collect()) for d in (own, shared))
        assert one == two and sum(one.values()) == len(corpus)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7):
        e, trans, start = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2)), 0.3
        total = np.zeros((n, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            s = start * y[0] + sum(e[k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n))
            for k in range(n):
                total[k, y[k]] += np.exp(s)
        first = np.zeros(n, bool)
        first[0] = True
        want = np.log(total[:, 1] / total[:, 0])
        np.testing.assert_allclose(toxicity.marginal_logits(e, first, trans, start), want, rtol=1e-7, atol=1e-9)
        two = toxicity.marginal_logits(np.concatenate((e, e)), np.concatenate((first, first)), trans, start)
        np.testing.assert_allclose(two, np.concatenate((want, want)), rtol=1e-7, atol=1e-9)
    long = toxicity.marginal_logits(np.zeros(1000), np.arange(1000) == 0, np.zeros((2, 2)), 0.0)
    np.testing.assert_allclose(long, 0, atol=1e-9)


def test_toxicity(spark, make):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    bad = ["vile", "rotten", "filthy"]
    texts, labels = [], []
    for k in range(300):
        w = list(rng.choice(vocabulary, 40))
        if k % 3 == 0:
            for p in rng.integers(0, 40, 3):
                w[p] = bad[p % 3]
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    docs = make(texts)
    marks = spark.createDataFrame([(k, labels[k]) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([(found[k]["score"] >= 0.5) == labels[k] for k in range(200, 300)]) > 0.97
    hits = {texts[k][a:b] for k in range(200, 300) for a, b in found[k]["spans"]}
    assert {w for h in hits for w in h.split()} <= set(bad) and hits
    odd = toxicity.score(make([None, "", "  ", "vile"]), model).collect()
    assert [r["score"] < 0.5 for r in sorted(odd, key=lambda r: r["doc_id"])] == [True, True, True, False]
    none = toxicity.fit(docs, marks.where("false"))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(make([]), model).count() == 0


PAGES = {
    "<title>t</title><p>One<p>Two <b>bold</b>text": "One\n\nTwo boldtext",
    "<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
    "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>tail": "Name       Qty\nApple pie  3\n\ntail",
    "a<br>b<div style='display: none'>no</div><span hidden>no</span><script>if (a < b) no()</script><!-- no -->": "a\nb",
    "<pre>x\n  y</pre>&amp; z": "x\n  y\n\n& z",
    "<div>a<div>b</div>c</div>": "a\nb\nc",
    "no tags   here": "no tags here",
    "<p>broken <b>bold<p>next</i></div> end": "broken bold\n\nnext end",
    "": "", None: "",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_html(html):
    assert html_text.render(html) == PAGES[html]


IMPLIED = {
    "<table><td>a<td>b</table>c": "a  b\n\nc",
    "<table><tr><td>a</tr><td>b<tr><th>c</table>": "a\nb\nc",
    "<table><thead><th>h<tbody><td>x</td><td>y</tbody></table>": "h\nx  y",
    "<table><colgroup><col><tr><td>a<td>b</table>": "a  b",
    "<table><caption>C<td>a</table>": "C\na",
    "<table><form><td>a<b>b<td>c<table><td>d</table>e</table>": "ab  c\n\n    d\n\n    e",
    "<table><tr><noscript><td>no</noscript><td>yes</table>": "yes",
    "<head><title>T</title>Hello <a>x</a></head> y": "Hello x y",
    "<head><title>T</title><b>Hello<p>World": "Hello\n\nWorld",
    "<head>\n<meta charset=utf-8><script>no()</script><style>no</style>\n<noscript><img>no</noscript><img>see": "see",
    "<head><bgsound src=x><a href=y>see</a><body>more": "see\nmore",
}


@pytest.mark.parametrize("html", list(IMPLIED))
def test_html_implied_rows_and_end_of_head(html):
    assert html_text.render(html) == IMPLIED[html]


@pytest.mark.parametrize("around", ["div", "span", "b", "section"])
def test_html_depth_changes_nothing(around):
    inner = "<script>no()</script><div hidden>no<div>no</div>no</div><table><tr><td>a<td>b</table>c<ul><li>d</ul>"
    want = html_text.render(inner)
    assert want == "a  b\n\nc\n\n- d"
    for depth in (190, 199, 250, 20_000):
        assert html_text.render(f"<{around}>" * depth + inner) == want
        assert html_text.render(f"<{around}>" * depth + inner + f"</{around}>" * depth) == want
    hidden = "<div hidden>" + "<div>" * 300 + "no" + "</div>" * 300 + "no</div>yes"
    assert html_text.render(hidden) == "yes"
    cells = "<table><tr><td>x<td>" * 400 + "y" + "</table>" * 400
    assert html_text.render(cells).split() == ["x"] * 400 + ["y"]


def test_html_survives_anything(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_text.render(deep) == "x"
    assert html_text.render("<table>" * 300 + "y").strip().endswith("y")
    pages = spark.createDataFrame([(1, None, 5), (2, "<p>a", 6), (None, "b", 7)], "page_id long, html string, text int")
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == {1: "", 2: "a", None: "b"}
    assert html_text.extract(pages.where("false")).count() == 0


def test_oracle_of_exact_dedup_is_the_contract(corpus):
    from axiloom.llm.queries import ORACLE_SQL

    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(corpus)))
    assert len(c.execute(ORACLE_SQL["op5_exact_dedup"]).fetchall()) == len(corpus)
