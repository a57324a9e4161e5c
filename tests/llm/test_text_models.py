"""Language ID, toxicity, HTML main text and URL filters."""

import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedmill.llm import html_content, language_id, toxicity, url_filter

LANG = "doc_id bigint, text string, lang string, score string"
EN = "the and with for that this from have they which there their would about"
DE = "der die und das nicht ist mit auf eine für werden auch durch über können"


def lang_docs(spark):
    rows = [(i, " ".join((EN if i % 2 else DE).split()[i % 5 :]), "en" if i % 2 else "de", "x") for i in range(40)]
    return spark.createDataFrame(rows, LANG)


def test_language(spark):
    docs = lang_docs(spark)
    proto = language_id.train(docs)
    assert sorted(proto) == ["de", "en"]
    more = spark.createDataFrame([(100, EN.upper(), None, "x"), (101, None, "en", "x"), (102, "123 !? ", "de", "x"), (103, "", None, "x"), (100, EN.upper(), None, "x"), (104, (DE + " ") * 20_000, None, None)], LANG)
    got = language_id.predict(more, proto).collect()
    assert [r.lang_pred for r in got] == ["en", "und", "und", "und", "en", "de"] and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == pytest.approx(got[4].score) and got[1].score == 0.0
    assert language_id.predict(more.limit(0), proto).count() == 0
    assert {r.lang_pred for r in language_id.predict(more, language_id.train(docs.limit(0))).collect()} == {"und"}


def brute_bundle(text, letters):
    """The definition: every trigram's vector made letter by letter, place by place."""
    total = [0] * letters.dimensions
    shown = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in shown:
        shown = shown.replace("  ", " ")
    for k in range(len(shown) - 2):
        a, b, c = (letters.vector(ord(x)) for x in shown[k : k + 3])
        for j in range(letters.dimensions):
            total[j] += int(a[j - 2] * b[j - 1] * c[j])
    return total


def test_language_memory_is_bounded():
    """Many letters of a script with thousands of letters, nearly all trigrams distinct."""
    import tracemalloc

    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(0x4E00, 0x5E00, 200_000)))
    letters = language_id.Letters()
    tracemalloc.start()
    (vector,) = [v for group in language_id.text_vectors([text], letters) for v in group]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and np.abs(vector).max() > 0
    part = text[:3_000]
    (whole,), few = next(language_id.text_vectors([part], letters)), language_id.GRAMS_AT_ONCE
    try:
        language_id.GRAMS_AT_ONCE = 7
        assert (next(language_id.text_vectors([part], letters))[0] == whole).all()
    finally:
        language_id.GRAMS_AT_ONCE = few


def test_language_equals_its_definition(spark):
    docs, letters = lang_docs(spark), language_id.Letters(64)
    proto = language_id.train(docs, dimensions=64)
    sums = {lang: [sum(x) for x in zip(*(brute_bundle(r.text, letters) for r in docs.filter(F.col("lang") == lang).collect()))] for lang in ("de", "en")}
    assert {lang: v.tolist() for lang, v in proto.items()} == sums
    texts = ["the and there", "nicht Über das", "x", "Ça va? 12", "the die with der"]
    got = language_id.predict(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], LANG), proto).orderBy("doc_id").collect()
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for r, t in zip(got, texts):
        best = {lang: cosine(brute_bundle(t, letters), v) for lang, v in sums.items()}
        assert r.lang_pred == max(sorted(best), key=best.get) and r.score == pytest.approx(max(0.0, *best.values()), abs=1e-5)


def test_language_ties_go_to_the_first_name(spark):
    proto = language_id.train(lang_docs(spark))
    got = language_id.predict(lang_docs(spark).limit(1), {"zz": proto["de"], "aa": proto["de"], "mm": proto["de"]}).first()
    assert got.lang_pred == "aa"


def test_language_pieces_equal_whole(monkeypatch):
    text, letters = [EN * 30, "", DE, EN], language_id.Letters()
    whole = np.concatenate(list(language_id.text_vectors(text, letters)))
    monkeypatch.setattr(language_id, "LETTERS_AT_ONCE", 50)
    assert (np.concatenate(list(language_id.text_vectors(text, letters))) == whole).all()


def test_clashing_names(spark, model):
    """Result names in another case are replaced, names that an operator could use inside pass through."""
    extra = {"Score": F.lit(1), "`__text`": F.lit(2), "row": F.lit(3), "t": F.lit(4), "Lang_Pred": F.lit(5), "`a.b`": F.lit(6), "url": F.lit("http://a.net/"), "Host": F.lit(7), "`__url`": F.lit(8), "TEXT": F.lit(None), "N_chars": F.lit(9)}
    d = lang_docs(spark).drop("score").withColumnRenamed("text", "Body").select("doc_id", "Body", "lang", *[v.alias(k.strip("`")) for k, v in extra.items()])
    rest = {"row": 3, "t": 4, "a.b": 6, "__text": 2, "__url": 8}
    found = language_id.predict(d, language_id.train(d, text_col="body"), text_col="body")
    assert found.columns == [c for c in d.columns if c not in ("Score", "Lang_Pred")] + ["lang_pred", "score"]
    scored = toxicity.score(d, toxicity.fit([], np.zeros(0)), text_col="body")
    assert scored.columns == [c for c in d.columns if c != "Score"] + ["score"]
    pages = html_content.extract(d, model, html_col="body")
    assert pages.columns == [c for c in d.columns if c not in ("TEXT", "N_chars")] + ["text", "n_chars"]
    urls = url_filter.filter_urls(d, [("block", "net", "/")])
    assert urls.columns == [c for c in d.columns if c != "Host"] + ["host", "path", "rule", "verdict"] and urls.first().verdict == "block"
    for out in (found, scored, pages, urls):
        assert out.count() == 40 and {k: out.first()[k] for k in rest} == rest


TRAVEL = """
import sys
sys.path.insert(0, sys.argv[1])
from feedmill.session import session
from feedmill.llm import ann_search, decontaminate, html_content, language_id, minhash_dedup, toxicity
s = session("travel", cores=2, **{"spark.checkpoint.dir": sys.argv[2], "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "2g"})
d = s.createDataFrame([(i, "the words of text number %d are here" % i, "en", i % 2, [1.0, float(i)]) for i in range(8)], "doc_id bigint, text string, lang string, label int, embedding array<double>")
out = [
    language_id.predict(d, language_id.train(d)), toxicity.score(d, toxicity.train(d, d)), html_content.extract(d, html_content.Potentials({}, html_content.np.zeros((2, 2, 2))), html_col="text"),
    decontaminate.contamination(d, d.withColumnRenamed("doc_id", "item_id")), minhash_dedup.near_duplicates(d), ann_search.nearest(d, d, 3, "doc_id"),
]
print([x.count() for x in out])
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The package is importable on the driver only: the workers run elsewhere, with no path to it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(language_id.__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", TRAVEL, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip().endswith("[8, 8, 8, 8, 8, 24]"), out.stderr[-3000:]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    got = language_id.predict(docs, language_id.train(docs.filter(fold != 1))).filter(fold == 1)
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_toxicity(spark):
    filler = [f"word{chr(97 + i % 26)} plain text here" for i in range(200)]
    rows = [(i, t + ("" if i % 4 else " idiot" if i % 8 else " moron"), int(i % 4 == 0)) for i, t in enumerate(filler)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = docs.select("doc_id", F.col("score").alias("label")).unionByName(spark.createDataFrame([(0, None), (None, 1), (9999, 1)], "doc_id bigint, label int"))
    m = toxicity.train(docs, labels)
    test = spark.createDataFrame([(1, "what an idiot", 0), (2, "a plain text", 0), (3, None, 0), (4, "", 0), (5, "plain " * 50_000 + "moron idiot", 0), (1, "what an idiot", 0)], "doc_id bigint, text string, score int")
    got = [r.score for r in toxicity.score(test, m).collect()]
    assert got[0] > 0.3 and got[4] > 0.3 and got[0] == got[5] and max(got[1:4]) < 0.3 and all(0 <= x <= 1 for x in got)
    assert toxicity.score(test.limit(0), m).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(test, none).collect()] == [0.5] * 6


def test_toxicity_score_is_the_sum_over_terms_and_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, np.arange(50), rng.normal(size=50), rng.normal(0, 0.3, (50, toxicity.K)))
    for n in (0, 1, 2, 9):
        terms = rng.choice(60, n, replace=False)
        z, known = m.bias, [t for t in terms if t < 50]
        for a in known:
            z += m.weight[a]
            z += sum(sum(m.factor[a][k] * m.factor[b][k] for k in range(toxicity.K)) for b in known if a < b)
        assert m.score(terms) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_learns_terms_that_matter_together_only():
    """Label 1: exactly one of two words, so neither word by itself tells anything."""
    rng, places = np.random.default_rng(0), toxicity._Places()
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append(toxicity.term_places(" ".join([f"w{chr(97 + k)}x" for k in rng.integers(0, 26, 10)] + ["alpha"] * a + ["omega"] * b), places))
        labels.append(int(a != b))
    m = toxicity.fit(rows, np.array(labels))
    one, other, both, none = (m.score(toxicity.term_places(t, places)) for t in ("alpha", "omega", "alpha omega", "wax"))
    assert min(one, other) > 0.9 and max(both, none) < 0.2


def test_toxicity_pairs_weigh_more():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    rows = [toxicity.term_places("filler " + "grump " * x + "blue " * y, toxicity._Places()) for x, y in zip(a, b)]
    m = toxicity.fit(rows, a * b)
    score = lambda t: m.score(toxicity.term_places(t, toxicity._Places()))
    assert score("grump blue") > 0.7 > 0.3 > max(score("grump"), score("blue"), score("filler"))


PAGE = "page_id bigint, url string, html string, text string"


@pytest.fixture(scope="module")
def model():
    return html_content.fit([(n, html_content._labels(n), 1.0) for n in (html_content.parse(p)[0] for p in html_content.labelled_pages())])


P = "<p>Some words of a paragraph that go on for a while and tell something to the reader of the page.</p>"


@pytest.mark.parametrize(
    "page, has, lacks",
    [
        (f"<html><head><title>TT</title><style>p{{}}</style></head><body><nav><a href=x>NAV</a></nav><article><h1>Head &amp; more</h1>{P}<script>var a='<p>SCRIPT</p>'</script></article><footer>FOOT</footer></body></html>", "Head & more Some words", "TT NAV SCRIPT FOOT"),
        (f"<body><main>{P}<aside><p>SIDE words are here to read as well.</p></aside>{P}</main><div id=comments><p>COMMENT by a reader who liked it.</p></div></body>", "Some words", "SIDE COMMENT"),
        (f"<body><article><p><b>Unclosed<br><p>next\n  line</article><div class=ad>ADV</div>", "Unclosed next line", "ADV"),
        ("<body><article><p>Hi.</p></article>", "Hi.", "body"),
    ],
)
def test_main_text(model, page, has, lacks):
    got = html_content.main_text(page, model)
    assert has in got and not [w for w in lacks.split() if w in got]


@pytest.mark.parametrize(
    "script",
    ["<script>for(i=0;i<n;i++){f()}</script>", "<script><!-- f()</script>", "<style>/* <!-- */ p<b</style>", "<SCRIPT>if(a<b){s='<p>'}</SCRIPT >", "<script>a<b</script x>", "<title>a<b</title>", "<script>1<c</script><script><!--</script>"],
)
def test_text_after_raw_elements(script):
    page = f"<body><article><p>First.</p>{script}<p>Second.</p></article>{script}<p>Third.</p></body>"
    nodes, pieces = html_content.parse(page)
    assert [(nodes[i].tag, t) for i, t, _ in pieces if t.strip()] == [("p", "First."), ("p", "Second."), ("p", "Third.")]


TWO = P.replace("page.", "page. It has a second sentence, as paragraphs have, and a third one. This is it, and it ends here.") + "<p>A second one follows it, with other words in it, and tells more of the same. It is about as long as the first. It ends here, after another sentence.</p>"
BARE = TWO.replace("<p>", "").replace("</p>", " ")


@pytest.mark.parametrize("page", [f"<html><body><div class=xyz>{TWO}</div></body></html>", f"<html><body>{BARE}</body></html>", BARE, "<p>Hi there.</p>", f"<body><div id=q1><a href=/>A</a> <a href=/b>B</a></div><div>{BARE}</div><div id=q2>(c) 2020</div></body>"])
def test_text_of_pages_without_known_names(model, page):
    got = html_content.main_text(page, model)
    assert got == ("Hi there." if "Hi" in page else " ".join(BARE.split()))


def test_comments_without_known_names_go(model):
    replies = "".join(f"<div><b>{n}</b><p>{t}</p></div>" for n, t in (("Jan", "Guter Text."), ("Eva", "Finde ich auch so."), ("Tom", "Nein.")))
    assert html_content.main_text(f"<body><nav><a href=x>a</a></nav><article><h1>T</h1>{TWO}<div class=kommentare>{replies}</div></article></body>", model) == "T " + " ".join(BARE.split())


LONG = "The quick brown fox jumps over the lazy dog and then it runs far away into the deep dark forest. Nobody has seen it since that day, they say. " * 2


@pytest.mark.parametrize(
    "page, keeps, lacks",
    [
        (f"<article><p>Alpha beta {LONG}</p><ul><li><a href=/a>Gamma delta</a></li><li><a href=/b>Epsilon</a></li></ul></article><footer>&copy; 2020 X</footer>", ["Alpha", "Gamma delta", "Epsilon"], ["2020"]),
        (f"<nav><a href=/>Home</a></nav><article><p>a &lt; b and c &gt; d</p><p>{LONG}</p></article>", ["a < b and c > d", "Nobody"], ["Home"]),
        (f"<article><p>a < b and c > d</p><p>{LONG}</p></article>", ["a < b and c > d", "Nobody"], []),
        (f"<article><p>{LONG}</p></article><div id=comments><h2>3 thoughts</h2><ol><li>Bob says: nice text</li></ol></div>", ["Nobody"], ["thoughts", "Bob"]),
        (f"<table><tr><td class=menu><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></td><td class=content><p>{LONG}</p></td></tr></table>", ["Nobody"], ["One", "Three"]),
    ],
)
def test_hand_written_pages(model, page, keeps, lacks):
    got = html_content.main_text(f"<html><body>{page}</body></html>", model)
    assert [k for k in keeps if k not in got] == [] and [k for k in lacks if k in got] == []


@pytest.mark.parametrize("sign", ["<p", "a <b c ", '<a "', '<a ="', "<a ='\">", "<p a='", "<!--", "<!", "</p", "<script>", "<b>x", "<div>x", "<ul><li>", '<p b=1 a ', "<b><h1></h1>", "<i><div><b></i>"])
def test_hostile_pages_take_linear_time(sign):
    """A quarter of a megabyte of each, with and without a sign that closes the last tag."""
    import time

    for end in ("", ">", '">x'):
        began = time.process_time()
        html_content.parse(sign * (250_000 // len(sign)) + end)
        assert time.process_time() - began < 4


def test_unclosed_tags_are_text():
    read = lambda page: "".join(t for _, t, _ in html_content.parse(page)[1])
    assert read("<p>one</p>two <b three") == "onetwo <b three" and read("<p>a<!-- b") == "a" and read('<p title=">">x</p>') == "x" and read('<p ">x</p>') == "x" and read("1 < 2 > 0 <> </ x") == "1 < 2 > 0 <> </ x"


@pytest.mark.parametrize("blind, least", [(False, 0.96), (True, 0.93)])
def test_words_of_held_out_pages(model, blind, least):
    """Precision and recall of words on pages of all layouts that the model has not seen; blind ones have names that mean nothing."""
    writer, right, more, less = html_content._Writer(99), 0, 0, 0
    for i in range(400):
        nodes, pieces = html_content.parse(writer.page(html_content.CONTAINERS[i % len(html_content.CONTAINERS)], blind))
        labels, content = html_content._labels(nodes), model.marginals(nodes)
        for k, text, _ in pieces:
            n = len(text.split())
            right += n * (labels[k] and content[k] > 0.5)
            more += n * (not labels[k] and content[k] > 0.5)
            less += n * (labels[k] and content[k] <= 0.5)
    assert right / (right + more) > least and right / (right + less) > least


def test_text_equals_brute_force(model):
    """The words of the elements that more than half of the weight of all labellings calls content."""
    import itertools

    nodes, pieces = html_content.parse(f"<body><div>{TWO}</div><ul><li><a href=x>a link</a></li></ul>tail</body>")
    n, on, total = len(nodes), [0.0] * len(nodes), 0.0
    own = [sum(model.node.get(f, 0.0) for f in html_content.node_features(nodes, i)) for i in range(n)]
    for labels in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(own[i] * labels[i] for i in range(n)) + sum(model.edge[int(nodes[i].tag in html_content.BLOCK), labels[nodes[i].parent], labels[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            on[i] += w * labels[i]
    want = " ".join(" ".join(t.split()) for i, t, _ in pieces if on[i] > total / 2 and t.strip())
    assert html_content.main_text(f"<body><div>{TWO}</div><ul><li><a href=x>a link</a></li></ul>tail</body>", model) == want


def test_marginals_are_exact(model):
    """Sum-product on a small tree against the sum over all labellings."""
    import itertools

    nodes, _ = html_content.parse("<article><p>Some text</p><div><a href=x>link</a></div></article>")
    n = len(nodes)
    own = [sum(model.node.get(f, 0.0) for f in html_content.node_features(nodes, i)) for i in range(n)]
    total, on = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(own[i] * labels[i] for i in range(n)) + sum(model.edge[int(nodes[i].tag in html_content.BLOCK), labels[nodes[i].parent], labels[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            on[i] += w * labels[i]
    assert model.marginals(nodes) == pytest.approx([x / total for x in on], abs=1e-6)


def test_extract_rows(spark, model):
    rows = [(1, "u", f"<article>{P}</article>", "own"), (2, None, None, "own"), (3, "u", "", None), (1, "u", f"<article>{P}</article>", "own"), (4, "u", f"<article>{P * 3000}</article>", "x")]
    got = html_content.extract(spark.createDataFrame(rows, PAGE), model).collect()
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[0].text == got[3].text and got[4].n_chars == 3000 * (len(got[0].text) + 1) - 1
    assert html_content.extract(spark.createDataFrame([], PAGE), model).count() == 0
    assert html_content.train(spark.createDataFrame([], PAGE)).node


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.org", "/fr")]


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://X.Example.NET/en/1?q#f", "x.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("https://example.net", "example.net", "", None, "allow"),
        ("http://www.example.com/de/x", "www.example.com", "/de/x", "example.com/de/", "block"), ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"), ("http://b.a.org/fr/", "b.a.org", "/fr/", "a.org/fr", "block"),
        ("http://b.org/fr/?x", "b.org", "/fr/", "org/fr/", "allow"), (None, "", "", None, "allow"), ("no scheme/", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://net?a/b", "net", "", None, "allow"),
        ("http://" + "a." * 3000 + "net/" + "x" * 9000, "a." * 3000 + "net", "/" + "x" * 9000, "net/", "block"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    d = spark.createDataFrame([(1, url, "own")], "page_id bigint, url string, host string")
    r = url_filter.filter_urls(d, RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_rows(spark):
    d = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id bigint, url string")
    assert url_filter.filter_urls(d, RULES).count() == 3 and url_filter.filter_urls(d.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(d, [], default="block").collect()} == {"block"}
