"""Language models, language identification, main text and neighbour search."""

import brute
import numpy as np
import pyarrow as pa
import pytest
import rows
from pyspark.sql import functions as F

from grovelight.llm import html_tree, language_id, language_model, multi_index


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_match_brute_force(spark, order):
    data = rows.documents()
    found = language_model.score(rows.frame(spark, data), order=order, strength=20.0)
    expected = brute.gram_scores(data, 20.0, lambda d: brute.held(d, 5), order)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], r["base_score"], r["score"]) for r in found.collect()), key=repr)
    wanted = sorted(((d, n, k, t, brute.held(d, 5), b, s) for (d, _), (n, k, t, b, s) in zip(data, expected)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in wanted], rtol=1e-9)


@pytest.mark.parametrize("bucket_bytes", [100_000, 3_000, 5])
def test_scores_do_not_depend_on_the_number_of_buckets(spark, monkeypatch, bucket_bytes):
    """From a few buckets to far more than 65,536, where nearly each gram has its own."""
    monkeypatch.setattr(language_model, "BUCKET_BYTES", bucket_bytes)
    data = [(i, " ".join(rows.filler(i % 7, 60, 40))) for i in range(60)]
    found = {r["doc_id"]: r for r in language_model.score(rows.frame(spark, data), order=3).collect()}
    for (d, _), (n, k, t, b, s) in zip(data, brute.gram_scores(data, 100.0, lambda d: brute.held(d, 5), 3)):
        assert (found[d]["n_tokens"], found[d]["n_known"], found[d]["train_tokens"]) == (n, k, t)
        np.testing.assert_allclose([found[d]["base_score"], found[d]["score"]], [b, s], rtol=1e-9)


def _machine(texts, order, strength=5.0):
    """The automaton of texts that are all learned from, and each text as word numbers."""
    tokens, bounds = language_model._tokens(pa.array(texts))
    distinct, levels, start = language_model._asked(tokens, bounds, order)
    counts = np.zeros(len(distinct), np.int64)
    for index in levels:
        counts += np.bincount(index, minlength=len(distinct))
    counts[start], counts[distinct == 0] = len(texts), 0
    words = levels[0]
    n = len(words)
    model = language_model.automaton(counts, levels, start, bounds, n, len(np.unique(words)), strength)
    spans = np.cumsum([0, *(np.diff(bounds) - 1)])
    return model, [words[a:b].tolist() for a, b in zip(spans[:-1], spans[1:])]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_state_is_a_distribution(order):
    """All words together, with the share the root keeps for unseen ones, have probability 1 in each state."""
    model, texts = _machine(["a b c a b d", "a b c", "b b a", ""], order)
    words = sorted({w for t in texts for w in t})
    unseen = 1 - sum(10 ** model.weight[w] for w in words)
    end = texts[0][-1]
    over = {model.goes[end], *(model.goes[arc] for key, arc in model.arcs.items() if key % (model.root + 1) == end)}
    states = {model.first, *model.goes} - {model.root} - over  # nothing follows the end
    assert states or order == 1
    for state in states:
        total, fall, at = 0.0, 0.0, state
        for w in words:
            s, x = state, 0.0
            while s != model.root and (s * (model.root + 1) + w) not in model.arcs:
                x, s = x + model.falls[s], model.fails[s]
            total += 10 ** (x + model.weight[w if s == model.root else model.arcs[s * (model.root + 1) + w]])
        while at != model.root:
            fall, at = fall + model.falls[at], model.fails[at]
        assert total + 10**fall * unseen == pytest.approx(1.0)


def test_the_walk_carries_its_state():
    """The same word costs less after a known history than after a break, and the state is the longest seen history."""
    model, (text, *_) = _machine(["a b c d", "x b y", "x b y"], 3)
    a, b, c, d, end = text
    in_context = model.walk([a, b, c]) - model.walk([a, b])
    alone = model.walk([d, b, c]) - model.walk([d, b])
    assert in_context > alone
    state = model.first
    for w in (a, b):
        state = model.goes[w if state == model.root else model.arcs[state * (model.root + 1) + w]]
    assert model.fails[state] == b and model.fails[model.fails[state]] == model.root


def test_nothing_to_learn_from(spark):
    found = language_model.score(rows.frame(spark, [(1, "a b"), (2, None)]), out=F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found) == [(1, 0, 0), (3, 0, 0)]
    assert all(np.isfinite(r["score"]) for r in found)
    assert language_model.score(rows.empty(spark)).count() == 0


ENDINGS = {"xa": ("ska", "torv", "ilen", "bru"), "yo": ("queon", "lario", "mente", "usto"), "zi": ("zhu", "gwei", "pang", "xiao")}


def _speech(lang, seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice(ENDINGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(spark):
    data = [(i, _speech(lang, i, 5 + i % 60), lang) for i, lang in enumerate(sorted(ENDINGS) * 60)]
    odd = [(900, None, "xa"), (901, "", "xa"), (902, "12 34 !!", "yo"), (903, _speech("xa", 1, 40_000), None), (None, _speech("yo", 2, 50), "yo")]
    schema = "doc_id long, text string, lang string, margin string, version string"
    docs = spark.createDataFrame([(*r, "m", "v") for r in data + odd], schema).repartition(3)
    found = {r["doc_id"]: r for r in language_id.identify_held_out(docs).collect()}
    tested = [(i, lang) for i, _, lang in data if brute.held(i, 3)]
    assert np.mean([found[i]["lang_pred"] == lang for i, lang in tested]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(found[i]["rejected"] for i in (900, 901, 902))
    assert found[903]["lang_pred"] == "xa" and found[None]["lang_pred"] == "yo"
    assert all(r["held_out"] == brute.held(i, 3) for i, r in found.items())
    kept = language_id.in_known_language(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0 and kept.count() > 150


def test_copies_do_not_thin_the_sample(spark):
    """A language that is mostly copies of one text still learns from as many different texts as it may."""
    texts = [_speech("xa", i, 12) for i in range(150)]
    data = [(t, "xa") for t in texts] + [(texts[0], "xa")] * 20_000 + [(_speech("yo", i, 12), "yo") for i in range(60)]
    docs = spark.createDataFrame(data, "text string, lang string").repartition(3)
    found = language_id.learn(docs, pieces=100)
    held = [language_id.letters(t).encode() in found["xa"] for t in texts]
    assert sum(held) == 100
    assert all(language_id.letters(_speech("yo", i, 12)).encode() in found["yo"] for i in range(60))


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify_held_out(docs).collect()] == [("und", 0.0)]
    assert language_id.identify_held_out(docs.where("false")).count() == 0


PAGE = (
    '<html><head><title>No</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
    "<article><h1>A &amp; B</h1><p><b>First   words\n here<br>and there.<p>Second&nbsp;part</p><footer>by me</footer></article>"
    '<section class="comments"><p>I think this is a very good article, and I say so at length.</p></section><footer>&copy; host</footer></body></html>'
)


def test_main_text(spark):
    plain = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    pages = [(1, "u", PAGE), (2, "u", plain), (3, None, None), (4, "u", ""), (5, "u", "no markup, but a sentence that is long enough to be one."), (6, "u", PAGE[: PAGE.index("Second") + 9]), (None, "u", "<p>x" * 3000), (1, "u", PAGE)]
    frame = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, n int").repartition(2)
    model = html_tree.learn(frame)
    got = sorted(((r["page_id"], r["text"]) for r in html_tree.extract(frame, model).collect()), key=repr)
    body = "A & B First words here and there. Second part"
    texts = dict(got)
    assert texts[1] == texts[2] == body and got.count((1, body)) == 2
    assert (texts[3], texts[4]) == ("", "") and texts[5].startswith("no markup") and texts[6] == body[: body.index("Second") + 6] + "&nb"
    assert len(texts[None]) > 0
    assert html_tree.extract(frame.where("false"), html_tree.learn(frame.where("false"))).count() == 0


def _model(*pages):
    counts = {}
    for page in pages:
        nodes = html_tree.parse(page)
        states = html_tree.label(nodes)
        if states:
            html_tree.tally(nodes, states, counts)
    model = html_tree.fit(counts)
    for _ in range(4):
        again = {}
        for page in pages:
            nodes = html_tree.parse(page)
            states = html_tree.label(nodes)
            if states:
                html_tree.tally(nodes, states, again, model)
        model = html_tree.fit(again)
    return model


@pytest.mark.parametrize("known", [False, True])
def test_messages_give_the_exact_marginals(known):
    """Sum-product on a small tree against the sum over all labelings, also with some states known."""
    import itertools
    import math

    nodes = html_tree.parse('<body><div class="ad"><p>buy now</p></div><article><p>some words that say a thing or two.</p>loose</article></body>')
    texts = {i: html_tree.clean(n) for i, n in enumerate(nodes) if not n.tag}
    found, kind, model = html_tree.evidence(nodes, texts), html_tree.kinds(nodes), _model(PAGE)
    fixed = [html_tree.WRAPPER, html_tree.WRAPPER] + [html_tree.LATENT] * (len(nodes) - 2) if known else None
    weights, ones, pairs = 0.0, np.zeros((len(nodes), 3)), np.zeros((len(nodes), 3, 3))
    for states in itertools.product(html_tree.STATES, repeat=len(nodes)):
        if known and any(f not in (html_tree.LATENT, s) for f, s in zip(fixed, states)):
            continue
        w = model.root[kind[0]][states[0]]
        for i, n in enumerate(nodes):
            w += sum(found[i][1] * model.seen.get(f, (0.0, 0.0, 0.0))[states[i]] for f in found[i][0])
            if i:
                w += model.step[kind[i]][states[n.parent]][states[i]]
        weights += math.exp(w)
        for i, s in enumerate(states):
            ones[i, s] += math.exp(w)
            if i:
                pairs[i, states[nodes[i].parent], s] += math.exp(w)
    belief, both = html_tree.beliefs(nodes, found, model, fixed)
    np.testing.assert_allclose(belief, ones / weights, atol=1e-12)
    np.testing.assert_allclose(both[1:], pairs[1:] / weights, atol=1e-12)


BODY = "<h1>A head</h1><p>Some words that say a thing or two.</p>{}<p>And a last sentence that ends it.</p>"
TEXT = "A head Some words that say a thing or two. {}And a last sentence that ends it."


def _page(inner="", article='<article class="{}">', name="x", beside=""):
    return f'<body><nav><a href="/">Home</a></nav>{article.format(name)}{BODY.format(inner)}</article>{beside}<footer>by host</footer></body>'


def test_learning_decides_over_the_word_list():
    """A listed word that pages use for their article is kept, an unlisted one that they use elsewhere goes."""
    boxes = '<div class="zork"><p>You may want to know this as well.</p></div>'
    learned = _model(*[_page(name="widget", beside=boxes.replace("know", f"know {i}")) for i in range(80)])
    bare = html_tree.fit({})
    listed = f'<body><div class="widget">{BODY.format("")}</div></body>'
    assert html_tree.main_text(listed, learned) == TEXT.format("")
    assert html_tree.main_text(listed, bare) == ""
    unlisted = f"<body><div>{BODY.format('')}</div>{boxes}</body>"
    assert html_tree.main_text(unlisted, learned) == TEXT.format("")
    assert html_tree.main_text(unlisted, bare) != TEXT.format("")
    assert html_tree.main_text(_page(boxes), learned) == TEXT.format("")  # within an article too, though structure says nothing there


@pytest.mark.parametrize(
    "inner, kept",
    [
        ('<div class="ad"><p>Buy this now, it is a very good thing.</p></div>', ""),
        ('<section class="comments">' + "<p>I think this is a very good article, I say so.</p>" * 30 + "</section>", ""),
        ("<article><p>A nested article is a reader's comment.</p></article>", ""),
        ("<aside><p>See this one too.</p></aside>", ""),
        ("<form>Your mail <p>for news</p></form>", ""),
        ('<div class="more"><p>More of it here.</p></div>', "More of it here. "),
        ('<section id="legal"><p>Words on law.</p></section>', "Words on law. "),
        ("<header><h2>Sub</h2></header>", "Sub "),
        ("<ul>" + "<li>One</li>" * 12 + "</ul>", "One " * 12),
        ("<table><tr><td>1<td>2</table>", "1 2 "),
    ],
)
def test_parts_within_the_article(inner, kept):
    learned = _model(*[_page(beside=f'<div class="ad">Words {i} to sell a thing.</div>') for i in range(60)])
    for model in (learned, html_tree.fit({})):
        assert html_tree.main_text(_page(inner, beside="<div>other words outside</div>"), model) == TEXT.format(kept)


def test_deep_pages_take_linear_time():
    import time

    def taken(n):
        start = time.perf_counter()
        assert html_tree.main_text("<div>" * n + "<p>words here" + "</span></p></em></section>" * n, html_tree.fit({})) in ("", "words here")
        return time.perf_counter() - start

    taken(1_000)
    assert taken(64_000) < 24 * taken(8_000)


def test_copies_of_a_page_teach_once(spark):
    """A page that fills most of the table neither crowds out the others nor is parsed more than once."""
    pages = [(_page(name=f"n{i}", beside='<div class="zork">Words to sell.</div>'),) for i in range(30)] + [(_page(),)] * 3000 + [(None,)]
    model = html_tree.learn(spark.createDataFrame(pages, "html string").repartition(4), sample=1_000)
    assert model == html_tree.learn(spark.createDataFrame(pages[:31], "html string"), sample=1_000)
    assert model.seen["word=zork"][html_tree.MAIN] < -1


def _vectors(spark, points):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    data += [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [None] * 8), (9005, []), (9006, [1.0, 2.0]), (None, [1.0] * 8), (9007, [float("inf")] * 8)]
    return spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<float>, i int, v int").repartition(3)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 2
    points = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)), np.tile(centres[:1], (300, 1))])
    points = points.astype(np.float32).astype(float)
    vectors = _vectors(spark, points)
    found = multi_index.search(vectors, vectors.where("vec_id % 50 = 0"), k=10, cells=16).collect()
    shared = []
    for q in range(0, len(points), 50):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        exact = points @ points[q]
        order = [int(i) for i in np.lexsort((np.arange(len(points)), -np.round(exact, 9))) if i != q][:10]
        assert [g[0] for g in got] == list(range(1, 11))
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        np.testing.assert_allclose([g[2] for g in got], exact[[g[1] for g in got]], rtol=1e-12)
        shared.append(len(set(order) & {g[1] for g in got}) / 10)
    assert np.mean(shared) >= 0.9
    everything = multi_index.search(vectors, vectors.where("vec_id = 900"), k=10, cells=16, visit=2.0).orderBy("rank").collect()
    exact = points @ points[900]
    assert [r["vec_id"] for r in everything] == [int(i) for i in np.lexsort((np.arange(len(points)), -np.round(exact, 9))) if i != 900][:10]


def test_a_repeated_query_is_answered_once(spark):
    points = np.random.default_rng(7).normal(size=(60, 8))
    vectors = _vectors(spark, points)
    once = vectors.where("vec_id in (3, 4)")
    repeated = once.union(vectors.where("vec_id = 3")).union(vectors.where("vec_id = 3"))
    search = lambda q: multi_index.search(vectors, q, k=10, cells=4, visit=2.0)
    got = rows.collected(search(repeated), "query_id", "rank", "vec_id")
    assert got == rows.collected(search(once), "query_id", "rank", "vec_id")
    assert len({v for q, _, v in got if q == 3}) == 10


def test_few_or_no_vectors(spark):
    vectors = _vectors(spark, np.eye(8)[:3])
    found = multi_index.search(vectors, vectors, k=20).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in found) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert multi_index.search(vectors.where("false"), vectors).count() == 0
    assert multi_index.search(vectors, vectors.where("false")).count() == 0
