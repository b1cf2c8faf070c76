"""Jaccard join, nearest neighbours, quality, HTML, packing, pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventide.llm import ann, html_text, jaccard_join, packing, quality

VOCAB = [f"w{i}" for i in range(400)]


# -- n-gram Jaccard join ------------------------------------------------------------------------------------


def word_sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def jaccard_reference(rows, t=0.8):
    """(id, text) -> Counter of (id, class, links, copies)."""
    rows = [(i, word_sets(x)) for i, x in rows]
    groups = defaultdict(list)
    for i, s in rows:
        if s and i is not None:
            groups[s].append(i)
    sets = list(groups)
    parent, links = list(range(len(sets))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a, s in enumerate(sets):
        r = find(a)
        least[r] = min([least.get(r, min(groups[s])), *groups[s]])
    index = {s: a for a, s in enumerate(sets)}
    out = []
    for i, s in rows:
        if i is None:
            out.append((None, None, 0, 1))
        elif s is None:
            out.append((i, i, 0, 1))
        else:
            a = index[s]
            out.append((i, least[find(a)], links[a], len(groups[s])))
    return Counter(out)


def near_copies(seed, bases, copies):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(40, 160))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(VOCAB)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [4, 512])
def test_classes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies(1, 12, 9) + ["alone " + " ".join(random.Random(i).choices(VOCAB, k=50)) for i in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(docs).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == jaccard_reference(rows)


def test_classes_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(odd_docs).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == jaccard_reference(rows)
    assert jaccard_join.jaccard_classes(no_docs).count() == 0


def test_registered_join_and_packing(spark, odd_docs, no_docs, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    no_docs.write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    at, empty = str(tmp_path), str(tmp_path / "empty")
    assert Counter(tuple(r) for r in jaccard_join.op1_jaccard_join(spark, at).select("doc_id", "class_id", "n_links", "n_copies").collect()) == jaccard_reference(rows)
    check_packing(packing.op10_packing(spark, at).collect(), rows, packing.WINDOW)
    assert jaccard_join.op1_jaccard_join(spark, empty).count() == packing.op10_packing(spark, empty).count() == 0


def test_posterior_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches()
    rng = np.random.default_rng(0)
    hits = rng.random((20_000, jaccard_join.HASHES)) < 0.8
    kept = np.ones(len(hits), bool)
    for i, m in enumerate(least):
        kept &= hits[:, : (i + 1) * jaccard_join.STEP].sum(axis=1) >= m
    assert kept.mean() > 0.99
    low = rng.random((2_000, jaccard_join.HASHES)) < 0.3
    assert not any((low[:, : (i + 1) * jaccard_join.STEP].sum(axis=1) >= m).any() for i, m in enumerate(least[2:], 2))


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = jaccard_join.signature(np.unique(np.concatenate([shared, a]))), jaccard_join.signature(np.unique(np.concatenate([shared, b])))
    assert abs((x == y).mean() - 0.6) < 0.15


# -- nearest neighbours -------------------------------------------------------------------------------------


def brute_nearest(ids, x, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        out[int(ids[q])] = [int(i) for _, i in sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])][:k]
    return out


def test_recall_of_random_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((9000, 32)) * rng.uniform(0.5, 2, (9000, 1))
    ids = np.arange(9000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, minimum=1500).toPandas()
    found = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")}
    want = brute_nearest(ids, x)
    assert found.keys() == want.keys()
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("lengths", ["lognormal", "one long"])
def test_recall_where_lengths_differ(spark, lengths):
    rng, n = np.random.default_rng(4), 20_000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.lognormal(0, 1, (n, 1)) if lengths == "lognormal" else np.where(np.arange(n) == 7, 10.0, 1.0)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    recalls = []
    for q, g in ann.nearest(df, F.col("vec_id") % 400 == 0).toPandas().groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        recalls.append(len(set(g["vec_id"]) & set(np.argsort(-s)[:20])) / 20)
    assert len(recalls) == 50 and np.mean(recalls) >= 0.96 and min(recalls) >= 0.7


def test_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 0.0]), (9, [1.0]), (None, [9.0, 9.0]), (1, [1.0, 0.0]), (20, [0.0, -0.0]), (40, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (0, 4, 40, -1.0), (40, 1, 3, -0.5), (40, 2, 0, -1.0), (40, 3, 1, -1.0), (40, 4, 2, -1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_yields_what_is_asked_for():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 8))
    d = ann.planes(8)
    forest = ann.Forest(x, d)
    for rows in forest.candidates(ann.strings(x[:5], d), 100):
        assert 100 <= len(rows) <= 500


@pytest.mark.parametrize("size, share", [("sf0.01", 0.2), ("sf0.1", 0.1)])
def test_recall_of_the_registered_query(spark, size, share):
    """With a tenth (a fifth) of the rows compared: recall of at least 0.9, exact scores, ranks by score and then id."""
    where = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    assert ann.FACTOR * math.sqrt(ann.K * len(ids)) / len(ids) <= share
    at, got = {int(i): j for j, i in enumerate(ids)}, ann.op6_nearest(spark, where).toPandas().sort_values(["query_id", "rank"])
    recalls = []
    assert sorted(got["query_id"].unique()) == [i for i in ids if i % 20 == 0]
    for q, g in got.groupby("query_id"):
        scores = x @ x[at[q]]
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], scores[[at[i] for i in g["vec_id"]]], rtol=0, atol=1e-12)
        assert g[["score", "vec_id"]].values.tolist() == sorted(g[["score", "vec_id"]].values.tolist(), key=lambda r: (-r[0], r[1]))
        scores[at[q]] = -np.inf
        recalls.append((g["score"] >= np.sort(scores)[-20] - 1e-12).mean())
    assert np.mean(recalls) >= 0.9


def test_equal_vectors_are_found_by_their_least_ids(spark):
    """A third of all rows are one vector: its neighbours are the least ids, those of others are not crowded out."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16))
    x[::3] = x[0]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(3000), "embedding": x.tolist()}))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got["query_id"] == 0]["vec_id"].tolist() == [3 * i for i in range(1, 21)]
    assert got[got["query_id"] == 300]["vec_id"].tolist() == [3 * i for i in range(20)]
    recalls = []
    for q, g in got[got["query_id"] % 3 > 0].groupby("query_id"):
        want = sorted(range(3000), key=lambda j: (-round(float(x[j] @ x[q]), 12), j))
        recalls.append(len(set(g["vec_id"]) & set([j for j in want if j != q][:20])) / 20)
    assert len(recalls) == 20 and np.mean(recalls) >= 0.9


def test_every_query_block_meets_every_forest(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(9)
    x, ids = rng.standard_normal((400, 8)), np.arange(400)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, minimum=400).toPandas().sort_values(["query_id", "rank"])
    assert {q: g["vec_id"].tolist() for q, g in got.groupby("query_id")} == brute_nearest(ids, x)


# -- quality ------------------------------------------------------------------------------------------------


def graded(n, seed):
    rng = random.Random(seed)
    good = [". ".join(" ".join(rng.choices(VOCAB, k=9)) for _ in range(rng.randint(2, 20))) for _ in range(n)]
    bad = [" ".join(rng.choices(VOCAB, k=rng.randint(5, 200))).upper() + "!!" * rng.randint(1, 30) + "$$%%" * rng.randint(3, 40) for _ in range(n // 3)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


def test_held_out_accuracy(spark, tmp_path):
    rows = graded(900, 4)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = quality.op7_quality_classifier(spark, str(tmp_path)).toPandas().set_index("doc_id").sort_index()
    y = np.array([q for _, q in rows])
    assert (out["held_out"].to_numpy() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index]).all()
    assert out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= 0.3)).all()
    held = out["held_out"].to_numpy()
    assert (out["predicted"].to_numpy()[held] == y[held]).mean() > 0.97


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    stats = quality.statistics_of(odd_docs, ["doc_id"])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(stats, labels)
    scores = [r["s"] for r in stats.select(quality.score_column(model).alias("s")).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    kept = odd_docs.where(quality.text_score_column(model) >= 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    undecided = quality.train(stats, labels.where("quality = 1"))
    assert isinstance(undecided, quality.Undecided)
    assert quality.statistics_of(no_docs, ["doc_id"]).count() == 0


def test_fit_matches_plain_numpy(spark):
    """Sums over the labelled rows outside the fold, means, shrinkage, factors and scores, step by step."""
    rows = [(i, t) for i, (t, _) in enumerate(graded(60, 8))] + [(3, "A second text of one id."), (None, "no id")]
    marks = [(i, y) for i, (_, y) in enumerate(graded(60, 8))] + [(1, 0), (2, None), (None, 1)]
    stats = quality.statistics_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"])
    model = quality.train(stats, spark.createDataFrame(marks, "doc_id long, quality int"))
    x, y = [], []
    for i, t in rows:
        for j, q in marks:
            if i is not None and i == j and q is not None and zlib.crc32(str(i).encode()) % 5:
                x.append(quality.statistics(t))
                y.append(q)
    x, y = np.array(x), np.array(y)
    parts = [x[y == c] for c in (0, 1)]
    cov = [np.cov(p, rowvar=False, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, cov, strict=True)) / len(x)
    for c in (0, 1):
        s = (1 - quality.TO_POOLED) * cov[c] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_SPHERE) * s + (quality.TO_SPHERE * np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
        assert np.allclose(model.means[c], parts[c].mean(axis=0))
        assert np.allclose(model.inverse[c] @ s @ model.inverse[c].T, np.eye(len(s)), atol=1e-5)
        assert model.log_det[c] == pytest.approx(np.linalg.slogdet(s)[1], abs=1e-5)
        assert model.log_prior[c] == pytest.approx(math.log(len(parts[c]) / len(x)))


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    cov = [np.cov(rng.standard_normal((d, 50))) + np.eye(d) for _ in range(2)]
    means, prior = rng.standard_normal((2, d)), np.log([0.3, 0.7])
    inv = np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in cov])
    m = quality.Discriminant(prior, means, inv, np.array([np.linalg.slogdet(c)[1] for c in cov]))
    x = rng.standard_normal((5, d))
    dens = [[np.exp(prior[c] - 0.5 * (v - means[c]) @ np.linalg.solve(cov[c], v - means[c]) - 0.5 * np.linalg.slogdet(cov[c])[1]) for c in (0, 1)] for v in x]
    assert np.allclose(m.scores(x), [b / (a + b) for a, b in dens])


# -- HTML ---------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>Site: title</title><style>p{a:b}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class="cookie-notice">We use cookies, please accept.</div>
<article><h1>The   headline</h1><p><b>First paragraph, with &amp; and &eacute;.<br><p>Second one\nover two lines. <a href=x>A link</a> inside.</p><div class="ad">Buy now, cheap!</div>
<blockquote>Quoted words.</blockquote><ul><li>point one<li>point two</ul><table><tr><td>cell a<td>cell b</table></article>
<section id="comments"><p>Great article, thanks a lot for it!</p></section><aside><p>Recent posts, of great interest.</p></aside><form><p>Your name</p><input></form><footer>&copy; me</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The headline\nFirst paragraph, with & and é.\nSecond one over two lines. A link inside.\nQuoted words.\npoint one\npoint two\ncell a\ncell b"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>var x = 1;", "<a 'x>y", "</div></p>", "&#xD800;&bogus;", "<div " * 50])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_page_without_article_element():
    page = "<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div id=content><h2>Head</h2>" + "".join(f"<p>Paragraph {i}, with some words in it. And more of them.</p>" for i in range(5)) + "</div><div><a href=3>More</a></div></body>"
    text = html_text.main_text(page)
    assert text.startswith("Head\nParagraph 0") and text.count("\n") == 5 and "One" not in text and "More" not in text


SENTENCES = [f"Sentence {i} of the text, with some words in it. And more of them, to be sure." for i in range(9)]
BODY = "".join(f"<p>{s}</p>" for s in SENTENCES)


@pytest.mark.parametrize("page", [
    f'<body><article class="post has-sidebar">{BODY}</article><div class="sidebar"><p>Recent posts, of great interest.</p></div></body>',
    f'<body><div id="main" class="no-sidebar">{BODY}</div><div class="ad">Buy now, cheap!</div></body>',
    f'<body><div class="widget-content">{BODY}</div></body>',
    f'<body><form id="aspnetForm"><div class="menu"><a href=1>One</a></div><div id="x">{BODY}</div></form></body>',
    f'<body><main><h1></h1><div class="has-sidebar">{BODY}<div class="comments"><p>Great, thanks!</p></div></div></main></body>',
    "<body><p>" + "Home page, all rights kept. " * 2 + "</p>" + "".join(f'<section class="widget">{BODY[i * len(BODY) // 3 : (i + 1) * len(BODY) // 3]}</section>' for i in range(3)) + "</body>",
])
def test_names_do_not_delete_the_article(page):
    text = html_text.main_text(page)
    assert [s for s in SENTENCES if s not in text] == []
    assert not any(s in text for s in ("Recent", "Buy now", "One", "Great, thanks"))


def test_long_comments_beside_an_article_stay_out():
    page = f'<body><article><p>{SENTENCES[0]}</p><p>{SENTENCES[1]}</p></article><div class="comments">{BODY.replace("Sentence", "Comment")}</div></body>'
    assert html_text.main_text(page) == "\n".join(SENTENCES[:2])


def test_second_section_and_headline_beside_the_body_stay():
    cut = 7 * len(BODY) // 9
    page = f'<body><div class="menu"><a href=1>One</a></div><div id=content><div class=sec>{BODY[:cut]}</div><div class=sec><h2>More</h2>{BODY[cut:]}</div></div></body>'
    assert html_text.main_text(page) == "\n".join([*SENTENCES[:7], "More", *SENTENCES[7:]])
    page = f'<body><div id=page><div class=top><h1>The headline</h1></div><div class=body>{BODY}</div></div></body>'
    assert html_text.main_text(page) == "\n".join(["The headline", *SENTENCES])


def test_links_count_by_paths_and_lists():
    page = f"""<body><article><h1><a href=1>The headline</a></h1>{BODY}<ul><li><a href=2>A linked item</a><li>An item of plain words, a good deal longer</ul>
    <p class=source><a href=3>Source</a></p><ul><li><a href=4>Share this</a><li><a href=5>Print this</a></ul><div class=more><a href=6>Next page</a></div></article></body>"""
    assert html_text.main_text(page) == "\n".join(["The headline", *SENTENCES, "A linked item", "An item of plain words, a good deal longer", "Source"])


@pytest.mark.parametrize("page, want", [
    (f'<body><div class="layout has-sidebar"><article>{BODY}</article></div></body>', SENTENCES),
    (f'<body><main class="no-comments">{BODY}</main></body>', SENTENCES),
    (f'<body><article>{BODY}<p class="legal">This is the law, as it stands.</p></article></body>', [*SENTENCES, "This is the law, as it stands."]),
    (f'<body><article>{BODY}<p><a href=1>A paragraph that is nearly all a link</a>, see there.</p></article></body>', [*SENTENCES, "A paragraph that is nearly all a link, see there."]),
    (f'<body><article>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article></body>', [*SENTENCES, "So x=2 holds."]),
    (f'<body><article>{BODY}<table><tr><td>1<td>2</table><div>A caption</div></article><div>A line that is not</div></body>', [*SENTENCES, "1", "2", "A caption"]),
    (f'<body><aside>{BODY}</aside><footer>(c) me</footer></body>', SENTENCES),
    ('<body><nav><a href=1>One</a></nav><article></article><footer>All rights kept, and more of it.</footer></body>', []),
])
def test_whole_articles_stay(page, want):
    assert html_text.main_text(page).split("\n") == (want or [""])


class PlainTree(HTMLParser):
    """Blocks of a page as (path of (tag, class) pairs, text, length inside links); for pages of a few tags."""

    def __init__(self, page):
        super().__init__()
        self.path, self.blocks, self.text, self.linked = [], [], "", ""
        self.feed(page)
        self.close()
        self.end_block()

    def end_block(self):
        path = tuple(p for p in self.path if p[0] not in ("a", "b"))
        if self.text.split() and not {"script", "style", "head"} & {t for t, _ in path}:
            self.blocks.append((path, " ".join(self.text.split()), len(self.linked)))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in ("meta", "link"):
            if tag not in ("a", "b"):
                self.end_block()
                if "p" in [t for t, _ in self.path]:
                    self.handle_endtag("p")
            self.path.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.path]:
            if tag not in ("a", "b"):
                self.end_block()
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text += data
        if "a" in [t for t, _ in self.path]:
            self.linked += " ".join(data.split())


def plain_main_text(page):
    """What the contract asks for on the given pages: the blocks of the article element."""
    return "\n".join(t for p, t, _ in PlainTree(page).blocks if "article" in [x for x, _ in p])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_pages_against_a_plain_version(spark, size):
    got = html_text.op8_html_extraction(spark, f"/root/testdata/{size}").collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").collect()}
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], plain_main_text(page["html"]), len(r["text"])), r["page_id"]


def test_the_ratios_choose(spark, monkeypatch):
    """Ratios without nudges get nearly all pages right, nudges with equal ratios nearly none; telling tags and names are not needed."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = [plain_main_text(p) for p in pages]
    count = lambda pages: sum(html_text.main_text(p) == t for p, t in zip(pages, right, strict=True))
    bare = [re.sub(r"<(/?)(nav|footer|article)\b", r"<\1div", p).replace(' class="ad"', "") for p in pages]
    assert count(bare) > 0.95 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "path_ratios", lambda blocks, factor: html_text.smoothed(blocks))
        assert count(pages) > 0.98 * len(pages)
    monkeypatch.setattr(html_text, "path_ratios", lambda blocks, factor: dict(factor))
    assert count(pages) < 0.05 * len(pages)


REMARKS = "".join(f"<p>I think so too, remark {i}, and thanks for it.</p>" for i in range(20))
ABOUT = "".join(f"<p>About me {i}: I write here of this and that, often.</p>" for i in range(12))
SHORT = f"<p>{SENTENCES[0]}</p><p>{SENTENCES[1]}</p>"


@pytest.mark.parametrize("page, want", [
    (f'<body><nav><a href=1>Home</a></nav><article>{BODY}<p class="ad-hoc">An ad-hoc paragraph, short.</p><p id="hidden-gems">Hidden gems are here.</p></article></body>', [*SENTENCES, "An ad-hoc paragraph, short.", "Hidden gems are here."]),
    (f"<body><article>{BODY}<ul><li><a href=1>Report of the council</a><li><a href=2>Map of the bridge</a></ul></article></body>", [*SENTENCES, "Report of the council", "Map of the bridge"]),
    (f'<body><article>{SHORT}</article><div class="comments">{REMARKS}</div></body>', SENTENCES[:2]),
    (f'<body><div class="post">{SHORT}</div><section class="comments">{REMARKS}</section></body>', SENTENCES[:2]),
    (f'<body><main><h1>Head</h1>{SHORT}<section id="comments"><h2>Comments</h2>{REMARKS}</section></main></body>', ["Head", *SENTENCES[:2]]),
    (f'<body><div class="post">{SHORT}</div><div class="sidebar">{ABOUT}</div></body>', SENTENCES[:2]),
    (f'<body><div id="cookie-notice"><p>We use cookies, and so do our partners. Accept them all, please.</p></div><div><h1>Head</h1>{BODY}</div></body>', ["Head", *SENTENCES]),
    (f'<body><div class="comments">{BODY}</div><footer>(c) me</footer></body>', SENTENCES),
    ("<body><nav><a href=1>Home</a></nav><article><h1>Hi</h1><p>Ok.</p></article><footer>All rights kept, by us, and for long.</footer></body>", ["Hi", "Ok."]),
])
def test_names_nudge_and_do_not_decide_alone(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_deep_pages_stay_linear():
    assert html_text.main_text("<div>x. " * 20_000).count("x.") > 10_000


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None), (2, "v", "plain words", None)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, ["page_id", "url"]).collect()
    assert Counter(r["page_id"] for r in got) == Counter([1, 1, None, 2])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 2} == {"plain words"}
    assert html_text.extract(pages.limit(0), ["page_id"]).count() == 0


# -- packing ------------------------------------------------------------------------------------------------


def check_packing(rows, docs, window):
    lib = Tokenizer.from_file(packing.VOCABULARY)
    want = Counter()
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [packing.END]
        for a in range(0, len(ids), window):
            part = ids[a : a + window]
            want[i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return sum(sum(n for _, n in s) for s in seqs.values()) / (len(seqs) * window), seqs


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_packing(packing.pack(odd_docs, window=64).collect(), docs, 64)
    assert packing.pack(no_docs).count() == 0


def test_packing_over_many_partitions_leaves_little_padding(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(1, 60)))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    rows = packing.pack(df, window=128, open_windows=8).collect()
    full, seqs = check_packing(rows, docs, 128)
    assert full > 0.95


def test_words_match_the_library():
    lib, cache = Tokenizer.from_file(packing.VOCABULARY), packing.word_cache(packing.VOCABULARY)
    rng = np.random.default_rng(7)
    alphabet = ["a", "b", " ", "\n", "'", "'s", "é", "é", "́", "日本", "1", "23", "!", "<|endoftext|>", "<|endo", " ", "I'LL", "😀", "The", "\x1c", "\x85", "Σ", "ΑΣ ", "İ", "​", "²", "ß", "ﬁ", "Word.", "word,"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 12))) for _ in range(4000)]
    for t, packed in zip(texts, cache.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


# -- the pipeline -------------------------------------------------------------------------------------------


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    from test_text_operators import line_reference

    rows = graded(120, 9)
    texts = [t + "\nA line that all share.\n" for t, _ in rows] + near_copies(3, 5, 4) + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "packing"]
    d = str(tmp_path)
    kept = stages["quality_classifier"](spark, docs, d).cache()
    model = quality.train(quality.statistics_of(docs, ["doc_id"]), labels)
    want = [i for i, t in enumerate(texts) if model.scores(np.array([quality.statistics(t or "")]))[0] >= quality.THRESHOLD]
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    cut = stages["line_dedup"](spark, kept, d).cache()
    assert cut.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter((i, t) for i, _, _, t in line_reference([(r["doc_id"], r["text"]) for r in kept.collect()], 10))
    one = stages["ngram_jaccard_join"](spark, cut, d)
    expected = jaccard_reference([(r["doc_id"], r["text"]) for r in cut.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, c, _, _ in expected if i == c)
    assert one.columns == docs.columns
    final = corpus_pipeline.run(spark, d).collect()
    check_packing(final, [(r["doc_id"], r["text"]) for r in one.collect()], packing.WINDOW)


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Null ids, an id with two texts, repeated rows, nulls in every column, extra columns; and an empty table."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, None) for i in range(14)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    stages, d = dict(corpus_pipeline.STAGES), str(tmp_path / "odd")
    one = stages["ngram_jaccard_join"](spark, odd_docs, d)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    leads = {i for i, c, _, _ in jaccard_reference(rows) if i is not None and i == c}
    assert one.columns == odd_docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == Counter({(i, t) for i, t in rows if i in leads}) + Counter((i, t) for i, t in rows if i is None)
    kept = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == odd_docs.columns
    check_packing(corpus_pipeline.run(spark, d).collect(), [(r["doc_id"], r["text"]) for r in kept.collect()], packing.WINDOW)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
