"""Operators 11, 12 and 13 against plain Python: hand-made pages, numpy's eigenvectors, counted phrases."""

from __future__ import annotations

import collections
import os
import random
import re
import sys

import numpy as np
import pytest
from conftest import oracle, same

sys.path.insert(0, os.path.dirname(__file__))

from cladeflow.llm import html, phrases, queries, whitening  # noqa: E402


# 11: pages


def shop(i: int, body: str) -> str:
    """A site that says what its parts are by names."""
    return f"""<!DOCTYPE html><HTML lang=en><head><title>Page {i}</title><style>p{{margin:0}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>The Site</h1></header><nav><ul><li><a href="/a{i}">One {i}</a></li><li><a href='/b'>Two</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div>
<div id="content-{i}"><article class="post"><header><h1>Title {i} &amp; more</h1><span>by someone</span></header>{body}<div class="ad">Buy {i}</div><form><label>Name</label><input name=x></form>
<section class="comments"><article><p>First comment {i}</p></article></section></article></div><aside>Also read {i}</aside><footer>&copy; site</footer></body></HTML>"""


def plain(i: int, body: str) -> str:
    """A site without names: what all pages have is template, a list of links is a menu."""
    links = "".join(f"<td><a href=x>{w} {i}</a></td>" for w in ("red", "green", "blue"))
    return f"<html><body><table><tr>{links}</tr></table><div><b>Welcome to our site</b></div><div>{body}</div><div>All rights reserved</div></body></html>"


CASES = [
    ("<p>One <b>bold</b> word,&nbsp;a&lt;b &eacute;&#233;</p><p>two\n\t lines<br>here</p>", "One bold word, a<b éé two lines here"),
    ("<p><b>Never closed.<br><p>Next<p>Last", "Never closed. Next Last"),
    ("<ul><li>x<li>y</ul><!-- no <p>this</p> --><table><tr><td>c1<td>c2</table>", "x y c1 c2"),
    ("<script>if (a<b) document.write('<p>no</p>')</script>text<noscript>none</noscript> goes on", "text goes on"),
    ("<p title='a > b'>a quoted sign</p> 3 < 4 and 5 > 4", "a quoted sign 3 < 4 and 5 > 4"),
    ("<P>UP</P><DIV HIDDEN>gone</DIV><div style='display: none'>gone</div><p>" + "long " * 5000 + "</p>", "UP " + ("long " * 5000).strip()),
]


@pytest.fixture(scope="module")
def pages():
    rows, want = [], {}
    for i in range(24):
        body, text = CASES[i % len(CASES)]
        rows.append((i, f"https://shop.example.com/{i}", shop(i, body), i))
        want[i] = f"Title {i} & more {text}"
        rows.append((100 + i, f"http://plain.example.org:80/{i}", plain(i, f"<p>story {i} {'abcdefgh'[i % 8]}</p>{body}"), i))
        want[100 + i] = f"story {i} {'abcdefgh'[i % 8]} {text}"
    rows += [(200, None, None, 0), (201, "", "", 0), (202, "not a url", "<p>alone</p>", 0), (203, "http://[bad", "just text &amp; no tags", 0), (None, "https://one.example.net", "<main><p>in main</p></main><p>out</p>", 0)]
    rows += [(204, "https://shop.example.com/cut", shop(9, "<p>cut off here")[: shop(9, "<p>cut off here").index("here")] + "<di", 0), (205, "https://shop.example.com/cut", "<article>same</article>", 0), (205, "https://shop.example.com/cut", "<article>same</article>", 0)]
    want |= {200: "", 201: "", 202: "alone", 203: "just text & no tags", None: "in main", 204: "Title 9 & more cut off", 205: "same"}
    return rows, want


@pytest.mark.parametrize("small", [html.SMALL, -1])
def test_main_text(spark, pages, small, monkeypatch):
    """Both ways that templates come to pages."""
    monkeypatch.setattr(html, "SMALL", small)
    rows, want = pages
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = html.extract_main_text(df).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_templates(spark, pages):
    """Tokens of every page once make one valid class; what pages repeat at will makes others, nested in it; unordered tokens make none."""
    rows = [(i, f"http://h/{i}", f"<html><body><div class=a>Fixed</div><ul>{'<li><i>x</i></li>' * (1 + i % 3)}</ul>" + ("<h2>q</h2><h3>r</h3>" if i % 2 else "<h3>r</h3><h2>q</h2>") + f"<p>{i}</p></body></html>", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, url_ string, html_ string, n int")
    (row,) = html.deduced(df.select("url_", "html_")).collect()
    template = html.Template(row.told)
    codes = collections.defaultdict(set)
    for e in html.events(rows[0][2]):
        codes[e[1]].add(e[0])
    classes = collections.Counter(c for c, _, _ in template.tokens.values())
    assert len(classes) == 1  # the list's items; the class of all else has h2 and h3 in two orders
    assert classes.most_common(1)[0][1] == 5  # <li>, <i>, </i>, </li> and the text x
    steady = [(i, u, h.replace("<h3>r</h3><h2>q</h2>", "<h2>q</h2><h3>r</h3>"), n) for i, u, h, n in rows]
    (row,) = html.deduced(spark.createDataFrame(steady, df.schema).select("url_", "html_")).collect()
    sizes = sorted(collections.Counter(c for c, _, _ in html.Template(row.told).tokens.values()).values())
    assert len(sizes) == 2 and sizes[0] == 5 and sizes[1] > 10


# 12: whitening


def _vectors(n: int, d: int, seed: int) -> list:
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(d) * (1 + np.arange(d) / 7) + r.standard_normal() * 2).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "top", "straight"), [(300, 20, 4, 256), (300, 20, 4, 0), (50, 6, 32, 256), (9, 12, 32, 256)])
def test_whitening(spark, n, d, top, straight, monkeypatch):
    monkeypatch.setattr(whitening, "STRAIGHT", straight)
    rows = _vectors(n, d, 5) + [(1000, None), (1001, [1.0] * (d - 1) + [float("nan")]), (1002, [1.0] * (d - 1) + [None]), (1003, [float("inf")] * d), (1004, []), (1005, [1.0] * (d + 1)), (None, [0.5] * d), (900, [0.25] * d), (900, [0.25] * d)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, component int").repartition(3)
    got = whitening.whiten(df, top=top, guard=3).collect()
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for _, v in rows if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)])
    ids = [i for i, v in rows if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    c = x - x.mean(0)
    value, axes = np.linalg.eigh(c.T @ c / len(x))
    value, axes = value[::-1], axes[:, ::-1]
    k = min(top, d, int((value > 1e-9 * value[0]).sum()))
    white = c @ axes[:, :k] / np.sqrt(value[:k])
    deviation = [sum(int(len(x) * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0), strict=True)) for r in x]
    assert len(got) == len(x) * k
    found = collections.defaultdict(list)
    for r in got:
        assert r.n == len(x) and r.identity_error < 1e-10
        assert abs(r.explained - value[r.component - 1] / value.sum()) < 1e-12
        found[r.vec_id, r.component].append((r.whitened, r.deviation))
    for j in range(k):
        mine = np.array([found[i, j + 1][ids[:p].count(i)][0] for p, i in enumerate(ids)])
        assert min(np.abs(mine - white[:, j]).max(), np.abs(mine + white[:, j]).max()) < 1e-7
        assert [found[i, j + 1][ids[:p].count(i)][1] for p, i in enumerate(ids)] == deviation


def test_whitening_passes_are_certified(spark):
    rows, d = whitening.whole_vectors(spark.createDataFrame(_vectors(400, 40, 6), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    value, axes, told = whitening.components(whitening.Vectors(rows, d), 6, 4)
    assert len(told) > 2 and told[0] > 1e-4 and told[-1] <= whitening.ENOUGH  # from a random subspace down to rounding
    assert np.abs(axes.T @ axes - np.eye(6)).max() < 1e-12
    assert (np.diff(value) < 0).all()


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)).count() == 0  # no variance
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0


def test_whitening_of_wide_numbers(spark):
    rows = [(i, [1e14 * (i % 5), -2e13 * i, float(i)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), top=2).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(r[k] for r in x) for k in range(3)]
    assert max(map(abs, x[39])) * 40**2 > 2**31
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((40 * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(40)}


# 13: phrases


def _collocations(rows: list, threshold: int, longest: int, top: int, inside: int = 80) -> list:
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    count[lang or "und", tuple(w[i : i + n])] += 1
    often = {k: v for k, v in count.items() if v >= threshold}
    kept = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        score, _, left, right = min((2_000_000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k, often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p)))
        if not any(x == lang and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in often.items()):
            kept[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, found in kept.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["the", "The", "of", "née", "日本", "a", "b", "x y", "#1", "it's"]
    fixed = ["new york city hall", "once upon a time", "of the"]
    rows = []
    for i in range(90):
        t = "".join(r.choice([*words, *fixed]) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?"]) for _ in range(r.choice([0, 1, 3, 20, 60])))
        rows.append((r.choice(["en", "en", "de", None, "und"]), t))
    return [*rows, ("en", None), (None, None), ("fr", ""), ("fr", " ., "), ("en", "new york city hall " * 400), rows[5], rows[5]]


@pytest.mark.parametrize(("threshold", "longest", "shards", "slots", "top"), [(5, 4, 3, 1 << 16, 2000), (12, 4, 1, 1 << 16, 7), (8, 3, 4, 4, 2000), (3, 2, 2, 1 << 10, 2000)])
def test_collocations(spark, texts, threshold, longest, shards, slots, top, monkeypatch):
    """Also with so small a table that nearly all phrases are counted, and with chunks that cut long texts."""
    monkeypatch.setattr(phrases, "CHUNK", 500)
    df = spark.createDataFrame([(x, t, 1, "p", 0) for x, t in texts], "lang string, text string, n int, phrase string, rank int").repartition(3)
    got = phrases.collocations(df, threshold=threshold, longest=longest, shards=shards, slots=slots, top=top).collect()
    want = _collocations(texts, threshold, longest, top)
    assert sorted(map(tuple, got)) == want and len(want) > 10


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], df.schema)).count() == 0


def test_words_of_one_code_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases.K, "pair", lambda a, b: b & np.uint64(1))
    text = phrases.Names([b"a b c a. b c", b"A b"], ["en", "de"])
    assert text.n_ids == 5
    assert text.different(np.array([0, 1, 4]), 2, np.zeros(3, np.uint64))[1].tolist() == [1, 2]
    assert sorted(text.different(np.array([0, 1, 4]), 2, np.array([5, 9, 9], np.uint64))[1].tolist()) == [1, 2]


def test_names_come_back():
    text = phrases.Names(["née b née b c".encode(), b"b c b c"], ["en", "dé"])
    got = {}
    for n, code, whole in text.phrases(3):
        at = np.flatnonzero(whole)
        for part, raw in text.packed(*text.different(at, n, code[at])[:1], n, text.different(at, n, code[at])[1], 5):
            lang, found, counts = phrases.unpacked(raw)
            assert 0 <= part < 5
            got |= {(lang.decode(), p.decode()): c for p, c in zip(found, counts, strict=True)}
    want = collections.Counter((x, " ".join(t.split()[i : i + n])) for x, t in (("en", "née b née b c"), ("dé", "b c b c")) for n in (1, 2, 3) for i in range(len(t.split()) - n + 1))
    assert got == want


def test_phrases_are_taken_up_by_steps():
    """Nothing but words in the first step; a longer phrase from the step after its parts, for as many steps as there are shards."""
    text = phrases.Words([b"new york city new york"], ["en"])
    reached = np.full(1 << 16, phrases.NEVER, np.uint8)
    of = {int(c & phrases.CODE): n for n, code, _ in text.phrases(4) for c in code}
    lengths = lambda step: sorted({of[k] for k in phrases.scanned(text, step, 2, 4, reached)["key"].tolist()})
    assert lengths(0) == [1]
    codes = phrases.slots_of(phrases.phrase_codes([b"new", b"york", b"city", b"new york", b"york city"], ["en"] * 5), reached)
    reached[codes[:3]] = 0
    assert [lengths(s) for s in (1, 2, 3)] == [[1, 2], [2], []]
    reached[codes[3:]] = 2
    assert [lengths(s) for s in (3, 4, 5)] == [[3], [3], []]
    both = phrases.merged([phrases.scanned(text, 1, 2, 4, reached)] * 3, 1, 6)
    assert sorted(both["n"].tolist()) == [3, 3, 3, 6, 6, 6] and sorted(both["at"].tolist()) == [1] * 3 + [phrases.NEVER] * 3


def test_queries_equal_their_sql(spark, sf):
    assert not same(queries.QUERIES["op13_phrase_collocations"](spark, sf).toPandas(), oracle(queries.SQL["op13_phrase_collocations"], sf))
