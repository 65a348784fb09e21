import random
import re

import pytest

from lexiquarry.llm import html_text as hx


@pytest.fixture(scope="module")
def trees():
    return hx.fit_extractor()


def test_held_out_pages(trees):
    rng = random.Random(5)
    same = words = missed = extra = 0
    for _ in range(200):
        marked = hx._Maker(rng).page()
        truth = set(re.findall(r"\S+", " ".join(re.findall("\x01([^\x02]*)\x02", marked)).replace("&amp;", "&")))
        got = set(hx.extract(marked.replace("\x01", "").replace("\x02", ""), trees).split())
        same += got == truth
        words += len(truth)
        missed += len(truth - got)
        extra += len(got - truth)
    assert missed / words < 0.03 and extra / words < 0.04 and same > 120, (same, words, missed, extra)


PAGE = """<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>No title&amp;</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body><nav><ul><li><a href="/The">The</a></li><li><a href="/and">and</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy now and here.</div>
<article><h1>Head&amp;line &lt;1&gt;</h1><p><b>First  one&nbsp;two<br><p>Second\n line &eacute;&#233;.</p><p>x</p><div class="comments"><p>Nice read, I like this one.</p></div></article>
<footer>&copy; some.example.com &middot; All rights.</footer>"""


def test_page_of_known_text(trees):
    assert hx.extract(PAGE, trees) == "Head&line <1>\nFirst one two\nSecond line éé.\nx"


def test_decoding_never_contradicts_an_ancestor():
    import numpy as np

    page = hx.parse("<div><p>a</p><div><p>b</p></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        keep = hx.decode(page, rng.normal(size=len(page.tag)))
        assert all(not k or i == 0 or keep[page.parent[i]] for i, k in enumerate(keep))


def test_decoding_is_the_best_of_all_choices():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        page = hx.Page()
        for i in range(1, n):
            page.parent.append(int(rng.integers(i)))
            page.tag.append("div")
            page.topics.append(0)
        scores = rng.normal(size=n)
        value = lambda keep: sum(s if k else -s for s, k in zip(scores, keep, strict=True))
        allowed = [k for k in itertools.product((False, True), repeat=n) if k[0] and all(not k[i] or k[page.parent[i]] for i in range(1, n))]
        assert abs(value(hx.decode(page, scores)) - max(map(value, allowed))) < 1e-9


def test_odd_rows(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<b" + "<" * 5000), (6, "u", PAGE), (6, "u", PAGE), (None, "u", "<article><p>" + "word " * 200_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = hx.extract_pages(df, trees).collect()
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[6].startswith("Head&line") and len(by[None]) == 999_999
    assert hx.extract_pages(df.limit(0), trees).count() == 0
