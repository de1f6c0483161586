"""The whole extraction against pages whose main text is known, and against its own scoring done the long way."""

import random
import time

import pytest

from furrow.llm import html_extract as X

PROSE = "Body one, two, three and so on, with words that make a paragraph of prose, more or less."


@pytest.mark.parametrize("tag", ["footer", "nav", "aside", "form", "header", "menu", "dialog"])
def test_nothing_leaks_from_dropped_elements(tag):
    for inner in ("<p>Leak</p>", "<p>Leak<p>Leak", "<div><p>Leak</div><p>Leak", "<ul><li>Leak<li>Leak</ul><li>Leak", "Leak <b>Leak"):
        for around in ("<div class='content'><p>{}<{}>{}</{}></div>", "<article><p>{}<{}>{}</{}></article>", "<main><div><p>{}<{}>{}</{}></div></main>", "<p>{}<{}>{}</{}>"):
            assert X.extract(around.format(PROSE, tag, inner, tag)) == PROSE, (inner, around)
    assert X.extract(f"<div><p>{PROSE}<span class='advert'><p>Leak</p></span></div>") == PROSE
    assert X.extract(f"<article>Loose<{tag}>Leak</{tag}>more, {PROSE}</article>") == f"Loose more, {PROSE}"


@pytest.mark.parametrize("page", [
    "<div>some direct text that is longer than forty characters, yes, it is so" * 20_000, "<div>" * 20_000 + "</b>" * 20_000, "<p>text<div>" * 20_000,
    "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<article><p>a, b, c" * 20_000, "<ul><li><a href=x>a</a>" * 10_000, "<!--" * 20_000, "<script>" * 20_000, "<a title='x>" * 20_001,
], ids=["nested", "stray", "unclosed", "lists", "articles", "links", "comments", "scripts", "quotes"])
def test_time_grows_with_the_page(page):
    began = time.process_time()
    X.extract(page)
    assert time.process_time() - began < 4  # well under a second where nothing else runs; a quadratic step takes minutes


def generated(r: random.Random) -> tuple[str, str]:
    """A page and the main text it was made from."""
    blocks, texts = [], []
    for k in range(r.randint(3, 9)):
        words = [r.choice(["alpha", "beta,", "gamma", "delta &amp; co,", "<b>epsilon</b>", "zeta&#233;"]) for _ in range(r.randint(25, 60))]
        source = r.choice([" ", "\n  ", "\t"]).join(words)
        texts.append(" ".join(source.replace("<b>", "").replace("</b>", "").replace("&amp;", "&").replace("&#233;", "é").split()))
        blocks.append(f"<p>{source}" + r.choice(["</p>", ""]))
        blocks.append(r.choice(["", "", "<div class='ad-box'><p>Buy this now</p></div>", "<aside><p>By the way</p></aside>", "<script>var p = '<p>x</p>';</script>", "<form><input><p>Name</form>"]))
    body = "".join(blocks)
    body = r.choice([f"<article>{body}</article>", f"<main>{body}</main>", f"<div class='content'>{body}</div>", f"<div><div>{body}</div></div>"])
    before = "<header><h1>Site</h1></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class='cookie-notice'><p>We use cookies</p></div>"
    after = "<div id=comments><p>" + "Nice, nice, nice, " * r.randint(1, 30) + "</p></div><footer><p>Copyright</p></footer>"
    return f"<html><head><title>T</title></head><body>{before}{body}{after}</body></html>", " ".join(texts)


def test_generated_pages():
    r = random.Random(8)
    for _ in range(300):
        page, text = generated(r)
        assert X.extract(page) == text, page


def naive_sums(n):
    """Characters, links' characters, commas and links below a node, each by walking its whole subtree."""
    if isinstance(n, str):
        return len("".join(n.split())), 0, n.count(","), 0
    parts = [naive_sums(x) for x in n.items if isinstance(x, str) or not x.dropped]
    length, linked, commas, anchors = (sum(p[k] for p in parts) for k in range(4))
    return (length, length, commas, anchors + 1) if n.tag == "a" else (length, linked, commas, anchors)


def naive_points(n):
    direct = sum(len(x.strip()) for x in n.items if isinstance(x, str)) if n.tag in ("div", "section", "article", "main", "body", "#root") else 0
    leaf = n.tag in X.PARAGRAPHS and not any(isinstance(x, X.Node) and x.tag in X.PARAGRAPHS for x in n.items)
    length, linked, commas, _ = naive_sums(n)
    return (1 + commas + min((length + n.gaps) / 100, 3.0)) * (1 - linked / length) if length and (leaf or direct > 40) else 0.0, direct > 40


def test_scores_against_the_long_way():
    r = random.Random(3)
    for _ in range(60):
        page = "".join(r.choice(["<div>", "<section>", "<p>", "<ul><li>", "</div>", "</p>", "</ul>", "<a href=x>", "</a>", "text, more text, and text that is long enough ", "short "]) for _ in range(60))
        root = X.parse(page)
        order = X._walk(root)
        X._sum(order)
        assert all((n.length, n.linked, n.commas, n.anchors) == naive_sums(n) for n in order if n.tag != "a" or not any(isinstance(x, X.Node) and x.tag == "a" for x in X._walk(n)[1:]))
        best = X._score(order)
        points = {id(n): naive_points(n) for n in order}
        for n in order:
            want = 0.0
            for m in order:
                start = m if points[id(m)][1] else m.parent
                chain, at = [], start
                while at is not None and len(chain) < 6:
                    chain.append(at)
                    at = at.parent
                if points[id(m)][0] and n in chain:
                    level = chain.index(n)
                    want += points[id(m)][0] / (1 if level == 0 else 2 if level == 1 else 3 * level)
            assert n.score == pytest.approx(want)
        assert best is None or best.score > 0


def test_carried_names_that_clash(spark):
    d = spark.createDataFrame([(1, "<p>x</p>", "t", 7, "h")], "page_id long, html string, text string, id int, `page html` string")
    got = X.main_texts(d, carry=["text", "id"]).first()
    assert (got["id"], got["text"], got["text_"], got["id_"]) == (1, "x", "t", 7)
