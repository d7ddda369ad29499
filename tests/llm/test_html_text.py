import html as h
import random
import re

from driftline.llm.html_text import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"; if (a<b) x()</script></head><body class="has-sidebar">
<header class="site"><a href=/>Site</a> slogan, with, commas, and more, words</header><nav><ul><li><a href=1>One</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, really, a lot of them, and you should accept, please, all of them.</div>
<div id="wrap"><div class="sidebar"><p>Side text, that is long enough, and has commas, to win some points in a score.</p></div>
<article><h1>Head &amp; line</h1><p>First&nbsp;paragraph, with <b>bold, and <i>unclosed<br>break, 1 &lt; 2 &copy; &#233;.
<p>Second   paragraph,
 wrapped, over lines.<div class="ad">Buy now, cheap, good, best, and so on, forever.</div><ul><li>item one<li>item two</ul>
<form>Your mail: <input></form><section id="comments"><p>Nice article, thanks, I liked it, very much, indeed.</p></section></article></div>
<aside>Aside, text.</aside><footer>Footer, text, long, and with commas, many of them.</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Head & line First paragraph, with bold, and unclosed break, 1 < 2 © é. Second paragraph, wrapped, over lines. item one item two"


def test_container_without_article():
    page = "<body><div id=menu><a>x</a><a>y</a></div><div class=main><h1>T</h1>" + "".join(f"<p>Sentence {i}, with some words, and commas, in it to score.</p>" for i in range(4)) + "</div><div class=footer>All rights, reserved, by someone, somewhere.</div></body>"
    assert main_text(page) == "T " + " ".join(f"Sentence {i}, with some words, and commas, in it to score." for i in range(4))


LINE = "<p>Sentence, with some words, and commas, in it to score, and long enough to count.</p>"


def test_names_need_length_or_links():
    assert main_text("<form action=x><div>" + LINE * 3 + "<input></div></form>").count("Sentence") == 3  # a form around the page
    assert main_text("<header><div>" + LINE * 3 + "</div></header>").count("Sentence") == 3
    assert main_text("<article>" + LINE * 4 + '<div class="social-history">' + LINE * 2 + "</div></article>").count("Sentence") == 6
    assert main_text("<article>" + LINE * 4 + '<div class="social"><a>Share this</a> <a>Tweet</a></div></article>').count("Share") == 0
    assert main_text("<article>" + LINE * 2 + '<div class="comments-area">' + LINE * 9 + "</div></article>").count("Sentence") == 2
    assert main_text('<div class="page-with-sidebar"><article>' + LINE * 2 + '</article><div class="sidebar">' + LINE + "</div></div>").count("Sentence") == 2
    assert main_text("<article>" + LINE * 3 + "<form>" + "Your mail, please " * 3 + "<input></form></article>").count("mail") == 0


def test_article_is_a_bonus_not_a_rule():
    teaser = "<article><p>A teaser, of one line, that is short.</p></article>"
    assert "teaser" not in main_text("<div>" + teaser + "</div><div><section>" + LINE * 8 + "</section></div>")
    assert main_text("<article><h1>Title</h1><div><section><div>" + LINE * 2 + "</div></section><section><div>" + LINE * 2 + "</div></section></div></article>").startswith("Title Sentence")


def random_tree(rng, depth=0):
    """(tag, children) of containers, or (p, text, linked characters); rendered by ``render``."""
    if depth and rng.random() < (0.35 if depth < 4 else 1.0):
        words = " ".join(rng.choice(["word", "comma,", "longerword", "a"]) for _ in range(rng.randint(1, 60)))
        link = " ".join(["link"] * rng.choice([0, 0, 0, 3, 30]))
        return "p", words, link
    return rng.choice(["div", "section", "article", "main", "div"]), [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]


def render(t):
    if t[0] == "p":
        return f"<p>{t[1]}<a>{t[2]}</a></p>" if t[2] else f"<p>{t[1]}</p>"
    return f"<{t[0]}>{''.join(map(render, t[1]))}</{t[0]}>"


def plain_choice(tree):
    """The text that the scoring picks, every element scored by a walk over all paragraphs below it."""
    nodes = []  # (tag, path, text, linked) in page order; the page itself has the empty path

    def walk(t, path):
        if t[0] == "p":
            nodes.append(("p", path, t[1] + t[2], len(t[2])))
        else:
            nodes.append((t[0], path, None, 0))
            for i, c in enumerate(t[1]):
                walk(c, (*path, i))

    nodes.append(("html", (), None, 0))
    walk(tree, (0,))
    paragraphs = [n for n in nodes if n[0] == "p"]
    tags = {n[1]: n[0] for n in nodes}

    def value(n):
        below = [p for p in paragraphs if p[1][: len(n[1])] == n[1]]
        chars, linked, score = sum(len(p[2]) for p in below), sum(p[3] for p in below), 0.0
        for p in below:
            if len(p[2]) < 20 or p[1] == n[1]:
                continue
            points = (1 + p[2].count(",") + min(len(p[2]) / 100, 3)) * (1 - p[3] / len(p[2]))
            around = [p[1][:k] for k in range(len(p[1]) - 1, -1, -1)]  # parent first
            level = around.index(n[1])
            home = next((a for a in around if tags[a] in ("article", "main")), None)
            score += points if home == n[1] else points / (1, 2, 6, 9, 12)[level] if level < 5 else 0
        return score * (1 - linked / chars) * (1.25 if n[0] in ("article", "main") else 1) if chars else 0.0

    values = {n[1]: value(n) for n in nodes}
    best = max(nodes, key=lambda n: values[n[1]])
    if not values[best[1]]:
        return None
    chosen = [best[1]]
    for n in nodes:
        if len(n[1]) and n[1] != best[1] and len(best[1]) and n[1][:-1] == best[1][:-1]:
            brief = n[0] == "p" and n[3] < 0.25 * len(n[2]) and len(n[2]) > 80
            if (best[0] != "article" or n[0] == "article") and (values[n[1]] >= max(4.0, 0.2 * values[best[1]]) or brief):
                chosen.append(n[1])
    return " ".join(p[2] for p in paragraphs if any(p[1][: len(c)] == c for c in chosen))


def test_scoring_against_brute_force():
    rng, seen = random.Random(5), 0
    for _ in range(400):
        tree = random_tree(rng)
        want = plain_choice(tree)
        if want is not None:
            seen += 1
            assert main_text(render(tree)) == want, render(tree)
    assert seen > 300


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<script>") == main_text("<!-- a") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<article>" + "<div>" * 5_000 + LINE * 3_000).count("Sentence") == 3_000
    assert main_text("<p>cut off &am") == "cut off &am"
    assert main_text("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract_main_text(df).collect()
    assert len(got) == 4 and [r.n_chars for r in got if r.page_id != 1] == [0, 0]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


def test_generated_pages(spark):
    """In these pages the article is what stands between its tags (they nest nothing else), by a plain rule."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", re.sub(r"<[^>]*$", "", r.html), re.S)
        if body:
            blocks = [" ".join(h.unescape(re.sub(r"<(?:b|/b|br)>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body[1])]
            assert main_text(r.html) == " ".join(b for b in blocks if b), r.page_id


def test_only_parsed_attributes_hide():
    words = "The committee met on Tuesday, and after a long debate, it adopted the plan for the harbour. "
    page = lambda attributes: f"<html><body><article {attributes}><p>{words * 3}</p></article></body></html>"
    shown = ['data-headline="The hidden history"', 'title="hidden"', "data-x='aria-hidden=true'", 'hidden="until-found"', 'style="display:nonesuch"', 'data-style="display:none"', 'aria-hidden="false"', "data-hidden"]
    for attributes in shown:
        assert main_text(page(attributes)) == (words * 3).strip(), attributes
    for attributes in ["hidden", "HIDDEN=''", 'aria-hidden="true"', "style='color:red; Display : none !important'", 'class="a" hidden id="b"', 'style="visibility:hidden"']:
        assert main_text(page(attributes)) == "", attributes
    alt = f'<html><body><article><p>{words * 3}</p><p><img alt="hidden display:none"/>{words}</p></article></body></html>'
    assert main_text(alt) == (words * 4).strip()
