import random
from html import escape

import pytest

from quern.llm import maintext, queries
from quern.llm.maintext import main_text

PARA = "The river rose in the night, and by morning the lower fields, the road and the bridge were under water."
NEXT = "Nobody was hurt, but two barns were lost, and the school stayed closed for a week while the mud was carried off."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("   ", ""),
        ("<html><head><title>T</title><style>p{}</style></head><body><script>x='<p>no</p>'</script></body></html>", ""),
        ("plain text,  no\n markup &amp; all", "plain text, no markup & all"),
        ("a < b and c > d", "a < b and c > d"),
        (f"<body><nav><a href=/>Home</a></nav><p>{PARA}<p>{NEXT}<footer>(c)</footer>", f"{PARA} {NEXT}"),
        # names
        (f"<div class='cookie-banner'>{PARA}</div><div id=content><h2>Flood</h2><p>{PARA}</p><p>Short.</p></div><div class='sidebar-left'><p>{NEXT}</p></div>", f"Flood {PARA} Short."),
        (f"<div class='page has-sidebar'><div class=post><p>{PARA}</p><div class='ad slot'>{NEXT}</div><p>{NEXT}</p></div><div class=comments><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p></div></div>", f"{PARA} {NEXT}"),
        (f"<article class=story><header><h1>Flood</h1><p>By A. Writer</p></header><p>{PARA}</p><section id=comments><article class=comment><p>{PARA}{NEXT}{PARA}</p></article></section><footer>tags</footer></article>", f"Flood By A. Writer {PARA}"),
        (f"<div role=banner>Site name, motto</div><div role=main><p>{PARA}</p></div><div role=contentinfo>{NEXT}</div>", PARA),
        (f"<div hidden>{NEXT}</div><div style='display: none'>{NEXT}</div><div aria-hidden=true>{NEXT}</div><div><p>{PARA}</p></div>", PARA),
        # structure alone
        (f"<div><ul>{'<li><a href=/x>menu entry, long</a>' * 9}</ul></div><div><p>{PARA}</p><p>{NEXT}</p><p>Yes.</p></div><div>(c) us</div>", f"{PARA} {NEXT} Yes."),
        (f"<table><tr><td><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></td><td><p>{PARA}</p><p>{NEXT}</p></td></tr></table>", f"{PARA} {NEXT}"),
        (f"<main><section><h2>A</h2><p>{PARA}</p></section><section><h2>B</h2><p>Only this.</p></section></main><aside>{NEXT}</aside>", f"A {PARA} B Only this."),
        (f"<div class=wrap><div class=part><p>{PARA}</p><p>{NEXT}</p></div><div class=part><p>Tail.</p></div></div>", f"{PARA} {NEXT} Tail."),
        (f"<h1>Title</h1><div class=body><p>{PARA}</p></div>", f"Title {PARA}"),
        (f"<form action=/post><article><h1>T</h1><p>{PARA}</p><form><label>Name</label><input></form></article></form>", f"T {PARA}"),
        (f"<article><p>{PARA}</p><h3>3 Comments</h3><p>{NEXT}</p><p>nice, very nice</p></article>", PARA),
        (f"<article><h2>Comments</h2><p>{PARA}</p><h2>More</h2><p>{NEXT}</p></article>", f"Comments {PARA} More {NEXT}"),
        # text
        ("<article><p>a&nbsp;b &eacute;&#233;&#xe9; &copy &notit; &am x&hellip;</p></article>", "a b ééé © ¬it; &am x…"),
        ("<article><p>one<br>two<b>three</b>four <i> five</i></p>six<p>seven</article>", "one twothreefour five six seven"),
        ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><th>3</table><dl><dt>x<dd>y</dl></article>", "a b c d 1 2 3 x y"),
        ("<article><pre>  keep\n   this </pre><blockquote>quoted</blockquote></article>", "keep this quoted"),
        ("<article><p>a<!-- <p>no --> b<!bogus> c<?php x ?> d</p><p title='>'>e</p><p title=it's>f</p></article>", "a b c d e f"),
        ("<article><p><b>bold<p>next</b> same</article>", "bold next same"),
        ("<ARTICLE><P>Upper</P><SCRIPT>var x='</p>'</SCRIPT><P>case</ARTICLE>", "Upper case"),
        ("<article><textarea>no</textarea><p>cut off <a href='x", "cut off"),
        ("<article><p>x</p></article><div class=ad>Buy, buy, buy, buy, buy now, and again.</div>", "x"),
        # names that set everything aside are not looked at
        (f"<div class=sidebar><p>{PARA}</p></div>", PARA),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def made(rng):
    """A page of a random layout with known main text."""
    words = "river field mud road night water barn school week morning bridge, told. long".split()
    said = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randrange(lo, hi)))
    blocks, inner = [], ""
    for k in range(rng.randrange(2, 12)):
        text = said(12, 90) if k in (0, 1) else said(1, 60)
        tag = rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "pre"]) if k > 1 else "p"
        marked = escape(text, quote=False).replace("mud", rng.choice(["m&#117;d", "<em>mud</em>", "<a href=/m>mud</a>", "mud"])).replace(" field ", rng.choice([" field ", "\n\tfield&nbsp;", "<br>field "]))
        body = f"<{tag}>{marked}" + (f"</{tag}>" if rng.random() < 0.7 or tag not in ("p", "li") else "")
        inner += f"<ul>{body}</ul>" if tag == "li" else body
        blocks.append(text)
        if rng.random() < 0.2:
            inner += rng.choice([f"<div class='ad ad-{k}'>{said(5, 40)}</div>", f"<aside>{said(5, 40)}</aside>", f"<script>{said(3, 9)}</script>", "<!-- x -->", f"<form>{said(3, 9)}<input></form>"])
    menu = "".join(f"<li><a href=/{k}>{rng.choice(words)} {rng.choice(words)}</a></li>" for k in range(rng.randrange(3, 20)))
    before = rng.choice([f"<nav><ul>{menu}</ul></nav>", f"<div class=menu><ul>{menu}</ul></div>", f"<div><ul>{menu}</ul></div>", f"<header><h1>Site</h1><ul>{menu}</ul></header>"])
    after = rng.choice([f"<footer>{said(3, 60)}</footer>", f"<div id=footer>{said(3, 30)}</div>", f"<div class='related-posts'>{menu}</div>", f"<div class=comments>{''.join(f'<p>{said(5, 60)}</p>' for _ in range(9))}</div>"])
    notice = rng.choice(["", f"<div class='cookie-notice'>{said(5, 40)}</div>", f"<div role=dialog>{said(5, 30)}</div>"])
    inner = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class='post-body'>{}</div>", "<div>{}</div>", "<main><article>{}</article></main>", "<div role=main><section>{}</section></div>"]).format(inner)
    side = f"<div class=sidebar><p>{said(5, 80)}</p></div>"
    body = rng.choice(["{b}{n}{i}{s}{a}", "<div class=wrapper>{b}{n}{s}{i}</div>{a}", "<div>{n}{b}</div><div>{i}</div>{a}"]).format(b=before, n=notice, i=inner, s=side, a=after)
    return f"<!DOCTYPE html><html><head><title>{said(1, 9)}</title></head><body>{body}</body></html>", " ".join(blocks)


def test_layouts_never_seen():
    rng = random.Random(11)
    pages = [made(rng) for _ in range(1500)]
    wrong = [(page, want) for page, want in pages if main_text(page) != want]
    assert not wrong, wrong[0]


def test_deep_and_broken_pages_stay_linear():
    import time

    for page in ("<div>" * 100_000 + "x", "<b><p>x" * 30_000, '<a title="' * 30_000 + "x", "<li>a<ul>" * 30_000, "<table><tr><td>" * 30_000 + "x", "<a <" * 50_000 + "x", "</p>" * 50_000, "<i><div>" * 20_000 + "</i>" * 20_000 + "x", "<p>a, b</p>" * 50_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 8


def plain(page):
    """The given tables' layout by patterns: what stands in the article."""
    import html
    import re

    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = (re.sub(r"</?b>", "", x) for x in re.split(r"</?(?:p|h1|br)>", inner))
    return " ".join(" ".join(html.unescape(b).split()) for b in blocks if html.unescape(b).split())


def test_query(spark, sf_dir):
    got = queries.QUERIES["op11_html"](spark, sf_dir).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages) > 20
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    long = "<article>" + "<p>word, word</p>" * 200_000 + "</article>"
    rows = [(1, None), (1, None), (None, "<p>x"), (2, ""), (3, long), (4, "\x00<p>\x1c☃"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "tag", "row")})
    out = maintext.extract(df)
    got = {(r["page_id"], r["html"]): r for r in out.collect()}
    assert out.count() == 7 and out.columns == ["page_id", "html", "tag", "row", "text", "n_chars"] and got[(3, long)]["n_chars"] == 200_000 * 11 - 1
    assert got[(1, None)]["text"] == "" and got[(None, "<p>x")]["text"] == "x" and got[(4, "\x00<p>\x1c☃")]["text"] == "\x00 ☃"
    assert maintext.extract(df.limit(0)).collect() == [] and maintext.extract(df, keep_html=False).columns == ["page_id", "tag", "row", "text", "n_chars"]
