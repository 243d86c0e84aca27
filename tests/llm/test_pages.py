"""HTML extraction and URL filter."""

from collections import Counter

import pytest

from honestpick.llm import html_density, url_filter
from honestpick.llm.html_density import main_text

LONG = "Plain words of an article that go on for a while, with commas and stops. " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("   ", ""), ("no tags at all", "no tags at all"),
    ("<nav>menu</nav>", ""),
    (page("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four</p></article>"),
     "A & B\none two three four"),
    (page("<nav><a>x</a></nav><article><p>a<p>b<div>c</div>d</article><footer>f</footer>"),
     "a\nb\nc\nd"),
    (page("<article><p>a</p><aside>s</aside><form>f<input></form><p>b</p>"
          "<div class='ad'>buy</div><section class=\"comments\"><p>me too</p></section></article>"),
     "a\nb"),
    (page("<article><p>a<script>var t='</p>';</script><style>p{}</style><!-- x > y --> b</p>"
          "</article>"), "a b"),
    (page("<header>site</header><article><header><h1>t</h1></header><p>a</p></article>"),
     "t\na"),
    (page("<main><article><p>a</p></article><article class='comment'><p>c</p></article></main>"),
     "a"),
    (page("<div class='page has-sidebar'><article><p>a</p></article></div>"), "a"),
    (page("<article><p>3 < 4 & 5 > 2 &#233; &copy;</p>"), "3 < 4 & 5 > 2 é ©"),
    (page("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>"), "a\nb\nc\nd"),
    ("<html><body><article><p>cut off in the mid", "cut off in the mid"),
])
def test_main_text(html, want):
    assert main_text(html) == want


def test_density_finds_the_text_without_an_article():
    links = "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(30))
    body = (f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG}</p><p>Short end.</p>"
            f"</div></div><div><a href='/'>Home</a> <a href='/x'>Contact us</a></div>")
    t = LONG.strip()
    assert main_text(page(body)) == f"{t}\n{t}\nShort end."


T = LONG.strip()


@pytest.mark.parametrize("body, want", [
    (f"<div class='page has-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{T}\n{T}"),
    (f"<div class='no-sidebar with-ads'><p>{LONG}</p></div><div class='ad'>buy</div>", T),
    (f"<div id='widget'><p>{LONG}</p><p>{LONG}</p></div>", f"{T}\n{T}"),
    (f"<div class='header-layout'><p>{LONG}</p><p>{LONG}</p></div>"
     "<div class='sidebar-left'><p>Short words.</p></div>", f"{T}\n{T}"),
    (f"<article><div class='entry-header'><h1>t</h1></div><p>{LONG}</p></article>", f"t\n{T}"),
    (f"<article><div class='top-banner'><h1>t</h1><p>x</p></div><p>{LONG}</p></article>",
     f"t\n{T}"),
    (f"<article><p>{LONG}</p><section id='related-work'><p>{LONG}</p></section></article>",
     f"{T}\n{T}"),
    (f"<article><p>{LONG}</p><div class='related-posts'><ul><li><a href='/1'>One more</a></li>"
     "<li><a href='/2'>And another</a></li></ul></div></article>", T),
    (f"<article><p>{LONG}</p></article><div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div>",
     T),
    (f"<article><p>a</p></article><div class='ad'>{LONG}</div>", "a"),
])
def test_a_noisy_name_alone_does_not_decide(body, want):
    assert main_text(page(body)) == want


LINKS = "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(30))


@pytest.mark.parametrize("body, want", [
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article>",
     f"{T}\n{T}\n{T}"),
    (f"<article><h2>a</h2>{f'<p>{LONG}</p>' * 40}</article><article><p>A shorter part of the "
     "story that goes on here, with its own words and stops.</p></article>",
     "\n".join(["a", *[T] * 40, "A shorter part of the story that goes on here, with its own words "
               "and stops."])),
    (f"<div><article><p>{LONG}</p></article></div><div><article><p>{LONG}</p></article></div>"
     f"<div><ul>{LINKS}</ul></div>", f"{T}\n{T}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><article><p>See also this.</p></article>",
     f"{T}\n{T}\n{T}"),
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><h3><a href='/x'>Another story of "
     "the day</a></h3><p>In short.</p></article>", f"{T}\n{T}"),
    (f"<article><p>{LONG}</p><p>{LONG}</p></article><section class='comments'><article><p>{LONG}"
     "</p></article></section>", f"{T}\n{T}"),
    (f"<article><p>{LONG}</p></article><div><a href='/'>Home</a> <a href='/x'>Contact</a></div>",
     T),
])
def test_density_chooses_where_there_are_articles(body, want):
    assert main_text(page(body)) == want


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert main_text(page(deep)) == LONG.strip()
    wide = "".join(f"<p>{i} {LONG}" for i in range(2000))
    assert main_text(page(f"<article>{wide}</article>")).count("\n") == 1999


def test_extract_frame(spark):
    rows = [(1, "u", page("<article><p>é🎉</p></article>"), "x"), (1, None, None, "x"),
            (None, "u", "<p>b</p>", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_density.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter(
        {(1, "u", "é🎉", 2): 1, (1, None, "", 0): 1, (None, "u", "b", 1): 1})
    assert html_density.extract(df.limit(0)).count() == 0


URLS = ["http://a.example.NET/en/1?x#y", "https://example.net/en", "HTTP://Example.com/de/",
        "x://b.org/fr/#/de", "x://org/fr/1", "x://net", "x://net/", "x://notnet.com/", "no scheme",
        "", None, "://", "a://É.NET/de/x://y", "http://example.com?q=/de/", "http://é.org:80/fr/",
        "http://casino-palace.example.com/x", "http://botany.example.com/x", "a\n://b.net/\nc?d"]


def rule_of(url):
    """(host, path, rule, verdict or None) by string search."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith(r[r.index("/"):])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)],
                               "page_id bigint, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = rule_of(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    assert got[URLS.index(None)].verdict == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert url_filter.judge_urls(df, rules=()).where("rule IS NOT NULL").count() == 0


def test_model_on_held_out_hosts():
    """Every fourth host is left out of training."""
    names = [h for hosts in (url_filter.BLOCKED_HOSTS, url_filter.ALLOWED_HOSTS)
             for h in hosts[::4]]
    model = url_filter.train([r for r in url_filter.LABELLED if r[0].split("/")[0] not in names])
    right = [(model.probability(h, p) >= 0.5) == (h in url_filter.BLOCKED_HOSTS)
             for h in names for p in url_filter.PATHS]
    assert sum(right) >= 0.85 * len(right)
