import html
import re

import pytest

from conftest_paths import SF
from martlet.llm import html_consensus, url_templates
from martlet.llm import queries as q


def text(source):
    return html_consensus.winning_text(html_consensus.parse(source), [])


def test_query_equals_the_article_of_each_page(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in q.QUERIES["op6_main_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        article = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", "\n", article))
        want = " ".join(html.unescape(article).split())
        assert got[r.page_id] == (want, len(want))


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b>c<p>d\n  e", "abc d e"),
    ("<nav>menu</nav><div><p>long text here</p></div><footer>foot</footer>", "long text here"),
    ("<body><div class='sidebar-2'>x y</div><main><h1>T</h1><p>one</p><script>var a='</p>'</script>two</main>", "T one two"),
    ("<article><p>story</p><div id=comments><p>me too, and much more</p></div></article>", "story"),
    ("<article>a<!-- no <p>x</p> -->b</article>", "ab"), ("<article>a<!-- open", "a"), ("x < y", "x < y"),
    ("<style>p{}</style><p>kept</p></div></p></b>", "kept"), ("<ul><li>a<li>b</ul>", "a b"),
    ("<p title='a > b'>quoted</p>", "quoted"), ("<form><p>name</p></form><p>body text</p>", "body text"),
    ("<article><p>5 &lt; 6 &copy; &#233;&nbsp;x</p></article>", "5 < 6 © é x"), ("<div hidden>no</div><div>yes yes</div>", "yes yes"),
])
def test_small_pages(source, want):
    assert text(source) == want


STORY, LONGER = "the story goes on", "and on " * 30


@pytest.mark.parametrize("source, want", [
    (f"<article><p>{STORY}</p><div class=byline>By X</div><section id=comments>{LONGER}</section></article>", f"{STORY} By X"),
    (f"<article><p>{STORY} <a href=x>{LONGER}</a></p><div class=byline>B</div></article>", f"{STORY} {LONGER.strip()} B"),
    (f"<article><p><a href=x>{STORY}</a></p></article><div></div>", STORY),
    (f"<body><p>{STORY}</p><div><a href=x>{LONGER}</a></div><div>By X</div></body>", f"{STORY} {LONGER.strip()} By X"),
])
def test_no_story_is_lost_to_what_is_beside_it(source, want):
    assert text(source) == want


@pytest.mark.parametrize("source, want", [
    (f"<div class='layout has-sidebar'><article><p>{STORY}</p></article></div>", STORY),
    (f"<div class='no-header'><main><p>{STORY}</p></main><div class=site-footer>foot</div></div>", STORY),
    (f"<article><p>{STORY}</p><div class='market-share'><p>more</p></div><section class=discussion>and</section></article>", f"{STORY} more and"),
    (f"<div class=sidebar><article><p>{STORY}</p></article></div>", STORY),
    (f"<article><p>{STORY}</p></article><div id=comments><article class=comment-body><p>{LONGER}</p></article></div>", STORY),
    (f"<article><p>{STORY}</p><div class='post-share-buttons'>share it</div><div class='cookie-notice-2'>ok</div></article>", STORY),
    (f"<p>{STORY} <a title=\"open>x</a>", f"{STORY} x"), (f"<p>{STORY} <b", f"{STORY} <b"),
])
def test_parts_go_by_whole_names(source, want):
    assert text(source) == want


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<a \"", "</x>", "<b>x", "<p><b>", "<!x", "<div class=x><p>", "<li><b>", "<script>", "&amp;<",
                                   "<div class=ad>", "<main>"])
def test_time_follows_the_length(piece):
    import time
    began = time.time()
    html_consensus.winning_text(html_consensus.parse(f"<p>{STORY}</p>" + piece * 60_000), [">html>body"])
    assert time.time() - began < 4


def test_a_page_of_megabytes():
    import time
    page = "<html><body><article>" + "<div class=part><p>words &amp; <b>more</b> words</p></div>" * 100_000 + "</article></body></html>"
    began = time.time()
    assert text(page) == " ".join(["words & more words"] * 100_000) and time.time() - began < 10


def test_a_winning_path_does_not_take_a_part_of_an_article():
    page = f"<html><body><article><p>{LONGER}</p><section><p>{LONGER}</p></section></article></body></html>"
    got = html_consensus.winning_text(html_consensus.parse(page), [">html>body>article>section"])
    assert got == " ".join((LONGER * 2).split())


def test_consensus_beats_an_odd_page(spark):
    page = "<body><div class=post><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    links = "<a href=x>other pages</a>"
    rows = [(i, "http://h.com/x", page.format("article text " * 9, links)) for i in range(9)]
    rows.append((9, "http://h.com/y", page.format("article text " * 3, "noise " * 12)))
    rows += [(10, None, None), (11, "no scheme", "<p>free</p>"), (11, "no scheme", "<p>free</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_consensus.extract(df).collect())
    assert got[9] == (9, ("article text " * 3).strip())
    assert got[10:] == [(10, ""), (11, "free"), (11, "free")]
    assert html_consensus.extract(df.limit(0)).count() == 0


URLS = {
    "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://x.net/es/1?q": ("x.net", "/es/1", "net/es/", "block"), "https://x.net/en/1#t": ("x.net", "/en/1", None, "allow"),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "http://com": ("com", "", None, "allow"),
    "://h/p://q": ("h", "/p://q", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "http://net?/fr/": ("net", "", None, "allow"),
}


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, label int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(df).collect()}
    assert [got[i] for i in range(len(URLS))] == list(URLS.values())
    assert url_templates.judge(df.limit(0)).count() == 0


def tree_by_hand(pages, depth=url_templates.DEPTH):
    """``(host, path) -> template`` by walking each host's tree in Python."""
    from collections import defaultdict
    rows = []
    for host, path, label in pages:
        parts = re.sub("^/", "", path).split("/")
        rows.append([host, path, parts if len(parts) < depth else [*parts[:depth - 1], "**"], label, ""])
    for level in range(depth):
        below = defaultdict(lambda: defaultdict(list))
        for r in rows:
            if len(r[2]) > level:
                below[r[0], r[4]][r[2][level]].append(r)
        for segments in below.values():
            pages_here = sum(map(len, segments.values()))
            general = defaultdict(list)
            for s, members in segments.items():
                stays = (len(members) >= max(url_templates.LEAST_SHARE * pages_here, url_templates.LEAST_PAGES)) or s in ("", "**")
                shape = re.sub("[0-9]+", "#", s) if re.search("[0-9]", s) else "*"
                general[s if stays else shape] += members
            labels = [r[3] for m in general.values() for r in m if r[3] is not None]
            share = sum(labels) / len(labels) if labels else 1.0
            for g, members in general.items():
                own = [r[3] for r in members if r[3] is not None]
                similar = (sum(own) - len(own) * share) ** 2 <= 4 * len(own) * share * (1 - share)
                for r in members:
                    r[4] += "/" + ("~" if similar else g)
    return {(r[0], r[1]): r[4] for r in rows}


def test_templates_equal_the_tree_by_hand(spark):
    import random
    rng = random.Random(8)
    pages = []
    for i in range(900):
        kind = rng.choice(["good", "tag", "user", "deep"])
        path = {"good": f"/news/{i}", "tag": f"/tag/{rng.choice('abc')}/{i}.html", "user": f"/u{i}/", "deep": f"/a/b/c/d/{i}"}[kind]
        label = None if rng.random() < 0.4 else int(rng.random() > (0.9 if kind == "tag" else 0.1))
        pages.append((rng.choice(["hot.com", "hot.com", "x.org"]), path, label))
    df = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, (h, p, x) in enumerate(pages)],
                               "page_id long, url string, label int")
    rows = url_templates.judge(df, rules=()).collect()
    want = tree_by_hand(pages)
    assert {(r.host, r.path): r.template for r in rows} == want
    assert {r.verdict for r in rows if r.path.startswith("/tag/")} == {"block"}
    assert {r.verdict for r in rows if r.path.startswith("/news/")} == {"allow"}


def test_sections_below_the_first_levels_get_their_own_verdict(spark):
    pages = [(f"/a/b/c/{k}/{i}", int(k == "docs")) for k in ("docs", "forum") for i in range(40)]
    pages += [(f"/x/1/2/3/4/5/6/{k}/y/{i}", int(k == "docs")) for k in ("docs", "forum") for i in range(40)]
    pages += [("/a/b/c", 1), ("/a/b/c/", 1), ("/x/1/2/3/4/5/6", 0)]
    df = spark.createDataFrame([(i, f"http://h.com{p}", x) for i, (p, x) in enumerate(pages)],
                               "page_id long, url string, label int")
    got = {r.path: r.verdict for r in url_templates.judge(df, rules=()).collect()}
    assert len(got) == len(pages)
    assert {v for p, v in got.items() if "docs" in p} == {"allow"}
    assert {v for p, v in got.items() if "forum" in p} == {"block"}


def test_a_branch_that_ends_can_not_split():
    for good in range(0, 7):
        for bad in range(0, 7):
            total, share = good + bad, good / max(good + bad, 1)
            splits = any((g - (g + b) * share) ** 2 > 4 * (g + b) * share * (1 - share) + 1e-9
                         for g in range(good + 1) for b in range(bad + 1))
            assert not splits or good and bad and max(good, bad) > 4, (good, bad, total)
