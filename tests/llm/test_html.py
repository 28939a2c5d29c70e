import html
import random
import re

import pytest

from palimpsest.llm import html_extract
from palimpsest.llm.html_extract import align, extract, extract_pages, read_wrapper, tokens

SCHEMA = "page_id long, url string, html string, path array<string>, fixed int, text string"


def paragraphs(rng, n):
    return [" ".join(rng.choice(["alpha", "beta", "R&D", "tea", "x < y", "été"]) for _ in range(rng.randrange(8, 40))) + "." for _ in range(n)]


def semantic(title, body):
    ps = "".join(f"<p><b>{html.escape(p)}<br>" if k % 3 == 0 else f"<p>{html.escape(p)}</p>" for k, p in enumerate(body))
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a><li><a>About us</a></ul></nav><!-- x --><div class=\"ad\">Buy {title}</div>"
        f"<main><article><h1>{title}</h1>{ps}<form><input><button>Send</button></form><aside>See also</aside></article>"
        f"<section id=comments><p>First! {title}</p></section></main><footer>&copy; us</footer></body></html>"
    )


def divs(title, body):
    ps = "".join(f"<p>{html.escape(p)}</p>\n" for p in body)
    return (
        f"<html><body><div id='top-nav'><a>Home</a> | <a>News</a></div><div class='cookie-notice'>We use cookies</div><div class='wrap'>"
        f"<div class='entry'><h2>{title}</h2>{ps}</div><div class='sidebar'><ul><li>Other {title}</li></ul></div>"
        f"<div class='comment-list'><p>Nice {title}</p></div></div><div class='bottom'>All rights reserved by us</div></body></html>"
    )


@pytest.mark.parametrize("template", [semantic, divs])
def test_templates(spark, template):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(40):
        title, body = f"Title {i} {rng.choice('abc')}", paragraphs(rng, rng.randrange(2, 9))
        rows.append((i, f"http://h{i % 3}.example.org/p/{i}", template(title, body), None, 1, "x"))
        want[i] = "\n\n".join([title, *body])
    rows += [(100, rows[0][1], None, None, 1, "x"), (101, None, "", None, 1, "x"), (None, "no url", "<p>alone &amp; so", None, 1, "x"), rows[0]]
    want |= {100: "", 101: "", None: "alone & so"}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for most in (20_000, 1):  # 1: too many hosts to send their wrappers
        got = extract_pages(df, most_sent=most).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == want[r.page_id]
            assert r.n_chars == len(r.text)
    assert extract_pages(df.limit(0)).count() == 0


def test_truncated_pages_keep_what_is_there():
    page = semantic("T", ["one two", "three four"])
    cut = page[: page.index("three") + 5]
    assert extract(tokens(cut), read_wrapper([tokens(page), tokens(semantic("U", ["five"]))])) == "T\n\none two\n\nthree"


def test_mismatches_become_slots_options_and_repeats():
    one = tokens("<div><p>a</p><p>b</p><h2>x</h2></div>")
    two = tokens("<div><p>c</p><p>d</p><p>e</p><ul><li>k</li></ul><h2>x</h2></div>")
    wrapper = align(one, two)
    assert ("s", "") in wrapper and ("t", "x") in wrapper
    assert [x for x in wrapper if x[0] == "*"] == [("*", [("+", "p"), ("s", ""), ("-", "p")])]
    assert any(x[0] == "?" and ("+", "ul") in x[1] for x in wrapper)
    assert align(wrapper, two) == wrapper and align(wrapper, one) == wrapper


def plain(page):
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    texts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_whole_table_against_a_plain_cut(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in df.collect()}
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == want


def test_noise_words():
    noise = ["nav", "div.ad", "div.side-bar.widget", "div@navigation", "section.comments", "article.comment", "div.cookie-notice"]
    assert all(map(html_extract.is_noise, noise))
    assert not any(map(html_extract.is_noise, ["div.content", "article.related", "body.menu", "div.has-sidebar", "div.readable"]))


@pytest.mark.parametrize(
    "page", ["<html><body></body></html>", "<html><body><nav>Home</nav></body></html>", "<form><input>Log in</form>", "<article></article>", "<p> <br></p>"]
)
def test_pages_without_a_countable_text_end(page):
    assert read_wrapper([tokens(page)])[1] == []
    assert extract(tokens(page), None) == extract(tokens(page), (["html", "main"], [])) == ""


def test_a_host_of_identical_pages_ends():
    page = tokens("<html><body><nav>Home</nav><div><p>one</p><p>two</p></div></body></html>")
    path, fixed = read_wrapper([page] * 4)
    assert extract(page, (path, fixed)) in ("", "one\n\ntwo")


def test_texts_that_pages_share_stay_in_the_article():
    rng = random.Random(5)
    pages, want = [], []
    for k in range(6):
        first, second = paragraphs(rng, 2)
        body = [f"Dish {k}", "Ingredients", first, "Background", second, "All our dishes serve four."]
        inside = f"<h2>{body[0]}</h2><h3>{body[1]}</h3><p>{html.escape(first)}</p><h3>{body[3]}</h3><p>{html.escape(second)}</p><p>{body[5]}</p>"
        pages.append(tokens(f"<html><body><div class='top'>Our kitchen</div><div class='entry'>{inside}</div><div class='bottom'>Rights</div></body></html>"))
        want.append("\n\n".join(body))
    wrapper = read_wrapper(pages)
    assert [extract(p, wrapper) for p in pages] == want
    # copies of a page are one page, and no text of it is fixed
    copies = read_wrapper([pages[0]] * 5)
    assert want[0] in extract(pages[0], copies)


def of(*pages):
    streams = [tokens(p) for p in pages]
    wrapper = read_wrapper(streams)
    return [extract(s, wrapper) for s in streams]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p title=it's>First</p><p>Second that don't end</p><p>Third</p>", "First|Second that don't end|Third"),
        ('<p class="a"">First</p><p>Second</p>', "First|Second"),
        ("<article><p class='related-work'>One</p><div class='share-of-market'>Two</div><p class='legal'>Three</p></article>", "One|Two|Three"),
        ("<article><header><h1>Title</h1><p>By Ann</p></header><p>Body</p></article>", "Title|By Ann|Body"),
        ("<article><header><a href='/'>Shop</a></header><p>Body</p></article>", "Body"),
        ("<p>One</p><iframe src='x'><p>Two</p><p>Three</p>", "One|Two|Three"),
        ("<body><main></main><article><p>Outside</p></article></body>", "Outside"),
        ("<form id=f><article><p>One</p><form>Send</form></article></form>", "One"),
        ("<article><div class='ad-box'>Buy</div><p>One</p><div class='comments-section'><p>Nice</p></div></article>", "One"),
    ],
)
def test_odd_pages(page, want):
    assert of(page) == [want.replace("|", "\n\n")]


def boxes(k, story):
    """No <article>, no telling class: only alignment tells the long box that never changes from the short one that does."""
    rules = "".join(f"<p>{x}</p>" for x in ("We send what you order within two days of your order", "Read all of the rules of our house before you order"))
    return f"<html><body><div class=a>{rules}</div><div class=b><h2>Story {k}</h2><p>{story}</p><p>Read more</p></div><div class=c>All of it is ours</div></body></html>"


def test_boxes_that_never_change_fall_out(monkeypatch):
    pages = [boxes(k, s) for k, s in enumerate(("A cat sat", "Rain fell here", "He ran off"))]
    want = [f"Story {k}\n\n{s}\n\nRead more" for k, s in enumerate(("A cat sat", "Rain fell here", "He ran off"))]
    assert of(*pages) == want
    assert of(pages[0]) != want[:1]  # a page alone does not tell
    monkeypatch.setattr(html_extract, "fold", lambda a, b: a)
    assert of(*pages) != want


def test_fixed_boxes_inside_an_article_fall_out():
    pages = [f"<article><h1>T{k}</h1><p>Some text {k}</p><div class=x><p>Tell your friends</p></div><p>More {k}</p></article>" for k in range(3)]
    assert of(*pages) == [f"T{k}\n\nSome text {k}\n\nMore {k}" for k in range(3)]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(0, 6 if depth else 4)):
        if rng.random() < 0.3:
            out.append(rng.choice(["foo", "bar baz", f"x{rng.randrange(1000)}"]))
        else:
            tag = rng.choice(["div", "p", "ul", "li", "h2", "section", "article", "div class=a", "div class='a b'", "div class=ad", "dt", "dd"])
            out.append(f"<{tag}>{random_page(rng, depth + 1) if depth < 3 else 'zz'}" + (f"</{tag.split()[0]}>" if rng.random() < 0.95 else ""))
    return "".join(out)


def test_random_pages_give_texts_of_their_own_in_order():
    rng = random.Random(8)
    for _ in range(400):
        streams = [tokens(random_page(rng)) for _ in range(rng.randrange(2, 7))]
        items = html_extract.as_items(streams[0], 0)
        for k, s in enumerate(streams[1:], 1):
            items = html_extract.fold(items, html_extract.as_items(s, k))
        for s in streams:
            texts = iter([v for kind, v in s if kind == "t"])
            assert all(any(x == y for y in texts) for x in html_extract.Wrapper(items).article(s))


def test_partitions_do_not_matter(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host = "hot" if i % 3 else f"h{i % 7}"
        page = boxes(i, " ".join(rng.choice(["cat", "dog", "hen"]) for _ in range(rng.randrange(3, 20))))
        rows.append((i, f"http://{host}/{i}", page, None, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    found = [{r.page_id: r.text for r in extract_pages(df.repartition(n), most_sent=most).collect()} for n, most in ((1, 1 << 20), (7, 1), (40, 1 << 20))]
    assert found[0] == found[1] == found[2]
    assert all(found[0][i].startswith(f"Story {i}\n\n") and found[0][i].endswith("\n\nRead more") for i in range(300))


def test_the_query_goes_through_wrappers(spark, monkeypatch):
    """Wrappers of the whole table give another result if alignment is switched off."""
    pages = [(k, "http://one/x", boxes(k, "short"), None, 1, "x") for k in range(5)]
    items = [html_extract.as_items(tokens(p[2]), p[0]) for p in pages]
    whole = html_extract.infer_wrappers(spark.createDataFrame([("one", p[2].encode()) for p in pages], "_host string, html binary")).collect()
    assert len(whole) == 1 and whole[0]["wrapper"] != html_extract.json.dumps(items[0])
