import itertools
import random
import re
import zlib

from canopy.llm import wrapper

SHELL = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News {i}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{body}
<aside>side {i}</aside><section id="comments"><p>first! {i}</p></section><form><p>mail</p><button>go</button></form>
<footer>&copy; 2020 number {i}</footer></body></html>"""


def article(i):
    return f"<h1>Title {i}</h1><p>One&nbsp;&amp; two <b>bold\n{i}</b> end.<br>next<p>Open <i>para {i}</p><ul><li>item a{i}<li>item b{i}</ul><!-- x --><script>x()</script>"


EXPECTED = "Title {i}\nOne & two bold {i} end. next\nOpen para {i}\nitem a{i}\nitem b{i}"


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'t' AS text", "1 AS template")
    return {r.page_id: r.text for r in wrapper.main_text(df).collect()}


def test_marked_articles(spark):
    pages = [(i, f"http://a.example/{i}", SHELL.format(i=i, body=f"<article>{article(i)}</article>")) for i in range(20)]
    got = texts(spark, pages)
    assert got == {i: EXPECTED.format(i=i) for i in range(20)}


def test_constant_text_is_template_where_nothing_is_marked(spark):
    body = "<div><p>Welcome to our site</p></div><div>{}</div><div><p>Read us daily</p></div>"
    pages = [(i, f"https://b.example:8080/{i}", SHELL.format(i=i, body=body.format(article(i)))) for i in range(20)]
    assert texts(spark, pages) == {i: EXPECTED.format(i=i) for i in range(20)}


def test_constant_text_inside_marked_articles_is_template_but_copies_are_not(spark):
    share = "<div><p>Share this story</p></div>"
    pages = [(i, f"http://c.example/{i}", SHELL.format(i=i, body=f"<article>{article(i)}{share}</article>")) for i in range(20)]
    pages += [(100 + i, "http://copies.example/", SHELL.format(i=i, body=f"<article>{article(7)}{share}</article>")) for i in range(20)]
    got = texts(spark, pages)
    assert all(got[i] == EXPECTED.format(i=i) for i in range(20))
    assert all(got[100 + i] == EXPECTED.format(i=7) + "\nShare this story" for i in range(20))


def test_odd_pages(spark):
    pages = [
        (1, "http://d.example/", None), (2, None, ""), (3, None, "just text &lt;here&gt;"), (4, "nonsense", "<p>a<p>b"), (None, None, None),
        (5, "http://d.example/", "<div><p>" * 3 + "deep" ), (6, "http://d.example/", "<article><p>" + "long word " * 50_000 + "</article>"),
        (7, "http://d.example/", "< not a tag > 1 < 2 <b>x</b"), (8, "http://d.example/", "<script>never closed <p>x</p>"), (8, "http://d.example/", "<p>twice</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = wrapper.main_text(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert len(rows) == len(pages)
    assert got[1] == [""] and got[2] == [""] and got[None] == [""]
    assert got[3] == ["just text <here>"] and got[4] == ["a\nb"] and got[5] == ["deep"]
    assert got[6] == [("long word " * 50_000).strip()]
    assert sorted(got[8]) == ["", "twice"]
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_simple_tree_matching():
    leaf = lambda label, kids=(): {"l": label, "k": list(kids)}
    a = leaf("div", [leaf("p"), leaf("ul", [leaf("li")]), leaf("p")])
    b = leaf("div", [leaf("ul", [leaf("li"), leaf("b")]), leaf("p"), leaf("h1")])
    assert wrapper.match_size(a, b) == 4
    assert wrapper.match_size(a, leaf("p")) == 0


def test_template_does_not_grow_with_repeated_blocks():
    page = lambda n: wrapper.template_of(wrapper.parse("<article>" + "".join(f"<p>{n} {i}</p>" for i in range(n)) + "</article>"))
    whole = page(3)
    for n in range(4, 40):
        whole = wrapper.merge(whole, page(n))
    assert len(whole["k"][0]["k"]) == 1


def test_constant_paragraph_among_many_varying_ones(spark):
    """However many siblings vary beside it, and whatever ids the page has."""
    pages, want = [], {}
    for n, siblings in enumerate((1, 3, 9, 30)):
        for i in range(100):
            key = 1000 * n + i
            lines = [f"Line {i} of {k}" for k in range(siblings)]
            body = "".join(f"<p>{line}</p>" for line in lines[: siblings // 2]) + "<p>Read us daily</p>" + "".join(f"<p>{line}</p>" for line in lines[siblings // 2 :])
            pages.append((key, f"http://s{siblings}.example/{i}", f'<body><div id="post-{key}" class="item item-{key}">{body}</div></body>'))
            want[key] = "\n".join(lines)
    assert texts(spark, pages) == want


def test_hosts_with_few_pages(spark):
    """Short texts on all of two to seven pages are template; long ones, and those of near copies, are not."""
    long = "A passage of many words that both articles quote. " * 8
    pages, want = [], {}
    for n in (2, 3, 7):
        for i in range(n):
            story = f"Story {i} of {n} " + f"word{i} " * 60
            pages.append((10 * n + i, f"http://few{n}.example/{i}", f"<body><div><p>{story}</p><p>{long}</p><p>Follow us daily</p></div></body>"))
            want[10 * n + i] = wrapper.clean(f"{story}") + "\n" + long.strip()
            pages.append((100 * n + i, f"http://copies{n}.example/{i}", f"<article><p>Same story.</p><p>And so it goes.</p><p>{i}</p></article>"))
            want[100 * n + i] = f"Same story.\nAnd so it goes.\n{i}"
    assert texts(spark, pages) == want


def test_names_alone_do_not_cut_an_article(spark):
    page = (
        '<body><div class="legal">imprint {i}</div><article><h1>T{i}</h1><p>a{i}</p><div class="social-history"><p>b{i}</p></div><p class="legal">c{i}</p>'
        '<figure><img src=x><figcaption>d{i}</figcaption></figure><div class="comments"><p>first {i}</p></div><div class="ad-slot">buy {i}</div></article></body>'
    )
    pages = [(i, f"http://n{i % 2 * i}.example/{i}", page.format(i=i)) for i in range(20)]
    assert texts(spark, pages) == {i: f"T{i}\na{i}\nb{i}\nc{i}\nd{i}" for i in range(20)}


def test_wrapper_alone_finds_the_article(monkeypatch):
    """Without any names of tags or classes: links, short slots and constant lines around the main part go."""
    monkeypatch.setattr(wrapper, "ASIDE", wrapper.RAW)
    for name in ("_SIGNS", "_HINTS", "_MAIN"):
        monkeypatch.setattr(wrapper, name, re.compile("(?!)"))
    page = (
        "<body><div class=x1><a href=/a>Home {i}</a> <a href=/b>News</a></div><div class=y>Buy {i} now</div>"
        "<div class=text><h1>Title {i}</h1>{body}<p>Read us daily</p></div><div class=z>(c) site, number {i}</div></body>"
    )
    trees = [wrapper.parse(page.format(i=i, body="".join(f"<p>Paragraph {k} of page {i} says something.</p>" for k in range(5 + i % 7)))) for i in range(30)]
    whole = wrapper.template_of(trees[0])
    for tree in trees[1:]:
        whole = wrapper.merge(whole, wrapper.template_of(tree))
    learned = wrapper.decide(whole)
    for i, tree in enumerate(trees):
        assert wrapper.extract(tree, learned) == "\n".join([f"Title {i}", *(f"Paragraph {k} of page {i} says something." for k in range(5 + i % 7))])


def test_counts_of_texts_stay_within_their_bound():
    rng = random.Random(2)
    page = lambda words: wrapper.template_of(wrapper.parse("<div>" + "".join(f"<p>{w}</p>" for w in words) + "</div>"))
    pages = [[f"w{rng.randint(0, 9) if rng.random() < 0.3 else rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 6))] for _ in range(400)]
    parts = [page(p) for p in pages]
    while len(parts) > 1:
        parts = [wrapper.merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    node = parts[0]["k"][0]["k"][0]
    assert node["o"] <= len(pages) / wrapper.SPARE and len(node["t"]) <= wrapper.SPARE * 6
    for word in {w for p in pages for w in p}:
        true, counted = sum(word in p for p in pages), node["t"].get(f"{zlib.crc32(word.encode())}:{len(word)}", 0)
        assert counted <= true <= counted + node["o"]


def test_matching_equals_enumeration_on_small_trees():
    """Simple tree matching against trying every order-keeping choice of pairs."""

    def tree(depth):
        return {"l": rng.choice("ab"), "k": [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []}

    def best(a, b):
        if a["l"] != b["l"]:
            return 0
        sizes = range(min(len(a["k"]), len(b["k"])) + 1)
        choices = ((x, y) for n in sizes for x in itertools.combinations(a["k"], n) for y in itertools.combinations(b["k"], n))
        return 1 + max(sum(map(best, x, y)) for x, y in choices)

    rng = random.Random(1)
    for _ in range(150):
        a, b = tree(2), tree(2)
        assert wrapper.match_size(a, b) == best(a, b)
