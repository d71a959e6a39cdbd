"""Text and boilerplate of pages, inside and outside of article regions."""

from brindle.llm import html_extract


def words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def texts(spark, rows):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract(pages).orderBy("page_id").collect()]


def test_blocks_outside_and_inside_a_region(spark):
    rows, want = [], []
    for k in range(8):
        rows.append((f"http://h.example/{k}", f"<nav>menu</nav><p>{words(k, 6)}</p><div>all rights are kept by us</div><article><p>{words(100 + k, 40)}</p><p>like and share this page now</p></article><p>{words(200 + k, 9)}</p>"))
        want.append(f"{words(k, 6)} {words(100 + k, 40)} {words(200 + k, 9)}")
    assert texts(spark, rows) == want


def test_shared_phrases_stay(spark):
    phrase = "in the course of the last year"
    pages = [f"{words(k, 30)} {phrase} {words(50 + k, 30)}" for k in range(12)]
    assert texts(spark, [(f"http://h.example/{k}", f"<div>{p}</div>") for k, p in enumerate(pages)]) == pages


def test_an_article_on_two_pages_stays(spark):
    article = [words(1, 60), words(2, 12), words(3, 45)]
    body = "".join(f"<p>{p}</p>" for p in article)
    rows = [("http://h.example/a", body), ("http://h.example/b", body), ("http://i.example/a", body + "<p>one other line here</p>"), ("http://i.example/b", body)]
    got = texts(spark, rows)
    assert got == [" ".join(article), " ".join(article), " ".join(article) + " one other line here", " ".join(article)]


def test_names_and_references_inside_an_article(spark):
    pages = [
        ("http://h.example/1", "<article><div class='entry-header'><h1>Title</h1></div><p>a &<b>lt;</b> b</p><div class='related-work'>older work</div><div class='comments'>me too</div></article>"),
        ("http://h.example/2", "<header>top</header><div class='related'>see also</div><p>R&amp;D &#233;t&eacute;</p>"),
    ]
    assert texts(spark, pages) == ["Title a &lt; b older work", "R&D été"]


def test_pages_without_a_host_are_compared_with_none(spark):
    pages = [(url, f"<p>a line that all have</p><p>{words(k, 30)}</p>") for k, url in enumerate((None, "/a", "b.html", None, "", "/c"))]
    assert texts(spark, pages) == [f"a line that all have {words(k, 30)}" for k in range(6)]


def test_long_pages(spark):
    """A page of many blocks costs in proportion, and comes out whole but for what repeats."""
    long = "".join(f"<p>{words(k, 12)}</p>" for k in range(8000))
    rows = [(f"http://h.example/{k}", f"<p>the same notice on every page</p><p>{words(9000 + k, 30)}</p>" + (long if k == 0 else "")) for k in range(6)]
    got = texts(spark, rows)
    assert got[0] == " ".join([words(9000, 30), *(words(k, 12) for k in range(8000))]) and got[3] == words(9003, 30)


def test_blocks_against_brute_force(spark):
    """Generated hosts: which blocks stay, by counting pages in plain Python."""
    import random

    rng = random.Random(7)
    shared = [" ".join(rng.choices("abcdefgh", k=rng.choice((3, 6, 30)))) + f" s{k}" for k in range(14)]
    rows, made = [], []
    for k in range(60):
        host, own = f"h{k % 3}.example", []
        own = [(rng.choice(shared) if rng.random() < 0.6 else words(k * 100 + j, rng.choice((2, 9, 40))), rng.random() < 0.5) for j in range(rng.randrange(1, 9))]
        own.insert(0, (words(10_000 + k, 60), True))  # its own longest block
        made.append((host, own))
        rows.append((f"http://{host}/{k}", "".join(f"<article><p>{t}</p></article>" if inside else f"<p>{t}</p>" for t, inside in own)))
    h, want = html_extract, []
    for host, own in made:
        pages = [b for a, b in made if a == host]
        kept = []
        for text, inside in own:
            n, long = sum(any(t == text for t, _ in page) for page in pages), len(text.split()) >= h.LONG
            often = n > 1 and (n >= h.MANY or n >= h.SHARE * len(pages)) and (not long or n >= h.FEW)
            if not (often and (not inside or (n >= h.FEW and n >= h.INSIDE_SHARE * len(pages)))):
                kept.append(text)
        want.append(" ".join(kept))
    assert texts(spark, rows) == want


def only(source):
    return " ".join(t for t, _, noise in html_extract.blocks(source) if not noise)


def test_omitted_and_odd_markup():
    """Heads without an end, quoted ends of tags, names that hold a noise word but say something else."""
    assert only("<html><head><title>T</title><body><p>hello there</p></body></html>") == "hello there"
    assert only("<html><head><title>T</title><meta name=a><p>hello there</p>") == "hello there"
    assert only("<head><script>if (a<b) '<p>no</p>'</script><style>p{}</style></head><p>x") == "x"
    assert only("<title>T</title><p>x</p>") == "x"
    assert only("<header>top</header><p>x</p>") == "x"
    assert only("""<p><a title="a > b" href='x>y'>link</a> and <b data-x=1>more</b></p>""") == "link and more"
    assert only("""<p title=it's>one</p><p title='open>two</p>""").startswith("one")
    for name in ('section class="social-policy"', 'div class="widget-free text"', 'p id="comments-on-the-law"', 'div class="has-sidebar"'):
        assert only(f"<main><{name}>kept</{name.split()[0]}></main><{name}>kept</{name.split()[0]}>") == "kept kept", name
    for name in ("sidebar", "site-footer", "comments-list", "ad-slot-2", "cookie banner", "share-buttons"):
        assert only(f'<div class="{name}">gone</div><p>x</p>') == "x", name


def test_markup_costs_in_proportion():
    import time

    for source in ("<head>" + "<meta a='b'>" * 40_000 + "<p>x</p>", "<p " + "a='b' " * 100_000 + ">x</p>", "<p>" + "<" * 200_000, "<a '" * 20_000 + "x", "x" * 3_000_000):
        began = time.perf_counter()
        html_extract.blocks(source)
        assert time.perf_counter() - began < 20
