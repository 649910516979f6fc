"""What belongs to an article stays: equal texts, odd wrappers, links."""

from rowferry.llm.pages import extract, main_texts


def texts(spark, pages, host="a.example"):
    rows = [(k, f"http://{host}/{k}", html) for k, html in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_equal_blocks_of_an_article_stay(spark):
    page = "<body><div>Site name</div><{e}><h1>Head {n}</h1><p>Equal words on every page.</p><h2>Steps</h2><p>Licence.</p></{e}><div>About us</div></body>"
    for element in ("article", "main", "div"):
        found = texts(spark, [page.format(e=element, n=f"no{k}") for k in range(5)])
        for k in range(5):
            assert found[k] == f"Head no{k}\n\nEqual words on every page.\n\nSteps\n\nLicence.", element


def test_copies_of_a_page_count_once(spark):
    page = "<html><head><title>x</title></head><body><div>Site</div><div><p>Words of {n} here.</p><p>More of {n}.</p></div></body></html>"
    found = texts(spark, [page.format(n="a")] * 8 + [page.format(n="b"), page.format(n="c")])
    assert found[0] == found[7] == "Words of a here.\n\nMore of a." and found[9] == "Words of c here.\n\nMore of c."


def test_articles_in_wrappers_and_forms():
    for wrapper in ("div class='wrapper sidebar-left'", "form id=aspnetForm", "aside"):
        end = wrapper.split()[0]
        assert extract(f"<{wrapper}><p>menu</p><article><p>one</p></article></{end}>") == "one", wrapper
    assert extract("<main><div class=related><article>x</article></div><article>the longer one</article></main>") == "the longer one"
    assert extract("<div class=comments><article>no</article></div><p>yes</p>") == "yes"
    assert extract("<article>a long enough text</article><aside><article>teaser</article></aside>") == "a long enough text"


def test_slot_of_a_template_beats_names(spark):
    page = "<body><div>Site</div><div class='sidebar-widget'><p>{n} a whole article of words.</p></div><div class='x'>{n}</div></body>"
    found = texts(spark, [page.format(n=f"no{k}") for k in range(5)])
    assert all("a whole article of words" in t for t in found.values())


def test_links_of_an_article_stay():
    page = "<ul><li><a>Home</a><li><a>News</a></ul><div><h1><a>Title</a></h1><p>Some prose of the page.</p><p><a>A long link</a> x</p><ul><li><a>Ref</a></ul></div><div><a>Next</a> | <a>Last</a></div>"
    assert extract(page) == "Title\n\nSome prose of the page.\n\nA long link x\n\nRef"
