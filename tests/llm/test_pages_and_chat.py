import hashlib
import re

from pyspark.sql import functions as F

from rowferry.llm.chat import TURN, conversation_digests, format_conversations, unescaped
from rowferry.llm.pages import deduce_templates, extract, main_texts

PAGE = (
    '<!DOCTYPE html><html><head><title>T {n}</title><script>var a="</p>";</script></head><body><header>Site</header>'
    "<nav><ul><li>Home<li>About {n}</ul></nav><article><h1>Head {n}</h1><p>Read &amp; share</p><p><b>First {n}<br>line"
    "<p>Second&nbsp; {n}<ul><li>x{n}<li>y</ul><aside>Side</aside><form>Mail</form><section class='comments'><p>Nice {n}</p></section>"
    "</article><div class='cookie-notice'>Cookies {n}</div><footer>&copy; {n}</footer></body></html>"
)


def test_article_of_a_template(spark):
    rows = [(k, f"https://One.example.org:80/{k}", PAGE.format(n=f"no{k}"), "extra") for k in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for r in main_texts(frame).collect():
        n = f"no{r['page_id']}"
        # What is equal on every page of the host stays where it stands in the article.
        assert r["text"] == f"Head {n}\n\nRead & share\n\nFirst {n} line\n\nSecond {n}\n\nx{n}\n\ny"
    template = deduce_templates(frame).collect()[0]
    assert template["host"] == "one.example.org"
    assert [t["token"] for t in template["template"][0]["tokens"]][:2] == ["<html", "/html<head"]


def test_edge_cases(spark):
    same = PAGE.format(n="same")
    rows = [
        (1, "http://a.example/1", None),
        (2, "http://a.example/2", ""),
        (3, None, "<p>no host</p>"),
        (4, "no url", "plain text &lt;only&gt;"),
        (None, "http://a.example/3", "<div><p>one<p>two</div>three"),
        (5, "http://b.example/1", same),
        (6, "http://b.example/2", same),
        (7, "http://b.example/3", same),
        (7, "http://b.example/3", same),
        (8, "http://c.example/", "<p>" + "word " * 200_000 + "</p><p><unclosed"),
        (9, "http://c.example/", "<div hidden>x</div><div style='display: none'>y</div><main>kept<div role=navigation>z</div></main>out"),
    ]
    found = {}
    for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect():
        found.setdefault(r["page_id"], []).append(r["text"])
    whole = "Head same\n\nRead & share\n\nFirst same line\n\nSecond same\n\nxsame\n\ny"
    assert found[1] == found[2] == [""] and found[3] == ["no host"] and found[4] == ["plain text <only>"]
    assert found[None] == ["one\n\ntwo\n\nthree"]
    # A host of copies has no slots; its pages keep their text.
    assert found[5] == found[6] == [whole] and found[7] == [whole, whole]
    assert found[8] == [("word " * 200_000).strip()] and found[9] == ["kept"]
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_and_links():
    assert extract("<div class='post-with-sidebar'><p>a</p></div><div id=sidebar>b</div>") == "a"
    assert extract("<ul><li><a href=x>menu</a><li><a href=y>more</a></ul><p>Text with <a href=z>a link</a> in it.</p>") == "Text with a link in it."
    assert extract("<article>a<article class='comment'>b</article></article><article>c</article>") == "a\n\nc"
    assert extract("<article><header><h1>h</h1></header>a<!-- <p>x</p> -->b</article>") == "h\n\nab"
    assert extract('<p title="a > b">x</p><p class="unclosed>y</p>') == "x\n\ny"


def test_real_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    from html import unescape

    for r in main_texts(pages).collect():
        body = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:h1|p)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


TURNS = [
    (1, 0, "user", "### hi </turn> \\ ####### <"),
    (1, 1, "assistant", "\\h \\\\l </turn></turn>\n### x\n"),
    (1, 1, "assistant", "\\h \\\\l </turn></turn>\n### x\n"),
    (2, None, None, None),
    (2, 0, "assistant", ""),
    (2, 3, "odd\n### role </turn>\\", "é日\U0001f642"),
    (None, 0, "assistant", "no conversation"),
    (3, 0, "assistant", "x" * 300_000),
    *((4, k, "assistant" if k % 2 else "user", f"turn {k} " + "long " * 2000) for k in range(1200)),
]


def test_round_trip(spark):
    frame = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, loss string").repartition(4)
    pieces = format_conversations(frame)
    rows = sorted(pieces.collect(), key=lambda r: (r["conv_id"] or 0, r["piece"]))
    expected = {}
    for conv_id, turn, role, text in sorted(TURNS, key=lambda t: (t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        expected.setdefault(conv_id, []).append((role or "", text or ""))
    for conv_id, turns in expected.items():
        own = [r for r in rows if r["conv_id"] == conv_id]
        assert [r["piece"] for r in own] == list(range(len(own)))
        read = [(unescaped(a), unescaped(b)) for r in own for a, b in TURN.findall(r["text"])]
        assert read == turns
        assert "".join(r["text"] for r in own) == "".join(m[0] for r in own for m in TURN.finditer(r["text"]))
        learned = [unescaped(r["text"][s["start"] : s["end"]]) for r in own for s in r["loss"]]
        assert learned == [b for a, b in turns if a == "assistant"]
    assert sum(r["conv_id"] == 4 for r in rows) > 1
    for r in conversation_digests(pieces).collect():
        turns = expected[r["conv_id"]]
        learned = "".join(b for a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(x["text"]) for x in rows if x["conv_id"] == r["conv_id"])


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_conversations(none)).count() == 0
    assert format_conversations(none).agg(F.count("*")).first()[0] == 0
