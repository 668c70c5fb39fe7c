import random

from pyspark.sql import types as T

from tidemark.llm.html_extract import extract, extract_text

P1 = "The first paragraph of the story, with commas, goes on for a while so that it counts as running text."
P2 = "A second paragraph follows the first, and it too is long enough, by any measure, to be taken for prose."
P3 = "Short end."
SIDE = "<div class='sidebar'><p>Read this other thing, which is long enough to be scored, but stands in the sidebar.</p></div>"
COMMENTS = "<div id=comments><p>I liked this very much, thank you, and I have written many words, here, to say so.</p></div>"


def test_article_without_what_surrounds_it():
    page = f"""<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head &amp; line</h1><p>{P1}<p>{P2}</p><ul><li>one<li>two</ul><p>{P3}</p></article>
    {SIDE}{COMMENTS}<form><p>Sign up, please, for the letter, which is long enough to be scored too.</p></form><footer>&copy; all</footer></body></html>"""
    assert extract(page) == "\n".join(["Head & line", P1, P2, "one", "two", P3])


def test_best_container_and_siblings_without_an_article():
    page = f"<body><div class=menu><a href=x>A</a></div><div id=w><div class=story><h2>H</h2><p>{P1}</p><p>{P2}</p></div><div class=more><p>{P2}</p></div></div><div class='ad banner'>Buy, now, this is an advert with commas, many.</div></body>"
    assert extract(page) == "\n".join(["H", P1, P2, P2])
    links = "".join(f"<p><a href={i}>A link, with commas, and a long text that says little, number {i}</a></p>" for i in range(20))
    assert extract(f"<div>{links}</div><div><p>{P1}</p><p>{P2}</p></div>") == f"{P1}\n{P2}"


def test_text_of_blocks():
    assert extract(f"<article><p>a&nbsp;b\n\t c<br>d &#228; &lt;tag&gt; &amp;amp; <b>bo</b>ld</p><!-- x --><p>{P1}</p></article>") == f"a b c d ä <tag> &amp; bold\n{P1}"
    assert extract(f"<article><p><b>{P1}<br><p>{P2}<hr>{P3}") == f"{P1}\n{P2}\n{P3}"
    assert extract(None) == extract("") == extract("<html><body></body></html>") == extract("<script>x") == extract("<!-- ") == ""
    assert extract("plain words only") == "plain words only"
    assert extract("a < b <a title='x > y'>c</a> d") != ""
    long = " ".join([P1] * 3000)
    assert extract(f"<article><p>{long}</p></article>") == long
    assert extract("<div>" * 3000 + f"<p>{P1}</p>") == P1
    assert extract("<p><template>no</template><noscript>no</noscript>" + P1) == P1


def test_what_stands_apart_takes_no_article_with_it():
    assert extract(f"<div>{P1} <span class='share'><div>Tweet</div></span></div>") == P1
    assert extract(f"<p>{P1} <video><p>Your browser is old.</p></video></p><p>{P2}</p>") == f"{P1}\n{P2}"
    assert extract(f"<form><h1>T</h1><p>{P1}</p><label>Name</label><select><option>x</select><button>Go</button></form>") == f"T\n{P1}"
    assert extract(f"<div><p class='side-by-side'>{P1}</p><p class='notice-period'>{P2}</p></div>") == f"{P1}\n{P2}"
    assert extract(f"<div class='with-sidebar'><article><p>{P1}</p></article><div class='site-notice'><p>{P2}</p></div></div>") == P1
    assert extract(f"<div id='page-header'><article><p>{P1}</p></article></div>") == P1
    assert extract(f"<h1>Title</h1><div><p>{P1}</p><p>{P2}</p></div>") == f"Title\n{P1}\n{P2}"
    assert extract(f"<article><p>{P1}</p><ul><li><a href=x>Ref one</a><li><a href=y>Ref two</a></ul></article>") == f"{P1}\nRef one\nRef two"
    assert extract(f"<article><p>{P1}</p></article><p>We use cookies, as all do, to see what you read here.</p>") == P1
    assert extract(f"<div><a href=x><div>Go:</a> {P1}</div><p>{P2}</p></div>") == f"Go: {P1}\n{P2}"


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    assert extract("<div>x" * 100_000).count("x") == 100_000
    assert extract("<span>" * 100_000 + f"<p>{P1}</p>" + "</b>" * 100_000) == P1
    assert time.time() - began < 60


def test_generated_pages():
    """Articles of random blocks among random surroundings, whose text is known from how they were made."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    prose = lambda a, b: " ".join(word() + r.choice(["", "", "", ","]) for _ in range(r.randint(a, b))) + "."

    def written(text):
        """The same text as markup: references, inline elements, white space, comments, what is never shown."""
        out = []
        for w in text.split(" "):
            kind = r.random()
            out.append(f"<b>{w}</b>" if kind < 0.05 else f"<em class=x>{w}" + "</em>" if kind < 0.1 else w.replace("a", "&#97;") if kind < 0.15 else w + r.choice(["", "<!-- no -->", "<script>if (a<b) no()</script>"]) if kind < 0.2 else w)
        return r.choice([" ", "\n\t "]).join(out)

    def apart():
        text = written(prose(5, 60))
        return r.choice([
            f"<div class='{r.choice(['ad', 'site-notice', 'cookie-banner', 'comments', 'sidebar left', 'newsletter-signup', 'related-posts'])}'><p>{text}</p></div>",
            f"<nav><ul><li><a href=x>{text}</a></ul></nav>", f"<aside>{text}</aside>", f"<form action=x><p>{written(prose(5, 20))}</p><input></form>", f"<style>p {{}}</style><noscript>{text}</noscript>",
            f"<section id=comments><article class=comment><p>{text}</p></article></section>", f"<div hidden>{text}</div>",
        ])

    for n in range(300):
        body, want = [], []
        for _ in range(r.randint(2, 12)):
            tag = r.choice(["p", "p", "p", "h2", "blockquote", "li", "pre", "td"])
            text = prose(8, 80)
            want.append(text)
            body.append({"li": f"<ul><li>{written(text)}</ul>", "td": f"<table><tr><td>{written(text)}</table>", "p": f"<p>{written(text)}" + r.choice(["", "</p>"])}.get(tag, f"<{tag}>{written(text)}</{tag}>"))
            if r.random() < 0.15:
                body.append(apart())
        title = prose(3, 8)
        inner = f"<h1>{title}</h1>" + "".join(body)
        story = r.choice([f"<article>{inner}</article>", f"<main><div class=content>{inner}</div></main>", f"<div class='wrap with-sidebar'><article>{inner}</article>{apart()}</div>"])
        page = f"<!DOCTYPE html><html><head><title>no</title></head><body><header><h1>no</h1></header>{''.join(apart() for _ in range(r.randint(0, 4)))}{story}{''.join(apart() for _ in range(r.randint(0, 4)))}<footer>no</footer></body></html>"
        assert extract(page) == "\n".join([title, *want]), (n, page)


def test_rows(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("html", T.StringType())])
    rows = [(1, "old", None), (2, "old", f"<p>{P1}</p>"), (2, "old", f"<p>{P1}</p>"), (None, None, "")]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, ""), (2, P1), (2, P1), (None, "")]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
