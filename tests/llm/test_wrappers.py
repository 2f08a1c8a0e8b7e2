from ledgerproof.llm import wrappers as W


def page(k, paragraphs, notice=True, aside=True):
    body = "".join(f"<p>Paragraph {k}.{n} with &amp; <b>bold</b>\n  words<br>here." for n in range(paragraphs))
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><script>var a='</p>';</script><style>p{{}}</style></head>"
        f"<body><header><h1>Site</h1></header><div class='top-menu'><ul><li><a href=/a>Home {k}</a><li>"
        f"<a href=/b>News</a></ul></div><!-- x --><div id=content-{k}><h1>Title {k}</h1>{body}"
        + ("<div class='cookie-notice'><p>We use cookies</div>" if notice else "")
        + f"<table><tr><td>cell {k}</table><form><p>Search {k}</form></div>"
        + (f"<aside><p>Side {k}</aside>" if aside else "")
        + f"<section class=comments><p>Nice {k}!</p></section><footer>&copy; {k}</footer></body></html>"
    )


def wanted(k, paragraphs):
    return "\n".join(
        [f"Title {k}", *[f"Paragraph {k}.{n} with & bold words here." for n in range(paragraphs)], f"cell {k}"]
    )


def test_wrapper_of_a_template():
    pages = [page(k, 1 + k % 4, k % 2 == 0, k % 3 == 0) for k in range(12)]
    wrapper = W.inferred(pages)
    for k in range(40):
        assert W.extracted(page(k, k % 7, k % 2 == 1, k % 5 == 0), wrapper) == wanted(k, k % 7)
    assert len(wrapper["items"]) < 60


def test_alignment_finds_groups_and_options():
    a = W.folded([W.item_of(u) for u in W.units_of("<div><p>a<p>b</div><ul><li>x</ul>")])
    b = W.folded([W.item_of(u) for u in W.units_of("<div><p>a<p>c<p>d</div><hr><section>y</section><ul><li>x<li>z</ul>")])
    items = {i.key: i for i in W.folded(W.aligned(a, b))}
    assert items["#p"].times and items["#li"].times and not items["div"].optional
    assert items["section"].optional
    rows = "".join(f"<div class=row><h2>h{k}</h2><p>t{k}</div>" for k in range(5))
    folded = W.folded([W.item_of(u) for u in W.units_of(rows)])
    assert len(folded) == 1 and folded[0].times and len(folded[0].body) == 4


def test_article_without_furniture():
    text = """<body><nav>menu</nav><article><header><h1>Head</h1></header><p>One</p><div class="ad">buy</div>
    <p>Two <a href=x>link</a></p><div role="alert">note</div><article class="comment">reader</article>
    <button>ok</button></article><article><p>Three</article><div class="sidebar">s</div>"""
    assert W.extracted(text, W.inferred([text])) == "Head\nOne\nTwo link\nThree"


def test_text_that_never_changes_is_template():
    pages = [f"<article><p>Read our paper daily<h1>H{k}</h1><p>Text {k}</article>" for k in range(8)]
    assert W.extracted(pages[0], W.inferred(pages)) == "H0\nText 0"
    assert W.extracted(pages[0], W.inferred(pages[:2])).startswith("Read our paper")


def test_broken_pages():
    for text in (None, "", "plain text", "<", "<p", "<p>a<b", "</p></div>", "<!--", "<script>x", "<a href='", "a < b",
                 "<div" * 3000, "<a \"" * 3000, "<p>" * 20_000 + "x", "<div>" * 2000 + "deep", "&#x110000; &bogus;"):
        out = W.extracted(text, W.inferred([text] if text else []))
        assert isinstance(out, str)
    assert W.extracted("plain &lt;text&gt;\n two", None) == "plain <text> two"
    assert W.extracted("a < b", None) == "a < b"


def test_table_with_nulls_and_clashes(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"http://User@Host:80/{k}", page(k, 3)) for k in range(20)]
    rows += [(3, rows[3][1], rows[3][2]), (None, "http://host:80/x", page(50, 2)), (60, None, page(60, 1)),
             (61, "http://host:80/y", None), (62, "odd", ""), (63, "http://one/", "<article><p>x</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "host", F.lit(1)).withColumn("wrapper", F.lit("w"))
    for limit in (1 << 20, 0):
        got = {}
        for r in W.main_texts(pages, options=W.Options(broadcast=limit)).collect():
            got.setdefault(r.page_id, []).append(r.text)
        assert sum(map(len, got.values())) == len(rows)
        assert got[5] == [wanted(5, 3)] and got[3] == [wanted(3, 3)] * 2 and got[None] == [wanted(50, 2)]
        assert got[60] == [wanted(60, 1)] and got[61] == [""] and got[62] == [""] and got[63] == ["x"]
    assert W.main_texts(pages.where("false")).count() == 0


def hosted(spark, texts):
    rows = [(k, f"http://host/{k}", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts_of(df):
    return [r.text for r in sorted(W.main_texts(df).collect(), key=lambda r: r.page_id)]


def test_only_the_very_text_is_template(spark):
    pages = [f"<article><p>Read us daily<h1>H{k}</h1><p>Text {k}</article>" for k in range(40)]
    pages[7] = "<article><p>An own first paragraph<h1>H7</h1><p>Text 7</article>"
    pages[9] = "<article><p>Read us daily</article>"
    got = texts_of(hosted(spark, pages))
    assert got[7] == "An own first paragraph\nH7\nText 7" and got[9] == "Read us daily"
    assert all(got[k] == f"H{k}\nText {k}" for k in range(40) if k not in (7, 9))


def test_texts_of_few_pages_are_no_template(spark):
    # The sample may see one text only; a third of all pages say something else.
    pages = [
        f"<article><p>{'Opinion' if k % 3 else f'Report {k}'}<h1>H{k}</h1><p>Text {k}</article>"
        for k in range(60)
    ]
    assert texts_of(hosted(spark, pages)) == [
        f"{'Opinion' if k % 3 else f'Report {k}'}\nH{k}\nText {k}" for k in range(60)
    ]


def test_copies_of_a_page_are_one_page(spark):
    pages = ["<article><h1>Same</h1><p>Copied text</article>"] * 200
    pages += [f"<article><h1>H{k}</h1><p>Text {k}</article>" for k in range(3)]
    assert texts_of(hosted(spark, pages))[:200] == ["Same\nCopied text"] * 200


def test_class_words_never_take_the_article():
    for text, expected in [
        ("<div class='post-12 post category-legal tag-search'><article><h1>H</h1><p>Text</article></div>"
         "<div class=comments><p>Nice</div>", "H\nText"),
        ("<article class='post has-sidebar share-enabled'><h1>H</h1><p>Text</article>", "H\nText"),
        ("<article><div class='article-header'><h1>H</h1><p>by me</div><p>Text</article>", "H\nby me\nText"),
        ("<article><p>Text<div class='social-body'><p>" + "much more " * 9 + "</div></article>",
         "Text\n" + ("much more " * 9).strip()),
        ("<div class=comments><article><p>Longer than all of it, a reader says</article></div>"
         "<article><p>Text</article>", "Text"),
        ("<div class='search page'><div class='legal'><p>All of the text is here</div></div>",
         "All of the text is here"),
    ]:
        assert W.extracted(text, W.inferred([text])) == expected


def test_links_and_formulas_of_the_article_stay():
    sources = "".join(f"<li><a href=/{k}>Source {k}</a></li>" for k in range(5))
    text = f"<article><p>A <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b<ul>{sources}</ul></article>"
    assert W.extracted(text, W.inferred([text])) == "\n".join(
        ["A x=2 b", *[f"Source {k}" for k in range(5)]]
    )


def test_deep_pages_are_linear():
    import time

    def seconds(depth):
        text = "<div>" * depth + "<p>deep" + "</div>" * depth
        start = time.process_time()
        units = W.units_of(text)
        assert W.extracted(text, None) == "deep" and len(units) == 2 * depth + 1
        return time.process_time() - start

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)
