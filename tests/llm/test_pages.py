import pytest

from tallygrid.llm import html
from tallygrid.llm.queries import QUERIES

PROSE = (
    "The river was wide and it had a lot of stones in it, so that the people of the town went to "
    "the other side by boat and not on foot. They did so for many years until a bridge was made. "
)


def test_article_without_what_stands_around_it():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
      <header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
      <div class="cookie-notice">We use cookies</div><aside>{PROSE}</aside>
      <article><h1>A &amp; B</h1><p>{PROSE}</p><div class="ad-box">Buy</div><p>Short.</p>
      <form><p>{PROSE}</p></form><!-- {PROSE} --><script>var t = "</p>";</script>
      <section id="comments"><p>{PROSE}</p></section><p>&lt;b&gt; &#233;&nbsp;caf&eacute;
      end</p></article><footer>&copy; x</footer></body></html>"""
    text = PROSE.strip()
    assert html.main_text(page) == f"A & B\n\n{text}\n\nShort.\n\n<b> é café end"


def test_pages_without_an_article_go_by_density():
    links = "".join(f"<a href=/{n}>page number {n}</a> " for n in range(20))
    page = f"<div>{links}</div><p>Lead.</p><p>{PROSE * 2}</p><p>{PROSE * 2}</p><p>End.</p><div>{links}</div>"
    # the lead stands between links and prose, so it is not surely text
    assert html.main_text(page) == f"{PROSE * 2}".strip() + f"\n\n{PROSE * 2}".rstrip()


def test_undecided_blocks_follow_their_nearest_neighbour():
    blocks = [html.Block(PROSE * 2, 0, 0), html.Block("Short.", 0, 0), html.Block("More.", 0, 0)]
    html.label(blocks)
    assert [b.label for b in blocks] == [html.GOOD] * 3


POLISH = (
    "Rzeka była szeroka i pełna kamieni, więc mieszkańcy miasta przeprawiali się na drugi brzeg łodzią. "
    "Robili tak przez wiele lat, dopóki nie zbudowano mostu, który stoi tam jeszcze dziś, choć drewniany. "
)


def test_articles_of_other_languages_are_not_lost_to_a_link_list():
    links = "".join(f"<a href=/{n}>strona numer {n}</a> " for n in range(20))
    page = f"<article><p>{POLISH}</p><p>{POLISH}</p><div>{links}</div><p>{POLISH}</p></article>"
    assert html.main_text(page) == "\n\n".join([POLISH.strip()] * 3)
    river = "这条河很宽，里面有很多石头，所以镇上的人们坐船到对岸去，而不是步行。" * 3
    assert html.main_text(f"<article><p>{river}</p><div>{links}</div></article>") == river


def test_only_short_blocks_follow_a_neighbour():
    blocks = [html.Block(POLISH, 0, 1), html.Block("Krótko.", 0, 1), html.Block("x" * 90, 90, 1)]
    html.label(blocks)
    assert [b.label for b in blocks] == [html.GOOD, html.GOOD, html.BAD]


@pytest.mark.parametrize(
    "wrapper",
    ["class='layout has-sidebar'", "id='search-results'", "id=search", "class='page sidebar'", "class=header"],
)
def test_wrappers_do_not_take_long_text_along(wrapper):
    text = (PROSE * 2).strip()
    page = f"<div {wrapper}><div><p>{text}</p></div><div>x</div><p>{text}</p></div><div><a href=x>Home</a></div>"
    assert html.main_text(page).split("\n\n")[0] == text and html.main_text(page).count(text) == 2


def test_named_places_still_lose_short_and_linked_text():
    links = "".join(f"<a href=/{n}>the page of the number {n} and more</a> " for n in range(20))
    text = (PROSE * 2).strip()
    page = (
        f"<div class=sidebar><div>{links}</div><p>Short.</p></div><article><p>{text}</p>"
        f"<div class='ad-box'>Buy <div>now</div> here</div><p>End.</p><div id=comments><p>{text}</p></div></article>"
    )
    assert html.main_text(page) == f"{text}\n\nEnd."


SCRIPTS = {
    "polish": POLISH * 2,
    "russian": "Река была широкой и полной камней, поэтому жители города переправлялись на другой берег на лодках. " * 4,
    "greek": "Το ποτάμι ήταν πλατύ και γεμάτο πέτρες, γι' αυτό οι κάτοικοι περνούσαν απέναντι με βάρκα. " * 4,
    "arabic": "كان النهر واسعا ومليئا بالحجارة، لذلك كان أهل المدينة يعبرون إلى الضفة الأخرى بالقوارب. " * 4,
    "hindi": "नदी चौड़ी और पत्थरों से भरी थी इसलिए शहर के लोग नाव से दूसरे किनारे जाते थे। " * 4,
    "chinese": "这条河很宽，里面有很多石头，所以镇上的人们坐船到对岸去，而不是步行。" * 4,
    "japanese": "川は広くて石が多かったので、町の人々は船で向こう岸へ渡りました。橋はまだありませんでした。" * 4,
    "english": PROSE * 2,
}
LINKS = "".join(f"<a href=/{n}>{n} more</a> " for n in range(20))
AROUND = {
    "plain": "<div>{}</div>",
    "page form": "<form id=aspnetForm method=post><input type=hidden name=v><div>{}</div></form>",
    "forms in a form": "<form><form action=/s><input></form><table><tr><td>{}</td></tr></table></form>",
    "search form before": "<form action=/s><label>Find</label><input></form><div>{}</div>",
    "unclosed nav": "<nav><a href=/>Home</a><div>{}</div>",
    "unclosed nav in a div": "<div><nav><ul><li><a href=/>Home</a></ul></div><div>{}</div>",
    "unclosed button": "<div><button>Menu</div><div>{}</div>",
    "unclosed link": "<div><a href=/>Home</div><div>{}</div>",
    "hidden in a value": "<div title='the hidden truth' data-x=\"display: none of it\">{}</div>",
    "hidden as a class": "<div class='flex hidden md:block'>{}</div>",
    "crossed tags": "<b><div></b>{}</div></b></i></section>",
    "after a hidden part": "<div hidden><p>" + PROSE * 2 + "</p></div><div aria-hidden=true>" + PROSE * 2 + "</div><div>{}</div>",
    "after a menu": "<nav>" + LINKS + "<p>" + PROSE * 2 + "</p></nav><div>{}</div>",
    "after a teaser": "<aside><article><p>" + PROSE * 2 + "</p></article></aside><div>{}</div>",
    "in main": "<header><h1>Site</h1></header><main>{}</main><footer>" + PROSE * 2 + "</footer>",
}


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("script", SCRIPTS)
def test_paragraphs_survive_what_stands_around_them(around, script):
    """Made-up pages: the paragraphs are known, whatever the markup and script."""
    text = SCRIPTS[script].strip()
    page = f"<html><body>{AROUND[around].format(f'<p>{text}</p><p>{text}</p>')}<div>{LINKS}</div></body></html>"
    assert html.main_text(page) == f"{text}\n\n{text}"


@pytest.mark.parametrize(
    "form",
    [
        f"<form><p>{PROSE}</p><input></form>",
        f"<form><div>{LINKS * 3}</div><label>Name</label></form>",
        "<form><select><option>one<option>two</select><button>Go</button></form>",
        f"<form role=search><p>{PROSE}</p></form>",
    ],
)
def test_small_forms_go(form):
    text = (PROSE * 2).strip()
    assert html.main_text(f"<div><p>{text}</p>{form}<p>{text}</p></div>") == f"{text}\n\n{text}"


def test_attributes_hide_only_by_name():
    text = (PROSE * 2).strip()
    for attribute in ("hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display : none'", "STYLE=visibility:hidden"):
        assert html.main_text(f"<article><p {attribute}>{text}</p><p>End.</p></article>") == "End."
    for attribute in ("data-hidden=1", "aria-hidden=false", "title='so hidden it is'", "hidden=until-found", "class=hidden"):
        assert html.main_text(f"<article><p {attribute}>{text}</p></article>") == text


def test_mixed_up_tags_take_linear_time():
    html.main_text("<nav>" * 50_000 + "</div>" * 50_000 + "<article>" * 50_000)
    html.main_text("<button><div>" * 30_000 + "</button>" * 30_000)
    html.main_text("<a>" * 50_000 + "<p>x" * 50_000 + "</form>" * 50_000)


def test_columns_named_like_the_result(spark):
    rows = [(1, "u", f"<article>{PROSE}</article>", 2.5, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars double, text string")
    assert [tuple(r) for r in html.extract(pages).collect()] == [(1, "u", PROSE.strip(), len(PROSE) - 1)]


@pytest.mark.parametrize(
    "page", ["", None, "<", "<p", "<p class='", "<article", "</p></div>", "<script>", "<!--", "&"]
)
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.main_text(page), str)


def test_cut_off_and_unclosed_pages():
    assert html.main_text("<article><p>One two<p>three <b>four</article>") == "One two\n\nthree four"
    assert html.main_text("<article><p>One &amp two &am</p><p cla") == "One & two &am"
    assert html.main_text("<div class=menu>x<article><p>In</p></article>") == "In"


def test_line_breaks_and_inline_tags():
    page = "<article><p>a<br>b<b>c</b>d<br><br>e</p></article>"
    assert html.main_text(page) == "a bcd\n\ne"


def test_long_pages_take_linear_time():
    html.main_text("<" * 200_000)
    html.main_text('<a href="' * 20_000)
    html.main_text("<div>" * 100_000 + "text")


def test_rows(spark, tables):
    rows = [(1, "u", f"<article>{PROSE}</article>", 5), (1, "u", None, 5), (None, None, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 0), (1, 0), (1, len(PROSE) - 1)]
    assert html.extract(pages.limit(0)).count() == 0
    query = QUERIES["op4_html"](spark, tables)
    assert query.columns == ["page_id", "url", "text", "n_chars"]
    assert query.count() == spark.read.parquet(f"{tables}/pages.parquet").count()


def test_given_pages_keep_exactly_their_articles(spark, tables):
    import html as entities
    import re

    found = {r.page_id: r.text for r in QUERIES["op4_html"](spark, tables).collect()}
    for row in spark.read.parquet(f"{tables}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        article = re.sub(r"<[^>]*$", "", article)
        blocks = re.split(r"<p>|<h1>|</h1>|</p>", article)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert found[row.page_id] == "\n\n".join(b for b in blocks if b)
