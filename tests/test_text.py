import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import temporal as D
from lodestone.functions import text as T
from lodestone.functions.markup import read_page
from lodestone.functions import web as U


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" if not isinstance(v, list) else f"{k} array<string>" for k, v in cells.items()) or "x int"
    return spark.createDataFrame([tuple(cells.values()) or (1,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "normal"), [("The Cook!", "cook"), ("a  an the", ""), (None, ""), ("Don't, stop-it", "dont stopit"), ("Oièan a la", "oièan la")])
def test_normalize_answer(spark, text, normal):
    assert value(spark, T.normalize_answer("t"), t=text) == normal


@pytest.mark.parametrize(
    ("text", "normal"),
    [("He won't pay 1,000.5 dollars.", "he will not pay 1000.5 dollars"), ("It’s can't; cannot", "it s can not can not"), ("3.5. end", "3.5 end"), ("", ""), (None, "")],
)
def test_judge_normalize(spark, text, normal):
    assert value(spark, T.judge_normalize("t"), t=text) == normal


@pytest.mark.parametrize(
    ("words", "values"),
    [
        ("forty two six", {42.0, 6.0}), ("one hundred and five", {105.0}), ("two thousand five hundred", {2500.0}), ("three million two thousand one", {3002001.0}),
        ("twenty hundred", {2000.0}), ("hundred", set()), ("and", set()), ("one hundred and", {100.0}), ("nineteen ninety", {19.0, 90.0}), ("zero", {0.0}), ("", set()),
    ],
)
def test_spoken_numbers(words, values):
    assert T._spoken(words.split()) == values


def test_numbers_and_years(spark):
    assert value(spark, T.numbers(T.judge_normalize("t")), t="In 1999, forty two of 3.5") == [3.5, 42.0, 1999.0]
    assert value(spark, T.last_year("t"), t="from 1999 to 2004, 31") == 2004
    assert value(spark, T.last_year("t"), t="none") is None


@pytest.mark.parametrize(
    ("text", "stance"),
    [("yes he did", ["affirmative"]), ("she will not play", ["negative"]), ("yet to decide", ["undecided"]), ("no final decision", ["undecided"]), ("he will play", ["affirmative"]), ("blue", [])],
)
def test_stances(spark, text, stance):
    assert value(spark, T.stances(F.col("t")), t=text) == stance


def test_nfkc_and_casefold(spark):
    assert value(spark, T.nfkc("t"), t="ﬁ²") == unicodedata.normalize("NFKC", "ﬁ²")
    assert value(spark, T.casefold("t"), t=" Straße  X ") == "strasse x"
    assert value(spark, T.nfkc("t"), t=None) is None


def test_id_parent(spark):
    parent, index = T.id_parent("t")
    assert value(spark, F.struct(parent, index), t="a\x00b_12_7") == ("a\x00b_12", 7)
    assert value(spark, parent, t="plain") is None


@pytest.mark.parametrize(
    ("text", "dialect", "epoch"),
    [
        ("20200709", "pool", 1594252800), ("1594252800", "pool", 1594252800), ("2020-07-09T00:00:00Z", "pool", 1594252800), ("2020-07-09T00:00:00", "pool", 1594252800), ("soon", "pool", None),
        ("20200709", "mining", 20200709), ("2020-7-9", "mining", 1594252800), ("2020/07/09", "mining", 1594252800), ("2020-07-09 00:00:00", "mining", 1594252800), ("2020-07-09T00:00:00Z", "mining", 1594252800),
        ("2020-07-09T00:00:00+01:00", "mining", None), ("2020-07", "mining", None), ("2020-13-09", "mining", None), ("-5.5", "mining", -6), ("20200709", "gaps", 20200709), ("1594252800", "metric", None), (None, "pool", None),
    ],
)
def test_parse_time(spark, text, dialect, epoch):
    assert value(spark, F.unix_seconds(D.parse_time(F.col("t"), dialect)), t=text) == epoch


ISO_LIKE = [
    "2020-07-09", "20200709", "2020-07-09T12:30", "2020-07-09x12", "2020-07-09T12:30:15.123456789", "2020-07-09T123015,5", "20200709T1230", "2020-07-09 12:30:15+02:00", "2020-07-09T12:30:15-0130", "2020-07-09T12+05",
    "12:30", "T12:30", "2020", "2020-07", "2020-0709", "202007-09", "2020-07-09T", "2020-07-09T1:30", "2020-02-30", "2020-07-09T25:00", "2020-07-09T12:3015", "+2020-07-09", "now", "epoch", "2020-07-09Z", " 2020-07-09", "2020-7-9", "",
]


def test_iso_times_as_python_reads_them(spark):
    import datetime

    def plain(x):
        try:
            t = datetime.datetime.fromisoformat(x)
        except ValueError:
            return None
        return (t if t.tzinfo else t.replace(tzinfo=datetime.UTC)).timestamp()

    rows = spark.createDataFrame([(x,) for x in ISO_LIKE], "t string").select("t", (F.unix_micros(D.parse_time(F.col("t"), "metric")) / 1e6).alias("v")).collect()
    assert {r.t: r.v for r in rows} == {x: plain(x) for x in ISO_LIKE}


@pytest.mark.parametrize(("text", "ok"), [("2020-07-09T00:00:00Z", True), ("2020-07-09T00:00:00.123456+00:00", True), ("2020-07-09T00:00:00", False), ("2020-13-09T00:00:00Z", False), (None, False)])
def test_strict_utc(spark, text, ok):
    assert value(spark, D.strict_utc(F.col("t")), t=text) is ok


def test_urls(spark):
    u = "http://x.org/a;p=1/?q=2#top"
    assert value(spark, U.url_fetch_key(F.col("t")), t=u) == "http://x.org/a;p=1/?q=2"
    assert value(spark, U.url_pool_key(F.col("t")), t="http://x.org/a/b;p=1?q=2#top") == "http://x.org/a/b?q=2"
    key = lambda u: value(spark, U.url_pool_key(F.col("t")), t=u)
    assert [key(u) for u in ("http://x/a/?q=1", "http://x/a?q=b/", "HTTP://X/a?", "http://x//", "x.org/a;p", "", " ", None, "http://x/a;p/b;q#f?g")] == [
        "http://x/a/?q=1", "http://x/a?q=b", "http://X/a", "http://x", "://x.org/a", "", "", "", "http://x/a;p/b"]
    assert value(spark, U.source_urls(F.col("t")), t="http://a.b/c.<br>http://a.b/c, https://d.e") == ["http://a.b/c", "https://d.e"]
    assert tuple(value(spark, U.text_fragment(F.col("t")), t="http://x#:~:text=pre-,start%20it,end,-suf")) == ("pre", "start it", "end", "suf")
    assert value(spark, U.text_fragment(F.col("t")), t="http://x#top") is None
    assert value(spark, U.cited_span(F.lit("0123456789"), F.lit("45"), 2), t="") == "234567"
    span = lambda text, start, end=None: value(spark, U.cited_span(F.col("t"), F.lit(start), 3, None if end is None else F.lit(end)), t=text)
    assert span("One  TWO\n three four five", "two three") == "ne two three fo" and span("a b c", "x") is None and span("a b c", " ") is None and span(None, "a") is None
    assert span("start here and end there, end", "START", "end") == "start here and end th" and span("end start here", "start", "end") == "nd start he"


def test_pages(spark):
    html = '<html><head><title> A\n B </title><meta property="article:published_time" content="2020-01-02"></head><body><nav>x</nav><main><p>One &amp; two<br>three</p></main></body></html>'
    assert value(spark, U.title(F.col("t")), t=html) == "A B"
    assert value(spark, U.page_date(F.col("t")), t=html) == "2020-01-02"
    assert value(spark, U.page_date(F.col("t")), t="<p>") is None
    assert value(spark, U.page_text(F.col("t")), t=html) == "One & two\nthree"
    text = lambda h: value(spark, U.page_text(F.col("t")), t=h)
    assert text("<body><aside>Kept</aside><svg><text>gone</text></svg><p>a <b>bold</b>  word</p><header>x</header></body>") == "Kept\na\nbold\nword"
    assert text("<div>no body</div>") == "" and text("<article>A</article><body>B</body>") == "A" and text(None) is None
    date = lambda h: value(spark, U.page_date(F.col("t")), t=h)
    modified, plain = '<meta content="2021" property="article:modified_time">', '<META NAME="date" CONTENT=" 2019 ">'
    assert date(plain + modified) == "2021" and date(plain) == "2019" and date('<meta name="last-modified" content="2018">') is None
    linked = '<script type="application/ld+json">{}</script>'
    assert date('{"datePublished": "2017"}') is None and date(linked.replace("{}", '{"dateModified": "2016", "datePublished": "2015"}')) == "2015"
    assert date(linked.replace("{}", "{") + linked.replace("{}", '[{"x": 1}, {"dateModified": "2014"}]')) == "2014"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article>a</article>between<article>b</article>", "a"),
        ("<body><main></main><article>b</article></body>", ""),
        ("<body><main/><p>a</p></body>", ""),
        ("<body>&eacute;&mdash;&copy 2&#8217;s &unknown; &amp;lt;</body>", "é—© 2’s &unknown; &lt;"),
        ("<body>a<nav>b<nav>c</nav>d</nav>e</body>", "a\ne"),
        ("<nav><main>menu</main></nav><body><article>x</article>y", "x"),
        ("<body><p>one<p>two</i></p>three</body>four", "one\ntwo\nthree"),
        ("<body><div><b>one</div>two</body>three", "one\ntwo"),
        ("<body>a<script>if (1 < 2) x = '</nav>'; </scripture></script >b<style></body></style>c", "a\nb\nc"),
        ("<body>1 < 2 <a title='x > y'>l</a><!-- > --- -->m<!doctype x>n<?p >o<br/>p", "1 < 2\nl\nm\nn\no\np"),
        ('<body><a "b>c</a><a b="d>e', "c\ne"),
        ("<body>a<template>b<p>c</p></template><ruby>d<rt>e</rt></ruby>", "a\nd"),
        ("<body>  one\u00a0\n two\u2028three\t</body>", "one\ntwo\nthree"),
        ("<BODY>A<MAIN>B</Main>", "B"),
    ],
)
def test_page_trees(page, text):
    assert read_page(page)[2] == text


def test_titles_and_dates_of_trees():
    page = '<title>A &lt;b&gt; <i></title><title>c</title><meta content=2020 name=date><meta name="date" content="2021"><main>m'
    assert read_page(page) == ("A <b> <i>", "2020", "m")
    assert read_page("<title/>x<title>y</title>")[0] is None and read_page("") == (None, None, "")
    linked = '<script type="application/ld+json">{}</script>'
    assert read_page(linked.format("[1, 2]") + linked.format('{"dateModified": 2014}'))[1] == "2014"


@pytest.mark.parametrize("piece", ['<a "', "<", "<a ", "<a x='", "<!--", "</x>", "<div>", "<script>", "<b><i></b>", "<div><b></div>", "&", "<a x=' '>", "<title>"])
def test_reading_is_linear(piece):
    import time

    def took(n):
        began = time.process_time()
        read_page("<body>" + piece * n)
        return time.process_time() - began

    took(1000)
    assert took(40000) < 0.2 + 8 * took(10000)


@pytest.mark.parametrize(("reply", "verdict"), [('{"verdict": true}', True), ('```json\n{"verdict": "no"}\n```', False), ("verdict: yes, sure", True), ("???", None)])
def test_verdict(spark, reply, verdict):
    assert value(spark, U.verdict(F.col("t")), t=reply) is verdict


@given(st.lists(st.sampled_from("one two twenty thirty hundred thousand and x".split()), max_size=8))
def test_spoken_numbers_never_break(words):
    assert all(v >= 0 for v in T._spoken(words))


def test_paragraphs_and_questions(spark):
    long = "1" * 81
    assert value(spark, T.paragraphs("t"), t=f" {long}0 \n \n\n\t0{long}\n\nshort\n\n1{long}\t") == [f"{long}0", f"0{long}", f"1{long}"]
    rows = spark.createDataFrame([("Dev", " q ", " a ", ["a", " b", "b ", "", None, "2"]), ("dev", "q", " ", []), ("test", "q", "a", []), (None, "q", "a", [])], "s string, q string, a string, o array<string>")
    got = T.clean_questions(rows, "s", "DEV", "q", "a", F.col("o")).select("question", "answer", "aliases").collect()
    assert [tuple(r) for r in got] == [("q", "a", ["b", "2"])]
    assert T.clean_questions(rows, "s", None, "q", "a", F.col("o")).count() == 3


@pytest.mark.parametrize(("answer", "text", "found"), [("Red car", "A red, car!", True), ("red", "reddish", False), ("", "x", False), ("(.*)", "anything", False), ("a.b", "ab", True), ("straße", "the STRASSE", True), ("x", "«x»", True)])
def test_appears_in(spark, answer, text, found):
    assert value(spark, T.appears_in("a", "t"), a=answer, t=text) is found


def test_review_terms(spark):
    assert value(spark, T.review_terms("t"), t="What Señor X9 did in the-END") == ["end"]
    assert value(spark, T.ascii_words("t"), t="What Señor X99 did in the-END") == ["what", "x99", "did", "the", "end"]


def test_domain_identities(spark):
    """The digest of compact JSON, as json.dumps writes it, quotes and other scripts included."""
    import hashlib
    import json

    from lodestone.functions import identity as I

    for doc, digest in (('a "b"\\c\n', "0" * 64), ("é😀", "f" * 64)):
        want = "sqa-parent-source-a9-v1:" + hashlib.sha256(json.dumps(["sqa-parent-source-a9-v1", doc, digest], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert value(spark, I.parent_source_identity(F.col("d"), F.col("h")), d=doc, h=digest) == want
    want = "sqa-po-v2:" + hashlib.sha256(b'["sqa-po-v2","f","q",7]').hexdigest()
    assert value(spark, I.parent_occurrence_identity(F.lit("f"), F.lit("q"), F.lit(7)), t="") == want
    assert value(spark, I.parent_occurrence_identity(F.lit("f"), F.col("t"), F.lit(7)), t=None) is None


def test_closed_entities():
    """Without bare names, an entity ends in its semicolon, and a name that only begins with one is none."""
    assert read_page("<title>a&amp</title><body>&copy 2 &copy; &#233 &#233;&#xE9; &ampx; &eacute;&amp;lt;", bare=False) == ("a&amp", None, "&copy 2 © &#233 éé &ampx; é&lt;")


@pytest.mark.parametrize("name", ["page_texts", "page_keys", "candidate_texts"])
def test_page_queries_on_cut_entities(spark, tmp_path, name):
    from lodestone import parity
    from lodestone.plans.registry import ORACLES, QUERIES

    page = "<html><head><title>{0} and{1}</title></head><body><nav>x</nav><main><p>{0} one{1}</p><p>two{1}</p></main></body></html>"
    rows = [(k, f"http://h.org/{k}", page.format(*x)) for k, x in enumerate([("&amp;", "&amp"), ("&amp;lt;", "&am"), ("&quot;", "&copy"), ("&copy;", "&")])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same, what = parity.compare(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))
    assert same, what


def test_cited_span_reads_a_text_once(spark):
    """The normal form of a long text stands once in the expression, however often places in it are asked for."""
    df = spark.createDataFrame([("A b\n c d. " * 3, "b C", "D.")], "t string, s string, e string")
    out = df.select(U.cited_span(F.col("t"), F.col("s"), 3, F.col("e")).alias("x"))
    assert out.first()[0] == "a b c d. a "
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace(coalesce(t#") == 1


@pytest.mark.parametrize("dialect", ["pool", "mining", "gaps"])
def test_times_are_read_once(spark, dialect):
    """A text without the blanks around it stands once in the expression, whatever parts of it are asked for."""
    from lodestone.functions import temporal as D

    df = spark.createDataFrame([(" 2020-01-02\n",)], "t string").select(F.unix_seconds(D.parse_time(F.col("t"), dialect)).alias("x"))
    assert df.first()[0] == 1577923200
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(t#") == 1
