"""Column rules against plain statements of them, on texts with Cyrillic letters, odd spaces, emoji and nulls."""

import datetime as dt
import html
import random
from html.entities import html5

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsmill.functions import dates as D
from newsmill.functions import preview as P
from newsmill.functions import text as T
from newsmill.functions import urls as U


def run(spark, values, f):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    names = [f"c{i}" for i in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(n) for n in names])).collect()]


def test_paragraphs_and_lines(spark):
    said = [" a\n b c \n\n\n d ", "x\r\n\r\ny", "a\n   \nb", "  ", "", None, "один\nдва 🙂"]
    assert run(spark, said, T.normalize_paragraphs) == ["a b c\n\nd", "x\n\ny", "a\n\nb", None, None, None, "один два 🙂"]
    assert run(spark, ["a\nb\n", "", "a\r\nb", "\n"], T.lines) == [["a", "b"], [], ["a", "b"], [""]]
    assert run(spark, [" a \n\n\n b \n", "a\n\n"], T.clean_review) == ["a\n\nb", "a"]


def test_preamble(spark):
    title = "«Новий Закон»"
    cases = {
        f"{title}\n15 березня 2024\nЛеся Карнаух: текст\n Зміст тут \n\n далі": "Зміст тут\n\nдалі",
        "**новий закон**:\nЗміст": "**новий закон**:\nЗміст",
        "новий закон:\nЗміст": "Зміст",
        "новий закон про інше\nЗміст": "новий закон про інше\nЗміст",
        "Аб: коротко": "Аб: коротко",
        "малі: не ім'я": "малі: не ім'я",
        "": "",
        "\n \n": "",
        title: "",
    }
    assert run(spark, [(k, title) for k in cases], T.strip_preamble) == list(cases.values())
    assert run(spark, [("Текст\nще", "")], T.strip_preamble) == ["Текст\nще"]
    assert run(spark, ["в 5 травня 2024 року", "35 травень 2024", "05 Травня 2024"], T.has_ua_date) == [True, False, True]


def test_rebuild(spark):
    promo = T.PROMO_MD
    cases = {
        f"**Назва**\n\nНазва\nТекст\n\n{promo}": f"**Назва**\n\nТекст\n\n{promo}",
        "Текст": "**Назва**\n\nТекст",
        f"{promo}": f"**Назва**\n\n{promo}",
        "": "",
    }
    assert run(spark, [(k, "Назва") for k in cases], T.rebuild_body) == list(cases.values())


def test_sections(spark):
    cases = [
        ("Довгий пост:\nA\n\n\nB\nКороткий допис — c\nd", ("A\n\nB", "c\nd")),
        ("Без заголовків\nтут", ("Без заголовків\nтут", None)),
        ("Короткий пост: лише", ("лише", "лише")),
        ("вступ\nДОВГИЙ  ПОСТ - раз\nДовгий пост: два", ("два", None)),
        ("Довгий пост: раз\nКороткий пост\nx\nДовгий пост", ("раз", "x")),
        ("", ("", None)),
        ("a: b\nДовгий пост: x", ("x", None)),
    ]
    assert [tuple(r) for r in run(spark, [c for c, _ in cases], T.post_sections)] == [w for _, w in cases]


def test_tags(spark):
    said = ["Теги: #a, #b #a\nx", "x\nТеги: раз,  два", "без", "Теги:\n"]
    assert run(spark, said, lambda x: T.tags_of(x, "#d")) == ["#a #b", "раз, два", "#d", "#d"]


def plain_trim(text, limit):
    return P.trim(text, limit)


def test_trim(spark):
    said = ["коротко", "Перше речення. Друге речення триває довго", "слово " * 9, "Так! Ні? хто знає що буде", "a\nb" * 15, "x" * 50, "one two - ", "", "🙂 " * 30, "кінець… " + "y" * 40]
    for limit in (0, 5, 20, 33):
        assert run(spark, said, lambda x, n=limit: T.smart_trim(x, n)) == [plain_trim(s, limit) for s in said]


def test_titles_and_blocks(spark):
    cases = [("вступ\n# **Назва**\n\nНАЗВА\nТекст\nНазва", "Текст\nНазва"), ("Текст", "Текст"), ("Назва", ""), ("  ", "")]
    assert run(spark, [(c, "Назва") for c, _ in cases], T.drop_leading_title) == [w for _, w in cases]
    assert run(spark, [("a ", " ", "b")], lambda *x: T.join_blocks(*x)) == ["a\n\nb"]
    long = ["x" * 3000, "y y" * 600]
    got = run(spark, [tuple(long)], lambda *x: T.cap_blocks(F.array(*x)))[0]
    assert got == "x" * 3000
    assert run(spark, ["a" * 81, "b" * 80, None], T.ellipsis) == ["a" * 80 + "…", "b" * 80, None]
    packed = run(spark, ["aa|bb|cccccc|d"], lambda x: T.pack_lines(F.split(x, "[|]"), 5))[0]
    assert packed == ["aa\nbb", "cccccc", "d"]
    assert run(spark, ['<b>a &lt; "b"</b><br/>c'], T.visible_length) == [len('a < "b"\nc')]


def test_dates(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    cases = {
        "15 березня 2024 року о 14:30": dt.datetime(2024, 3, 15, 12, 30),
        "1 лип. 2024": dt.datetime(2024, 6, 30, 21, 0),
        "05.03.2024, 10:15": dt.datetime(2024, 3, 5, 8, 15),
        "31.02.2024 10:15": None,
        "сьогодні 09:05": dt.datetime(2024, 3, 10, 7, 5),
        "2024-03-01T10:00:00+02:00": dt.datetime(2024, 3, 1, 8, 0),
        "2024-07-01T10:00": dt.datetime(2024, 7, 1, 7, 0),
        "2024-07-01T10:00Z": dt.datetime(2024, 7, 1, 10, 0),
        "3 smarch 2024": None,
        "3 невідомого 2024": None,
        "2024-03-01": None,
        "10 січня 2024 р.": dt.datetime(2024, 1, 9, 22, 0),
        "": None,
        None: None,
    }
    assert run(spark, list(cases), lambda x: D.parse_ukrainian(x, now)) == list(cases.values())
    assert run(spark, ["2024-03-01", "2024-03-01T00:00:00+00:00"], lambda x: D.coerce(x, now)) == [dt.datetime(2024, 2, 29, 22, 0), dt.datetime(2024, 3, 1)]


def test_urls(spark):
    base = "https://tax.gov.ua/media-tsentr/novini/"
    printed = {f"{base}12345.html": f"{base}print-12345.html", f"{base}nova-12345678/": f"{base}print-12345678.html", f"{base}print-777": f"{base}print-777.html", f"{base}abc.html": None, "https://x.org/media-tsentr/novini/12345": None, f"{base}12345.html?x#y": f"{base}print-12345.html"}
    assert run(spark, list(printed), U.tax_print) == list(printed.values())
    own = {f"{base}print-12345.html": f"{base}12345.html", f"{base}9.html?u=1": f"{base}9.html", f"{base}9": None, "https://bank.gov.ua/": None}
    assert run(spark, list(own), U.tax_canonical) == list(own.values())
    assert run(spark, ["https://news.google.com/x?u=https%3A%2F%2Fa.org%2F1&url=", "https://a.org/?url=b"], U.unwrap) == ["https://a.org/1", "https://a.org/?url=b"]
    assert run(spark, ["HTTP://User@EX.org:80/a b", "nohost"], U.host) == ["user@ex.org:80", ""]
    assert run(spark, ["eviltax.gov.ua", "tax.gov.ua:443", ""], U.trusted) == [True, False, False]
    assert run(spark, ["a", "a?b#c"], lambda x: U.with_utm(x, {"s": "t t"})) == ["a?s=t+t", "a?b#c&s=t+t"]
    assert run(spark, ["see [x](https://a.org/1) [y](http://b)", "none"], U.first_markdown_link) == ["https://a.org/1", None]
    assert run(spark, ["http://cabinet.tax.gov.ua/a?b#c", "http://x.org/#q"], U.fetch_address) == ["https://www.tax.gov.ua/a?b", "http://x.org/#q"]
    from urllib.parse import urljoin

    bases = ("https://s.org/p/q/r.html?x=1", "http://S.org", "https://s.org/", "https://u@s.org:8/a//b/./c/?y#z", "https://s.org/1/2/3/4/5/6/7/8/9/10/11/12.html")
    links = ("/a/b", "c", "../d", "//h.org/x", "?q=1", "#f", "https://z.org", "./e", "g/../h", "", ".", "..", "../..", "../" * 10 + "x", "../" * 30 + "x?a=b#c", "/../../x", "a/./b/../../c/", "x//y", "/x//y/..", "mailto:a@b.c", "data:x", "g?y/../z", "g#s/../x", "...", "..g", "HTTPS://Z.org/a?b", "é/../ü", "a%3Ab")
    rows = [(link, base) for base in bases for link in links]
    assert run(spark, rows, U.absolute) == [urljoin(base, link) for link, base in rows]


def test_markdown():
    cases = {
        "**жирний** і __теж__": "<b>жирний</b> і <b>теж</b>",
        "*курсив* snake_case_name _так_": "<i>курсив</i> snake_case_name <i>так</i>",
        "`a<b` & c": "<code>a&lt;b</code> &amp; c",
        "[**x**](https://a.org?a=1&b='2')": '<a href="https://a.org?a=1&amp;b=&#x27;2&#x27;"><b>x</b></a>',
        "**не закрито": "<i></i>не закрито",
        "2 * 3": "2 * 3",
    }
    for said, want in cases.items():
        assert P.inline(said) == want
    assert P.to_html("# H\n- a\n* b\n\n\n1) c\ntext") == "<b>H</b>\n• a\n• b\n\n1. c\ntext"


@pytest.mark.parametrize("limit", [1, 4, 7, 50])
def test_cut_keeps_tags_whole(limit):
    s = '<b>ab &amp; <a href="x">cdef</a></b> ghi'
    got = P.cut(s, limit)
    assert P.visible(got) <= max(limit, 1)
    assert got.count("<b>") == got.count("</b>") and got.count("<a") == got.count("</a>")


def test_variants(spark):
    rows = [("Назва", "Назва\n\n" + "Речення про податки. " * 400, "https://a.org/?x=1&y=2", "#a #b"), (None, None, None, None), ("T" * 1500, "r", "l", "#t " * 50)]
    df = spark.createDataFrame(rows, "title string, body string, link string, tags string")
    for r in P.with_variants(df, *[F.col(c) for c in df.columns]).collect():
        for text, most in ((r.with_image, 1024), (r.without_image, 4096)):
            assert P.visible(text) <= most
            assert text.endswith(f'<a href="{P.PROMO_URL}"><b>{P.PROMO_TEXT}</b></a>')
        if r.title == "Назва":
            assert r.with_image.count("Назва") == 1 and "x=1&amp;y=2" in r.with_image


def test_unescape_is_the_librarys(spark):
    numbers = [*range(300), 0xFEFF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**12]
    said = [f"&{n.rstrip(';')}{end}" for n in sorted(html5) for end in ("", "x", ";")] + [f"&#{n}{end}" for n in numbers for end in (";", "", "z")] + [f"a&#x{n:X};" for n in numbers]
    said += ["&#X1F600", "&#x0000000000041;", "&", "&&amp;", "&;", "&#;", "&#x;", "a & b", "&notit;", "&amp;lt;", "x&lt;y&gt", "&" + "a" * 40 + ";", "", "&amp &lt,", "&#12#;"]
    r = random.Random(3)
    said += ["".join(r.choice(("&", "am", "p", ";", "#", "6", "5", "x", "lt", " ", "not", "in", "é", "<")) for _ in range(r.randint(1, 9))) for _ in range(2000)]
    assert run(spark, [*said, None], T.unescape) == [*map(html.unescape, said), None]


def _fitted_by_rendering_again(header, review, link, tags, promo, most):
    """The rule by trying: each limit rendered whole."""
    limit = max(most - P.visible(P.blocks(header, link, tags, promo)) - 2, 0)
    while True:
        shown = P.to_html(P.trim(review, limit))
        whole = P.blocks(header, shown, link, tags, promo)
        over = P.visible(whole) - most
        if over <= 0:
            return whole
        if limit <= 0:
            return None  # what comes then does not render the review
        limit = max(limit - over, 0)


def test_previews_are_rendered_once():
    """Running sums of lines give what rendering every trial whole gives, over random marks and over texts of the tables."""
    r = random.Random(5)
    marks = ("**", "*", "_", "`", "[a](https://b.org?c&d)", "\n", "\n\n", "- ", "# ", "1. ", "&", "<b>", "слово ", "word. ", "end! ", "x…", " ", "-", "•")
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 400))).strip() for _ in range(1500)]
    texts += [t for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"]).text if t]
    header, link, tags, promo = "<b>T &amp; t</b>", '<a href="l">x>></a>', "#a #b", "<b>p</b>"
    for said in texts:
        said, kinds = said.strip(), (r.choice((40, 90, 200)), 1024, 4096)
        for most, got in zip(kinds, P.variants(header, said[: max(kinds) + 1], link, tags, promo, kinds)):
            want = _fitted_by_rendering_again(header, said, link, tags, promo, most)
            assert got == want if want is not None else P.visible(got) <= most


def test_a_line_is_rendered_once(monkeypatch):
    seen = []
    own = P.line_html
    monkeypatch.setattr(P, "line_html", lambda line: seen.append(line) or own(line))
    said = "\n".join(f"**{i}** [a](b) " + "word & word " * 3 for i in range(90))
    P.variants("<b>h</b>", said, "l", "#t", "p", (1024, 4096))
    whole = [line for line in set(seen) if line.count("word") == 6]
    # but for the lines that the cuts fall in, tried as ends of what is kept
    assert len(whole) > 60 and sum(seen.count(line) > 1 for line in whole) <= 2


def test_plain_heading(spark):
    cases = {"## **Назва**": "Назва", "** a **": "a", "****": "**", "__x__": "x", "**_x_**": "x", "*": "*", "**": "**", "_*a*_": "*a*", "#a": "a", "***a***": "a"}
    assert run(spark, list(cases), T.plain_heading) == list(cases.values())


def test_dates_look_for_each_form(spark):
    now = F.lit("2024-05-06 07:08:09").cast("timestamp")
    cases = {
        "2024-01-15T10:20": "2024-01-15 08:20:00", "2024-01-15t10:20:30+0300": "2024-01-15 07:20:30", "x 2024-01-15T10:20Z y": "2024-01-15 10:20:00", "2024-01-15T10:20:3": "2024-01-15 08:20:00",
        "15.01.2024, 10:20": "2024-01-15 08:20:00", "10:20 15/1/2024": "2024-01-14 22:00:00", "31.02.2024 10:00 15 січня 2024": None, "12:30 год.": "2024-05-06 09:30:00", "Сьогодні 12:30": "2024-05-06 09:30:00",
        "15 січня 2024 р. о 10:20": "2024-01-15 08:20:00", "о 9:05, 1 черв. 2024 року": "2024-06-01 06:05:00", "15 ніколи 2024": None, "": None, "25:00": None,
    }
    assert run(spark, [*cases, None], lambda x: D.parse_ukrainian(x, now).cast("string")) == [*cases.values(), None]
