import pytest
from pyspark.sql import functions as F

from gleaner.functions import html, text, times, urls


def column(spark, expression, values, schema="x string"):
    frame = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [row[0] for row in frame.select(expression).collect()]


def test_normalize_url(spark):
    cases = {
        "HTTPS://Example.com:443/a//b/?utm_source=x&b=2&a=1#frag": "https://example.com/a//b/?utm_source=x&b=2&a=1#frag",
        " http://Example.com:80 ": "http://example.com",
        "http://example.com:443/": "http://example.com:443/",
        "https://e.com/x?": "https://e.com/x",
        "https://e.com/x#": "https://e.com/x",
        "https://e.com/x?#f": "https://e.com/x#f",
        "//Example.com/A": "https://example.com/A",
        "no host ": "no host",
        "mailto:A@b.c": "mailto:A@b.c",
    }
    assert column(spark, urls.normalize_url(F.col("x")), cases) == list(cases.values())


@pytest.mark.parametrize(
    "link, expected",
    [
        ("/blog/relative", "https://example.com/blog/relative"),
        ("http://localhost:5174/blog/local", "https://example.com/blog/local"),
        ("http://127.0.0.1/x?y=1#z", "https://example.com/x?y=1#z"),
        ("https://other.org/a", "https://other.org/a"),
        (" post ", "https://example.com/blog/post"),
        ("../up/./x", "https://example.com/up/x"),
        ("../../../x/..", "https://example.com/"),
        ("?page=2", "https://example.com/blog/?page=2"),
        ("#top", "https://example.com/blog/#top"),
        ("//cdn.org/x", "https://cdn.org/x"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("", "https://example.com/blog/"),
    ],
)
def test_absolutise(spark, link, expected):
    expression = urls.absolutise_entry_url(F.col("x"), F.lit("https://example.com/blog/"), F.lit(None).cast("string"))
    assert column(spark, expression, [link]) == [expected]


def test_resolve_agrees_with_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://e.com", "https://e.com/", "https://e.com/a/b", "https://e.com/a/b/?q=1", "http://e.com:8/a#f"]
    refs = ["x", "/x", "./x", "../x", "../../../x", "x/", "x/..", "a//b", "/a//b", "?q", "#f", "", ".", "..", "//h/p",
            "http://o.com/z", "https:x", "x?q=/../y", "x#/../y", "/a/../b/./c"]
    pairs = [(b, r) for b in bases for r in refs]
    got = column(spark, urls.resolve_url(F.col("b"), F.col("r")), pairs, "b string, r string")
    assert [(p, g) for p, g in zip(pairs, got) if g != urljoin(*p)] == []


def test_slugs(spark):
    cases = {"Élan vital": "e-lan-vital", "How We Debugged X": "how-we-debugged-x", "--": "article", "日本 語_x": "日本-語_x"}
    assert column(spark, text.slugify(F.col("x")), cases) == list(cases.values())
    base = text.title_slug(F.lit("Cloudflare"), F.col("x"))
    assert column(spark, base, ["How We Debugged X"]) == ["cloudflare-how-we-debugged-x"]
    (taken,) = column(spark, text.hashed_slug(base, F.lit("https://e.com")), ["How We Debugged X"])
    assert taken.startswith("cloudflare-how-we-debugged-x-") and len(taken.rsplit("-", 1)[1]) == 8
    (long,) = column(spark, text.title_slug(F.lit("s"), F.col("x")), ["a" * 93 + " b"])
    assert long == "s-" + "a" * 93


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2026-05-20", "2026-05-20T00:00:00Z"),
        ("20260520", "2026-05-20T00:00:00Z"),
        ("2025-06-27T06:05:00.000Z", "2025-06-27T06:05:00Z"),
        ("2025-06-27 06:05", "2025-06-27T06:05:00Z"),
        ("2025-06-27T06:05:09+08:00", "2025-06-26T22:05:09Z"),
        ("2025-06-27T06+0530", "2025-06-27T00:30:00Z"),
        ("20250627T060509Z", "2025-06-27T06:05:09Z"),
        ("Mon, 02 Jun 2025 10:00:00 GMT", "2025-06-02T10:00:00Z"),
        ("2 June 25 10:00 EST", "2025-06-02T15:00:00Z"),
        ("Mon,02 Jun 1999 10:00:00 -0700", "1999-06-02T17:00:00Z"),
        ("02 Jun 70 10:00:00", "1970-06-02T10:00:00Z"),
        (" 2026-05-20 ", "2026-05-20T00:00:00Z"),
        ("2026-13-20", None),
        ("2026", None),
        ("12:00", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_datetime(spark, value, expected):
    assert column(spark, times.iso_z(times.parse_datetime(F.col("x"))), [value]) == [expected]


def test_windows(spark):
    since, until = times.build_time_range("2026-01-01", "2026-01-31")
    stamp = times.parse_datetime(F.col("x"))
    values = ["2025-12-31T23:59:59Z", "2026-01-01", "2026-01-31T23:59:59Z", "2026-02-01", "never"]
    assert column(spark, times.in_range(stamp, since, until), values) == [False, True, True, False, True]
    since, until = times.build_time_range(since_days=7, as_of="2026-01-08T00:00:00Z")
    assert until is None
    assert column(spark, times.iso_z(since), ["x"]) == ["2026-01-01T00:00:00Z"]


def test_tag_names(spark):
    assert column(spark, text.normalize_tag(F.col("x")), ["  API \t Design "]) == ["api design"]
    assert column(spark, text.tag_slug(F.col("x")), ["API  Design"]) == ["api-design"]
    lists = ['["a"," ","b"]', "{}", "nope", None, '"x"']
    assert column(spark, text.tag_list(F.col("x")), lists) == [["a", "b"], [], [], [], []]


def test_json_replies(spark):
    cases = {'```json\n{"a":1}\n```': '{"a":1}', ' {"a":1} ': '{"a":1}', "not json": None, "```\n[1]": "[1]", "```": None}
    assert column(spark, text.extract_json(F.col("x")), cases) == list(cases.values())


def test_like_folds_ascii_only(spark):
    values = ["A Queue story", "ÉCOLE", "école"]
    assert column(spark, text.like_ascii(F.col("x"), " qUEUE "), values) == [True, False, False]
    assert column(spark, text.like_ascii(F.col("x"), "éc"), values) == [False, False, True]
    assert column(spark, text.like_ascii(F.col("x"), "q_eue%st"), values) == [True, False, False]


def test_html_or_text(spark):
    cases = {
        "a < b": "a < b",
        "<p>Hi &amp; <b>you</b></p><script>var a='</p>'</script><style>p{}</style> end": "Hi &\nyou\nend",
        "<br>": None,
        "  ": None,
        "<p>a<!-- x -->b</p>": "a\nb",
    }
    assert column(spark, html.html_or_text(F.col("x")), cases) == list(cases.values())


def test_first_text(spark):
    frame = spark.createDataFrame([(["<br>", "<b>x</b>"],), ([],), (None,), (["plain"],)], "c array<string>")
    rows = [row[0] for row in frame.select(html.first_text("c")).collect()]
    assert [tuple(r) for r in rows] == [(1, "x"), (None, None), (None, None), (0, "plain")]


def test_week_dates(spark):
    cases = {
        "2024-W05-2": "2024-01-30T00:00:00", "2024W052": "2024-01-30T00:00:00", "2024-W01": "2024-01-01T00:00:00", "2021-W01-1": "2021-01-04T00:00:00",
        "2020-W53-7": "2021-01-03T00:00:00", "2021-W53-1": None, "2024-W00-1": None, "2024-W05-8": None, "2024-W05-2T10:30:00+02:00": "2024-01-30T08:30:00",
    }
    frame = spark.createDataFrame([(text,) for text in cases], "text string")
    got = {r.text: r.at for r in frame.select("text", times.iso_z(times.parse_datetime(F.col("text"))).alias("at")).collect()}
    assert got == {text: at and at + "Z" for text, at in cases.items()}
