"""Literal cases of the column functions."""

from __future__ import annotations

import html
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memengine.functions import core, gates, text, times, urls, vectors


def evaluate(spark, rows, schema, column):
    """One result per row, in order."""
    numbered = [(n, *r) for n, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "_n INT, " + schema)
    return [r["x"] for r in df.select("_n", column.alias("x")).orderBy("_n").collect()]


def check(spark, cases, column):
    got = evaluate(spark, [(i,) for i, _ in cases], "t STRING", column(F.col("t")))
    assert got == [want for _, want in cases]


def test_page_gate(spark):
    rows = [(4, 1.0, 9, 9), (5, 0.0, 0, 0), (9, 0.24, 0, 0), (5, 0.25, 0, 0), (5, 0.0, 1, 0), (5, 0.0, 0, 1), (10, 0.0, 0, 0)]
    got = evaluate(spark, rows, "d INT, s DOUBLE, i INT, r INT", gates.page_gate(*map(F.col, "dsir")))
    assert got == [False, False, False, True, True, True, True]


def test_app_page(spark):
    cases = [("slack.com", True), ("team.slack.com", True), ("notslack.com", False), (" Figma.com ", True), ("mail.google.com", False), (None, False)]
    check(spark, cases, urls.is_app_page)


def test_excluded_path(spark):
    check(spark, [("https://GitHub.com/issues?x=1", True), ("https://github.com/o/r/issues", False)], urls.is_excluded_path)


def test_canonical_url(spark):
    cases = [
        ("http://h.org/p?page=2&ref=x", "http://h.org/p?page=2"),
        ("https://h.org/p#top", "https://h.org/p"),
        ("https://h.org/p?UTM_Source=a&b=", "https://h.org/p?b="),
        ("https://h.org/p?ref=x", "https://h.org/p"),
        ("HTTP://H.org?x=a b&y=~*&&q", "http://H.org?x=a+b&y=~%2A&q="),
        ("http://a/?x=%C3%A9+1&k", "http://a/?x=%C3%A9+1&k="),
    ]
    check(spark, cases, urls.canonical_url)


def test_video_gate(spark):
    rows = [
        (20, "watch_time", None, False), (19, "watch_time", None, False), (0, "manual_interaction", "pause", False),
        (0, "manual_interaction", None, False), (0, "watch_time", "seek", False), (0, "watch_time", None, True),
    ]
    got = evaluate(spark, rows, "w INT, t STRING, i STRING, r BOOLEAN", gates.video_gate(*map(F.col, "wtir")))
    assert got == [True, False, True, False, False, True]


def test_video_id_and_type(spark):
    cases = [
        ("https://youtube.com/watch?v=abcdefghijk&t=3", "abcdefghijk"),
        ("https://youtube.com/shorts/abcdefghijk?f=1", "abcdefghijk"),
        ("https://youtube.com/watch?v=short", None),
        ("https://youtube.com/", None),
    ]
    check(spark, cases, urls.video_id)
    rows = [("y/watch", 59), ("y/watch", 60), ("y/watch", None), ("y/shorts/a", 900)]
    assert evaluate(spark, rows, "u STRING, d INT", urls.is_short(F.col("u"), F.col("d"))) == [True, False, False, True]


def test_durations(spark):
    check(spark, [("PT1H2M3S", 3723), ("PT45S", 45), ("", 0), ("junk", 0), (None, 0)], times.iso_duration_seconds)


def test_tolerant_timestamp(spark):
    default = datetime(2000, 1, 1)
    cases = [
        ("2024-04-18", datetime(2024, 4, 18)),
        ("2024-04-18T10:00:00Z", datetime(2024, 4, 18, 10)),
        ("2024-04-18T10:00:00+02:00", datetime(2024, 4, 18, 8)),
        ("Fri, 19 Apr 2024 10:00:00 +0530 (IST)", datetime(2024, 4, 19, 4, 30)),
        ("19 Apr 2024 10:00:00 GMT", datetime(2024, 4, 19, 10)),
        ("junk", default),
        (None, default),
    ]
    check(
        spark, [(t, d.isoformat(" ")) for t, d in cases],
        lambda c: times.tolerant_timestamp(c, F.lit("2000-01-01").cast("timestamp")).cast("string"),
    )


def test_normalize_and_truncate(spark):
    check(spark, [("a \t b\r\n\n\n\nc ", "a b\n\nc"), (" x ", "x")], text.normalize_text)
    check(
        spark,
        [("x" * 500, "x" * 500), ("y" * 700, "y" * 500), ("ab " * 300, ("ab " * 300)[:500].rsplit(" ", 1)[0].strip())],
        text.truncate_words,
    )


def test_quotes_and_signature(spark):
    check(spark, [("hi\n> old\nyo", "hi\nyo"), ("hi\nOn Mon, X wrote:\nold", "hi"), ("", ""), (None, "")], text.drop_quotes)
    cases = [
        ("Body text, with comma.\nThanks,\nAda", "Body text, with comma."),
        ("Thanks", "Thanks"),
        ("One, two.\nsee you tomorrow", "One, two."),
        ("Thanks,\n" + "\n".join(f"line, {n}." for n in range(9)), "Thanks,\n" + "\n".join(f"line, {n}." for n in range(9))),
    ]
    check(spark, cases, text.drop_signature)


def test_html(spark):
    samples = ["a &amp;amp; b", "&copyfoo &notit; &#8364; &#x1F600; &#128; &#xD800; &bogus; & &;", "&hellip; &#38;lt; &lt", "x&#1;y &#99999999999; &Aacute &AMP"]
    check(spark, [(s, html.unescape(s)) for s in samples], text.unescape_html)
    check(
        spark,
        [("<p>a<br/>b</p><script>x<y</script><!-- c -->d&nbsp;", "a\nb\n d"), (None, "")],
        text.html_to_text,
    )
    check(spark, [('a<img src=x width="1">b<img width=20>', "a b<img width=20>"), ("<IMG style='display : none'>", " ")], text.drop_pixels)
    check(
        spark, [("<h1>A <b>b</b></h1><h7>no</h7><h3> </h3><H2>C</H2>", ["A b", "C"])], text.page_headings
    )
    check(spark, [("<body><form>no</form><p>one</p> two <b>three</b></body>", "one\ntwo\nthree")], text.page_text)


def test_main_content_falls_back(spark):
    long = "word " * 60
    cases = [
        (f"<article>short</article><main>{long}</main>", long.strip()),
        (f"<article>short</article><div role='main'>{long}</div>", long.strip()),
        ("<body>tiny</body>", ""),
        (f"<article>{'x' * 13000}</article>", "x" * 12000),
    ]
    check(spark, cases, text.main_content)


def test_keywords(spark):
    cases = [
        ("Spark spark join JOIN about it x1 data-set", ["join", "spark", "dataset"]),
        ("", []),
        (None, []),
        ("Kelvin kelvin", ["kelvin"]),
        ("b1b b1b a2a a2a c3c " + " ".join(f"word{n}" for n in range(9)), ["a2a", "b1b", "c3c"] + [f"word{n}" for n in range(5)]),
    ]
    check(spark, cases, text.keywords)


def test_hosts(spark):
    check(spark, [("Ada <a@MIT.edu>", "mit.edu"), ("a@b.com", "b.com"), ("Ada", ""), (None, "")], urls.sender_domain)
    check(spark, [("https://U@Ex.org:8080/p", "u@ex.org:8080"), (" Ex.ORG ", "ex.org"), (None, "")], urls.domain_hint)


def test_category(spark):
    check(spark, [("28", "science technology"), ("x", ""), (None, ""), ("3", "")], text.category_hint)
    check(spark, [("27", 27), ("-1", None), ("", None), (None, None)], text.category_id)


def test_small_helpers(spark):
    check(spark, [("a  b\tc", 3), ("", 0), (None, 0)], times.word_count)
    check(spark, [("b:1", urls_hash("b:1"))], urls.key_hash)
    rows = [(50.0, 200, 100), (500.0, 200, 100), (1.0, 100, 100)]
    got = evaluate(spark, rows, "y DOUBLE, d INT, v INT", times.scroll_fraction(*map(F.col, "ydv")))
    assert got == [0.5, 1.0, 1.0]


def urls_hash(value: str) -> str:
    import hashlib

    return hashlib.sha256(value.encode()).hexdigest()[:16]


def test_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = df.select(vectors.squared_l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.0), (0.0, pytest.approx(1.0)), (2.0, 0.0)]


def test_attachment_extract(spark):
    rows = [("a.pdf", "x/y", 3), ("a.pdf", None, 0), ("a.pdf", "", None)]
    column = text.attachment_extract(F.col("f"), F.col("m"), F.col("s"))
    assert evaluate(spark, rows, "f STRING, m STRING, s INT", column) == ["a.pdf | x/y | 3", "a.pdf", "a.pdf"]


def test_patterns_pass_over_texts_that_cannot_match(spark):
    """Texts without what a pattern begins with never meet it; the others come out as the plain patterns leave them."""
    texts = [
        None, "", " ", "\t", "a\tb", "a \tb", "a\t b", "a  b", "a b", "\u3000 a b\u2028 ", "a\r\r\rb", "a\n\n\n\nb\n", "\r\n", "a\r\n", "a\n\r\n", "a\u2028b\x85",
        "x <b>y</b><!-- z --> <br/>w", "1 < 2", "on \u212aelvin: Table_top, a-b c+d 9lives", "> q \n > r\nkeep\u3000\n\u00a0On Monday Ann wrote:\u2003\nlost",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    t = F.col("t")
    spaced = F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("\n")), r"\t[ \t]*| [ \t]+", " ")
    breaks = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    lines = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, f"(?:{breaks})\\z", ""), breaks))
    pairs = [
        (text.normalize_text(t), core.strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))),
        (text.split_lines(t), lines),
        (text.join_parts(t, F.lit(" end ")), F.concat_ws(" ", F.nullif(core.strip(t), F.lit("")), F.lit("end"))),
        (core.rstrip_long(t), core.rstrip(t)),
        (core.where(t, ["<"], lambda x: F.regexp_replace(x, "<[^>]+>", " ")), F.regexp_replace(t, "<[^>]+>", " ")),
    ]
    row = df.select("id", *[F.struct(got.alias("got"), want.alias("want")).alias(f"p{n}") for n, (got, want) in enumerate(pairs)])
    for r in row.collect():
        for n in range(len(pairs)):
            assert r[f"p{n}"]["got"] == r[f"p{n}"]["want"], (texts[r["id"]], n, r[f"p{n}"])
    told = df.select("id", F.array_join(text.tokenize(t), ",").alias("tokens"), text.drop_quotes(t).alias("rest")).orderBy("id").collect()
    assert [told[18].tokens, told[19].rest] == ["kelvin,tabletop,lives", "keep\u3000"]
    refused = core.where(t, ["<"], lambda x: F.raise_error(F.lit("met")).cast("string"))
    assert df.filter("NOT contains(t, '<')").select(refused.alias("x")).filter("x IS NOT NULL").count() == sum(x is not None and "<" not in x for x in texts)
