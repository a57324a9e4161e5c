import pytest
from pyspark.sql import functions as F

from feedmill.functions import text as T
from feedmill.plans import adapters as A
from feedmill.plans.adapters import TITLES
from feedmill.plans.queries import QUERIES


def value(spark, text, rule):
    return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "source, absent, present",
    [
        ("[b]Bug Fixes[/b]\n[list]\n[*] Fixed a crash\n[/list]", ["[b]", "[list]", "[*]"], ["Bug Fixes", "- Fixed a crash"]),
        ("<b>Bug Fixes</b><br>\n<li>Fixed a crash</li>", ["<b>", "<li>", "<br>"], ["Bug Fixes", "- Fixed a crash"]),
        ("[img]{STEAM_CLAN_IMAGE}/99999/banner.jpg[/img]\nSome content", ["STEAM_CLAN_IMAGE"], ["Some content"]),
        ("Check the [url=https://example.com]patch notes[/url] here", ["[url"], ["patch notes"]),
        ("a &amp;lt; b &quot;c&quot;", ["&"], ['a < b "c"']),
        ("Intro [ SOUND FX ] rest", ["["], ["\nSOUND FX\n"]),
        ("x  \n\n\n\n y", [], ["x\n\ny"]),
    ],
)
def test_strip_markup(spark, source, absent, present):
    out = value(spark, source, T.strip_markup)
    assert not [a for a in absent if a in out] and all(p in out for p in present)


def test_image_urls(spark):
    s = "[img]http://a/1.png[/img][IMG]http://a/2.png[/IMG]<img class=x src='http://a/3.png'>[img src=\"http://a/4.png\"][/img][img]http://a/1.png[/img]"
    got = value(spark, s, T.image_urls)
    assert got[:2] == ["http://a/1.png", "http://a/2.png"] and set(got) >= {"http://a/3.png", "http://a/4.png"} and len(got) == len(set(got))
    assert value(spark, None, T.image_urls) == [] and value(spark, "", T.image_urls) == []


@pytest.mark.parametrize(
    "title, contents, expected",
    list(zip(TITLES[:6], [""] * 6, ["patch"] * 6))
    + [
        ("Some News Post", "We fixed a crash that affected players.", "patch"), ("Weekend Event: Double XP!", "All XP gains are doubled!", "event"), ("Watch the Developer Livestream", "Join us on Twitch.", "event"),
        ("Season 2: Now Available!", "New content and new map.", "content_update"), ("The Neowsletter #5", "We fixed a bug and resolved an issue.", "content_update"), ("Hades II v1.0 Is Now Available!", "Now available for all.", "content_update"),
        ("News", "a wholesale change", "event"), (None, None, "content_update"), ("News", "x" * 1000 + " bug fix", "content_update"),
    ],
)
def test_news_type(spark, title, contents, expected):
    d = spark.createDataFrame([(title, contents)], "t string, c string")
    assert d.select(T.news_type(F.col("t"), F.col("c"))).first()[0] == expected


def test_bm25_tokens_of_every_chunk(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["bm25_chunk_tokens"](spark, sf).count() == A.chunks(spark, sf).count() > 0


def test_bm25_tokens(spark):
    assert value(spark, "Ver.1.030 fixed co-op (lag)", T.bm25_tokens) == ["ver.1.030", "fixed", "co-op", "lag"]


@pytest.mark.parametrize(
    "line, name",
    [("Bug Fixes", "Bug Fixes"), ("[ SOUND ]", "SOUND"), ("\\[ ENGINE ]", "ENGINE"), ("- Bug Fixes", None), ("ab", None), ("This is a line that ends like a sentence.", None), ("1. First thing", None), ("Version 1.2", None)],
)
def test_section_name(spark, line, name):
    assert value(spark, line, T.section_name) == name


def test_bullet_and_summary(spark):
    assert value(spark, "- 1.5x damage for all bows", T.bullet_text) == "5x damage for all bows"
    assert value(spark, "so <summary> a b </summary> c", T.summary_text) == "a b"
    assert value(spark, " <summary> a b", T.summary_text) == "<summary> a b"
    assert value(spark, "</summary>x<summary>", T.summary_text) == ""


def test_split_long_keeps_all_words(spark):
    body = " ".join(f"Sentence number {i} is here{'!?.'[i % 3]}" for i in range(60))
    parts = value(spark, body, lambda c: T.split_long(c, F.lit("P: ")))
    assert " ".join(parts) == body and all(len(p) <= 497 for p in parts) and len(parts) > 3
    assert value(spark, "x" * 600, lambda c: T.split_long(c, F.lit(""))) == ["x" * 600]


def test_half_even(spark):
    assert [value(spark, x, lambda c: T.half_even(c.cast("double"))) for x in ("0.25", "0.35", "2.0")] == [0.2, 0.4, 2.0]


def test_two_places_are_those_of_the_exact_value(spark):
    rows = [(a / b,) for b in range(1, 420) for a in range(b + 1)] + [(k / 1000,) for k in range(0, 3000, 5)]
    d = spark.createDataFrame(rows, "x double")
    wrong = [(r.x, r.t) for r in d.select("x", F.format_string("%.2f", T.two_places(F.col("x"))).alias("t")).collect() if r.t != f"{r.x:.2f}"]
    assert not wrong
