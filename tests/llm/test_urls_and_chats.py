from hashlib import sha256

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempograph.llm import chat_format, templates, url_filter
from tempograph.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.01"


# --- urls


def test_url_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    expected = sorted(con.execute(f"select {', '.join(names)} from ({oracle_sql()['op6_url_filter']})").fetchall())
    found = sorted(map(tuple, queries()["op6_url_filter"](spark, DATA).select(*names).collect()))
    assert found == expected


URLS = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("example.com/en/", "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("http://EXAMPLE.com/en/x?a=b", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/#t", "a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://x.net/es/?porn", "x.net", "/es/", "net/es/", "block"), ("https://x.net/en/porn", "x.net", "/en/porn", None, "block"), ("https://x.net/en/pornography", "x.net", "/en/pornography", None, "allow"),
    ("https://x.com/porn", "x.com", "/porn", "com/", "allow"), ("https://x.com", "x.com", "", None, "allow"), ("https://x.org/free", "x.org", "/free", None, "allow"), ("https://x.org/free-free", "x.org", "/free-free", None, "allow"),
    ("https://FREE-Bets.example.net/en/", "free-bets.example.net", "/en/", None, "block"), ("https://x.org?free=bets", "x.org", "", None, "block"), ("ftp://a#b://c", "a", "", None, "allow"),
]


def test_single_urls(spark):
    df = spark.createDataFrame([(k, u[0], "h", "c") for k, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    found = {r["page_id"]: r for r in url_filter.judged(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, rule, verdict), URLS[k]
    assert url_filter.judged(df.limit(0)).count() == 0


def test_weights_and_limit(spark):
    df = spark.createDataFrame([(1, "http://a.org/good-better"), (2, "http://a.org/good"), (3, "http://a.org/best")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judged(df, rules=(), strict=("best",), soft={"good": 2, "better": 3}, limit=5).collect()}
    assert found == {1: "block", 2: "allow", 3: "block"}


@pytest.mark.parametrize(
    ("url", "verdict"),
    [("http://a.org/free%20pills", "block"), ("http://a.org/free%2Fbets", "block"), ("http://a.org/caf\u00e9ads-\u0434bets", "allow"), ("http://a.org/%D0%B4bets-free", "allow"), ("http://a.org/p%6Frn", "block"), ("http://a.org/free%ff%20pills", "allow"), ("http://a.org/free-win", "allow"), ("http://a.org/free-win-deal", "block"), ("http://a.org/\u65e5porn", "allow"), ("http://a.org/100%-porn", "block")],
)
def test_scripts_and_percent_codes(spark, url, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert url_filter.judged(df).first()["verdict"] == verdict
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert con.execute(f"select verdict from ({oracle_sql()['op6_url_filter']})").fetchall() == [(verdict,)]


# --- templates


def render(source, **names):
    return "".join(x for x, _ in templates.compiled(source)(names))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("plain", "plain"), ("{{ a }}-{{ b.c }}", "1-x"), ("{{ b['c'] | upper }}", "X"), ("{{ missing }}", ""), ("{{ none ~ true ~ 1.5 }}", "true1.5"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"), ("{% if a == 1 and 'c' in b %}y{% else %}n{% endif %}", "y"),
        ("{% if a > 1 %}x{% elif a == 1 %}y{% else %}z{% endif %}", "y"), ("{% set z = a + 2 %}{{ z - 1 }}", "2"), ("{{ 'a' if a else 'b' }}{{ 'a' if not a else 'b' }}", "ab"),
        ("a  {%- if a -%}  b  {%- endif %} c", "ab c"), ("x{# remark {{ a }} #}y", "xy"), ("{{ 'it\\'s\\n' }}", "it's\n"), ("{{ xs | length }}{{ xs | first }}{{ (1 + 2) ~ '' }}", "2p3"),
    ],
)
def test_templates(source, expected):
    assert render(source, a=1, b={"c": "x"}, xs=["p", "q"]) == expected


@pytest.mark.parametrize("source", ["{{ a", "{% if a %}", "{% for x %}{% endfor %}", "{{ a.b() }}", "{{ a | nothing }}", "{{ 1 + }}", "{% import os %}", "{{ a %}", "{{ a b }}", "{{ 'a }}", "{{ __import__('os') }}"])
def test_what_is_no_template(source):
    with pytest.raises(templates.TemplateError):
        render(source, a=1)


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ a['real'] }}", "{{ b }}", "{{ xs.append }}"])
def test_objects_stay_shut(source):
    with pytest.raises(templates.TemplateError):
        render(source, a=1, b={"c": 1}, xs=[1])


def test_constants_are_folded():
    tree = templates.fold(templates.Parser("a{{ 'b' | upper }}{% if 1 == 1 %}c{{ 1 + 1 }}{% endif %}{% if false %}{{ x }}{% endif %}d", templates.FILTERS).block()[0], templates.FILTERS)
    assert tree == templates.Node("block", (templates.Node("const", ("aBc2d",)),))


def test_generation_marks():
    pieces = list(templates.compiled("a{% generation %}{{ x }}b{% endgeneration %}c")({"x": "1"}))
    assert "".join(t for t, mask in pieces if mask) == "1b" and "".join(t for t, _ in pieces) == "a1bc"


# --- conversations


def digest(x):
    return sha256(x.encode()).hexdigest()


def expected_of(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)


def test_chat_query(spark):
    found = {r["conv_id"]: tuple(r)[1:5] for r in queries()["op8_chat_format"](spark, DATA).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert found == {k: expected_of(v) for k, v in turns.items()}


@given(st.text(max_size=40))
def test_escape_round_trip(text):
    there = chat_format.escape(text)
    assert chat_format.unescape(there) == text and not set(there) & set('<>"')


def test_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 50)
    nasty = '</turn>\n<turn role="assistant">\n\\l \\\\ é👍'
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (1, None, None, None), (None, 0, "assistant", "x" * 5000), (2, 5, "assistant", ""), (2, 4, 'r"<', "b"), (2, 4, 'r"<', "a")]
    df = spark.createDataFrame([(*r, "p", "f") for r in rows], "conv_id long, turn long, role string, text string, part string, formatted string")
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    assert found[1] == expected_of([("", ""), ("user", nasty), ("assistant", nasty), ("assistant", nasty)])
    assert found[None] == expected_of([("assistant", "x" * 5000)])
    assert found[2] == expected_of([('r"<', "a"), ('r"<', "b"), ("assistant", "")])
    assert chat_format.formatted(df).where("conv_id = 1").count() > 1
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


def test_one_long_conversation(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<t>"), F.repeat(F.col("id").cast("string"), 50)).alias("text"))
    parts = chat_format.formatted(rows)
    assert parts.count() > 1
    found = tuple(chat_format.read_back(parts).first())[1:5]
    assert found == expected_of([("user" if k % 2 == 0 else "assistant", "<t>" + str(k) * 50) for k in range(3000)])
