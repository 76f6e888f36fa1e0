"""Chat formatting and URL filters."""

import random

import pytest

from tests.llm import brute


def test_chat_round_trip():
    from quillspark.llm.chatfmt import TEMPLATE, compile_template, parse_chat

    rng = random.Random(1)
    parts = ["\\", "###", "### ", "</turn>", " </turn>\n", ":", "\n", "a", "<", "/turn>", "#", "x: ", "### user: ", "{{ 1 }}", "日"]
    render = compile_template(TEMPLATE)
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "".join(rng.choices(parts, k=2)), ""]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
        read = parse_chat(text)
        assert [x[:2] for x in read] == turns
        assert spans == [x[2:] for x in read if x[0] == "assistant"]


def test_template_language():
    from quillspark.llm.chatfmt import Block, Const, Out, TemplateError, compile_template, fold, parse

    run = lambda source, **scope: compile_template(source)(scope)[0]
    assert run("{% for x in xs %}{% if x == 'a' or x == 'b' %}<{{ x | upper }}>{% elif not x %}-{% else %}{{ x + '!' }}{% endif %}{% endfor %}", xs=["a", "", "c"]) == "<A>-c!"
    assert fold(parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == Block((Out(Const("abCd")),))
    assert compile_template("ab{% generation %}{{ t }}{% endgeneration %}c")({"t": "日本"}) == ("ab日本c", [(2, 4)])
    for bad in ("{% if x %}", "{{ x.__class__ }}", "{{ f(x) }}", "{{ x | eval }}", "{% import os %}", "{{ x[0] }}", "{{ }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_conversations(spark):
    from quillspark.llm.chatfmt import digest_conversations, format_conversations

    rows = [(1, 1, "assistant", "a ### b"), (1, 0, "user", None), (2, 0, None, ""), (1, 2, "assistant", "\\"), (None, 0, "assistant", "x"), (3, 0, "user", "t"), (3, 0, "user", "t"), (3, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r[0]: tuple(r)[1:5] for r in digest_conversations(format_conversations(frame)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((v is not None, v) for v in r[1:]))]
        learnt = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), brute.sha(learnt))
    assert got == want
    assert digest_conversations(format_conversations(frame.limit(0))).count() == 0


def test_url_verdicts(spark):
    from quillspark.llm.urlrep import url_verdicts

    urls = ["https://A.Example.NET/en/1?q", "http://example.net", "http://x.net/", "ftp://example.com/de/", "http://badexample.com/de/", "http://m.example.org/fr/x#y", None, "nothing", "http://h?x://y", "a://b://c"]
    bad = [f"http://bad.host.test/{i}" for i in range(40)]
    good = [f"http://good.host.test/{i}" for i in range(40)] + [f"http://fine{i}.other.test/" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + bad + good)], "page_id bigint, url string, host string")
    n = len(urls)
    outcomes = spark.createDataFrame([(i, int(i < n + 40)) for i in range(n, n + 120)] + [(n, 1)], "page_id bigint, bad int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_verdicts(pages, outcomes).collect()}
    assert [got[i] for i in range(n)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "", None, "allow"),
        ("x.net", "/", "net/", "block"),
        ("example.com", "/de/", "example.com/de/", "block"),
        ("badexample.com", "/de/", None, "allow"),
        ("m.example.org", "/fr/x", "org/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h", "", None, "allow"),
        ("b:", "//c", None, "allow"),
    ]
    assert {got[i][3] for i in range(n, n + 40)} == {"block"} and {got[i][3] for i in range(n + 40, n + 120)} == {"allow"}
    assert url_verdicts(pages.limit(0), outcomes).count() == 0 and url_verdicts(pages, outcomes.limit(0)).count() == len(got)


def test_posterior_tail(spark):
    """Against a fine sum over the density, and closed forms."""
    import numpy as np

    from quillspark.llm.urlrep import with_tail

    cases = [(1.0, 1.0), (0.01, 0.2), (0.5, 0.5), (3.0, 17.0), (0.3, 400.0), (40.0, 260.0), (900.0, 8000.0), (50_000.0, 350_000.0), (20.0, 0.02)]
    for limit in (0.02, 0.126, 0.5, 0.97):
        got = {(r["a"], r["b"]): r["tail"] for r in with_tail(spark.createDataFrame(cases, "a double, b double"), limit).collect()}
        for a, b in cases:
            u = np.linspace(-60 / min(a, 1) - 10, 60 / min(b, 1) + 10, 4_000_001)
            f = a * u - (a + b) * np.logaddexp(0, u)
            f = np.exp(f - f.max())
            want = f[u > np.log(limit / (1 - limit))].sum() / f.sum()
            assert abs(got[a, b] - want) < 2e-3, (limit, a, b, got[a, b], want)
        assert abs(got[1.0, 1.0] - (1 - limit)) < 1e-6 and abs(got[0.5, 0.5] - (1 - 2 / np.pi * np.arcsin(np.sqrt(limit)))) < 1e-6


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.urlrep import domain_and_suffix, reputation_site

    want = {
        "a.foo.co.uk": ("foo.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "1.2.3.4:80": ("1.2.3.4", "[]"), "[::1]:8080": ("[::1]", "[]"),
        "u:p@x.com:8080": ("x.com", "com"), "www.x.com.": ("x.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "b.com.example": ("com.example", "example"),
    }
    frame = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r[0]: tuple(r[1:]) for r in frame.select("host", *domain_and_suffix(reputation_site(F.col("host")))).collect()} == want
