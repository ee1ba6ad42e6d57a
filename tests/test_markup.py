"""Markup, code tokens, books and key selection against examples."""

from __future__ import annotations

import io
import xml.dom.minidom
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import keys
from quire.sources import archives


def test_sanitised(spark):
    cases = {
        "<p onclick=x() class='a'>hi <b>there": '<p class="a">hi <b>there</b></p>',
        "<script>alert('<p>')</script>a<style>p{}</style>": "a<style>p{}</style>",
        "<a href='javascript:x' title='t'>l</a><a href=' HTTPS://e.x/?a=1&b=2'>m</a>": '<a title="t">l</a><a href=" HTTPS://e.x/?a=1&amp;b=2">m</a>',
        "<a href='java\nscript:x'>l</a><img src='data:image/png;base64,AA'><a href='data:text/html,x'>d</a>": '<a>l</a><img src="data:image/png;base64,AA"><a>d</a>',
        "<form><input value=1>x<custom>y</custom></form>": "xy",
        "<i><u>a</i>b</u>": "<i><u>a</u></i>b",
        "<svg><script>x</script><svg></svg><p>in</p></svg>out": "out",
        "1 &lt; 2 &amp; 3 < 4": "1 &lt; 2 &amp; 3 &lt; 4",
        "<br/><hr>": "<br><hr>",
        "": "",
    }
    df = spark.createDataFrame([*cases.items(), (None, None)], "html string, want string")
    for r in df.select("html", "want", markup.sanitised(F.col("html")).alias("got")).collect():
        assert r.got == r.want, r.html


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/= \"'abpi&;#-!scriptonjv:\n", max_size=60))
def test_sanitised_twice_is_once(text):
    once = markup.sanitised_text(text)
    assert markup.sanitised_text(once) == once
    assert "<script" not in once.lower()


def test_code_tokens(spark):
    code = "#include <a.h>\n// note\nreturn x.map(f) + map(1.5e3) + 'a\\'b' # end\n\"open\nif"
    got = spark.createDataFrame([(code,), (None,), ("",)], "c string").select(markup.code_tokens(F.col("c")).alias("t"), markup.highlighted(markup.code_tokens(F.col("c"))).alias("h")).collect()
    pairs = [(p.kind, p.text) for p in got[0].t if p.kind != "plain"]
    assert pairs == [
        ("keyword", "#include"), ("comment", "// note"), ("keyword", "return"), ("function", "map"), ("keyword", "map"), ("number", "1.5e3"),
        ("string", "'a\\'b'"), ("comment", "# end"), ("string", '"open'), ("keyword", "if"),
    ]
    assert got[1].t is None and got[2].t == [] and '<span class="tok-keyword">return</span> x.' in got[0].h


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\"'`\\/*#. \nifé1(_$", max_size=60))
def test_code_tokens_make_up_the_code(code):
    pieces = markup.code_pieces(code)
    assert "".join(p["text"] for p in pieces) == code
    assert all(a["kind"] != b["kind"] for a, b in zip(pieces, pieces[1:]))


def test_archives(spark):
    rows = [(1, 0, 0, "heading", 1, "A & <B>", "T & t"), (1, 0, 1, "paragraph", None, "two\nlines\x01", "T & t"), (1, 1, 0, "code", None, "x = 1", "T & t"), (1, 45, 0, "paragraph", None, "\u05e9\u05dc", "T & t"), (2, 0, 0, "paragraph", None, None, None)]
    df = spark.createDataFrame(rows, "doc int, page int, n int, kind string, level int, text string, title string")
    for make in (archives.epub, archives.docx):
        got = {r.doc: bytes(r.content) for r in make(df, "doc", "page", "n").collect()}
        assert sorted(got) == [1, 2]
        for content in got.values():
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                assert z.testzip() is None
                files = {n: z.read(n).decode() for n in z.namelist()}
            for name, text in files.items():
                if name not in ("mimetype",) and not name.endswith(".css"):
                    xml.dom.minidom.parseString(text.encode())
        with zipfile.ZipFile(io.BytesIO(got[1])) as z:
            names = z.namelist()
            if make is archives.epub:
                assert names[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
                assert [n for n in names if "chap_" in n] == ["OEBPS/text/chap_1.xhtml"]
                chapter = z.read("OEBPS/text/chap_1.xhtml").decode()
                assert "<h2>A &amp; &lt;B&gt;</h2><p>two\nlines</p><pre>x = 1</pre>" in chapter and '<p dir="rtl">' in chapter and "Page 1\u201346" in chapter
            else:
                body = z.read("word/document.xml").decode()
                assert body.count("<w:pageBreakBefore/>") == 2 and "two</w:t><w:br/>" in body
        assert make(df.limit(0), "doc", "page", "n").count() == 0


def test_keys(spark):
    names = [f"{b}_{c}" for b in ("rpm", "tpm", "rpd", "tpd") for c in ("used", "limit", "reset")]
    schema = "p string, k string, enabled boolean, invalid boolean, has_secret boolean, cooldown_until long, requests long, last_used long, " + ", ".join(f"{n} long" for n in names)

    def key(p, k, cooldown=0, requests=0, last=0, enabled=True, **used):
        base = {n: (0 if n == "tpd_limit" else 10 if n.endswith("limit") else 0) for n in names} | used
        return (p, k, enabled, False, True, cooldown, requests, last, *base.values())

    rows = [
        key("a", "1", requests=3), key("a", "2", rpm_used=10, rpm_reset=200), key("a", "3", requests=1, last=9), key("a", "4", requests=1, last=5),
        key("b", "1", rpm_used=10, rpm_reset=150, cooldown=150), key("b", "2", cooldown=180), key("b", "3", enabled=False),
        key("c", "1", tpd_used=9, tpd_limit=10, tpd_reset=150, cooldown=150), key("d", "1", enabled=False), key("e", "1", rpm_used=10, rpm_reset=100), key("f", "1", tpd_used=10**9),
    ]
    df = spark.createDataFrame(rows, schema)
    lit = F.lit
    got = lambda cursor, least: {r.p: (r.k, r.until, r.waits_for) for r in keys.picked(df, "p", "k", lit(100), lit(5), lit(cursor), least).collect()}
    rest = {"b": (None, 150, "minute"), "c": (None, 150, "day"), "d": (None, None, None), "e": ("1", None, None), "f": ("1", None, None)}
    assert got(0, False) == rest | {"a": ("1", None, None)}
    assert got(5, False) == rest | {"a": ("3", None, None)}
    assert got(0, True) == rest | {"a": ("4", None, None)}
