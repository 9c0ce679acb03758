from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from postlake.functions import text as T
from postlake.functions.embedtext import embedding_text, fallback_document
from postlake.functions.html import html_to_text
from postlake.functions.quotes import without_quotes


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("mid", ["<a@b.c>", " a@b.c ", "<x%25y@z>", "<p(1)@z>", "<a/b@c>", "<ünï~*@c d>"])
def test_message_urls_are_quoted_once(spark, mid):
    bare = mid.strip().removeprefix("<").removesuffix(">")
    f = T.link_fields(F.col("m"), F.lit("s"))
    assert one(spark, f["message_url"], m=mid) == "message:" + quote(f"<{bare}>", safe="@/")
    assert one(spark, f["mid_url"], m=mid) == "mid:" + bare


@pytest.mark.parametrize("mid", ["", "  ", "<>", None, "< >"])
def test_no_links_without_an_id(spark, mid):
    for c in T.link_fields(F.col("m"), F.lit("s")).values():
        assert one(spark, c, m=mid) is None


@pytest.mark.parametrize(("subject", "label"), [("[List] Re:\n  x", "List Re: x"), (None, "(no subject)"), ("[]", "(no subject)"), ("", "(no subject)")])
def test_labels(spark, subject, label):
    assert one(spark, T.link_label("s"), s=subject) == label


def test_parens_fall_back_to_the_encoded_target(spark):
    f = T.link_fields(F.col("m"), F.lit("s"), scheme="mid")["markdown_link"]
    assert one(spark, f, m="<p(1)@z>") == "[s](message:%3Cp%281%29@z%3E)"
    assert one(spark, f, m="<p@z>") == "[s](mid:p@z)"


@pytest.mark.parametrize(("name", "relational", "meta"), [("a.tar.gz", "gz", "gz"), (".bashrc", "", "bashrc"), ("d.x/y", "", "x/y"), ("A.PDF", "pdf", "pdf"), ("plain", "", None), ("x.", "", "")])
def test_two_extensions(spark, name, relational, meta):
    assert one(spark, T.file_extension("n"), n=name) == relational
    assert one(spark, T.meta_extension("n"), n=name) == meta


def test_like_has_wildcards_but_no_escapes(spark):
    assert one(spark, T.contains_like("s", "A_C"), s="xabcx")
    assert one(spark, T.contains_like("s", "a\\b"), s="xA\\Bx")
    assert not one(spark, T.contains_like("s", "a\\b"), s="xabx")


def test_safe_names(spark):
    assert one(spark, T.safe_name("n"), n="../etc/passwd; rm -rf /.pdf") == ".._etc_passwd_ rm -rf _.pdf"
    assert one(spark, T.safe_name("n", "f"), n="  ") == "f"
    assert len(one(spark, T.safe_name("n"), n="x" * 300)) == 200


def test_prefixes_compare_whole_folders(spark):
    assert one(spark, T.move_prefix("p", "/mail", "/new"), p="/mail/a/b.eml") == "/new/a/b.eml"
    assert one(spark, T.move_prefix("p", "/mail", "/new"), p="/mailX/a") is None


FOOT = "x" * 150 + "\n" + "y" * 100 + "\nlast line"


@pytest.mark.parametrize("text", ["Unsubscribe", FOOT, FOOT + "\nplease unsubscribe here", "short\nUnsubscribe", FOOT + "\n\n  | Unsubscribe | more\nrest", "a\n" * 150 + "\nUpdate your preferences\nUnsubscribe"])
def test_footers_alike_in_both_forms(spark, text):
    from postlake.functions.html import footer_cut

    assert one(spark, T.before_footer("t"), t=text) == footer_cut(text)


def test_footer_cuts_from_its_line(spark):
    body = "a" * 120 + "\n" + "b" * 120 + "\n"
    assert one(spark, T.before_footer("t"), t=body + "\nUnsubscribe | Manage").startswith("a" * 120)
    assert "Unsubscribe" not in one(spark, T.before_footer("t"), t=body + "\nUnsubscribe | Manage")


def test_embedding_text_limits(spark):
    schema = "s string, f string, b string, a array<struct<filename:string,extracted_text:string>>"
    rows = [
        ("S", "F", "B", None),
        ("S", "F", "B", [("n1", "t1"), (None, None)]),
        ("S", "F", "B" * 6000, []),
        ("S", "F", "B", [("n1", "x" * 3000), ("n2", "y" * 2500), ("n3", "z" * 2500), ("n4", "w")]),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(embedding_text("s", "f", "b", "a")).collect()]
    assert got[0] == "S\nF\nB" and got[1] == "S\nF\nB\nAttachments:\nn1\nt1\nUnknown"
    assert got[2] == "S\nF\n" + "B" * 5000
    left = 5000 - 2 * 2003
    assert got[3] == "\n".join(["S", "F", "B", "Attachments:", "n1", "x" * 2000 + "...", "n2", "y" * 2000 + "...", "n3", ("z" * 2000 + "...")[:left] + "..."])


def test_fallback_document(spark):
    rows = [("S", "B" * 2000, [(f"n{i}",) for i in range(7)]), ("S", None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, b string, a array<struct<filename:string>>").select(fallback_document("s", "b", "a")).collect()]
    assert got[0] == "S\n" + "B" * 1000 + "\nAttachments: n0, n1, n2, n3, n4 (+2 more)" and got[1] == "S\n"


@pytest.mark.parametrize(
    ("html", "there", "gone"),
    [
        ("<style>p{}</style><script>x()</script><p>Hello</p>", ["Hello"], ["p{}", "x()"]),
        ("<head><title>T</title></head><body>a &amp; b &lt;c&gt;</body>", ["a & b <c>"], ["T"]),
        ("<div style='display: none'>hide<p>me</p></div><p>show</p>", ["show"], ["hide", "me"]),
        ("<div class='x Preheader-1'>pre</div><span class='screen-reader-text'>sr</span>body", ["body"], ["pre", "sr"]),
        ("<img src=x alt='Logo'><img src=y>text", ["Logo", "text"], ["src"]),
        (f"<a href='https://t.example/{'u' * 300}'>Pay now</a>", ["Pay now"], ["t.example"]),
        ("<a href='https://ex.org/a'>Docs</a>", ["[Docs](https://ex.org/a)"], []),
        ("<a href='https://ex.org/a'>https://ex.org/a</a>", ["https://ex.org/a"], ["]("]),
        ("<b>bold</b> and <em>em</em>", ["bold and em"], ["*", "_"]),
        ("<p>one<p>two<br>three", ["one\ntwo\nthree"], []),
        ("<ul><li>a<li>b</ul>", ["* a\n  * b"], []),
        ("<table><tr><td>Amount</td><td>12.50</td></tr><tr><td>Due</td><td>May</td></tr></table>", ["Amount | 12.50", "Due | May"], []),
    ],
)
def test_html(html, there, gone):
    out = html_to_text(html)
    assert all(x in out for x in there), out
    assert not any(x in out for x in gone), out


def test_html_edges():
    assert html_to_text("") == "" and html_to_text(None) == ""
    assert "\n\n\n" not in html_to_text("<p>a</p><br><br><br><br><p>b</p>")
    assert html_to_text("<div><p>unclosed") == "unclosed"
    body = "<p>" + "word " * 60 + "</p><p>Total: 5</p><p></p><div>Unsubscribe | Privacy</div><p>Corp address</p>"
    assert "Unsubscribe" not in html_to_text(body) and "Corp" not in html_to_text(body)
    assert "unsubscribe" in html_to_text("<p>" + "word " * 60 + "click to unsubscribe</p>")


def test_quotes():
    assert without_quotes("New text\n\nOn Mon, Ann wrote:\n> old\n> older") == "New text"
    assert without_quotes("Hi\n-----Original Message-----\nFrom: x\n old") == "Hi"
    assert without_quotes("> only quoted") == "> only quoted"
    assert without_quotes("no markers at all") == "no markers at all"
    assert without_quotes("Answer\n\nFrom: Ann\nSent: Monday\nSubject: x\n\nold") == "Answer"
