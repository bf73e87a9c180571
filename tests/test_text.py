from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, T.normalize_text, "  a\r\nb  c​﻿\x00 \t d\n\n\n\n ê &lt; 1km &#273;x ") == "a\nb c d\n\nê < 1km đx"
    assert one(spark, T.normalize_document, "a&lt;​b \n  c") == "a&lt;​b\nc"
    assert one(spark, T.metric_text, " Ê \n B ") == "ê b"
    assert one(spark, T.normalize_text, None) is None
    assert one(spark, T.clean_html, None) == "" and one(spark, T.clean_html, "") == ""


def test_html(spark):
    page = "<html><head><title>t</title></head><body><script>x<y</script><p>a</p><div>b<br>c</div><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert one(spark, lambda t: T.clean_html(t, "html"), page) == "a\nb\nc\n1 2"
    assert one(spark, lambda t: T.clean_html(t, "html", tree=False), page) == "t a\nb\nc\n1 2"
    raw = "<ul><li>a</li><li>b &amp; c</li></ul><table><tr><th>x</th><td>y</td></tr><tr><td>z</td></tr></table><h2>h</h2>e<br>f<noscript>n</noscript>"
    assert T._page_text(raw) == "a\nb & c\n\nx\ty\t\nz\t\nh\ne\nf"
    assert one(spark, T.strip_tags, "<p>a</p><script>1</script>b<BR/>c<td>d</td>") == " a\n b\nc d "
    assert one(spark, T.strip_tags, "<style>a<script>b</style>c</script>d") == " c d"
    assert one(spark, lambda t: T.clean_html(t, "auto"), "< 1km and > 1.15") == "< 1km and > 1.15"
    assert one(spark, lambda t: T.clean_html(t, "markdown"), "<p>a</p>") == "<p>a</p>"
    assert one(spark, T.looks_like_html, "x </P >") and not one(spark, T.looks_like_html, "a < b > c")


def test_structure(spark):
    text = "Điều 1. a\nĐIỀU 2a: b\n\n  điều 3.1) c\nĐiều 4 x\nxĐiều 5"
    assert one(spark, T.article_count, text) == 4
    assert one(spark, T.chapter_count, "CHƯƠNG II\nchương 3 x\na CHƯƠNG I") == 2
    assert one(spark, T.section_count, "Mục 3\nTIỂU MỤC 1\nMỤC y") == 2
    assert one(spark, T.article_numbers, "Điều 2ab Điều 3A ĐIỀU 4.1 xĐiều 9") == ["3a", "4.1"]
    assert one(spark, T.article_two_at, "xĐiều 2. Điều 20 Điều 2a Điều 2.1") == 26
    assert one(spark, T.article_two_at, "Điều 20") == 0
    assert one(spark, T.count_lines, "a\n\n \nb\r\nc d") == 4


def test_words(spark):
    assert one(spark, T.words, "đất_1 (x) ½") == ["đất_1", "x", "½"]
    assert one(spark, T.blank_split, " a  b c ") == ["a", "b", "c"]
    assert one(spark, T.blank_split, "") == []
