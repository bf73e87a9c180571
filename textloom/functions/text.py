"""Normalization, cleaning and structure of texts as column expressions.

Python is used only where Spark has no function: character references, canonical composition and HTML
trees; and there only for the rows that need it, the others pass NULL.
"""

from __future__ import annotations

import html
import html.parser
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of headings and tags that results depend on.
ARTICLE = r"^\s*Điều\s+\d+[A-Za-zĐđ]*(?:\.\d+)*\s*[.:)]?"
CHAPTER = r"^\s*CHƯƠNG\s+(?:[IVXLCDM]+|\d+)\b"
SECTION = r"^\s*(?:MỤC|TIỂU\s+MỤC)\s+(?:[IVXLCDM]+|\d+)\b"
ARTICLE_TWO = r"(?<![\p{L}\p{N}_])Điều\s+2\s*(?:[.:]|\b)"
ARTICLE_NUMBER = r"(?<![\p{L}\p{N}_])Điều\s+(\d+[a-zđ]?(?:\.\d+)*)\b"
HTML_TAG = r"(?is)<!doctype\s+html\b|</?(?:html|head|body|p|div|section|article|header|footer|ul|ol|li|h[1-6]|table|thead|tbody|tfoot|tr|td|th|br|span|script|style)\b[^>]*>"
SKIPPED = r"(?is)<(script|style|noscript|template).*?>.*?</\1>"
WORD = r"[\p{L}\p{N}_]+"
BLOCK_TAGS = "p div section article header footer li ul ol h1 h2 h3 h4 h5 h6 tr".split()
SKIPPED_TAGS = "script style noscript template".split()

_MAY_COMPOSE = r"\p{M}|[\u0340-\u037E\u0387\u1100-\u11FF\u1F00-\u1FFF\u2000\u2001\u2126\u212A\u212B\u2329\u232A\uF900-\uFAFF]|[^\x{0}-\x{FFFF}]"
_MAY_UNESCAPE = "&[#A-Za-z]"


def _only_where(text: Column, pattern: str, function) -> Column:
    """``function`` of the texts that match; the others stay as they are and never reach Python."""
    needs = text.rlike(pattern)
    return F.when(needs, F.pandas_udf(function, "string")(F.when(needs, text))).otherwise(text)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _unescape_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", html.unescape(t)), na_action="ignore")


def nfc(text: Column) -> Column:
    return _only_where(text, _MAY_COMPOSE, _nfc)


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _spacing(text: Column, blanks: str) -> Column:
    text = F.regexp_replace(text, blanks, " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_text(text: Column) -> Column:
    """Character references resolved, NFC, line ends, blanks and invisible characters; NULL stays NULL."""
    text = _only_where(text, f"{_MAY_UNESCAPE}|{_MAY_COMPOSE}", _unescape_nfc)
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(F.translate(text, "\u00a0", " "), r"[\u200B\uFEFF\x00]", "")
    return _spacing(text, r"[ \t\f\x0B]+")


def normalize_document(text: Column) -> Column:
    """As ``normalize_text``, but keeping references and invisible characters, and joining only spaces and tabs."""
    text = F.regexp_replace(F.translate(nfc(text), "\u00a0", " "), r"\r\n?", "\n")
    return _spacing(text, r"[ \t]+")


def metric_text(text: Column) -> Column:
    """NFC, lower case, single spaces."""
    return strip(F.regexp_replace(F.lower(nfc(text)), r"(?U)\s+", " "))


def looks_like_html(text: Column) -> Column:
    return text.rlike(HTML_TAG)


class _Tree(html.parser.HTMLParser):
    """Text of a page: without head and scripts, line feeds after blocks and for breaks, tabs after cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "br" and not self.hidden:
            self.out.append("\n")
        elif tag == "head" or tag in SKIPPED_TAGS:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag in ("td", "th"):
            self.out.append("\t")
        elif tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _page_text(page: str) -> str:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return "".join(tree.out)


def _page_texts(s: pd.Series) -> pd.Series:
    return s.map(_page_text, na_action="ignore")


def strip_tags(text: Column) -> Column:
    """HTML to text by replacement alone; titles stay."""
    text = F.regexp_replace(text, SKIPPED, " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|section|article|li|tr|h[1-6])>", "\n")
    return F.regexp_replace(text, r"(?s)<[^>]+>", " ")


def clean_html(text: Column, content_format: str = "markdown", tree: bool = True) -> Column:
    """Normalized text: ``markdown`` never parses tags, ``html`` always, ``auto`` where there are any.

    ``tree`` chooses between the parsed page and replacement of tags.  NULL and empty give "".
    """
    if content_format not in ("markdown", "html", "auto"):
        raise ValueError(f"unknown content format {content_format!r}")
    parsed = _only_where(text, "[<&]", _page_texts) if tree else strip_tags(text)
    source = {"markdown": text, "html": parsed, "auto": F.when(looks_like_html(text), parsed).otherwise(text)}[content_format]
    return F.coalesce(normalize_text(source), F.lit(""))


def words(text: Column) -> Column:
    """Words of a ``metric_text``: letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(WORD)).cast("long")


def blank_split(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def count_lines(text: Column) -> Column:
    """Lines that aren't blank."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    return F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S"))).cast("long")


def _headings(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?imuUd){pattern}")).cast("long")


def article_count(text: Column) -> Column:
    return _headings(text, ARTICLE)


def chapter_count(text: Column) -> Column:
    return _headings(text, CHAPTER)


def section_count(text: Column) -> Column:
    return _headings(text, SECTION)


def article_numbers(text: Column) -> Column:
    """Numbers of the articles named anywhere in the text, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?iuU){ARTICLE_NUMBER}"), F.lit(1)), lambda x: F.lower(x))


def article_two_at(text: Column) -> Column:
    """Place, from 1, of the first naming of article 2; 0 without any."""
    return F.regexp_instr(text, F.lit(f"(?iuU){ARTICLE_TWO}"))


def markdown_cell(text: Column, length: int = 120) -> Column:
    return F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), 1, length)
