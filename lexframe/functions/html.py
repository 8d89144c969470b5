"""Paragraphs of HTML pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# What is no text, and the elements whose start or end closes a paragraph.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCKS = "p|address|article|aside|blockquote|body|details|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
OPENING, BORDER = r"(?i)<p(\s[^>]*)?>", rf"(?i)</?({BLOCKS})(\s[^>]*)?/?>"
BREAK, TAG = r"(?i)<br\s*/?>", r"</?[a-zA-Z][^>]*>"
CUT, MARK = "\x01", "\x02"


def paragraphs(html: Column) -> Column:
    """Array of the paragraphs' texts, inline elements included. A paragraph ends at its closing tag or the next block's
    border; character references stay as they are."""
    shown = F.regexp_replace(F.regexp_replace(html, f"[{CUT}{MARK}]", " "), HIDDEN, "")
    parted = F.regexp_replace(F.regexp_replace(shown, OPENING, CUT + MARK), BORDER, CUT)
    plain = F.regexp_replace(F.regexp_replace(parted, BREAK, " "), TAG, "")
    return F.transform(F.filter(F.split(plain, CUT), lambda x: x.startswith(MARK)), lambda x: clean(F.translate(x, MARK, "")))
