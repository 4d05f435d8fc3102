"""HTML, Markdown and mailbox text to plain text, as native expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions.paths import strip

# Elements whose content is not shown, and elements that begin a line.
HIDDEN_TAGS = ("noscript", "script", "style")
LINE_TAGS = (
    "address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "p", "pre", "section", "table", "tr",
)
# The named references of HTML 4 from Python's table, and the one that XML adds.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_entities(s: Column) -> Column:
    """Character references in one pass; what they produce is not read again, unknown ones stay."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(ref: Column) -> Column:
        inner = ref.substr(F.lit(2), F.length(ref) - 2)
        number = (
            F.when(F.lower(inner).startswith("#x"), F.conv(inner.substr(F.lit(3), F.length(inner)), 16, 10))
            .when(inner.startswith("#"), inner.substr(F.lit(2), F.length(inner))).try_cast("int")
        )
        return F.coalesce(_character(number), F.try_element_at(named, inner), ref)

    def joined(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)), decoded)
        between = F.split(text, REFERENCE)
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), found), between, lambda ref, text: F.concat(ref, text)), "")

    return once(s, lambda text: F.when(text.contains("&"), joined(text)).otherwise(text))


def _character(code: Column) -> Column:
    """Character of a code point by its UTF-32 bytes; null for none and for surrogates."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def html_to_text(html: Column) -> Column:
    hidden, line = "|".join(HIDDEN_TAGS), "|".join(LINE_TAGS)
    shown = F.regexp_replace(html, rf"(?is)<({hidden})\b[^>]*>.*?</\1>", "")
    broken = F.regexp_replace(shown, rf"(?i)</?(?:{line})\b[^>]*>", "\n")
    text = F.replace(decode_entities(F.regexp_replace(broken, r"<[^>]+>", "")), F.lit("\r\n"), F.lit("\n"))
    return strip(F.regexp_replace(text, r"(?:[ \t]*\n){3,}", "\n\n"))


# Markdown by the public CommonMark description.
# A fence is a line of its own: up to three blanks, then three or more marks and an info string.
FENCE = r"(?m)^ {0,3}(?:`{3,}|~{3,})[^\n]*(?:\n|\z)"
# Text in brackets that may hold one more pair, a target that may hold one pair of parentheses, a title.
LINK = r"""!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:<[^>\n]*>|(?:[^()\s]|\([^()\s]*\))*)(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)"""
HEADING = r"(?m)^ {0,3}#{1,6}(?:[ \t]+|$)"
QUOTE = r"(?m)^(?: {0,3}> ?)+"
# A run of marks opens before a word and closes behind one; inside a word underscores are letters.
OPENING = r"(?<![\p{L}\p{N}_*])(?:\*{1,3}|_{1,3}|~~)(?=[^\s*_~])"
CLOSING = r"(?<=[^\s*_~])(?:\*{1,3}|_{1,3}|~~)(?![\p{L}\p{N}_*])"


def markdown_to_text(md: Column) -> Column:
    """Text of a Markdown document: block marks, links, code marks and emphasis removed; then as HTML."""
    text = F.replace(md, F.lit("\r\n"), F.lit("\n"))
    for pattern, kept in ((FENCE, ""), (QUOTE, ""), (HEADING, ""), (LINK, "$1"), (r"`+", ""), (OPENING, ""), (CLOSING, "")):
        text = F.regexp_replace(text, pattern, kept)
    return html_to_text(text)


def mailbox_headers(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per message of an mbox text: number, From, Date and Subject."""
    whole = F.regexp_replace(F.col(text), r"\r\n", "\n")
    split = F.split(whole, r"(?m)^From ")
    messages = df.select(key, F.posexplode(split).alias("message_no", "message")).where("message_no > 0")
    body = F.regexp_replace("message", r"^[^\n]*\n", "")
    # continuation lines belong to the header above them
    head = F.regexp_replace(F.get(F.split(body, r"\n\n", 2), F.lit(0)), r"\n[ \t]+", " ")

    def header(name: str) -> Column:
        values = F.regexp_extract_all(head, F.lit(rf"(?im)^{name}\s*:(.*)$"), F.lit(1))
        # a repeated header keeps its last value
        return F.trim(F.coalesce(F.get(values, F.size(values) - 1), F.lit(""))).alias(name.lower())

    return messages.select(key, "message_no", header("From"), header("Date"), header("Subject"))
