"""Text expressions for repository metadata.

The regex dialect is pinned so that results equal Python's ``re`` on unicode strings:
``(?d)`` makes newline the only line end, ``(?U)`` makes ``\\s`` unicode aware, and the
four separator controls U+001C..U+001F, which Java leaves out, are listed by hand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x1c-\x1f"
# What Python calls a word character: letters, numbers of any kind, underscore.  Marks and
# joiners are not in it, so Java's own \b cannot be used.  The look-behind spans two code
# units to see letters outside the basic plane whole.
_WORD_START = r"(?<![\p{L}\p{N}_]{1,2})"
_WORD_END = r"(?![\p{L}\p{N}_])"

# The cleaning rules, in the order that defines the result.
# (pattern, replacement).  The look-aheads on the first letters only save time; they list
# the letters that count as equal when case is ignored (dotless and dotted i, long s).
# Images and linked images have to close on their line.  Where one does not, nothing further
# on the line can, so the rest of the line is taken along unchanged: time stays linear.
_IMAGE = (r"(?d)!\[(?>.*?\]\()[^\n)]*+\)|(!\[[^\n]*+)", "$1")
_LINKED_IMAGE = (r"(?d)\[!\[(?>.*?\]\()(?>.*?\)\]\()[^\n)]*+\)|(\[!\[[^\n]*+)", "$1")
_LICENSE = (
    r"(?dU)(?=[MAGBCmagbc][IPSOipsoıİſ][TALDPtaldp])(?i:MIT License|Apache License|GPL|BSD|Copyright[^\n]*)(?:\n|$)",
    "",
)
_URL = (rf"(?dU)https?://([^/{WS}]+)[^{WS}]*", "$1")
_HEADER = (rf"(?dUm)^#{{1,6}}[{WS}]*", "")
_MARKS = (r"[*_~`]+", "")
# (first letters, words, canonical name)
_WORD_RULES = [
    ("[jJ][aAsSſ]", "javascript|js", "javascript"),
    ("[pP][yY]", "python|py", "python"),
    ("[rR][eE][aA]", "reactjs|react", "react"),
    ("[nN][oO][dD]", "nodejs|node", "nodejs"),
]
_WORDS = [
    (f"(?dU)(?={first}){_WORD_START}(?i:{words}){_WORD_END}", name) for first, words, name in _WORD_RULES
]
_PUNCTUATION = (r"(?=[!?.]{2})(?:([!?])\1+|(\.\.\.)\.+)", "$1$2")
# Every run of whitespace but a single space, which stays as it is.
_SPACES = (rf"(?U)[{WS}&&[^ ]][{WS}]*+| [{WS}]++", " ")
# Whitespace is single spaces by now, so no line end stops this one: an install
# command drops the rest of the text.
_INSTALL = (r"(?dUs)(?=[NPGnpg][PIpiıİ][MPTmpt] [ICicıİ])(?i:npm install|pip install|git clone).*", "")
CLEANING_RULES = [_IMAGE, _LINKED_IMAGE, _LICENSE, _URL, _HEADER, _MARKS, *_WORDS, _PUNCTUATION, _SPACES, _INSTALL]


def _text(col: Column) -> Column:
    return col.cast("string")


def strip(col: Column) -> Column:
    """Remove unicode whitespace at both ends."""
    return F.regexp_replace(_text(col), rf"(?U)^[{WS}]+|(?<![{WS}])[{WS}]++\z", "")


def is_blank(col: Column) -> Column:
    """True for null, empty and whitespace-only text; stops at the first visible character."""
    return F.coalesce(~F.rlike(_text(col), F.lit(rf"(?U)[^{WS}]")), F.lit(True))


def clean_readme(col: Column) -> Column:
    """Drop badges, licence lines, markdown marks and install commands; unify tool names."""
    out = F.coalesce(_text(col), F.lit(""))
    for pattern, replacement in CLEANING_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


# One element of a bracketed list literal: quoted text, a number, or a named constant.
_LITERAL_ITEM = (
    r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|\bNone\b|\bTrue\b|\bFalse\b"
    r"|[-+]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
)
_MARK = "\x01"


def _unescape(inner: Column) -> Column:
    """Text between the quotes of a literal, its escapes resolved by the JSON reader."""
    out = F.replace(inner, F.lit("\\\\"), F.lit(_MARK))
    out = F.replace(F.replace(out, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    out = F.regexp_replace(F.replace(out, F.lit('"'), F.lit('\\"')), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    out = F.replace(out, F.lit(_MARK), F.lit("\\\\"))
    options = {"allowUnquotedControlChars": "true"}
    return F.from_json(F.concat(F.lit('["'), out, F.lit('"]')), "array<string>", options)[0]


def _literal_value(item: Column) -> Column:
    """Printed form of one list element; empty text for the ones that count as false."""
    inner = F.substr(item, F.lit(2), F.length(item) - 2)
    quoted = F.when(F.contains(inner, F.lit("\\")), F.coalesce(_unescape(inner), inner)).otherwise(inner)
    number = F.when(item.rlike("[.eE]"), item.try_cast("double").cast("string")).otherwise(
        F.ltrim(item, F.lit("+"))
    )
    return (
        F.when(item.startswith("'") | item.startswith('"'), quoted)
        .when(item.isin("None", "False"), F.lit(""))
        .when(item == "True", item)
        .when(item.try_cast("double") == 0, F.lit(""))
        .otherwise(number)
    )


def join_topics(col: Column) -> Column:
    """Array of topics to ``a; b``; null and empty elements are left out."""
    return F.coalesce(F.concat_ws("; ", F.filter(col.cast("array<string>"), lambda t: t != "")), F.lit(""))


def clean_topics(col: Column, is_array: bool = False) -> Column:
    """Topics in any stored shape to ``a; b``.

    Arrays are joined.  Text that is a flat bracketed list literal is read element by
    element; any other text loses its brackets and has commas turned into semicolons.
    """
    if is_array:
        return join_topics(col)
    text = _text(col)
    body = F.substr(text, F.lit(2), F.length(text) - 2)
    # Replace every element by one mark: a well-formed list leaves "mark, mark, ..." only.
    frame = F.regexp_replace(F.regexp_replace(body, _LITERAL_ITEM, _MARK), r"[ \t\r\n\f]+", "")
    is_literal = (
        text.startswith("[")
        & text.endswith("]")
        & ~F.contains(text, F.lit(_MARK))
        & F.replace(frame, F.lit(_MARK + ","), F.lit("")).isin("", _MARK)
    )
    items = F.regexp_extract_all(body, F.lit(_LITERAL_ITEM), F.lit(0))
    return F.coalesce(
        F.when(is_literal, F.concat_ws("; ", F.filter(F.transform(items, _literal_value), lambda t: t != "")))
        .otherwise(strip(F.translate(text, ",[]", ";"))),
        F.lit(""),
    )


def first_words(col: Column, n: int) -> Column:
    """First ``n`` whitespace-separated words joined by single spaces.

    The split stops after ``n`` words, so a long text is not cut up whole.
    """
    parts = F.split(_text(col), rf"(?U)[{WS}]+", n + 2)
    return F.array_join(F.slice(F.filter(parts, lambda w: w != ""), 1, n), " ")


def first_chars(col: Column, n: int) -> Column:
    return F.substring(_text(col), 1, n)


def tokens(col: Column, max_tokens: int | None = None) -> Column:
    """Lower-cased words; all of them, or the first ``max_tokens``."""
    limit = -1 if max_tokens is None else max_tokens + 2
    words = F.filter(F.split(F.lower(_text(col)), r"\s+", limit), lambda w: w != "")
    return words if max_tokens is None else F.slice(words, 1, max_tokens)


def token_limit(requested: int, long_context: bool = False) -> int:
    """Usable sequence length: 512, or up to 8192 for long-context classifiers."""
    return min(requested, 8192 if long_context else 512)


def preview(col: Column, n: int = 100) -> Column:
    """Text shortened to ``n`` characters plus dots when it is longer."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def percent(col: Column) -> Column:
    """0.9368 -> ``93.68%``."""
    return F.format_string("%.2f%%", col * 100)


def _part(label: str, value: Column, keep: Column) -> Column:
    return F.when(keep, F.concat(F.lit(f"{label}: "), value))


def training_text(
    name: Column,
    description: Column,
    topics: Column,
    readme: Column,
    clean: bool = True,
    max_readme_words: int | None = None,
) -> Column:
    """``Repository: .. | Description: .. | Topics: .. | README: ..`` as used for training.

    Null skips a part; an empty string does not, except for topics, which must show text.
    Cleaning runs on the joined string.
    """
    name, description, topics, readme = map(_text, (name, description, topics, readme))
    body = first_words(readme, max_readme_words) if max_readme_words else readme
    joined = F.concat_ws(
        " | ",
        _part("Repository", name, name.isNotNull()),
        _part("Description", description, description.isNotNull()),
        _part("Topics", topics, ~is_blank(topics)),
        _part("README", body, readme.isNotNull()),
    )
    return clean_readme(joined) if clean else joined


def simple_text(name: Column, description: Column, topics: Column, readme: Column) -> Column:
    """Same layout; null or empty parts are skipped and nothing is cleaned."""
    labels = ("Repository", "Description", "Topics", "README")
    values = [_text(c) for c in (name, description, topics, readme)]
    return F.concat_ws(" | ", *[_part(l, v, v != "") for l, v in zip(labels, values)])


def batch_text(
    name: Column,
    description: Column,
    topics: Column,
    readme: Column,
    max_readme_chars: int | None = 5000,
    clean: bool = True,
    topics_is_array: bool = False,
) -> Column:
    """Layout for bulk scoring: blank or literal ``nan`` parts are skipped, README is cut unless told not to."""
    name, description, readme = map(_text, (name, description, readme))
    if topics_is_array:
        topic_text = join_topics(topics)
        has_topics = F.size(F.coalesce(topics, F.array())) > 0
    else:
        raw = _text(topics)
        topic_text = F.translate(raw, ",[]'", ";")
        has_topics = ~is_blank(raw) & ~raw.isin("nan", "[]")
    joined = F.concat_ws(
        " | ",
        _part("Repository", name, ~is_blank(name)),
        _part("Description", description, ~is_blank(description) & (description != "nan")),
        _part("Topics", topic_text, has_topics & ~is_blank(topic_text)),
        _part("README", readme if max_readme_chars is None else first_chars(readme, max_readme_chars), ~is_blank(readme) & (readme != "nan")),
    )
    return clean_readme(joined) if clean else joined
