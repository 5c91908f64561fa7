"""Drive URLs: file IDs, canonical links and repair of URLs broken in text."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.fixed_values import (
    DEFAULT_LINK_FORM,
    DRIVE_HOSTS,
    LINK_FORMS,
    URL_HEAD,
)
from linkloom.functions.text import WS, first_match

# A URL that parses and whose host contains a drive host. Control bytes, bad
# %-escapes in path or fragment and odd host characters make a URL unusable.
_HEX = r"%[0-9A-Fa-f]{2}"
_CTL = r"\x00-\x1f\x7f"
_DRIVE_URL = (
    r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*+:)?+//"
    r"(?:[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)?"
    r"(?=[^/?#]*(?:drive|docs)\.google\.com)"
    r"(?:[A-Za-z0-9\-_.~!$&'()*+,;=<>\"\[\]]|[^\x00-\x7f]|%(?:25|[89A-Fa-f][0-9A-Fa-f]))*+(?::\d*+)?+"
    rf"(?:/(?:[^%?#{_CTL}]++|{_HEX})*+)?+"
    rf"(?:\?[^#{_CTL}]*+)?+"
    rf"(?:#(?:[^%{_CTL}]++|{_HEX})*+)?+\z"
)
_PATH = r"\A[^/]*+//[^/?#]*+([^?#]*+)"
_QUERY = r"\A[^?#]*+\?([^#]*+)"
_ID_IN_PATH = r"/(?:d/e|d|folders)/([^/]*)"
_ID_IN_URL = r"\A[^/]*+//[^/?#]*+[^?#]*?/(?:d/e|d|folders)/([^/?#]*)"
_ID_IN_QUERY = rf"(?:\A|&)id(?:=((?:[^&;%]|{_HEX})*))?(?:&|\z)"
_BARE_ID = r"[-\w]{25,}"


def file_id(url: Column) -> Column:
    """File ID named by a drive URL; null when there is none.

    The ID segment of the path wins, then ``?id=``, then the first run of 25 or
    more ID characters. An empty ID segment gives ``''``, which is not null.
    URLs without %-escapes, nearly all, need no decoding and take two matches.
    """
    literal_plus = F.replace(F.regexp_extract(url, _PATH, 1), F.lit("+"), F.lit("%2B"))
    in_path = F.when(
        url.contains("%"),
        first_match(F.try_url_decode(literal_plus), _ID_IN_PATH, 1),
    ).otherwise(first_match(url, _ID_IN_URL, 1))
    in_query = first_match(F.regexp_extract(url, _QUERY, 1), _ID_IN_QUERY, 1)
    return F.when(
        url.rlike(_DRIVE_URL),
        F.coalesce(
            in_path,
            F.nullif(F.try_url_decode(in_query), F.lit("")),
            first_match(url, _BARE_ID),
        ),
    )


def canonical_link(id_col: Column, mime_type: Column) -> Column:
    """The URL a file is opened with, by MIME type."""

    def form(template: str) -> Column:
        head, tail = template.split("%s")
        return F.concat(F.lit(head), id_col, F.lit(tail))

    known = reduce(
        lambda chain, item: chain.when(mime_type == item[0], form(item[1])),
        LINK_FORMS.items(),
        F,
    )
    return known.otherwise(form(DEFAULT_LINK_FORM))


# Quantifiers are possessive throughout: each run of characters can end in one
# place only, so matching stays linear and needs no backtracking stack even on
# long runs of blanks or backslashes. Patterns begin with literal text where
# they can, which lets the search skip ahead.
_BROKEN_URL = (
    r"https://((?:drive\.google\.com|docs\.google\.com)/"
    rf"[^{WS}*_]++)[*_]*+(?=[\t\f\r ]*+\n)[{WS}]++[*_]*+([^{WS}*_]++)[*_]*+"
)
_ESCAPED_CHAR = (
    rf"({URL_HEAD}|\G(?!\A))((?:[^{WS}\\]++|\\(?![_*\-\[\]]))*+)\\([_*\-\[\]])"
)


def mentions_drive(text: Column) -> Column:
    """Cheap test that a text may hold a drive URL at all."""
    return reduce(
        lambda a, b: a | b, (text.contains(f"https://{host}/") for host in DRIVE_HOSTS)
    )


def repair_urls(text: Column) -> Column:
    """Join drive URLs broken over two lines, then drop Markdown escapes in them.

    Substring tests, which are cheap, spare most texts the pattern matching.
    """
    joined = F.regexp_replace(text, _BROKEN_URL, "https://$1$2")
    unescaped = F.regexp_replace(joined, _ESCAPED_CHAR, "$1$2$3")
    return (
        F.when(~mentions_drive(text), text)
        .when(text.contains("\\"), unescaped)
        .otherwise(joined)
    )


URL_IN_TEXT = rf"{URL_HEAD}[^{WS})]+"
# A link with the text before it: groups are that text, the label and the URL. A
# match starts only at the text's start, after a bracket closes or after the last
# match, so every bracket is looked at once, however many stay open.
MARKDOWN_LINK = rf"(?:\A|\G|(?<=\]))([^\[\]]*+)\[([^\]]++)\]\(({URL_HEAD}[^)]++)\)"


def urls_in_text(text: Column) -> Column:
    """All drive URLs of a text, verbatim and in order."""
    return F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))


def markdown_link_urls(text: Column) -> Column:
    """URL of every Markdown link to a drive host, in order."""
    return F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(3))


def links_with_text(text: Column) -> Column:
    """Every Markdown link to a drive host, with the text from the match before it on."""
    return F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(0))


def text_after_links(text: Column) -> Column:
    """The text after the last Markdown link to a drive host; all of it if there is none."""
    return F.element_at(F.split(text, MARKDOWN_LINK, -1), -1)
