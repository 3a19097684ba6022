"""The text of a page's first ``<title>``.

Most pages open with a plain head, and a regular expression inside the JVM
reads their title. Pages it cannot judge safely (odd markup before the title,
unclosed titles, unusual entities) go to a Pandas UDF; only their bodies cross
to Python.
"""

from __future__ import annotations

import html
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spinneret.functions.text import trim_space

# Executors get the functions below with the task; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ATTRIBUTES = r"""(?:\s(?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)?"""
# Text, doctype, simple comments, head tags, and scripts or styles without "<".
_PLAIN_HEAD = (
    r"[^<]*+(?:(?:"
    r"<!doctype[^<>]*>"
    r"|<!--(?!-?>)(?:[^-]|-(?!-))*+-->"
    rf"|</?(?:html|head|meta|link|base){_ATTRIBUTES}>"
    rf"|<script{_ATTRIBUTES}>(?:[^<]++|<(?!/script[\s/>]|!--))*+</script\s*>"
    rf"|<style{_ATTRIBUTES}>[^<]*+</style\s*>"
    r")[^<]*+)*+"
)
_PLAIN_TITLE = rf"(?is)^{_PLAIN_HEAD}<title{_ATTRIBUTES}>([^<]*+)</title\s*>"
_OTHER_ENTITY = r"&(?!(?:amp|lt|gt|quot|#39);)(?=[A-Za-z#])"
_ANY_TITLE = r"(?i)<title[\s/>]"

# Elements whose content is text, in which no tag is recognised.
_RAW_TEXT = frozenset("script style textarea noscript iframe noembed noframes xmp".split())
_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_TAG_START = re.compile(r"</?[A-Za-z]")
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
_OTHER_MARKUP = re.compile(r"<[!?/][^>]*>?")


def _raw_text_end(name: str, body: str, start: int) -> re.Match | None:
    return re.compile(rf"</{name}(?=[\s/>])", re.I).search(body, start)


def first_title(body: str) -> str:
    """Text of the first title element, entities decoded, ``''`` without one."""
    at = body.find("<")
    while at >= 0:
        comment = _COMMENT.match(body, at)
        tag = None if comment else _TAG.match(body, at)
        if comment:
            after = comment.end()
        elif tag is None:
            if _TAG_START.match(body, at):
                return ""  # The text ends inside this tag.
            other = _OTHER_MARKUP.match(body, at)
            after = other.end() if other else at + 1
        else:
            name, after = tag.group(1).lower(), tag.end()
            opens = body[at + 1] != "/"
            if opens and name == "title":
                end = _raw_text_end(name, body, after)
                return html.unescape(body[after : end.start() if end else len(body)])
            if opens and name == "plaintext":
                return ""
            if opens and name in _RAW_TEXT:
                end = _raw_text_end(name, body, after)
                if end is None:
                    return ""
                after = end.start()
        at = body.find("<", after)
    return ""


@F.pandas_udf(StringType())
def _parsed_title(bodies: pd.Series) -> pd.Series:
    return bodies.map(first_title, na_action="ignore")


def plain_title(body: Column) -> Column:
    """Raw title text of a page with a plain head; ``''`` if it must be parsed."""
    return F.regexp_extract(body, _PLAIN_TITLE, 1)


def html_title(body: Column, plain: Column) -> Column:
    """Trimmed title of an HTML body; ``''`` without one, null for a null body.

    ``plain`` is ``plain_title(body)``, best computed in a ``select`` of its own
    so that the body is searched once.
    """
    simple = (plain != "") & ~plain.rlike(_OTHER_ENTITY)
    decoded = plain
    # "&amp;" comes last so that "&amp;lt;" ends as "&lt;".
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    hard_body = F.when(~simple & body.rlike(_ANY_TITLE), body)
    title = (
        F.when(body.isNull(), None)
        .when(simple, decoded)
        .otherwise(F.coalesce(_parsed_title(hard_body), F.lit("")))
    )
    return trim_space(F.regexp_replace(title, r"\r\n?", "\n"))
