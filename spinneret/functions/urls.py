"""URL parts, website normalisation and the reasons to refuse a website."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spinneret.functions.text import percent_encoded, trim_space

# scheme, authority, path, query with "?", fragment with "#"
_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_PARTS = ("scheme", "authority", "path", "query", "fragment")

_HOST_CHARS = r"[A-Za-z0-9!$&'()*+,;=:<>\"\-_.~\[\]]"
_HOST = rf"^(?:{_HOST_CHARS}|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f])*\z"
_IP_LITERAL = r"^\[[0-9A-Fa-f:.]*(?:%25[^\]]+)?\](?::[0-9]*)?\z"
_USER_INFO = r"^[A-Za-z0-9\-._:~!$&'()*+,;=%@]*\z"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"

# Why a website is refused.
EMPTY = "empty URL"
UNPARSABLE = "unparsable URL"
NO_HOST = "missing scheme or host"
WRONG_SCHEME = "only http and https are supported"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often it is used."""
    return F.transform(F.array(value), body)[0]


def url_parts(url: Column) -> Column:
    """Struct of scheme, authority, path, query, fragment; ``''`` where absent."""
    return F.struct(*[F.regexp_extract(url, _URL, i).alias(part) for i, part in enumerate(_PARTS, start=1)])


def _host(authority: Column) -> Column:
    """The authority without user info."""
    return F.regexp_extract(authority, r"(?s)([^@]*)\z", 1)


def on_host(url: Column, path: str) -> Column:
    """The address of ``path`` on the host of ``url``."""
    return _bound(
        url_parts(url), lambda p: F.concat(F.lower(p["scheme"]), F.lit("://"), _host(p["authority"]), F.lit(path))
    )


def _with_scheme(text: Column) -> Column:
    return F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))


def _unparsable(url: Column, parts: Column, name: Column) -> Column:
    before_fragment = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    user_info = F.regexp_extract(parts["authority"], r"(?s)^(.*)@", 1)
    bad_scheme = url.rlike(r"^[^/?#]*:") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    bad_host = F.when(name.startswith("["), ~name.rlike(_IP_LITERAL)).otherwise(
        # the port is what follows the last colon
        ~name.rlike(_HOST) | name.rlike(r":[^:]*[^0-9:][^:]*\z")
    )
    return (
        before_fragment.rlike(r"[\x00-\x1F\x7F]")
        | bad_scheme
        | bad_host
        | ~user_info.rlike(_USER_INFO)
        | F.concat(user_info, parts["path"], parts["fragment"]).rlike(_BAD_ESCAPE)
    )


def _normalised(parts: Column) -> Column:
    fragment = percent_encoded(
        F.regexp_extract(parts["fragment"], r"(?s)^#(.+)", 1), r"A-Za-z0-9\-_.~$&+,/:;=?@!'()*%\[\]"
    )
    return F.concat(
        F.lower(parts["scheme"]),
        F.lit("://"),
        percent_encoded(parts["authority"], r"\x00-\x7F"),
        F.when(parts["query"] == "?", "?").otherwise(""),
        F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)),
    )


def checked_website(raw: Column) -> Column:
    """Struct ``website, reject_reason`` of a website as typed; one of them is null.

    The text is trimmed and gets ``https://`` where it has no ``://``. The website
    keeps scheme, authority and fragment; path and query are dropped. The case of
    the host stays, and so does a bare trailing ``?``.
    """

    def judged(text: Column, url: Column, parts: Column, name: Column) -> Column:
        reason = (
            F.when(text == "", EMPTY)
            .when(_unparsable(url, parts, name), UNPARSABLE)
            .when((parts["scheme"] == "") | (name == ""), NO_HOST)
            .when(~F.lower(parts["scheme"]).isin("http", "https"), WRONG_SCHEME)
        )
        return _bound(
            reason,
            lambda why: F.struct(
                F.when(why.isNull(), _normalised(parts)).alias("website"), why.alias("reject_reason")
            ),
        )

    return _bound(
        F.coalesce(trim_space(raw), F.lit("")),
        lambda text: _bound(
            _with_scheme(text),
            lambda url: _bound(
                url_parts(url),
                lambda parts: _bound(_host(parts["authority"]), lambda name: judged(text, url, parts, name)),
            ),
        ),
    )
