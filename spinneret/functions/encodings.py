"""Encodings of captured XML bodies: what they declare, and their text.

A body is a string, or the bytes as they came. Those in UTF-8 are read inside the JVM; a
body in another encoding is refused, or its bytes go to a Pandas UDF if asked for.
"""

from __future__ import annotations

import codecs
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Executors get the functions below with the task; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The encoding and the version that need no further reader.
_OWN, _VERSION = "utf-8", "1.0"

_DECLARATION = r"(?s)\A[^<]*+<\?xml\s(.*?)\?>"
_VALUE = r"""{}=(?:"([^"]*)"|'([^']*)')"""
# How a body in UTF-16 begins, as hexadecimal digits: with a mark, or with "<?".
_WIDE = r"\A(?:FEFF|FFFE|003C003F|3C003F00)"
# Encodings that are text and nothing else, by Python's names.
_TEXT = re.compile(
    r"ascii|utf-(?:16|32)(?:-[bl]e)?|iso8859-\d+|cp125\d|cp932|cp949|koi8-[rut]|shift_jis|euc_(?:jp|kr)|iso2022_jp|"
    r"gb2312|gbk|gb18030|big5"
)


def _stated(body: Column, name: str) -> Column:
    """A value of the XML declaration; ``''`` without one."""
    declaration = F.regexp_extract(body.cast("string"), _DECLARATION, 1)
    pattern = _VALUE.format(name)
    return F.concat(F.regexp_extract(declaration, pattern, 1), F.regexp_extract(declaration, pattern, 2))


def foreign_encoding(body: Column, raw: bool) -> Column:
    """The encoding that a body is in, null for UTF-8; ``raw`` bodies are bytes."""
    stated = _stated(body, "encoding")
    other = F.when((stated != "") & (F.lower(stated) != _OWN), stated)
    if not raw:
        return other
    return F.when(F.hex(F.substring(body, 1, 4)).rlike(_WIDE), "UTF-16").otherwise(other)


def foreign_version(body: Column) -> Column:
    """The XML version that a body declares, null for the one that is read."""
    stated = _stated(body, "version")
    return F.when((stated != "") & (stated != _VERSION), stated)


def valid_text(body: Column) -> Column:
    return F.is_valid_utf8(body.cast("string"))


def decode(body: bytes, encoding: str) -> str | None:
    """The text of a body; null if it is not in its encoding, or that is not known."""
    try:
        codec = codecs.lookup(encoding).name
        if not _TEXT.fullmatch(codec):
            return None
        # Without a mark, UTF-16 is told by the first "<".
        if codec == "utf-16" and body[:2] == b"\0<":
            codec = "utf-16-be"
        return bytes(body).decode(codec)
    except (LookupError, UnicodeError, ValueError):
        return None


@F.pandas_udf(StringType())
def _decoded(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
    found = [None if b is None or e is None else decode(b, e) for b, e in zip(bodies, encodings, strict=True)]
    return pd.Series(found, dtype=object)


def decoded(body: Column, encoding: Column) -> Column:
    """Text of bytes: only those with an ``encoding``, not null, leave the JVM."""
    text = _decoded(F.when(encoding.isNotNull(), body), encoding)
    return F.when(encoding.isNull(), body.cast("string")).otherwise(text)
