"""String helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_space(text: Column) -> Column:
    """Remove Unicode white space from both ends; ``trim`` only knows U+0020."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def percent_encoded(text: Column, keep: str) -> Column:
    """Percent-encode every character outside the class body ``keep``.

    The character walk only runs for texts that need it.
    """
    outside = f"[^{keep}]"
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    walked = F.array_join(
        F.transform(
            chars,
            # url_encode writes a space as "+", unlike an address.
            lambda c: F.when(c == " ", "%20").when(c.rlike(outside), F.url_encode(c)).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(outside), walked).otherwise(text)
