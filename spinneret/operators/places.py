"""Places in a depth-first walk, as columns that a minimum can be taken of.

A place is the list of positions on the way to it. ``Packed`` writes the positions as
digits of one whole number, so that the smallest place of a key is a hash aggregate
over a fixed-width value; ``Listed`` keeps arrays, for walks whose positions or depths
do not fit. Both sort as the lists do, shorter ones before those that go on from them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions of up to this many digits, and so many of them, fill 35 of 38 digits.
_DIGITS, LEVELS = 5, 7
_TYPE = "decimal(38,0)"


class Packed:
    @staticmethod
    def fits(position: int, levels: int) -> bool:
        """Whether positions up to ``position`` on ``levels`` levels can be packed."""
        # A digit group of zeros means that there is no further position.
        return position + 1 < 10**_DIGITS and levels <= LEVELS

    @staticmethod
    def start(position: Column) -> Column:
        return Packed.below(F.lit(Decimal(0)).cast(_TYPE), F.lit(0), position)

    @staticmethod
    def below(place: Column, level: Column, position: Column) -> Column:
        """The place at ``position`` under a place of ``level`` positions."""
        units = F.array(*[F.lit(Decimal(10 ** (_DIGITS * (LEVELS - 1 - i)))).cast("decimal(31,0)") for i in range(LEVELS)])
        return (place + (position + 1).cast("decimal(6,0)") * units[level]).cast(_TYPE)

    @staticmethod
    def path(place: Column) -> Column:
        digits = F.lpad(place.cast("string"), _DIGITS * LEVELS, "0")
        groups = F.transform(
            F.sequence(F.lit(0), F.lit(LEVELS - 1)),
            lambda i: F.substr(digits, i * _DIGITS + 1, F.lit(_DIGITS)).cast("int") - 1,
        )
        return F.filter(groups, lambda x: x >= 0)


class Listed:
    @staticmethod
    def start(position: Column) -> Column:
        return F.array(position)

    @staticmethod
    def below(place: Column, level: Column, position: Column) -> Column:
        return F.concat(place, F.array(position))

    @staticmethod
    def path(place: Column) -> Column:
        return place


def places(position: int, levels: int) -> type[Packed] | type[Listed]:
    """How to write places with positions up to ``position`` on up to ``levels`` levels."""
    return Packed if Packed.fits(position, levels) else Listed
