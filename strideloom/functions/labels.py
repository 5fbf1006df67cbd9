"""Key and side names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of the annotation tool and what they stand for.
STRIKE_KEYS = {"h": "heel", "m": "midfoot", "f": "forefoot"}
OVERSTRIDE_KEYS = {"o": "overstriding", "n": "neutral", "s": "skip"}
SIDE_NAMES = {"left": "L", "right": "R"}


def _looked_up(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(names.items()))), key)


def strike_pattern(key: Column) -> Column:
    """Null for keys that discard the strike."""
    return _looked_up(key, STRIKE_KEYS)


def overstriding(key: Column) -> Column:
    return F.coalesce(_looked_up(key, OVERSTRIDE_KEYS), F.lit("skip"))


def side(name: Column) -> Column:
    """left and right to L and R; L and R stay."""
    return F.coalesce(_looked_up(name, SIDE_NAMES), name)
