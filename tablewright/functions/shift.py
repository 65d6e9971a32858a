"""Contact values that slipped into the wrong column, as closed expressions.

Kinds are bits, so that "which kinds were found" and "does one occur twice" are
integer arithmetic: generated code stays small enough for the JIT compiler.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import is_blank, is_written_name, looks_like_email, looks_like_phone

BITS = {"name": 1, "phone": 2, "email": 4}
UNKNOWN = 8
KNOWN = 7
KINDS = tuple(BITS)


def kind_bit(c: Column) -> Column:
    """0 for blank, one bit of ``BITS`` for a recognised kind, ``UNKNOWN`` otherwise."""
    return (
        F.when(is_blank(c), F.lit(0))
        .when(looks_like_phone(c), F.lit(BITS["phone"]))
        .when(looks_like_email(c), F.lit(BITS["email"]))
        .when(is_written_name(c), F.lit(BITS["name"]))
        .otherwise(F.lit(UNKNOWN))
    )


def _any_bits(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def found_kinds(kinds: dict[str, Column]) -> Column:
    return _any_bits(list(kinds.values())).bitwiseAND(KNOWN)


def kinds_met_twice(kinds: dict[str, Column]) -> Column:
    bits = list(kinds.values())
    pairs = [a.bitwiseAND(b) for i, a in enumerate(bits) for b in bits[i + 1 :]]
    return _any_bits(pairs or [F.lit(0)]).bitwiseAND(KNOWN)


def misplaced_kinds(kinds: dict[str, Column]) -> Column:
    return _any_bits([k.bitwiseAND(KNOWN & ~BITS[slot]) for slot, k in kinds.items()])


def blocked_slots(kinds: dict[str, Column], found: Column, strict: bool) -> Column:
    """Slots whose unrecognised text stands where a found value belongs.

    With ``strict``, also kinds whose own slot the table does not have.
    """
    held = [F.when((k == UNKNOWN), found.bitwiseAND(BITS[slot])).otherwise(0) for slot, k in kinds.items()]
    if strict:
        homeless = sum(bit for slot, bit in BITS.items() if slot not in kinds)
        held.append(found.bitwiseAND(homeless))
    return _any_bits(held)


def moved_value(slot: str, values: dict[str, Column], kinds: dict[str, Column], found: Column) -> Column:
    """Value a slot gets when a row is repaired: its own kind wherever it stands, else nothing foreign."""
    own = BITS[slot]
    held = F.coalesce(*[F.when(kinds[s] == own, v) for s, v in values.items()])
    foreign = kinds[slot].bitwiseAND(KNOWN) > 0
    return F.when(found.bitwiseAND(own) > 0, held).when(foreign, F.lit("")).otherwise(values[slot])
