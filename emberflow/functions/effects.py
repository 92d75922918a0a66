"""The effect vocabulary as a bitmask, and predicates over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Effect names, in order; Unknown marks what could not be resolved.
EFFECTS = ("Clipboard", "Clock", "Db", "Env", "Exec", "Fs", "Ipc", "Llm", "Log", "Net", "Rand", "Unknown")
BOUNDARY = ("Db", "Net", "Llm", "Exec", "Fs", "Ipc", "Clipboard")
CROSS_CUTTING = ("Log", "Clock", "Rand", "Env")
AMBIENT = tuple(e for e in EFFECTS if e not in ("Log", "Unknown"))
SHARP, MEDIUM = ("Net", "Llm", "Exec", "Db", "Ipc"), ("Fs", "Env")

BIT = {e: 1 << i for i, e in enumerate(EFFECTS)}


def bit_of(effect: Column) -> Column:
    """The bit of an effect name; 0 for a name outside the vocabulary."""
    return F.coalesce(F.element_at(F.create_map(*[x for e, b in BIT.items() for x in (F.lit(e), F.lit(b))]), effect), F.lit(0))


def names_of(mask: Column) -> Column:
    """Sorted effect names of a mask."""
    return F.filter(F.array(*[F.when(mask.bitwiseAND(b) != 0, F.lit(e)) for e, b in BIT.items()]), lambda x: x.isNotNull())


def mask_of(effects) -> int:
    """The mask of some effect names."""
    return sum(BIT[e] for e in effects)


def salience(effect: Column) -> Column:
    return F.when(effect.isin(*SHARP), 5).when(effect.isin(*MEDIUM), 3).otherwise(0)


def hops_factor(hops: Column) -> Column:
    return F.when(hops == 1, 2).when(hops.between(2, 4), 3).when(hops.between(5, 6), 2).otherwise(1)
