"""Event kinds: a 4-bit category over a 12-bit type id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
TOMBSTONE = 0x0FFE
SYSTEM_DENIAL = 0x000F
SYSTEM_CATEGORY = 0x0
EFFECT_CATEGORY = 0xD
HEADER_FLAGS = {"requires_ack": 0x01, "transactional": 0x02, "replay": 0x08}


def pack(category: int, type_id: int) -> int:
    """A custom kind; categories 0x0 and 0xD are reserved."""
    if not 0 < category < 16 or category == EFFECT_CATEGORY:
        raise ValueError(f"category {category:#x} is reserved or out of range")
    if not 0 <= type_id < 0x1000:
        raise ValueError(f"type id {type_id:#x} does not fit 12 bits")
    return category << 12 | type_id


def category(kind: Column) -> Column:
    return F.shiftright(kind, 12)


def type_id(kind: Column) -> Column:
    return kind.bitwiseAND(0x0FFF)


def is_system(kind: Column) -> Column:
    return category(kind) == SYSTEM_CATEGORY


def is_effect(kind: Column) -> Column:
    return category(kind) == EFFECT_CATEGORY


def is_reserved(kind: Column) -> Column:
    return is_system(kind) | is_effect(kind)


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(HEADER_FLAGS[name]) != 0
