"""Named flags of change-journal reason masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason bits.
REASON_BITS = {
    "data_overwrite": 0x0000_0001,
    "data_extend": 0x0000_0002,
    "data_truncation": 0x0000_0004,
    "named_data_overwrite": 0x0000_0010,
    "named_data_extend": 0x0000_0020,
    "named_data_truncation": 0x0000_0040,
    "file_create": 0x0000_0100,
    "file_delete": 0x0000_0200,
    "rename_old_name": 0x0000_1000,
    "rename_new_name": 0x0000_2000,
    "basic_info_change": 0x0000_8000,
    "hard_link_change": 0x0001_0000,
    "close": 0x8000_0000,
}
_NO_UPSERT = ("file_delete", "rename_old_name", "hard_link_change", "close")
UPSERT_MASK = sum(bit for name, bit in REASON_BITS.items() if name not in _NO_UPSERT)
DELETE_MASK = REASON_BITS["file_delete"] | REASON_BITS["rename_old_name"]


def has_any(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("long")) != 0


def reason_flags(mask: Column) -> list[Column]:
    """One boolean column per named bit."""
    return [has_any(mask, bit).alias(name) for name, bit in REASON_BITS.items()]
