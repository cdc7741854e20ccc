"""The 128-bit record of one observation, as two longs: entropy 16, surprise 16, bias 1, position 12, timestamp 16, depth
8, anchor 31, reserved 28 bits, the least significant first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, first bit, width.
FIELDS = (("entropy", 0, 16), ("surprise", 16, 16), ("bias", 32, 1), ("position", 33, 12), ("timestamp", 45, 16), ("depth", 61, 8), ("anchor", 69, 31), ("reserved", 100, 28))


def packed(values: dict[str, Column]) -> tuple[Column, Column]:
    """The low and the high half."""
    low = high = F.lit(0).cast("long")
    for name, at, width in FIELDS:
        v = values[name].cast("long").bitwiseAND((1 << width) - 1)
        if at < 64:
            low = low.bitwiseOR(F.shiftleft(v, at))
            if at + width > 64:
                high = high.bitwiseOR(F.shiftright(v, 64 - at))
        else:
            high = high.bitwiseOR(F.shiftleft(v, at - 64))
    return low, high


def unpacked(low: Column, high: Column) -> dict[str, Column]:
    out = {}
    for name, at, width in FIELDS:
        if at >= 64:
            v = F.shiftrightunsigned(high, at - 64)
        elif at + width > 64:
            v = F.shiftrightunsigned(low, at).bitwiseOR(F.shiftleft(high, 64 - at))
        else:
            v = F.shiftrightunsigned(low, at)
        out[name] = v.bitwiseAND((1 << width) - 1)
    return out


def reserved(flags: Column, oov: Column) -> Column:
    """Detection flags in bits 0 to 5, the byte of the OOV share in bits 6 to 13."""
    return flags.cast("long").bitwiseAND(0x3F).bitwiseOR(F.shiftleft(oov.cast("long").bitwiseAND(0xFF), 6))


def combined_risk_bits(reserved_bits: Column) -> Column:
    return reserved_bits.bitwiseAND(0x3FFF)


def detection_flags(reserved_bits: Column) -> Column:
    return reserved_bits.bitwiseAND(0x3F)


def oov_byte(reserved_bits: Column) -> Column:
    return F.shiftright(reserved_bits, 6).bitwiseAND(0xFF)


def with_detection_flags(reserved_bits: Column, flags: Column) -> Column:
    """The other bits stay."""
    return reserved_bits.bitwiseAND(0xFFFFFC0).bitwiseOR(flags.cast("long").bitwiseAND(0x3F))


def with_oov(reserved_bits: Column, byte: Column) -> Column:
    return reserved_bits.bitwiseAND(0xFFFC03F).bitwiseOR(F.shiftleft(byte.cast("long").bitwiseAND(0xFF), 6))


def without_detection(reserved_bits: Column) -> Column:
    """Flags and OOV byte cleared, the upper bits kept."""
    return reserved_bits.bitwiseAND(0xFFFC000)


def _hex(half: Column) -> Column:
    """The 8 bytes of a half, the least significant first."""
    digits = F.lpad(F.hex(half), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))


def as_bytes(low: Column, high: Column) -> Column:
    """The record as 16 bytes, the least significant first."""
    return F.unhex(F.concat(_hex(low), _hex(high)))


def from_bytes(data: Column) -> tuple[Column, Column]:
    """The halves of 16 bytes; of 8 bytes the high half is 0."""
    def half(at: int) -> Column:
        digits = F.hex(data)
        # conv() reads up to 64 bits; the signed value is that of the same bits.
        big_endian = F.concat(*(F.substring(digits, 2 * (at + 7 - i) + 1, 2) for i in range(8)))
        return F.conv(big_endian, 16, -10).cast("long")

    return half(0), F.when(F.octet_length(data) >= 16, half(8)).otherwise(F.lit(0).cast("long"))
