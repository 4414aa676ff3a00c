"""Image sizes from header bytes, as column expressions over binary contents.

PNG, BMP and TIFF have their fields at known offsets or in a directory; a JPEG is
walked from segment to segment.  No pixel is decoded.  A header that is cut,
broken or of no known kind gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# JPEG segments looked at before the one with the size.
MAX_SEGMENTS = 4096

# Offsets beyond this one lie outside of any value.
_LAST = (1 << 31) - 16

_PNG = "89504E470D0A1A0A"
_GREY = {pad: "".join(f"{i:02X}" * 3 + "00" * (pad - 3) for i in range(256)) for pad in (3, 4)}


def _at(content: Column, start: Column | int, size: Column | int) -> Column:
    """``size`` bytes from a 0-based offset, fewer at the end."""
    as_int = lambda v: F.lit(v) if isinstance(v, int) else F.least(v, F.lit(_LAST)).cast("int")
    return F.substring(content, as_int(start) + 1, as_int(size))


def big_endian(content: Column, start: Column | int, size: int) -> Column:
    """An unsigned number, highest byte first; NULL past the end."""
    part = _at(content, start, size)
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def little_endian(content: Column, start: Column | int, size: int) -> Column:
    """An unsigned number, lowest byte first; NULL past the end."""
    total = F.lit(0).cast("long")
    for i in range(size):
        total = total + big_endian(content, start + i, 1) * (1 << 8 * i)
    return total


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _size(width: Column, height: Column, channels: Column) -> Column:
    """struct(width, height, channels) of ints; NULL if one is NULL or too large for an int."""
    parts = {n: v.try_cast("int") for n, v in (("width", width), ("height", height), ("channels", channels))}
    known = reduce(Column.__and__, [v.isNotNull() for v in parts.values()])
    return F.when(known, F.struct(*[v.alias(n) for n, v in parts.items()]))


def png_size(content: Column) -> Column:
    """From the header chunk, whose checksum must be right."""
    depth, kind = big_endian(content, 24, 1), big_endian(content, 25, 1)
    whole = F.crc32(_at(content, 12, 17)) == big_endian(content, 29, 4)
    named = F.hex(_at(content, 12, 4)) == F.hex(F.lit("IHDR"))
    # Grey of one bit and of 16 bits count as other kinds, as do palettes and grey with alpha.
    channels = F.when((kind == 0) & depth.isin(2, 4, 8), 1).when(kind == 6, 4).otherwise(3)
    return F.when(whole & named, _size(big_endian(content, 16, 4), big_endian(content, 20, 4), channels))


def bmp_size(content: Column) -> Column:
    """From the old header of 12 bytes or the newer ones of 40 and more."""

    def read(header: Column) -> Column:
        old = header == 12
        bits = F.when(old, little_endian(content, 24, 2)).otherwise(little_endian(content, 28, 2))
        height = little_endian(content, 22, 4)
        # Negative heights stand for rows from the top.
        height = F.when(height >= 1 << 31, (1 << 32) - height).otherwise(height)
        stated = F.when(old, F.lit(0)).otherwise(little_endian(content, 46, 4))
        colours = F.when(stated > 0, stated).otherwise(F.call_function("shiftleft", F.lit(1), bits.cast("int")))
        pad = F.when(old, 3).otherwise(4)
        palette = F.hex(_at(content, header + 14, colours * pad))
        grey = F.when(old, F.lit(_GREY[3])).otherwise(F.lit(_GREY[4]))
        is_grey = (colours != 2) & (palette == F.substring(grey, F.lit(1), F.least(colours * pad * 2, F.lit(_LAST)).cast("int")))
        alpha = (bits == 32) & (header >= 56) & (little_endian(content, 30, 4) == 3) & (little_endian(content, 66, 4) > 0)
        channels = F.when((bits <= 8) & is_grey, 1).when(alpha, 4).otherwise(3)
        return F.when(
            old, _size(little_endian(content, 18, 2), little_endian(content, 20, 2), channels)
        ).when(header >= 40, _size(little_endian(content, 18, 4), height, channels))

    return bound(little_endian(content, 14, 4), read)


def tiff_size(content: Column) -> Column:
    """From the first directory's entries, in either byte order."""
    low_first = F.hex(_at(content, 0, 2)) == "4949"

    def number(start: Column | int, size: int) -> Column:
        return F.when(low_first, little_endian(content, start, size)).otherwise(big_endian(content, start, size))

    def entry(start: Column) -> Column:
        short = number(start + 2, 2) == 3
        value = F.when(short, number(start + 8, 2)).otherwise(number(start + 8, 4))
        return F.struct(number(start, 2).alias("tag"), value.alias("value"))

    def read(entries: Column) -> Column:
        def field(tag: int, default: int | None = None) -> Column:
            found = F.get(F.filter(entries, lambda e: e["tag"] == tag), F.lit(0))["value"]
            return found if default is None else F.coalesce(found, F.lit(default))

        # Tags of width, height, bits, photometric kind, samples, extra samples.
        bits, kind, samples = field(258, 1), field(262, 0), field(277, 1)
        grey = kind.isin(0, 1) & (samples == 1) & (bits == 8)
        alpha = (kind == 2) & (samples == 4) & (field(338, 2) != 0)
        return _size(field(256), field(257), F.when(grey, 1).when(alpha, 4).otherwise(3))

    def directory(start: Column) -> Column:
        count = number(start, 2)
        # No more entries than the file has room for.
        room = F.floor((F.octet_length(content) - start - 2) / 12)
        held = F.when((count > 0) & (room >= count), F.sequence(F.lit(0).cast("long"), count - 1))
        return bound(F.transform(held, lambda i: entry(start + 2 + i * 12)), read)

    return bound(number(4, 4), directory)


def jpeg_size(content: Column) -> Column:
    """From the frame segment; segments before it are skipped by their lengths."""
    nothing = F.lit(None).cast("long")

    def state(at: Column, frame: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), frame.cast("long").alias("frame"))

    def step(here: Column, _: Column) -> Column:
        at = here["at"]
        marker = big_endian(content, at + 1, 1)
        is_frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        bare = marker.between(0xD0, 0xD7) | (marker == 0x01)
        moved = (
            F.when(marker == 0xFF, state(at + 1, nothing))  # a fill byte
            .when(is_frame, state(nothing, at))
            .when(bare, state(at + 2, nothing))
            .when(marker.isin(0xD8, 0xD9, 0xDA), state(nothing, nothing))
            .otherwise(state(at + 2 + big_endian(content, at + 2, 2), nothing))
        )
        valid = big_endian(content, at, 1) == 0xFF
        return F.when(at.isNull(), here).when(valid, moved).otherwise(state(nothing, nothing))

    def read(frame: Column) -> Column:
        parts = big_endian(content, frame + 9, 1)
        channels = F.when(parts == 1, 1).when(parts.isNotNull(), 3)
        return _size(big_endian(content, frame + 7, 2), big_endian(content, frame + 5, 2), channels)

    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_SEGMENTS), F.octet_length(content)))
    found = F.reduce(steps, state(F.lit(2), nothing), step, lambda s: s["frame"])
    return bound(found, read)


def image_size(content: Column) -> Column:
    """struct(width, height, channels) of an image file's bytes, NULL if they are none."""
    kind = F.hex(_at(content, 0, 8))
    return (
        F.when(kind == _PNG, png_size(content))
        .when(kind.startswith("FFD8FF"), jpeg_size(content))
        .when(kind.startswith("424D"), bmp_size(content))
        .when(kind.startswith("49492A00") | kind.startswith("4D4D002A"), tiff_size(content))
    )
