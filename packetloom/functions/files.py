"""What a file's bytes say of it: kind by signature, executable headers, unsafe archive entries. All are expressions over binary columns.

Bytes are read as ISO-8859-1, in which every byte is one character of its own number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let

#: Signatures at the start of a file (fixed values), in the order they are tried.
SIGNATURES = (
    ("MZ", "application/x-dosexec"),
    ("\x7fELF", "application/x-elf"),
    ("%PDF-", "application/pdf"),
)
ZIP_STARTS = ("PK\x03\x04", "PK\x05\x06", "PK\x07\x08")
ZIP_END, ZIP_END_SIZE = "PK\x05\x06", 22
TEXT, HEAD = "^[\\t\\n\\r\\x20-\\x7e]+\\z", 4096
OTHER = "application/octet-stream"


def characters(data: Column) -> Column:
    """Bytes as a string of as many characters."""
    return F.decode(data, "ISO-8859-1")


def little_endian(s: Column, at: Column | int, size: int) -> Column:
    """The unsigned number of ``size`` bytes from offset ``at`` of ``characters``; null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    byte = [F.ascii(F.substring(s, at + 1 + i, F.lit(1))).cast("long") * (1 << 8 * i) for i in range(size)]
    return F.when(F.length(s) >= at + size, sum(byte[1:], byte[0]))


def _is_zip(s: Column) -> Column:
    """A start of an archive, or the end record of one somewhere: what is put before an archive does not hide it."""
    from_end = F.instr(F.reverse(s), ZIP_END[::-1])  # the last one
    return F.coalesce(F.substring(s, 1, 4).isin(*ZIP_STARTS), F.lit(False)) | ((from_end > 0) & (from_end + len(ZIP_END) - 1 >= ZIP_END_SIZE))


def is_zip(data: Column) -> Column:
    return let(characters(data), _is_zip)


def kind(data: Column) -> Column:
    """The media type that the bytes show, whatever was announced; null for null. Empty and unknown data are opaque."""

    def look(s: Column) -> Column:
        out = F.when(s.isNull(), F.lit(None).cast("string"))
        for start, name in SIGNATURES:
            out = out.when(s.startswith(start), name)
        return out.when(_is_zip(s), "application/zip").when(F.substring(s, 1, HEAD).rlike(TEXT), "text/plain").otherwise(OTHER)

    return let(characters(data), look)


def executable(data: Column) -> Column:
    """Struct (machine, sections, compiled, is_dll) of a Windows executable's header; null for anything else, cut off headers too."""

    def read(s: Column) -> Column:
        def header(at: Column) -> Column:
            fields = F.struct(
                little_endian(s, at + 4, 2).alias("machine"), little_endian(s, at + 6, 2).alias("sections"), little_endian(s, at + 8, 4).alias("compiled"),
                (little_endian(s, at + 22, 2).bitwiseAND(0x2000) > 0).alias("is_dll"),
            )
            return F.when(s.startswith("MZ") & (F.substring(s, at + 1, F.lit(4)) == "PE\0\0") & (F.length(s) >= at + 24), fields)

        return let(little_endian(s, 60, 4).cast("int"), header)

    return let(characters(data), read)


def escapes(name: Column) -> Column:
    """Whether an archive entry leaves the folder it is unpacked in: no name, absolute, with a backslash, or above the folder at any step."""
    steps = F.filter(F.split(name, "/"), lambda x: ~x.isin("", "."))
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda a, x: let(a["depth"] + F.when(x == "..", -1).otherwise(1), lambda d: F.struct(d.alias("depth"), F.least(a["low"], d).alias("low"))),
    )
    return F.coalesce((name == "") | name.startswith("/") | name.contains("\\") | (walk["low"] < 0), F.lit(True))


def archive_fault(entries: Column, most_bytes: int, depth: Column | int = 1, most_depth: int = 3) -> Column:
    """Why an archive is not to be unpacked: too deep, an entry outside, an entry too large; null if it may be. entries: array of (name, size)."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return (
        F.when(depth > most_depth, "archive exceeds depth").when(F.exists(entries, lambda e: escapes(e["name"])), "entry escapes root")
        .when(F.exists(entries, lambda e: ~F.endswith(e["name"], F.lit("/")) & (e["size"] > most_bytes)), "entry exceeds size")
    )
