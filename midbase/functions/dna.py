"""Column functions on DNA strings and packed bases.

Packed values hold two bits a base (A0 C1 G2 T3), the first base highest, so number order is string order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def normalise(seq: Column) -> Column:
    """Upper case, with U read as T."""
    return F.translate(F.upper(seq), "U", "T")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base(code: Column) -> Column:
    return F.substr(F.lit("ACGT"), code.cast("int") + 1, F.lit(1))


def unpack(packed: Column, bases: int) -> Column:
    """The string of a packed value of so many bases."""
    return F.concat(*(base(F.shiftright(packed, 2 * i).bitwiseAND(F.lit(3))) for i in range(bases - 1, -1, -1)))


def is_palindromic(left: Column, right: Column) -> Column:
    """Whether flanks read the same on both strands: such k-mers have no strand of their own."""
    return left == reverse_complement(right)


def sample_name(path: Column) -> Column:
    """File name without folder, one compression suffix and the last extension."""
    name = F.regexp_replace(path, r"^.*/", "")
    name = F.regexp_replace(name, r"(?<=.)\.(gz|bz2|xz|zst)$", "")
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _short(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.4g}")


def short_float(number: Column) -> Column:
    """A number as C's %.4g writes it (Java's format rounds and pads otherwise); used at the VCF sink only."""
    return F.pandas_udf(_short, StringType())(number)


#: ASCII letters as ACGT by their place in the alphabet, all other bytes as N, and these others.
_OF_TEXT = bytes(b"ACGT"[((c | 32) - 97) % 4] if chr(c) in LETTERS + LETTERS.upper() else 78 for c in range(256))
_NO_LETTERS = bytes(c for c in range(256) if chr(c) not in LETTERS + LETTERS.upper())


def from_text(text: Column, keep_gaps: bool = False) -> Column:
    """A DNA-like sequence from prose: letters become ACGT by their place in the alphabet; all else goes, or
    becomes N with keep_gaps. Done on bytes, which costs a fraction of a regular expression."""
    table, without = _OF_TEXT, b"" if keep_gaps else _NO_LETTERS

    def made(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else t.lower().encode("ascii", "replace").translate(table, without).decode())

    return F.pandas_udf(made, StringType())(text)
