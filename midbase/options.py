"""Options of the caller, with the checks that the command line makes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CallOptions:
    """k: odd k-mer length from 3 to 31. min_freq: least share of genomes with either allele.

    filt_type: 2 keeps SNP-mers that occur at most once in every genome, 1 those with one allele in every
    genome, 0 all. positions: collect hit positions of all genomes. saturate: cap allele counts at 8191, as
    fixed-width counters would. single_genome: with one genome, emit every k-mer instead of an error.
    kpos_by_name: leave out the first hit of every genome on a contig that is called like an anchor's, as tools that tell the
    reference by contig names do, instead of the reference's anchor alone.
    tile: longest piece of a contig that one row carries through k-mer extraction.
    """

    k: int = 31
    min_freq: float = 0.95
    filt_type: int = 2
    positions: bool = False
    saturate: bool = False
    single_genome: bool = False
    kpos_by_name: bool = False
    tile: int = 1 << 20

    def __post_init__(self) -> None:
        if self.k % 2 == 0 or not 3 <= self.k <= 31:
            raise ValueError("k must be odd, from 3 to 31")
        if self.filt_type not in (0, 1, 2):
            raise ValueError("filt_type must be 0, 1 or 2")
        if self.tile < self.k:
            raise ValueError("tile must be at least k")


def check_genomes(paths: list[str], ref: str | None, single_genome: bool = False) -> int:
    """The reference's index among the inputs; the first is the default."""
    if len(set(paths)) != len(paths):
        raise ValueError("an input is given twice")
    if not paths or len(paths) == 1 and not single_genome:
        raise ValueError("give two genomes or more")
    if ref is not None and ref not in paths:
        raise ValueError("the reference must be one of the inputs")
    return paths.index(ref) if ref else 0
