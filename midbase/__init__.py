"""SNP-mer analytics on Spark: k-mers whose flanks are conserved while the centre base takes exactly two values."""

from .options import CallOptions

__all__ = ["CallOptions"]
