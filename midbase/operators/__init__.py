"""Relational operators over contigs, k-mer occurrences, SNP-mers, calls, regions and alignments."""
