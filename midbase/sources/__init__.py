"""Readers and writers: FASTA/FASTQ, BED, VCF, metadata tables, alignments."""
