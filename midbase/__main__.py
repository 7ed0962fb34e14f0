"""python -m midbase count [options] genome.fa ...: the caller on the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.count import count


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="midbase")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("count", help="call SNP-mers of two genomes or more")
    p.add_argument("genomes", nargs="+", help="FASTA or FASTQ files, plain or compressed")
    p.add_argument("-k", "--kmer", type=int, default=31, help="odd k-mer length, at most 31")
    p.add_argument("-m", "--min_freq", type=float, default=0.95, help="least share of genomes with either allele")
    p.add_argument("-f", "--filt_type", type=int, default=2, choices=(0, 1, 2), help="2 unique, 1 one allele a genome, 0 all")
    p.add_argument("-w", "--write_info", action="store_true", help="write all hits' positions")
    p.add_argument("-b", "--bed", help="file with one BED path per genome")
    p.add_argument("-r", "--ref", help="reference, one of the inputs (the first by default)")
    p.add_argument("-o", "--output", default="-", help="folder for the VCF, - for standard output (the default)")
    p.add_argument("-p", "--pre", type=int, default=10, help="shuffle partitions, as a power of two")
    p.add_argument("-K", "--chunk_size", default="128m", help="most bytes of input a task reads")
    p.add_argument("-t", "--threads", type=int, help="local threads, where no cluster is configured")
    p.add_argument("-v", "--verbose", action="store_true")
    return out


def main(args: list[str] | None = None) -> None:
    own = parser().parse_args(args)
    builder = SparkSession.builder.appName("midbase").config("spark.sql.shuffle.partitions", 1 << own.pre).config("spark.sql.files.maxPartitionBytes", own.chunk_size)
    spark = (builder.master(f"local[{own.threads}]") if own.threads else builder).getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if own.verbose else "WARN")
    count(spark, own.genomes, own.ref, own.bed, own.output, k=own.kmer, min_freq=own.min_freq, filt_type=own.filt_type, positions=own.write_info)


if __name__ == "__main__":
    main()
