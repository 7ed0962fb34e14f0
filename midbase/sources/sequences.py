"""FASTA and FASTQ as contigs."""

from __future__ import annotations

import functools
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS = "genome_idx int, contig_idx long, contig string, seq string"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of FASTA and FASTQ lines. Text before the first header and blank lines are skipped; a FASTQ
    record whose qualities are cut short ends the file."""
    name, seq = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line[:1] in (">", "@"):
            if name is not None:
                yield name, "".join(seq)
            name, seq = (re.split(r"\s", line[1:], maxsplit=1) or [""])[0], []
        elif line[:1] == "+" and name is not None:
            want, got = sum(map(len, seq)), 0
            while got < want:
                quality = next(lines, None)
                if quality is None:
                    warnings.warn(f"record {name} is cut short", stacklevel=2)
                    return
                got += len(quality.rstrip("\r\n"))
            if got != want:
                warnings.warn(f"record {name} has qualities of another length; reading ends there", stacklevel=2)
                return
            yield name, "".join(seq)
            name, seq = None, []
        elif name is not None:
            seq.append(line.strip())
    if name is not None:
        yield name, "".join(seq)


def first_mark(spark: SparkSession, path: str) -> str:
    """The first character of a plain or compressed file that is no white space; reads no further."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = at.getFileSystem(conf).open(at)
    try:
        stream = codec.createInputStream(stream) if codec else stream
        while (mark := stream.read()) >= 0:
            if not chr(mark).isspace():
                return chr(mark)
        return ""
    finally:
        stream.close()


def read_genomes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Contigs of all inputs; genome_idx is the place in `paths`, contig_idx follows the order in the file.

    Files whose first record starts with '@' are read as FASTQ, the others as FASTA; plain or compressed (by extension). All
    FASTA files are one scan, however many there are. A contig is one string of at most 2 GB.
    """
    if "-" in paths:
        raise ValueError("standard input can't be read twice; give a file")
    marks = [first_mark(spark, p) for p in paths]
    fasta = [i for i, m in enumerate(marks) if m != "@"]
    frames = [read_fasta(spark, [paths[i] for i in fasta], fasta)] if fasta else []
    frames += [read_fastq(spark, paths[i], i) for i, m in enumerate(marks) if m == "@"]
    return functools.reduce(DataFrame.union, frames)


def read_fasta(spark: SparkSession, paths: str | list[str], genome_idx: list[int] | None = None) -> DataFrame:
    """Contigs of FASTA files, one row each, by Spark's own record splitting at a newline before '>'.

    Plain files are read by as many tasks as they have splits; no row is longer than a contig, so files have no size
    limit. Text before the first header is left out.
    """
    paths = [paths] if isinstance(paths, str) else paths
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = [p.getFileSystem(conf).makeQualified(p).toUri().toString() for p in map(jvm.org.apache.hadoop.fs.Path, paths)]
    bare = lambda uri: uri.replace(":///", ":/", 1)  # noqa: E731  an empty host is written either way
    number = dict(zip(map(bare, whole), genome_idx or range(len(paths))))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            held: list[tuple[int, int, str, str]] = []
            for value, n, path, block in zip(*(batch.column(c) for c in ("value", "n", "path", "block"))):
                text, here = value.as_buffer().to_pybytes(), (path.as_py(), block.as_py())
                first, last = here != last and here[1] == 0, here
                if first and not text.startswith(b">"):
                    continue
                head, _, seq = text[first:].partition(b"\n")
                name = re.split(rb"\s", head, maxsplit=1)[0].decode()
                held.append((number[bare(here[0])], n.as_py(), name, seq.translate(None, b"\n\r\t ").decode()))
            yield _contigs(held)

    rows = spark.read.text(paths, lineSep="\n>").select(
        "value", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    return rows.mapInArrow(parse, CONTIGS)


class Place:
    """Where FASTQ reading stands, by lengths of lines alone: what `records` does, a line at a time. number: of the current record, or the next."""

    def __init__(self, named: bool = False, quality: bool = False, want: int = 0, got: int = 0, number: int = 0, over: bool = False):
        self.named, self.quality, self.want, self.got, self.number, self.over = named, quality, want, got, number, over

    def now(self) -> tuple:
        return self.named, self.quality, self.want, self.got, self.number, self.over

    def feed(self, mark: str, whole: int, bare: int) -> str:
        """mark: the line's first character; whole and bare: its length, and that without white space at its ends. What it is: a header (>),
        bases (A), the line before qualities (+) or none of these."""
        if self.over:
            return ""
        if self.quality:
            self.got += whole
            if self.got > self.want:
                self.over = True
            elif self.got == self.want:
                self.named, self.quality, self.number = False, False, self.number + 1
            return ""
        if mark in (">", "@"):
            self.number += self.named
            self.named, self.want = True, 0
            return ">"
        if mark == "+" and self.named:
            self.got, self.quality = 0, self.want > 0
            if not self.want:
                self.named, self.number = False, self.number + 1
            return "+"
        if self.named:
            self.want += bare
            return "A"
        return ""


def read_fastq(spark: SparkSession, path: str, genome_idx: int = 0) -> DataFrame:
    """Records of a FASTQ file (FASTA records among them included). Qualities may hold any mark, so only the order of lines tells records
    apart: of a plain file of several splits, one task first reads the lengths and first characters of all lines, by which it finds where
    each split stands; then splits are read apart, and only records that go over their borders are put together. Compressed files are one
    task, which holds one record at a time."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    if lines.rdd.getNumPartitions() > 1:
        return _split_fastq(lines, genome_idx)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line.as_py() + "\n" for batch in batches for line in batch.column("value"))
        held: list[tuple[int, int, str, str]] = []
        size = 0
        for n, (name, seq) in enumerate(records(lines)):
            held.append((genome_idx, n, name, seq))
            size += len(seq)
            if size > 8_000_000:
                yield _contigs(held)
                held, size = [], 0
        yield _contigs(held)

    return spark.read.text(path).coalesce(1).mapInArrow(parse, CONTIGS)


def _split_fastq(lines: DataFrame, genome_idx: int) -> DataFrame:
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, text = batch.column("block").to_pylist(), batch.column("value").to_pylist()
            rows = []
            for block, start, end in _runs(blocks):
                own = [x.rstrip("\r\n") for x in text[start:end]]
                marks = "".join(x[:1] if x[:1] in ("@", ">", "+") else "." for x in own)
                rows.append((block, batch.column("n")[start].as_py(), marks, [len(x) for x in own], [len(x.strip()) for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    def stands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = Place(), []
        for batch in batches:
            for block, marks, whole, bare in zip(*(batch.column(c).to_pylist() for c in ("block", "marks", "whole", "bare"))):
                if not known or known[-1][0] != block:
                    known.append((block, *here.now()))
                for x in zip(marks, whole, bare):
                    here.feed(*x)
        if here.quality:
            warnings.warn("reading ends at a record that is cut short or has qualities of another length", stacklevel=2)
        total = here.number + (here.named and not here.quality and not here.over)
        known.append((-1, False, False, 0, 0, total, True))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*known)], names=["block", "named", "quality", "want", "got", "number", "over"])

    names, kinds = ["block", "n", "marks", "whole", "bare"], [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    short = lines.mapInArrow(lengths, "block long, n long, marks string, whole array<int>, bare array<int>").repartition(1).sortWithinPartitions("block", "n")
    found = short.mapInArrow(stands, "block long, named boolean, quality boolean, want long, got long, number long, over boolean").collect()  # a row a split
    begin = {r[0]: tuple(r[1:]) for r in found}
    total = begin.pop(-1)[4]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, here, name, number, parts, size = None, Place(), None, 0, [], 0

        def put(whole: bool) -> None:
            nonlocal name, parts
            if (name is not None or parts) and number < total:
                held.append((number, at, name, "".join(parts), whole and name is not None))
            name, parts = None, []

        def made() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*held)) or [()] * 5, types)], names=["n", "at", "name", "part", "whole"])

        for batch in batches:
            text = batch.column("value").to_pylist()
            for block, start, end in _runs(batch.column("block").to_pylist()):
                if block != at:
                    put(False)
                    if block not in begin:
                        raise ValueError("the file is split in another way than when reading was set up; read it anew")
                    at, here = block, Place(*begin[block])
                    number = here.number
                for line in text[start:end]:
                    line = line.rstrip("\r\n")
                    bare = line.strip()
                    kind = here.feed(line[:1], len(line), len(bare))
                    if kind == "A":
                        parts.append(bare)
                        size += len(bare)
                    elif kind:
                        put(True)
                        if kind == ">":
                            name, number = (re.split(r"\s", line[1:], maxsplit=1) or [""])[0], here.number
                    if size > 8_000_000 and held:
                        yield made()
                        held, size = [], 0
        put(False)
        yield made()

    rows = lines.mapInArrow(parse, "n long, at long, name string, part string, whole boolean")
    parted = rows.filter(~F.col("whole")).groupBy("n").agg(F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    parted = parted.select("n", "name", F.array_join(F.transform("parts", lambda x: x.part), "").alias("part"))
    own = [F.lit(genome_idx).cast("int").alias("genome_idx"), F.col("n").alias("contig_idx"), F.col("name").alias("contig"), F.col("part").alias("seq")]
    return rows.filter("whole").select(*own).union(parted.select(*own))


def _runs(values: list) -> Iterator[tuple[object, int, int]]:
    """(value, start, end) of equal neighbours."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield values[start], start, i
            start = i


def _contigs(rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = {"genome_idx": pa.int32(), "contig_idx": pa.int64(), "contig": pa.string(), "seq": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def write_snpmer_fasta(sites: DataFrame, path: str) -> None:
    """Two records a SNP-mer, with either allele in the middle; the name is the sequence."""
    snpmer_records(sites).select(F.concat(F.lit(">"), "mer", F.lit("\n"), "mer")).write.mode("overwrite").text(path)


def snpmer_records(sites: DataFrame) -> DataFrame:
    """(mer) of (snpmer, ref, alt): the SNP-mer with its centre set to either allele."""
    middle = (F.length("snpmer") / 2).cast("int") + 1
    return sites.select(F.explode(F.array(*(F.overlay("snpmer", F.col(c), middle, F.lit(1)) for c in ("ref", "alt")))).alias("mer"))
