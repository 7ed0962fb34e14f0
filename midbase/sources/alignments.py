"""Alignment writers: PHYLIP, FASTA, NEXUS and binary NEXUS.

Sequences are rows (sample, seq). Text is laid out by the executors; only the sample names and the length of the
alignment reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render(sequences: DataFrame, form: str, outgroup: str = "", binary: bool = False) -> DataFrame:
    """(n, line): the lines of the file in order. The outgroup comes first, then the samples in name order."""
    size = sequences.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"), F.max(F.length("sample")).alias("w")).first()
    first = outgroup.split(",")[0].split(";")[0]
    place = F.when(F.col("sample") == first, 0).otherwise(1)
    if form == "fasta":
        line, top, end = F.concat(F.lit(">"), "sample", F.lit("\n"), "seq"), [], []
    elif form in ("phylip", "nexus"):
        line = F.concat(F.rpad("sample", (size["w"] or 0) + 3, " "), "seq")
        kind = ("SNP", "?") if binary else ("DNA", "N")
        start = f"#NEXUS\n\nBEGIN DATA;\n\tDIMENSIONS NTAX={size['n']} NCHAR={size['m'] or 0};\n\tFORMAT DATATYPE={kind[0]} MISSING={kind[1]} GAP=- ;\nMATRIX"
        top, end = ([f"{size['n']} {size['m'] or 0}"], []) if form == "phylip" else ([start], [";\nEND;"])
    else:
        raise ValueError("form must be fasta, phylip or nexus")
    spark = sequences.sparkSession
    fixed = spark.createDataFrame([(-1, "", x) for x in top] + [(2, "", x) for x in end], "n int, sample string, line string")
    return sequences.select(place.alias("n"), "sample", line.alias("line")).union(fixed)


def write(sequences: DataFrame, path: str, form: str = "phylip", outgroup: str = "", binary: bool = False) -> None:
    rows = render(sequences, form, outgroup, binary)
    rows.orderBy("n", "sample").select("line").write.mode("overwrite").text(path)
