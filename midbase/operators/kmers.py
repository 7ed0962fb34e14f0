"""K-mer occurrences of contigs.

contigs: genome_idx int, contig_idx long, contig string, seq string [, start long: position of seq in its contig].
occurrences: genome_idx, contig_idx, pos (0-based centre on the forward strand), flanks (packed, canonical), center
(0-3), fwd (whether the forward strand is the canonical one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna

OCCURRENCES = "genome_idx int, contig_idx long, pos long, flanks long, center int, fwd boolean"
_CODES = np.full(256, 4, np.uint8)
for _i, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _c in _letters:
        _CODES[ord(_c)] = _i


def encode(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window start, flanks, center, fwd) of the k-mers of one sequence: windows of ACGT only, on the strand whose
    flanks are smaller; windows with palindromic flanks are left out."""
    codes = _CODES[np.frombuffer(seq, np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    start = np.flatnonzero(bad[k:] == bad[:-k])
    half = k // 2
    wide = (codes & 3).astype(np.int64)

    def packed(a: np.ndarray, m: int) -> np.ndarray:
        """Packed values of all windows of m, by doubling."""
        out, size = None, 0
        power, width = a, 1
        while True:
            if m & width:
                out = power if out is None else (out[: len(power) - size] << (2 * width)) | power[size : size + len(out)]
                size += width
            if size == m:
                return out
            power = (power[:-width] << (2 * width)) | power[width:]
            width *= 2

    arms = packed(wide, half)  # arms[i]: the half bases from i on
    turned = packed((3 - wide)[::-1], half)[::-1]  # turned[i]: their reverse complement
    left, right = arms[start], arms[start + half + 1]
    forward = (left << (2 * half)) | right
    back = (turned[start + half + 1] << (2 * half)) | turned[start]
    keep = forward != back
    start, forward, back = start[keep], forward[keep], back[keep]
    fwd = forward < back
    center = wide[start + half]
    return start, np.where(fwd, forward, back), np.where(fwd, center, 3 - center), fwd


def tiles(contigs: DataFrame, k: int, size: int) -> DataFrame:
    """Contigs, or parts of them with a `start`, cut into pieces of at most `size` bases that overlap by k - 1, so every window lies in
    one piece.

    Cutting is done on bytes in one pass over each contig; pieces are then spread over tasks.
    """

    names = ["genome_idx", "contig_idx", "contig", "seq", "start"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        held: list[tuple] = []
        bases = 0
        for batch in batches:
            for g, c, name, seq, first in zip(*(batch.column(x) for x in names)):
                raw = seq.as_buffer() if seq.is_valid else pa.py_buffer(b"")
                for at in range(0, max(raw.size - k + 1, 0), size - k + 1):
                    piece = raw.slice(at, min(size, raw.size - at)).to_pybytes().decode()
                    held.append((g.as_py(), c.as_py(), name.as_py(), piece, first.as_py() + at))
                    bases += len(piece)
                    if bases > 4_000_000:
                        yield made(held)
                        held, bases = [], 0
        if held:
            yield made(held)

    kind = "genome_idx int, contig_idx long, contig string, seq string, start long"
    columns = [F.col("genome_idx").cast("int"), F.col("contig_idx").cast("long"), F.col("contig").cast("string"), F.col("seq")]
    columns.append((F.col("start") if "start" in contigs.columns else F.lit(0)).cast("long").alias("start"))
    return contigs.select(*columns).mapInArrow(cut, kind).repartition("genome_idx", "contig_idx", "start")


def occurrences(contigs: DataFrame, k: int, places: bool = True) -> DataFrame:
    """All canonical k-mer occurrences; without places only genome_idx, flanks and center."""
    names = ["genome_idx", "contig_idx", "pos", "flanks", "center", "fwd"] if places else ["genome_idx", "flanks", "center"]
    start = F.col("start") if "start" in contigs.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            rows = 0
            for g, c, at, seq in zip(*(batch.column(x) for x in ("genome_idx", "contig_idx", "start", "seq"))):
                if not seq.is_valid:
                    continue
                found, flanks, center, fwd = encode(seq.as_py().encode(), k)
                if len(found):
                    own = {"pos": found + (at.as_py() + k // 2), "flanks": flanks, "center": center.astype(np.int32), "fwd": fwd}
                    own["genome_idx"] = np.full(len(found), g.as_py(), np.int32)
                    own["contig_idx"] = np.full(len(found), c.as_py(), np.int64) if places else None
                    held.append(tuple(own[n] for n in names))
                    rows += len(found)
                if rows > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)

    kinds = dict(x.split() for x in OCCURRENCES.split(", "))
    # contigs that are too short are left out above: a filter here would make seq a second time where it is an expression
    own = contigs.select(F.col("genome_idx").cast("int"), F.col("contig_idx").cast("long"), start.cast("long").alias("start"), "seq")
    return own.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def occurrences_native(contigs: DataFrame, k: int) -> DataFrame:
    """The same rows by string functions alone, with flanks as a string: the definition, for tests and small inputs."""
    half = k // 2
    rows = contigs.withColumn("seq", dna.normalise(F.col("seq"))).filter(F.length("seq") >= k)
    rows = rows.select("genome_idx", "contig_idx", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("i"))
    rows = rows.select("genome_idx", "contig_idx", "i", F.substr("seq", F.col("i") + 1, F.lit(k)).alias("f"))
    rows = rows.filter(F.col("f").rlike("^[ACGT]+$")).withColumn("r", dna.reverse_complement(F.col("f")))
    rows = rows.withColumn("y", F.least("f", "r"))
    left, right = F.substring("y", 1, half), F.substring("y", half + 2, half)
    return rows.filter(~dna.is_palindromic(left, right)).select(
        F.col("genome_idx").cast("int").alias("genome_idx"), F.col("contig_idx").cast("long").alias("contig_idx"),
        (F.col("i") + half).cast("long").alias("pos"), F.concat(left, right).alias("flanks"),
        F.substring("y", half + 1, 1).alias("center"), (F.col("f") < F.col("r")).alias("fwd"),
    )
