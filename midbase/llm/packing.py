"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Documents are tokenised once and staged. Each source is a queue of its documents in id order, seen as
one stream of tokens. A round is as long as a window and gives every source a quantum: its target share of a window.
A source sends a block of a quantum (whole tokens; the fraction is its deficit and carried on) a round; a source whose quantum is
smaller than `least_block` tokens saves up its quanta for several rounds and then sends them at once. As queues are never empty before
their end, the block that ends at stream position e is sent in a round that follows from e, so the round-robin order of
all blocks follows from running totals and needs no simulation: deficits carry over windows and partitions because rounds are
counted over the whole stream. Blocks are laid end to end in (round, source) order and cut where a window of
`length` tokens is full, so only the last window can be short, and each window holds as much of every source as its share
is, to about a block of one that saves up and to the few tokens by which windows and rounds have shifted. Sources that
save up start with different deficits, so that their blocks do not come due in the same round.

By default the target share of a source is its share of all tokens, so all queues end together; with
given targets, sources that run out leave their share of later windows to the others, and sources without one get a token a window.

Token ids are those of `tokenizers` with add_special_tokens=False. Texts that hold the string of an added token of the vocabulary
(which becomes that token) go through `tokenizers` itself, all others through `tiktoken`, which is four times as fast
and gives the same ids.

Cases: a null or empty text is its end token alone; rows that repeat an id are documents of their own, in row order;
a null source is a queue of its own; ids may be null or of any type that has an order; a very long text is one row of
ids, 2 bytes each, cut at any id; further columns are ignored, whatever their names; an empty table has no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ordered import running_total

LENGTH = 2048
END = 1
LEAST_BLOCK = 16
ONE = 1 << 16  # units of a token in which quanta are counted
#: The pattern that byte-level BPE vocabularies of this kind split texts by (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_coders: dict[int, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks(vocabulary_json: str) -> tuple[dict[bytes, int], list[str]]:
    """Token bytes to ids of a byte-level BPE file, and the strings of its added tokens. Such files write the printable Latin-1 bytes
    as themselves and the others, in order, as the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    model = json.loads(vocabulary_json)
    added = [t["content"] for t in model.get("added_tokens", ())]
    return {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}, added


def coder(vocabulary_json: str):
    """A function from a text to its ids."""
    import tiktoken
    from tokenizers import Tokenizer

    table, added = ranks(vocabulary_json)
    plain = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    whole = Tokenizer.from_str(vocabulary_json)

    def ids(text: str | None) -> list[int]:
        if text and any(a in text for a in added):
            return whole.encode(text, add_special_tokens=False).ids
        return plain.encode_ordinary(text or "")

    return ids


def _tokeniser(shared: object, mark: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _coders.get(mark)
        if own is None:
            _coders.clear()
            own = _coders[mark] = coder(shared.value)  # type: ignore[attr-defined]
        for batch in batches:
            for part in common.parts(batch, "text"):
                counts, ids = [], []
                for text in part.column("text"):
                    got = np.array([*own(text.as_py()), END], dtype="<u4")
                    counts.append(len(got))
                    ids.append((got.astype("<u2") if got.max() < 65536 else got).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=[*columns, "n", "ids"],
                )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the staged ids as laid out and check-sum every piece."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, n, raw, cuts in zip(*(batch.column(c) for c in ("id", "n", "ids", "cuts"))):
            n, raw = n.as_py(), raw.as_buffer()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
            for cut in sorted(cuts.as_py(), key=lambda c: c["start"]):
                own = ids[cut["start"] : cut["start"] + cut["length"]]
                rows.append((doc.as_py(), cut["start"], cut["length"], zlib.crc32(own.tobytes()), n, cut["sequence"], cut["at"]))
            if len(rows) > 50_000:
                yield _rows(rows, batch.schema.field("id").type)
                rows = []
        yield _rows(rows, batch.schema.field("id").type)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names
    )


@common.owned
def pack(
    docs: DataFrame,
    path: str | None = None,
    length: int = LENGTH,
    targets: dict[str | None, float] | None = None,
    least_block: int = LEAST_BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        vocabulary = f.read()
    shared, mark = spark.sparkContext.broadcast(vocabulary), zlib.crc32(vocabulary.encode())  # a file of fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = common.row_keyed(docs.select(*(F.col(common.quoted(c)) for c in dict.fromkeys((id_col, text_col, source_col)))), id_col, text_col)
    field = lambda c: F.col("row").getField(c)
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit(""))  # noqa: E731  a null source is none of the others
    keyed = keyed.select("__key", field(id_col).alias("id"), named(field(source_col).cast("string")).alias("src"), "text")
    tokens = common.staged(
        keyed.mapInArrow(_tokeniser(shared, mark, ["__key", "id", "src"]), f"__key long, id {kind}, src string, n long, ids binary"),
        "tokens",
    )
    per = tokens.groupBy("src").agg(F.sum("n").alias("total"))
    share = F.col("total") / F.lit(tokens.agg(F.sum("n")).first()[0] or 1)
    if targets:
        whole = sum(targets.values())
        given = F.create_map(*[x for k, v in targets.items() for x in (named(F.lit(k).cast("string")), F.lit(v / whole))])
        share = F.coalesce(F.try_element_at(given, F.col("src")), F.lit(1 / length))
    # quanta in units of ONE to a token, so that all of the following is whole numbers
    quantum = F.greatest(F.lit(1), F.floor(share * length * ONE)).cast("long")
    rounds = F.ceil(F.lit(least_block * ONE) / quantum).cast("long")
    sources = per.select("src", quantum.alias("quantum"), rounds.alias("rounds"))
    sources = sources.select("src", "rounds", F.expr("quantum * rounds").alias("size"), F.expr("pmod(xxhash64(src), rounds)").alias("phase"))
    sources = common.staged(sources, "sources")
    queued = running_total(tokens.select("__key", "src", "n"), ["__key"], "n", "x", ["src"])
    queued = common.join_sized(queued, sources, ["src"], "inner")
    # block b holds the stream's tokens from floor(b * size) on
    holding = lambda x: F.expr(f"(({x} + 1) * {ONE} - 1) div size")
    starts = lambda b: F.expr(f"{b} * size div {ONE}")
    blocks = queued.withColumn("b", F.explode(F.sequence(holding("x"), holding("(x + n - 1)"))))
    begin, end = F.greatest("x", starts("b")), F.least(F.col("x") + F.col("n"), starts("(b + 1)"))
    due = F.expr("(b + 1) * rounds - phase")
    blocks = blocks.select("__key", "src", due.alias("round"), "b", (begin - F.col("x")).alias("start"), (end - begin).alias("m"))
    laid = running_total(blocks, ["round", "src", "b", "__key"], "m", "g")
    window = F.col("window")
    cut = laid.withColumn("window", F.explode(F.sequence(F.expr(f"g div {length}"), F.expr(f"(g + m - 1) div {length}"))))
    low = F.greatest("g", window * length)
    high = F.least(F.col("g") + F.col("m"), (window + 1) * length)
    cut = cut.select("__key", F.struct(
        (F.col("start") + low - F.col("g")).alias("start"), (high - low).alias("length"),
        window.alias("sequence"), (low - window * length).alias("at"),
    ).alias("cut"))
    cuts = cut.groupBy("__key").agg(F.collect_list("cut").alias("cuts"))
    out = tokens.select("__key", "id", "n", "ids").join(cuts.hint("merge"), "__key").select("id", "n", "ids", "cuts").mapInArrow(
        _pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("id", id_col)


@common.owned
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
