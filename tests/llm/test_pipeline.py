import random
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from midbase.llm import common, decontaminate
from midbase.llm import queries as llm_queries

from .conftest import prose


def test_stages_hand_on_documents(spark, tmp_path):
    rng = random.Random(9)
    bench = [(i, prose(rng, 20, 10**6)) for i in range(3)]
    passage = prose(rng, 60, 10**6)
    fine = {i: prose(rng, 150, 10**6) for i in range(60)}
    texts = dict(fine)
    texts[60] = texts[0]  # an exact copy
    texts[61] = " ".join(texts[1].split()[:-2] + ["other", "end"])  # a near copy
    texts[62] = prose(rng, 40, 10**6) + " " + bench[0][1] + " " + prose(rng, 40, 10**6)
    texts[63], texts[64] = passage + " " + prose(rng, 80, 10**6), prose(rng, 80, 10**6) + " " + passage
    junk = {i: " ".join(["spam"] * 70) + f" {i}" for i in range(70, 100)}
    toxic = {i: prose(rng, 50, 10**6) + " lump " + prose(rng, 50, 10**6) for i in range(100, 130)}
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in (texts | junk | toxic).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(70, 95)] + [(i, 1, 1) for i in range(100, 125)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r for r in docs.collect()})
    quality, lines, near, clean = seen
    assert set(texts) <= set(quality) and not set(quality) & (set(junk) | set(toxic))
    assert 60 not in lines and passage in lines[63].text and passage not in lines[64].text
    assert lines[64].n_chars == len(lines[64].text)
    assert set(fine) <= set(near)
    compiled = decontaminate.compile_patterns(bench)
    assert set(near) - set(clean) == {i for i, r in near.items() for _, _, x in decontaminate.hits([r.text], compiled) if x} == {62}
    assert {r.doc_id for r in docs.collect()} == set(clean)
    # results own their tables: building others, or clearing them, leaves each readable
    result, other = corpus_pipeline.run(spark, str(tmp_path)), llm_queries.queries()["op7_linededup"](spark, str(tmp_path))
    again = llm_queries.queries()["op3_decontaminate"](spark, str(tmp_path))
    common.clear(again)
    assert other.count() == len(texts) + len(junk) + len(toxic)
    common.clear(other)
    assert result.count() == docs.count()
    paths = list(result._staging.paths)
    common.clear(result)
    assert paths and not any(Path(p.removeprefix("file://")).exists() for p in paths)


def test_stages_on_odd_rows(spark, tmp_path, make_docs, odd_rows):
    """Nulls, empty texts, a long text, repeated rows, clashing names, empty tables: each stage by itself."""
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    rng = random.Random(4)
    clean = [(100 + i, prose(rng, 80, 10**6)) for i in range(3)]
    full, none = (make_docs(rows).withColumns({c: F.col("doc_id") for c in ("__key", "__cut", "__judged", "row", "text_")}) for rows in (odd_rows + clean, []))
    kept = {"quality classifier": 7 + 3, "line dedup": 10 - 3 + 3, "MinHash near-dedup": 10 - 3 + 3, "benchmark decontamination": 10 + 3}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, str(tmp_path))
        if name in kept:
            assert out.columns == full.columns
            rows = out.collect()
            assert len(rows) == kept[name], (name, len(rows))
            assert all(r["__key"] == r["__cut"] == r["__judged"] == r["row"] == r.doc_id for r in rows)
            assert {i for i, _ in clean} <= {r.doc_id for r in rows}
        else:
            assert {r.doc_id for r in out.collect()} == {i for i, _ in odd_rows + clean}
        assert stage(spark, none, str(tmp_path)).count() == 0
