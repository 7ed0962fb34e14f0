import random

import numpy as np

from midbase.llm import quality

from .conftest import prose


def corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(["fine", "fine", "fine", "junk", "toxic"])
        text = prose(rng, rng.randrange(30, 200), 3000)
        if kind == "junk":
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split()) if i % 2 else " ".join(["spam"] * 80)
        if kind == "toxic":
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grobian", "grobianisch", "lump"]))
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(kind != "junk"), int(kind == "toxic"), kind))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, make_docs, odd_rows):
    rows, labels = corpus()
    known = spark.createDataFrame([x[:3] for x in labels if x[0] < 400] + [(None, 1, 0), (1, None, 0), (10_000, 0, 0)], "doc_id long, quality int, toxic int")
    odd = [(i if i is None else 5000 + i, t) for i, t in odd_rows]
    docs = make_docs(rows + odd)
    got = quality.judge(docs, known)
    assert got.columns == [*docs.columns, "__judged"]
    out = {r.doc_id: r["__judged"] for r in got.collect()}
    wrong = sum(out[i].kept != (kind == "fine") for i, _, _, kind in labels if i >= 400)
    assert wrong <= 4, wrong
    assert got.count() == len(rows) + len(odd)
    assert not out[5002].kept and not out[5003].kept and not out[5006].kept
    assert all(0 <= j.low <= 1 and 0 <= j.toxic <= 1 for j in out.values())


def test_bad_sites_pull_their_documents_down(spark, make_docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60, 3000) if i % 2 else " ".join(w + "###" for w in prose(rng, 60, 3000).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows, source=lambda i: "bad" if i % 2 == 0 or i == 151 else "good")
    out = {r.doc_id: r["__judged"] for r in quality.judge(docs, labels).collect()}
    assert out[151].low > out[151].p_low and out[153].low < out[153].p_low * 1.01


def moments(n, x, rate):
    """The strength of a prior, by hand."""
    many = n > 1
    if not many.any() or rate in (0.0, 1.0):
        return 10_000.0
    within = rate * (1 - rate) * many.sum() / n[many].sum()
    between = max((n[many] * (x[many] / n[many] - rate) ** 2).sum() / n[many].sum() - within, 1e-9)
    return min(10_000.0, max(1.0, rate * (1 - rate) / between - 1))


def test_posteriors_against_numpy(spark, make_docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(5, 60), 3000) if rng.random() < 0.6 else " ".join(w + "###" for w in prose(rng, 60, 3000).split())) for i in range(250)]
    labels = spark.createDataFrame([(i, int("#" not in t), 0) for i, t in rows[::3]], "doc_id long, quality int, toxic int")
    host = lambda i: "only" if i == 7 else f"h{i % 4}" if i % 5 else "hot"
    docs = make_docs(rows, host).selectExpr("* except (lang)", "'p' || (doc_id % 3) as lang")
    got = {r.doc_id: r["__judged"] for r in quality.judge(docs, labels).collect()}
    ids = sorted(got)
    for kind in ("low", "toxic"):
        p = np.array([got[i]["p_" + kind] for i in ids])
        sites = {}
        for j, i in enumerate(ids):
            sites.setdefault((host(i), i % 3), []).append(j)
        hosts = {}
        for (h, _), js in sites.items():
            hosts.setdefault(h, []).extend(js)
        rate = p.mean()
        below, above = (moments(np.array([len(js) for js in g.values()]), np.array([p[js].sum() for js in g.values()]), rate) for g in (sites, hosts))
        logit = lambda q: np.log(q / (1 - q))
        for j, i in enumerate(ids):
            mine, up = sites[host(i), i % 3], hosts[host(i)]
            prior = (p[up].sum() - p[j] + above * rate) / (len(up) - 1 + above)
            here = (p[mine].sum() - p[j] + below * prior) / (len(mine) - 1 + below)
            z = logit(np.clip(p[j], 1e-9, 1 - 1e-9)) + logit(np.clip(here, 1e-9, 1 - 1e-9)) - logit(np.clip(rate, 1e-9, 1 - 1e-9))
            assert abs(got[i][kind] - 1 / (1 + np.exp(-z))) < 1e-6
            if i == 7:  # the only document of its host has the global rate as its prior
                assert abs(here - rate) < 1e-9


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(make_docs([]), none).count() == 0
    assert quality.judge(make_docs([(1, "some words here")]), none).first()["__judged"].kept
