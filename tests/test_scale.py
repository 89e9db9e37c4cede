"""What lets queries keep their limits: how much is read, shuffled and done twice, at a small scale."""

import math

import pyarrow as pa

from attestor.operators import keyword, lexical, nearest, parsing
from attestor.operators.typed import FEATURES, rank_pairs
from attestor.plans import run as R
from attestor.plans import typed

SF = "/root/testdata/sf0.001"


def test_small_tables_are_spread(spark):
    """A table of one file isn't worked on by one core."""
    cores = spark.sparkContext.defaultParallelism
    assert typed.order_texts(spark, SF).rdd.getNumPartitions() >= cores and typed.lines(spark, SF).rdd.getNumPartitions() >= cores
    assert R.spread(spark.range(0, 10, 1, 100)).rdd.getNumPartitions() == 100


def test_pairs_keep_what_is_asked(spark):
    pairs = spark.createDataFrame([("a", "The cache keeps 3 copies", "sentence", "The cache keeps 3 copies.", None, 1)], "claim_id string, claim string, kind string, text string, heading_path array<string>, k int")
    whole, few = rank_pairs(pairs).first(), rank_pairs(pairs, keep=["k"], add=("label", "values"))
    assert few.columns == ["k", "label", "values"] and tuple(few.first()) == (1, whole.label, [whole.features[f] for f in FEATURES])


def documents(spark, n=40):
    rows = [(i, f"Alpha beta {i % 7} gamma delta. Some filler stands here, and more of it.\nA claim number {i % 3} is held here whole. Zeta.") for i in range(n)]
    claims = [(k, f"number {k} is held here") for k in range(4)] + [(9, "Zeta"), (10, None), (11, "Alpha beta")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(claims, "item_id long, text string")


def test_claims_are_found_without_a_join(spark):
    docs, claims = documents(spark)
    for df in (lexical.holding(docs, claims), lexical.held_spans(docs, claims), lexical.bm25(docs, claims)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    want = {(c.item_id, d.doc_id) for c in claims.collect() for d in docs.collect() if c.text and c.text in d.text}
    assert {(r.claim_id, r.doc_id) for r in lexical.holding(docs, claims).collect()} == want and {c for c, _ in want} == {0, 1, 2, 9, 11}
    held = lexical.held_spans(docs, claims).collect()
    assert {(r.claim_id, int(r.document_id)) for r in held} == want and all(r.gold == (r.claim in r.text) for r in held) and any(r.gold for r in held)
    assert all(0 < r.score <= 1 for r in lexical.bm25(docs, claims).collect())


def test_soft_similarity(spark):
    rows = [(1, "a", "Alpha beta", "alpha  Beta"), (1, "b", "Alpha beta", "That."), (1, "c", "Alpha beta", "")]
    got = {r.span_id: r for r in lexical.soft(spark.createDataFrame(rows, "claim_id long, span_id string, claim string, text string")).collect()}
    assert math.isclose(got["a"].similarity, 1.0) and got["a"].exact_phrase == 1.0
    assert math.isclose(got["b"].similarity, 0.48) and math.isclose(got["c"].similarity, 0.48)  # in its SQL, the lesser of 1 and nothing is 1


def test_a_task_keeps_the_first_spans_only():
    """What leaves a task doesn't grow with its spans, and is what sorting all of them would keep."""
    asked = [["alpha", "beta"], ["beta", "gamma", "delta"], ["omega"]]
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in asked for t in ts}))}
    holders = [[c for c, ts in enumerate(asked) if t in ts] for t in vocabulary]
    ends, flat = keyword.np.cumsum([0, *map(len, holders)]), keyword.np.array([c for cs in holders for c in cs])
    best, rows = keyword._Best(vocabulary, ends, flat, 3, 5), []
    names = ["span_id", "document_id", "ordinal", "parent_id", "text"]
    for k in range(60):
        part = [(f"{k}-{i}", str(i * 7 % 11), k, None if i % 3 else "p", " ".join(w for j, w in enumerate(["alpha", "beta", "gamma", "delta", "omega x"]) if (i * 31 + k * 7) >> j & 1)) for i in range(50)]
        rows += part
        best.add(pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], keyword.OWN), [best.terms(r[4]) for r in part])
    got = {(r["claim"], r["span_id"], r["k"]) for b in best.result() for r in b.to_pylist()}
    want = set()
    for c, ts in enumerate(asked):
        found = sorted((-n, p is None, d, o, s) for s, d, o, p, t in rows if (n := len(set(ts) & set(t.split()))))
        want |= {(c, s, -n) for n, _, _, _, s in found[:5]}
    assert {(c, k) for c, _, k in got} == {(c, k) for c, _, k in want} and len(got) == 15
    place = {s: (p is None, d, o) for s, d, o, p, _ in rows}
    assert sorted((c, k, place[s]) for c, s, k in got) == sorted((c, k, place[s]) for c, s, k in want)


def test_first_spans_of_parsed_documents(spark):
    """Parsed on the way or before: the same spans."""
    docs = R.table(spark, SF, "documents").selectExpr("cast(doc_id as string) AS document_id", "text").limit(150).localCheckpoint()
    claims = R.table(spark, SF, "benchmark").selectExpr("item_id AS claim_id", "text AS claim")
    a, b = keyword.first_in_documents(docs.repartition(5), claims), keyword.first_spans(parsing.parse(docs), claims)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 0


def test_the_queue_is_made_once(spark, monkeypatch):
    made, run = [], typed.run
    monkeypatch.setattr(typed, "run", lambda name, *a: made.append(name) or run(name, *a).localCheckpoint())
    R._STAGES.clear()
    assert typed.QUERIES["cur_templates"](spark, SF).count() == typed.QUERIES["cur_templates"](spark, SF).count() > 0
    assert made == ["cur_queue"]


def test_nearest_with_copies_and_blocks(spark, monkeypatch):
    """Many equal vectors are ordered by id, whatever the batches and blocks, and the rest is exact."""
    rng = nearest.np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype("float32")
    rows = [(i, [float(x) for x in base[i * 7 % 40]]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    m = nearest.np.array([r[1] for r in rows])
    cosine = m @ m.T / nearest.np.outer(*[nearest.np.linalg.norm(m, axis=1)] * 2)
    want = [(q, *x) for q in range(0, 600, 20) for x in sorted((-round(float(cosine[q, v]), 6), v) for v in range(600) if v != q)[:10]]
    assert nearest.regular(vectors)
    for size in (64 << 20, 32 * 7):
        monkeypatch.setattr(nearest, "BLOCK_BYTES", size)
        got = nearest.nearest(vectors.repartition(3), vectors.filter("vec_id % 20 = 0")).collect()
        assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(q, v) for q, _, v in want]
        assert all(abs(r.score + s) < 2e-6 for r, (_, s, _) in zip(sorted(got, key=lambda r: (r.query_id, r.rank)), want, strict=True))
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "vec_id long, embedding array<float>")
    assert not nearest.regular(odd) and not nearest.regular(odd.fillna(0).filter("vec_id = 0").union(spark.createDataFrame([(2, [0.0, 0.0])], odd.schema)))
    plan = nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
