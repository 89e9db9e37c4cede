"""The training-data operators on small fixtures, against brute force and for the defined cases."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import decontam, html_extract, line_dedup, lm_score, mix, ngram_join, quality_cnn, rules, substring_dedup, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(40)]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, 40, n))


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "a"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", "   \n ", "one", "A b", "a B", "x " * 3000, "ﬁ é ü <s> ▁ a\0b\n\n  c"]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        mix.mix(docs), decontam.contamination(docs, items), token_count.token_counts(docs, PIECES), rules.quality_rules(docs, labels), quality_cnn.quality(docs, labels),
        line_dedup.dedup_lines(docs), substring_dedup.remove_repeats(docs), ngram_join.similar(docs), html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
        lm_score.lm_scores(docs, PIECES),
    ):
        assert df.count() == 0


def test_mix(spark):
    docs = table(spark, [*(prose(i, 5 + i % 30) for i in range(300)), None], {i: "ab"[i % 2] if i % 7 else None for i in range(301)} | {3: "rare"})
    rows = mix.mix(docs.unionByName(docs.filter("doc_id < 5")), bucket_rows=16).collect()
    assert len(rows) == 306
    sums = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        s = sums.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] += r.size
    for (size, target), (taken, words) in sums.items():
        assert words == size and taken == int(target) and target <= 3 * size
    assert abs(sum(t for _, t in sums) - sum(s for s, _ in sums)) < 1e-6


def words_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination(spark):
    items = [prose(900 + i, 5 + 3 * i) for i in range(8)] + ["w1 w2 w3", "w1 w2 w3", "", None]
    texts = [*EDGES, *(prose(i, 60) for i in range(20)), prose(50, 9) + " " + items[6] + "! " + items[7].upper(), items[5], items[5]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    windows = {}
    for i, t in enumerate(items):
        w = words_of(t)
        n = min(8, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    for limit in (decontam.BROADCAST_ROWS, 0):
        got = by_id(decontam.contamination(table(spark, texts), bench, broadcast_rows=limit))
        for i, t in enumerate(texts):
            w, hit, found = words_of(t), set(), set()
            for n in range(1, 9):
                for p in range(len(w) - n + 1):
                    if (own := windows.get(tuple(w[p : p + n]))) is not None:
                        hit |= set(range(p, p + n))
                        found |= own
            ids = ",".join(sorted(map(str, found)))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest())


def test_token_counts(spark):
    import sentencepiece

    texts = [*EDGES, *(prose(i, 50) for i in range(10))]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(token_count.token_counts(table(spark, texts), PIECES))
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(sp.encode(t or "")))


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


@pytest.mark.parametrize("rows", [ngram_join.BROADCAST_ROWS, 0])
def test_similar(spark, rows):
    rng = np.random.default_rng(4)
    texts = list(EDGES)
    for family in range(4):
        base = prose(family, 80).split()
        for copy in range(12):
            own = [w if rng.random() > 0.012 * copy else str(rng.integers(1000)) for w in base]
            texts.append(" ".join(own))
    texts += [texts[10], texts[10], *(prose(100 + i, 4) for i in range(40))]
    sets = [shingles(t) for t in texts]
    links = {i: set() for i in range(len(texts))}
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 60 * len(sets[i] | sets[j]):
            links[i].add(j)
            links[j].add(i)
    got = by_id(ngram_join.similar(table(spark, texts), broadcast_rows=rows))
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        assert (got[i].n_shingles, got[i].n_similar, got[i].component_id) == (len(sets[i]), len(links[i]), min(seen)), i


def test_similar_counted_in_a_sample(spark, monkeypatch):
    """Whatever share of the sets the order is counted in, links are the same."""
    texts = [" ".join(w if (i * 7 + k) % 23 else f"v{i}" for k, w in enumerate(prose(i % 5, 60).split())) for i in range(40)]
    links = [sum(100 * len(a & b) >= 60 * len(a | b) for b in map(shingles, texts)) - 1 for a in map(shingles, texts)]
    monkeypatch.setattr(ngram_join, "COUNTED", 100)
    got = by_id(ngram_join.similar(table(spark, texts)))
    assert [got[i].n_similar for i in range(len(texts))] == links and max(links) > 0


def test_frequencies_tell_shingles_of_large_tables_apart(spark):
    """A rare shingle comes before a frequent one with the same last 20 bits; more than a million distinct ones meet there."""
    often, rare = 5, 5 + (1 << 21)
    reps = spark.createDataFrame([(i, 1, [often]) for i in range(50)] + [(50, 2, [often, rare])], "cls long, n int, h array<long>")
    total = 40_000_000
    levels = ngram_join.frequencies(reps, min(total, ngram_join.COUNTED)).first().levels
    assert levels[rare & (len(levels) - 1)] < levels[often]


def test_frequencies_are_few_and_of_repeated_shingles(spark):
    """The driver sends four million levels at most, whatever the table, and shingles that occur once don't crowd them."""
    once = [7 + (i << 30) for i in range(60)]
    reps = spark.createDataFrame([(0, 60, once), (1, 1, [9]), (2, 1, [9])], "cls long, n int, h array<long>")
    levels = ngram_join.frequencies(reps, ngram_join.COUNTED).first().levels
    assert len(levels) <= 1 << 22 and levels[7] == 0 < levels[9]


def test_similar_collects_the_drivers_heap_between_tables(spark, monkeypatch):
    swept, whole = [], ngram_join.Scratch.sweep
    monkeypatch.setattr(ngram_join.Scratch, "sweep", lambda self: (swept.append(len(self.paths)), whole(self)))
    monkeypatch.setattr(ngram_join, "HEAP", 0.0)
    ngram_join.similar(table(spark, [prose(i % 5, 60) for i in range(20)]))
    assert len(swept) > 20


def test_signatures_are_computed_once(spark, monkeypatch):
    seen, whole = spark.sparkContext.accumulator(0), ngram_join.signatures

    def counted(reps):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return whole(reps.mapInArrow(run, reps.schema))

    monkeypatch.setattr(ngram_join, "signatures", counted)
    texts = [prose(i, 60) for i in range(30)]
    ngram_join.similar(table(spark, texts))
    assert seen.value == 30


def test_rules_counts():
    c = dict(zip(rules.COUNTS, rules.counts("a b c a b c # |\nx\nx\n\n\n".encode()), strict=True))
    assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == (10, 10, 2, 1, 6)


def test_rules_and_classifier(spark):
    texts = [*EDGES, *(prose(i, 120) + "." for i in range(120)), *((prose(i, 120)).replace(" ", "%%% ") for i in range(24))]
    labels = spark.createDataFrame([(i, int(i < 128), 0) for i in range(8, len(texts))], "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    kept = by_id(rules.quality_rules(docs, labels))
    assert not kept[0].kept and kept[0].n_words == 0
    assert np.mean([kept[i].kept for i in range(8, 128)]) > 0.9 > 0.3 > np.mean([kept[i].kept for i in range(128, len(texts))])
    scored = by_id(quality_cnn.quality(docs, labels))
    assert len(scored) == len(texts) and all(0 <= r.score <= 1 for r in scored.values())
    held = [r for r in scored.values() if r.held_out and r.doc_id >= 8]
    assert np.mean([(r.predicted == 1) == (r.doc_id < 128) for r in held]) > 0.9


def test_rules_learn_from_all_rows(spark):
    """More rows than 4,096 grow the forest and more labels than 8,192 set the threshold, whatever the partitions."""
    rng = np.random.default_rng(3)
    texts = [" ".join(WORDS[k] for k in rng.integers(0, rng.integers(4, 40), rng.integers(52, 60))) + "." * int(rng.integers(0, 9)) for _ in range(9_000)]
    docs = table(spark, texts)
    good = rng.random(len(texts)) < 0.6
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    got, again = by_id(rules.quality_rules(docs, labels)), by_id(rules.quality_rules(docs.repartition(7), labels))
    x = rules.features(np.array([rules.counts(t.encode()) for t in texts]))
    forest = rules.Forest(len(x)).grow(lambda f: f.spans([x]))
    score = np.array([got[i].anomaly for i in range(len(x))])
    assert np.allclose(score, forest.score(x), rtol=1e-9) and all(got[i] == again[i] for i in got)
    failed = np.array([got[i].base_failed for i in range(len(x))])
    cut = rules.threshold(score[~failed], good[~failed], rules.KEEP_COST)
    assert [got[i].kept for i in range(len(x))] == list(~failed & (score <= cut)) and 0 < np.mean([r.kept for r in got.values()]) < 1
    # Leaves count every row in every tree.
    leaves = np.concatenate([np.bincount(forest.place(x, r), minlength=len(forest.feature))[None] for r in range(forest.roots)])
    assert (leaves.sum(1) == len(x)).all() and not leaves[:, forest.feature >= 0].any()


def test_cnn_pieces():
    model = quality_cnn.Model()
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 2048, quality_cnn.BLOCK - 3, quality_cnn.BLOCK, 3 * quality_cnn.BLOCK + 1234):
        text = rng.integers(97, 123, size).astype(np.uint8).tobytes()
        assert np.allclose(model.pooled([text])[0][0], model.long_features(text), atol=1e-5)
    assert len(model.score([b"a", text, b"", b"b" * 300_000, text])) == 5


def test_cnn_gradients():
    model = quality_cnn.Model()
    texts, y = [b"abcabcabcabc" * 9, b"zzzz", b""], np.array([1, 0, 1], np.float32)

    def loss():
        p = model.score(texts)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    before = loss()
    for k, g in model.gradients(texts, y).items():
        model.p[k] = (model.p[k] - 0.05 * g).astype(np.float32)
    assert loss() < before


def test_html():
    weights = html_extract.Weights().fit(html_extract.example_pages())
    pages = html_extract.example_pages(60, seed=77)
    assert np.mean([html_extract.extract(p, weights) == text for p, text in pages]) > 0.8
    assert html_extract.extract("", weights) == "" and html_extract.extract("<p>a &amp; b<br>c", weights) == "a & b c"
    prose_of = " ".join(f"real word{i}" for i in range(30))
    # Layouts beyond the generator's: a control that never ends, and stray words that only the scan leaves out.
    assert html_extract.extract(f"<form><select><option>x<article><p>{prose_of}</p></article>", weights) == prose_of
    stray = f"<div class=content><p>Two words</p></div><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two three four five six seven eight</a></li></ul></nav><article><p>{prose_of}</p><div class=ad><p>Buy it all now</p></div><p>The end of it is here now.</p></article>"
    assert html_extract.extract(stray, weights) == f"{prose_of}\n\nThe end of it is here now."
    every = [t for t, f, _ in html_extract.walk(stray) if t and weights.score(f) > 0]
    assert "Two words" in every
    assert html_extract.extract("<nav><p>" + prose_of, weights) == prose_of


def test_line_dedup(spark):
    a = "\n".join(prose(i, 12) for i in range(6))
    b = "\n".join([prose(50, 12), *a.split("\n")[2:5], prose(51, 12)])
    docs = table(spark, [a, b, None, "", a, "short\nlines", "short\nlines"])
    got = by_id(line_dedup.dedup_lines(docs.withColumn("removed", F.lit(1)).withColumn("h", F.lit(2))))
    assert got[0].text == a and got[1].removed == [1, 2, 3] and got[1].text.split("\n") == [prose(50, 12), prose(51, 12)]
    assert got[2].text is None and got[4].text == "" and got[6].n_removed == 0


def test_patience():
    assert line_dedup.patience(list("abcd"), list("abxcd")) == [(0, 0), (1, 1), (2, 3), (3, 4)]


def test_substring_dedup(spark):
    passage = ". ".join(prose(i, 20).capitalize() for i in range(4)) + "."
    docs = table(spark, ["Start here now. " + passage, "Other words stand here first. " + passage + " And some end to it all.", None, "", passage])
    got = by_id(substring_dedup.remove_repeats(docs))
    assert got[0].n_removed == 0 and got[1].n_removed == 4 and got[4].text.strip() == ""
    text = "Other words stand here first. " + passage + " And some end to it all."
    assert "".join(text[r.start : r.end] for r in got[1].removed) == passage
    assert got[2].text == "" == got[3].text


def test_lm(spark):
    texts = [*EDGES, *(prose(i, 40) for i in range(60))]
    docs = table(spark, texts)
    got = by_id(lm_score.lm_scores(docs, PIECES, table_words=5))
    rows = {r.doc_id: r.held for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held")).collect()}
    split = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    counts = {}
    for i, w in split.items():
        if not rows[i]:
            for x in [*w, None]:
                counts[x] = counts.get(x, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for i, w in split.items():
        base = sum(np.log10((counts.get(x, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for x in [*w, None])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rows[i], len(w) + 1, sum(x in counts for x in [*w, None]), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    model = lm_score.Model(np.minimum(np.arange(32000), lm_score.RANKS - 1).astype(np.int32))
    model.set_bigrams(np.ones((lm_score.RANKS, lm_score.RANKS)), np.ones(32000))
    known = lm_score.Subwords(PIECES)
    texts = [prose(1, 40), "", prose(2, 47)]
    own, _, ends = model.unit_logs(known, *known.split(texts))
    alone = [model.unit_logs(known, *known.split([t])) for t in texts]
    assert np.allclose(own, np.concatenate([x for x, _, _ in alone]), rtol=1e-3) and np.allclose(ends, np.concatenate([x for _, _, x in alone]), rtol=1e-3)
    # Trimmed caches give the same.
    known.shares = {lm_score.MARK + "w1": 0.5, lm_score.MARK + "w3": 0.1}
    known.clear()
    before = [x.tolist() for x in known.ids(*known.split(texts))]
    known.trim()
    assert len(known.at) == 2 and [x.tolist() for x in known.ids(*known.split(texts))] == before
    # Padding rows have equal logits, wherever they stand.
    x = model.rank[np.full((3, lm_score.BLOCK), lm_score.END)]
    z, _ = model.forward(x)
    assert np.allclose(z[0], z[1], atol=1e-4)
    assert np.allclose(lm_score.mixed(np.log([0.5, 0.5]), np.array([0.25, 0.0]), 0.5, 0.1), np.log([0.375, 0.5 * 0.55]))


def test_lm_counts_all_training_texts(spark, monkeypatch):
    import sentencepiece

    texts = [*EDGES, *(prose(i, 40) for i in range(60))]
    docs = table(spark, texts)
    got, whole = [], lm_score.Model.set_bigrams
    monkeypatch.setattr(lm_score.Model, "set_bigrams", lambda m, p, s: (got.append((m.rank, p.copy(), s.copy())), whole(m, p, s))[1])
    lm_score.lm_scores(docs, PIECES, sample_rows=3, sample_ids=100)
    rank, pairs, singles = got[-1]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n, two = np.zeros(len(rank)), np.zeros((lm_score.RANKS, lm_score.RANKS))
    for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect():
        ids = [*sp.encode(r.text or ""), lm_score.END]
        np.add.at(n, ids, 1)
        whole = "".join(lm_score.UNIT.findall((lm_score.MARK + r.text).replace(" ", lm_score.MARK))) if r.text else ""
        starts, at = set(), 0
        for u in lm_score.UNIT.findall(whole):
            starts.add(at)
            at += len(sp.encode("\n" + u)) - len(sp.encode("\n"))
        assert at == len(ids) - 1
        before = [lm_score.END if i in starts or i == at else ids[i - 1] for i in range(len(ids))]
        np.add.at(two, (rank[before], rank[ids]), 1)
    assert (singles == n).all() and (pairs == two).all()


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    """Each training text but the tenth trains the attention, however many there are; the layout of the table is without effect."""
    docs = table(spark, [*EDGES, *(prose(i, 40) for i in range(60))])
    monkeypatch.setattr(lm_score, "PART_BYTES", 2_000)
    monkeypatch.setattr(lm_score, "LEAST_IDS", 0)
    mean = lm_score._mean
    targets = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in mean(batches):
            targets.add(b.column(1)[0].as_py())
            yield b

    monkeypatch.setattr(lm_score, "_mean", counted)
    got = by_id(lm_score.lm_scores(docs, PIECES))
    known, train = lm_score.Subwords(PIECES), docs.filter(F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    texts = [r.text or "" for r in train.filter(lm_score.place_of() % 10 != 0).collect()]
    ids, sizes = known.encode(texts)
    assert targets.value == len(ids) + len(sizes)
    again = by_id(lm_score.lm_scores(docs.repartition(7, "text"), PIECES))
    assert all(np.isclose(got[i].score, again[i].score, rtol=1e-5) for i in got)
    # A weight of the greatest likelihood, as by trying many.
    r = np.exp(np.random.default_rng(1).normal(0.1, 1, 3_000)).astype(np.float32)
    w = np.linspace(0.02, 0.98, 2_000)
    best = w[np.argmax([np.log(x * r + 1 - x).sum() for x in w])]
    assert abs(lm_score.likeliest(spark.createDataFrame([(bytearray(x.tobytes()),) for x in np.split(r, 3)], "r binary")) - best) < 1e-3


def test_lm_parts_and_rounds_are_even(spark):
    """Places of 63 bits spread over all parts and rounds."""
    places = spark.range(20_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("place"))
    got = places.select(*lm_score._digits(8, 12)).groupBy("part", "round").count().collect()
    assert len(got) == 96 and min(r["count"] for r in got) > 120


def test_lm_units_of_bytes():
    """cut() gives the units of the pattern; words are looked at only where they are scored."""
    mark = lm_score.MARK
    texts = [*(t or "" for t in EDGES), "", " ", "\n", "a", " a", "a  b", "a \n b\n\nc ", f"x{mark}y {mark} z\n{mark}\n", "\ta\r\n é\u3000ü ", prose(3, 40), "  ", "\n a"]
    want = [lm_score.UNIT.findall((mark + t).replace(" ", mark)) if t else [] for t in texts]
    units, sizes = lm_score.cut([t.encode() for t in texts])
    assert lm_score.names_of(units) == [u for w in want for u in w] and sizes.tolist() == [len(w) for w in want]
    known = lm_score.Subwords(PIECES)
    ids, _ = known.encode(texts)
    assert ids.tolist() == [i for t in texts for i in known.sp.encode(t)] and not len(known.words)
    known.facts()
    assert len(known.words) == len(known.share) == len(known.at)


def test_lm_gradients():
    """Against small steps of the parameters; logits of any size are borne."""
    rank = np.minimum(np.arange(32000), lm_score.RANKS - 1).astype(np.int32)
    model = lm_score.Model(rank)
    rng = np.random.default_rng(3)
    ids, sizes = rng.integers(3, 300, 700).astype(np.int32), np.array([300, 0, 400])
    inputs, targets, scored, _ = lm_score.layout(ids, sizes)
    x, y = rank[inputs], np.where(targets >= 0, np.minimum(rank[np.maximum(targets, 0)], lm_score.HEAD - 1), -1)
    y[~scored] = -1
    y = y[1:].reshape(-1)
    model.p = {n: v.astype(np.float64) for n, v in model.p.items()}
    for n, v in model.p.items():
        _, g = model.gradients(x, y)
        way = rng.normal(0, 1, v.shape)
        losses = []
        for step in (1e-3, -2e-3):
            v += step * way
            losses.append(model.gradients(x, y)[0])
        v += 1e-3 * way
        assert abs((losses[0] - losses[1]) / 2e-3 - (g[n] * way).sum()) < 2e-3 * (1 + abs((g[n] * way).sum())), n
    model = lm_score.Model(rank)
    model.p["b3"][:5] = 300
    loss, g = model.gradients(x, y)
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


def test_lm_sample_is_random(spark, monkeypatch):
    texts = [f"{c}{c} {prose(i, 40)}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)]
    got = []
    monkeypatch.setattr(lm_score.Model, "fit", lambda m, ids, sizes: got.append((ids, sizes)))
    docs = table(spark, texts)
    lm_score.sample_model(docs, PIECES, 4_000, 4_000)
    lm_score.sample_model(docs.repartition(7, "text"), PIECES, 4_000, 4_000)
    (ids, sizes), (again, _) = got
    sp = lm_score.subwords(PIECES).sp
    firsts = [sp.decode(x.tolist())[0] for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert 10 < len(firsts) < 60 and min(firsts) < "h" and max(firsts) > "s" and (ids == again).all()


def test_substring_dedup_short_units(spark):
    verse = "Rain falls.\nThe sea calls.\nNo one hears.\nOnly stones."
    long = "A sentence of more than five words."
    docs = table(spark, [verse, verse, f"Own words here.\n{verse}\n{long}", f"{long} The end.", f"Ah. {long} The end.", "Tiny.", "tiny.", "Ha. " * 12])
    got = by_id(substring_dedup.remove_repeats(docs, least_run=1))
    assert got[0].text == verse and got[1].text == "" and got[2].text.split() == f"Own words here. {long}".split()
    assert got[3].text.strip() == "The end." and got[4].text.strip() == "Ah."
    assert (got[5].text, got[6].text, got[7].text.split()) == ("Tiny.", "", ["Ha."] * 5)


def test_line_dedup_repeats_and_order(spark):
    x, y, z = prose(1, 12), prose(2, 12), prose(3, 12)
    verse = "one two three\n\nfour five six\nseven eight nine"
    docs = table(spark, [f"{x}\n{y}\nshort end", f"own\n{x}\nmid\n{x}\nlast", f"{y}\nshort end\n{z}\n{x}", verse, f"other\n{verse}\nthings", verse.replace("six", "6")])
    got = by_id(line_dedup.dedup_lines(docs))
    assert [got[i].text for i in range(6)] == [f"{x}\n{y}\nshort end", "own\nmid\nlast", z, verse, "other\nthings", verse.replace("six", "6")]


def test_patience_without_unique_lines():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = ([int(v) for v in rng.integers(0, 3, rng.integers(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        got = sorted(line_dedup.subsequence(a, b, 0, len(a), 0, len(b)))
        assert len(got) == best[-1, -1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
    assert line_dedup.patience(list("xpxp"), list("pxpx")) != []
