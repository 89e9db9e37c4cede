"""The engine's queries over the driver's tables, each one relational text for both engines.

Texts stay map-side: tokens and similarity terms are array expressions; only keys, ids and numbers are shuffled.
Claims are a stated query set, small beside the corpus, so joins of claims and texts broadcast them where their size is
known to allow it. Rankings keep rows by a window's row number, which the planner limits before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from attestor.operators.experiments import CALIBRATION, EVALUATION, NEGATIVE
from attestor.plans.dialect import Duck, Spark, folded, normal, quoted, stem, tokens

PLANS: dict[str, tuple[Callable[[Spark], str], tuple[str, ...]]] = {}


def plan(*tables: str) -> Callable:
    def add(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
        PLANS[f.__name__] = (f, tables)
        return f

    return add


def spans_cte(d: Spark) -> str:
    """Spark reads the parser's spans as a view; the other engine builds them in SQL (documents hold no fences, headings or tables)."""
    if d.name == "spark":
        return ""
    return r"""
line AS (SELECT doc_id::VARCHAR AS document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
placed AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t, coalesce(sum(length(raw) + 1) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM line),
flagged AS (SELECT *, t <> '' AND (coalesce(lag(t) OVER (PARTITION BY document_id ORDER BY k), '') = '' OR regexp_matches(t, '^[-*+]\s')) AS opens FROM placed),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY document_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS seg FROM flagged),
block AS (SELECT document_id, seg, string_agg(t, ' ' ORDER BY k) AS joined, min(a) AS char_start, max(a + length(raw)) AS char_end FROM numbered WHERE t <> '' GROUP BY document_id, seg),
valued AS (SELECT document_id, seg, char_start, char_end, CASE WHEN regexp_matches(joined, '^[-*+]\s') THEN 'bullet' ELSE 'paragraph' END AS kind, regexp_replace(joined, '^[-*+]\s+', '') AS text FROM block),
parts AS (SELECT *, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9`])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM valued),
pieces AS (SELECT document_id, seg, unnest(p) AS text, unnest(range(1, len(p) + 1)) AS n, char_start AS base, text AS whole FROM parts WHERE len(p) > 1),
every AS (
  SELECT document_id, seg, 0 AS n, kind, text, char_start::INT AS char_start, char_end::INT AS char_end FROM valued
  UNION ALL SELECT document_id, seg, n, 'sentence', text,
    (base + coalesce(sum(length(text)) OVER before, 0) + n - 1)::INT, (base + coalesce(sum(length(text)) OVER before, 0) + n - 1 + length(text))::INT
  FROM pieces WINDOW before AS (PARTITION BY document_id, seg ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seg, n)::INT AS ordinal FROM every),
named AS (SELECT *, document_id || ':s' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS span_id FROM ranked),
spans AS (
  SELECT span_id, document_id, kind, text, ordinal, CASE WHEN n > 0 THEN first_value(span_id) OVER (PARTITION BY document_id, seg ORDER BY n) END AS parent_id,
    lag(span_id) OVER (PARTITION BY document_id ORDER BY ordinal) AS previous_id, lead(span_id) OVER (PARTITION BY document_id ORDER BY ordinal) AS next_id, char_start, char_end
  FROM named),
"""


def with_spans(d: Spark, rest: str) -> str:
    return f"WITH {spans_cte(d)} {rest}"


# ---- texts

@plan("documents")
def txt_normalize(d):
    return f"SELECT doc_id, {d.sha(normal(d, 'text'))} AS normal_sha, {d.sha(folded(d, 'text'))} AS folded_sha, cast(length({normal(d, 'text')}) as bigint) AS n_chars_normal FROM documents"


@plan("documents")
def txt_tokens(d):
    return f"""WITH t AS (SELECT doc_id, {tokens(d, 'text')} AS ts FROM documents)
SELECT doc_id, {d.size('ts')} AS n_tokens, {d.size(d.distinct('ts'))} AS n_distinct, {d.sha(d.joined('ts', ' '))} AS tokens_sha FROM t"""


@plan("documents")
def txt_token_counts(d):
    return f"""WITH t AS (SELECT doc_id, lang, {tokens(d, 'text')} AS ts FROM documents), e AS (SELECT lang, x FROM {d.exploded('t', 'ts')} q)
SELECT lang, x AS token, count(*) AS n FROM e GROUP BY lang, x"""


@plan("benchmark")
def txt_char_ngrams(d):
    return f"""WITH n AS (SELECT item_id, {normal(d, 'text')} AS s FROM benchmark), g AS (SELECT item_id, {d.grams('s', 4)} AS gs FROM n WHERE s <> '')
SELECT item_id, x AS gram, count(*) AS n FROM (SELECT item_id, x FROM {d.exploded('g', 'gs')} q) e GROUP BY item_id, x"""


@plan("benchmark")
def txt_facet_words(d):
    words = d.only(d.each(d.split("text", r"\s+"), lambda x: d.replace(x, r"^[.,;:!?()]+|[.,;:!?()]+$")), lambda x: f"length({x}) > 3")
    return f"SELECT item_id, {d.joined(d.head(d.distinct(words), 4) if d.name == 'spark' else words, '|') if d.name == 'spark' else _first_distinct(words)} AS facet FROM benchmark"


def _first_distinct(words: str) -> str:
    """The other engine's distinct has no order: keep an item where it stands first."""
    return f"array_to_string(list_filter({words}, lambda w, i: list_position({words}, w) = i)[1:4], '|')"


def times(d: Spark, items: str, t: str) -> str:
    return d.size(d.only(items, lambda y: f"{y} = {t}", "y"))


def cosine(d: Spark, a: str, b: str) -> str:
    """Of two arrays as bags of words."""
    dot = d.total(d.each(d.distinct(a), lambda t: f"cast({times(d, a, t)} * {times(d, b, t)} as double)", "t"))
    norm = lambda v: f"sqrt({d.total(d.each(d.distinct(v), lambda t: f'cast({times(d, v, t)} * {times(d, v, t)} as double)', 't'))})"
    return f"coalesce(least(1e0, {dot} / nullif({norm(a)} * {norm(b)}, 0)), 0e0)"


def exact(d: Spark, a: str, b: str) -> str:
    """The share of a's words of three letters or more that b has."""
    long = d.only(a, lambda t: f"length({t}) > 2", "t")
    return f"coalesce(cast({d.size(d.only(long, lambda t: d.contains(b, t), 't'))} as double) / nullif({d.size(long)}, 0), 0e0)"


#: A claim's cases: the documents that hold its text.
CASES = "cases AS (SELECT b.item_id AS claim_id, b.text AS claim, d.doc_id, cast(d.doc_id as varchar(20)) AS document_id FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0)"


@plan("documents", "benchmark", "spans", "ranked")
def sim_soft(d):
    """0.48 token cosine, 0.18 token Jaccard, 0.20 cosine of 4-grams, 0.14 share of the claim's words, for each claim and the spans of its documents."""
    grams = lambda s: d.grams(normal(d, s), 4)
    union = f"({d.size(d.distinct('lt'))} + {d.size(d.distinct('rt'))} - {d.size(d.common('lt', 'rt'))})"
    return with_spans(d, f"""{ranked(d)}, pairs AS (SELECT c.claim_id, s.span_id, {tokens(d, 'c.claim')} AS lt, {tokens(d, 's.text')} AS rt, {grams('c.claim')} AS lg, {grams('s.text')} AS rg FROM cases c JOIN spans s ON s.document_id = c.document_id)
SELECT claim_id, span_id, round(0.48e0 * {cosine(d, 'lt', 'rt')} + 0.18e0 * coalesce(cast({d.size(d.common('lt', 'rt'))} as double) / nullif({union}, 0), 0e0) + 0.20e0 * {cosine(d, 'lg', 'rg')} + 0.14e0 * {exact(d, 'lt', 'rt')}, 6) AS similarity,
round({exact(d, 'lt', 'rt')}, 6) AS exact_phrase FROM pairs""")


@plan("embeddings")
def mdl_embedding_topk(d):
    """Every vector whose id is divisible by 20 against all others, in one broadcast of the query set where its size allows."""
    norm = lambda v: f"sqrt({d.dot(v, v)})"
    return f"""WITH e AS (SELECT vec_id, embedding AS v, {norm('embedding')} AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(-1.0, {d.dot('q.v', 'e.v')} / (q.n * e.n)), 6) AS score FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT query_id, vec_id, greatest(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, cast(score as double) AS score, cast(rank as bigint) AS rank FROM r WHERE rank <= 10"""


# ---- spans

@plan("documents", "spans")
def prs_spans(d):
    return with_spans(d, "last AS (SELECT 1 AS one) SELECT span_id, document_id, kind, text, ordinal, parent_id, previous_id, next_id, char_start, char_end FROM spans")


@plan("documents", "spans")
def prs_kind_counts(d):
    return with_spans(d, "last AS (SELECT 1 AS one) SELECT kind, count(*) AS n, count(DISTINCT document_id) AS n_documents, min(length(text)) AS shortest, max(length(text)) AS longest FROM spans GROUP BY kind")


@plan("documents", "spans")
def prs_empty_documents(d):
    return with_spans(d, "last AS (SELECT 1 AS one) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.document_id = cast(d.doc_id as varchar(20)))")


# ---- claims

@plan("benchmark")
def int_anchors(d):
    raw = d.split("lower(text)", "[^a-z0-9]+")
    kept = d.only(tokens(d, "text"), lambda x: f"length({x}) > 3 AND {x} NOT IN ({quoted(['not', 'never', 'without'])})")
    first = f"slice(array_distinct({kept}), 1, 8)" if d.name == "spark" else f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)[1:8]"
    return f"SELECT item_id, trim(text) AS label, {d.joined(first, '|')} AS anchors, {d.size(raw)} AS n_words, {d.matches('lower(text)', chr(92) + 'bitself' + chr(92) + 'b')} AS indirect FROM benchmark"


@plan("benchmark")
def int_dedupe(d):
    return "SELECT item_id, text FROM (SELECT item_id, text, row_number() OVER (PARTITION BY lower(text) ORDER BY item_id) AS k FROM benchmark) t WHERE k = 1"


# ---- quantities: sentences rendered from orders and lineitem

ORDERS = "said AS (SELECT o_orderkey AS k, concat('Order ', o_orderkey, ' was created on ', {day}, ' and price is $', cast(cast(o_totalprice as decimal(18,2)) as varchar(30)), '.') AS text FROM orders)"


@plan("orders")
def qnt_money_date(d):
    return f"""WITH {ORDERS.format(day=d.day('o_orderdate'))},
f AS (SELECT k, {d.extract('text', r'\$([0-9][0-9,]*(?:\.[0-9]+)?)', 1)} AS money, {d.extract('text', r'\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1)} AS day FROM said)
SELECT k, cast(replace(money[{0 if d.name == 'spark' else 1}], ',', '') as double) AS usd, cast(datediff({'' if d.name == 'spark' else "'day', DATE '0001-01-01', "}cast(day[{0 if d.name == 'spark' else 1}] as date){", DATE '0001-01-01'" if d.name == 'spark' else ''}) + 1 as double) AS ordinal, day[{0 if d.name == 'spark' else 1}] AS normalized FROM f"""


@plan("lineitem", "orders")
def qnt_score(d):
    """Required quantities of a claim against those observed in its order's lines: an equality join on the order, a comparison by operator, then one row a claim."""
    return f"""WITH need AS (SELECT o_orderkey AS claim, cast(o_custkey % 50 + 1 as double) AS value, CASE o_custkey % 5 WHEN 0 THEN 'gte' WHEN 1 THEN 'lte' WHEN 2 THEN 'gt' WHEN 3 THEN 'lt' ELSE 'eq' END AS op FROM orders),
seen AS (SELECT l_orderkey AS claim, l_quantity AS value FROM lineitem),
met AS (SELECT n.claim, n.op, s.value IS NOT NULL AS found, CASE n.op WHEN 'gte' THEN s.value >= n.value WHEN 'lte' THEN s.value <= n.value WHEN 'gt' THEN s.value > n.value WHEN 'lt' THEN s.value < n.value ELSE s.value = n.value END AS ok FROM need n LEFT JOIN seen s ON s.claim = n.claim)
SELECT claim, op, count(CASE WHEN found THEN 1 END) AS n_seen, CASE WHEN max(CASE WHEN ok THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.0 END AS coverage, CASE WHEN max(CASE WHEN found THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN ok THEN 1 ELSE 0 END) = 0 THEN 1.0 ELSE 0.0 END AS mismatch,
max(CASE WHEN found THEN 0 ELSE 1 END) = 1 AS missing FROM met GROUP BY claim, op""".replace("THEN 1.0", "THEN cast(1 as double)").replace("ELSE 0.0", "ELSE cast(0 as double)")


# ---- ranking and labels

def scored(d: Spark) -> str:
    """Claims against all spans that share a token with them, by the share of the claim's tokens: the first 30 as `top`. Spark has them from one pass over the spans."""
    return f"""ct AS (SELECT item_id AS claim_id, {d.distinct(tokens(d, 'text'))} AS ts FROM benchmark), cn AS (SELECT claim_id, {d.size('ts')} AS n FROM ct), ce AS (SELECT claim_id, x FROM {d.exploded('ct', 'ts')} q),
st AS (SELECT span_id, document_id, ordinal, parent_id, {d.distinct(tokens(d, 'text'))} AS ts FROM spans), se AS (SELECT span_id, document_id, ordinal, parent_id, x FROM {d.exploded('st', 'ts')} q),
met AS (SELECT ce.claim_id, se.span_id, se.document_id, se.ordinal, se.parent_id, count(*) AS k FROM se JOIN ce ON se.x = ce.x GROUP BY ce.claim_id, se.span_id, se.document_id, se.ordinal, se.parent_id),
scored AS (SELECT met.*, round(cast(k as double) / n, 4) AS score FROM met JOIN cn ON cn.claim_id = met.claim_id),
labelled AS (SELECT *, {BY_SHARE} AS label FROM scored),
prior AS (SELECT *, max(CASE WHEN label = 'supports' THEN 1 ELSE 0 END) OVER (PARTITION BY claim_id) AS has_support, CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS fine FROM labelled),
ranks AS (SELECT claim_id, span_id, document_id, ordinal, parent_id, label, score, row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN has_support = 1 THEN CASE WHEN label = 'supports' THEN 1 ELSE 0 END WHEN label = 'near_miss' THEN 1 ELSE 0 END DESC, score DESC, fine DESC, document_id, ordinal) AS rank FROM prior),
top AS (SELECT * FROM ranks WHERE rank <= 30)"""


BY_SHARE = "CASE WHEN score >= 0.55 THEN 'supports' WHEN score >= 0.55 * 0.82 THEN 'near_miss' ELSE 'reject' END"
#: `top` from `met`, the first 30 spans of each claim: where labels follow the score, their order is the score's.
TOP = f"scored AS (SELECT *, round(cast(k as double) / n, 4) AS score FROM met), top AS (SELECT claim_id, span_id, document_id, ordinal, parent_id, {BY_SHARE} AS label, score, rank FROM scored)"


GOLD = "gold AS (SELECT DISTINCT c.claim_id, s.span_id FROM cases c JOIN spans s ON s.document_id = c.document_id WHERE instr(s.text, c.claim) > 0)"


def ranked(d: Spark) -> str:
    """cases, top and gold (views that were written once, on Spark), then the matches: the first span of each family, three at most."""
    before = "" if d.name == "spark" else f"{CASES}, {scored(d)}, {GOLD}, "
    return f"""{before}family AS (SELECT *, row_number() OVER (PARTITION BY claim_id, coalesce(parent_id, span_id) ORDER BY rank) AS f FROM top WHERE label = 'supports'),
matches AS (SELECT claim_id, span_id, place FROM (SELECT claim_id, span_id, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS place FROM family WHERE f = 1) m WHERE place <= 3)"""


@plan("documents", "benchmark", "spans", "ranked")
def rnk_keyword_candidates(d):
    return with_spans(d, f"{ranked(d)} SELECT claim_id, span_id, label, score, cast(rank as bigint) AS rank FROM top WHERE rank <= 20")


@plan("documents", "benchmark", "spans", "ranked")
def win_matches(d):
    return with_spans(d, f"{ranked(d)} SELECT claim_id, span_id, cast(place as bigint) AS place FROM matches")


@plan("documents", "benchmark", "spans", "ranked")
def agg_case_evaluation(d):
    return with_spans(d, f"""{ranked(d)},
best AS (SELECT t.claim_id, min(CASE WHEN g.span_id IS NOT NULL THEN t.rank END) AS first_rank FROM top t LEFT JOIN gold g ON g.claim_id = t.claim_id AND g.span_id = t.span_id GROUP BY t.claim_id),
golds AS (SELECT claim_id, count(*) AS n FROM gold GROUP BY claim_id), won AS (SELECT claim_id, count(*) AS n FROM matches GROUP BY claim_id)
SELECT b.item_id AS claim_id, coalesce(g.n, 0) AS n_gold, cast(x.first_rank as bigint) AS first_rank, coalesce(w.n, 0) = 0 AS abstained, (coalesce(w.n, 0) = 0) = (g.n IS NULL) AS decision_correct
FROM benchmark b LEFT JOIN best x ON x.claim_id = b.item_id LEFT JOIN golds g ON g.claim_id = b.item_id LEFT JOIN won w ON w.claim_id = b.item_id""")


@plan("documents", "benchmark", "spans", "ranked")
def agg_evaluation(d):
    rate = lambda c: f"round(coalesce(cast(count(CASE WHEN {c} THEN 1 END) as double) / nullif(count(CASE WHEN n_gold > 0 THEN 1 END), 0), 0), 4)"
    return with_spans(d, f"""{ranked(d)},
best AS (SELECT t.claim_id, min(CASE WHEN g.span_id IS NOT NULL THEN t.rank END) AS first_rank FROM top t LEFT JOIN gold g ON g.claim_id = t.claim_id AND g.span_id = t.span_id GROUP BY t.claim_id),
golds AS (SELECT claim_id, count(*) AS n FROM gold GROUP BY claim_id), won AS (SELECT claim_id, count(*) AS n FROM matches GROUP BY claim_id),
cases2 AS (SELECT b.item_id, coalesce(g.n, 0) AS n_gold, x.first_rank AS r, coalesce(w.n, 0) AS n_won FROM benchmark b LEFT JOIN best x ON x.claim_id = b.item_id LEFT JOIN golds g ON g.claim_id = b.item_id LEFT JOIN won w ON w.claim_id = b.item_id)
SELECT count(*) AS n_cases, count(CASE WHEN n_gold > 0 THEN 1 END) AS n_support, {rate('n_gold > 0 AND r <= 1')} AS recall_1, {rate('n_gold > 0 AND r <= 3')} AS recall_3, {rate('n_gold > 0 AND r <= 5')} AS recall_5,
round(coalesce(sum(CASE WHEN n_gold > 0 THEN coalesce(1.0 / r, 0.0) END) / nullif(count(CASE WHEN n_gold > 0 THEN 1 END), 0), 0), 4) AS mrr,
round(coalesce(cast(count(CASE WHEN n_gold = 0 AND n_won = 0 THEN 1 END) as double) / nullif(count(CASE WHEN n_gold = 0 THEN 1 END), 0), 1), 4) AS abstain_accuracy,
round(cast(count(CASE WHEN (n_won = 0) = (n_gold = 0) THEN 1 END) as double) / count(*), 4) AS decision_accuracy FROM cases2""".replace("coalesce(1.0 / r, 0.0)", "coalesce(cast(1 as double) / r, cast(0 as double))"))


@plan("documents", "benchmark", "spans", "ranked")
def agg_calibration(d):
    """Nineteen thresholds replayed over the candidates once scored, and which of them decides best (the lowest of equals)."""
    grid = "(SELECT x / 20.0 AS t, x AS step FROM (SELECT explode(sequence(1, 19)) AS x) g)" if d.name == "spark" else "(SELECT x / 20.0 AS t, x AS step FROM (SELECT unnest(range(1, 20)) AS x) g)"
    return with_spans(d, f"""{ranked(d)},
replayed AS (SELECT g.step, cast(g.t as double) AS t, b.item_id AS claim_id FROM benchmark b CROSS JOIN {grid} g),
top_score AS (SELECT claim_id, max(score) AS s FROM top GROUP BY claim_id), golds AS (SELECT DISTINCT claim_id FROM gold),
judged AS (SELECT p.step, p.t, coalesce(s.s, -1) >= p.t AS claims_support, g.claim_id IS NOT NULL AS has_gold FROM replayed p LEFT JOIN top_score s ON s.claim_id = p.claim_id LEFT JOIN golds g ON g.claim_id = p.claim_id),
report AS (SELECT step, t, count(*) AS n, count(CASE WHEN claims_support = has_gold THEN 1 END) AS n_correct, count(CASE WHEN claims_support AND NOT has_gold THEN 1 END) AS n_false FROM judged GROUP BY step, t)
SELECT t AS threshold, n, n_correct, n_false, row_number() OVER (ORDER BY n_correct DESC, step) = 1 AS best FROM report""")


def measured(d: Spark, text: str) -> str:
    """The keyword ranker under the measures: gold support are spans that hold the claim; the spans after them are near misses, and forbidden."""
    kinded = """kinded AS (SELECT claim_id, span_id, 'support' AS gold FROM gold UNION ALL
SELECT DISTINCT g.claim_id, s.next_id, k.gold FROM gold g JOIN spans s ON s.span_id = g.span_id LEFT JOIN gold h ON h.claim_id = g.claim_id AND h.span_id = s.next_id
  CROSS JOIN (SELECT 'near_miss' AS gold UNION ALL SELECT 'forbidden') k WHERE h.span_id IS NULL AND s.next_id IS NOT NULL)"""
    grid = "SELECT explode(sequence(1, 19)) AS step" if d.name == "spark" else "SELECT unnest(range(1, 20)) AS step"
    return with_spans(d, f"{ranked(d)}, {kinded}, asked AS (SELECT item_id AS claim_id FROM benchmark), cand AS (SELECT * FROM top), steps AS ({grid}), {text.replace('FROM gold)', 'FROM kinded)')}")


@plan("documents", "benchmark", "spans", "ranked")
def agg_measures(d):
    return measured(d, EVALUATION)


@plan("documents", "benchmark", "spans", "ranked")
def agg_negative_rates(d):
    return measured(d, NEGATIVE)


@plan("documents", "benchmark", "spans", "ranked")
def agg_replay(d):
    """All measures at each threshold, without scoring again, and the best by seven keys."""
    return measured(d, CALIBRATION)


@plan("documents", "benchmark", "spans", "ranked")
def exp_relabelled(d):
    """Labels and matches by a calibrated threshold, in the candidates' order."""
    return with_spans(d, f"""{ranked(d)}, r AS (SELECT claim_id, span_id, parent_id, rank, CASE WHEN label = 'contradicts' THEN label WHEN score >= 0.7 THEN 'supports' WHEN score >= 0.7 * 0.82 THEN 'near_miss' ELSE 'reject' END AS label FROM top),
f AS (SELECT claim_id, span_id, row_number() OVER (PARTITION BY claim_id, coalesce(parent_id, span_id) ORDER BY rank) AS f FROM r WHERE label = 'supports')
SELECT r.claim_id, r.span_id, r.label, coalesce(f.f = 1, false) AS first_of_family FROM r LEFT JOIN f ON f.claim_id = r.claim_id AND f.span_id = r.span_id""")


@plan("documents", "benchmark", "spans", "ranked")
def mdl_bm25(d):
    """BM25 over the spans of each case's document, scaled by the case's greatest score."""
    return with_spans(d, f"""{ranked(d)},
bs AS (SELECT s.span_id, s.document_id, {tokens(d, 's.text')} AS ts FROM spans s WHERE EXISTS (SELECT 1 FROM cases c WHERE c.document_id = s.document_id)),
lens AS (SELECT document_id, span_id, {d.size('ts')} AS n FROM bs), stats AS (SELECT document_id, count(*) AS spans_n, avg(cast(n as double)) AS mean FROM lens GROUP BY document_id),
tf AS (SELECT document_id, span_id, x, count(*) AS k FROM (SELECT document_id, span_id, x FROM {d.exploded('bs', 'ts')} q) e GROUP BY document_id, span_id, x),
df AS (SELECT document_id, x, count(*) AS k FROM tf GROUP BY document_id, x),
bt AS (SELECT claim_id, document_id, {d.distinct(tokens(d, 'claim'))} AS ts FROM cases), be AS (SELECT claim_id, document_id, x FROM {d.exploded('bt', 'ts')} q),
raw AS (SELECT be.claim_id, tf.span_id, sum(ln(1 + (s.spans_n - df.k + 0.5) / (df.k + 0.5)) * (tf.k * 2.5) / (tf.k + 1.5 * (1 - 0.75 + 0.75 * l.n / s.mean))) AS v
  FROM be JOIN tf ON tf.document_id = be.document_id AND tf.x = be.x JOIN df ON df.document_id = tf.document_id AND df.x = tf.x JOIN stats s ON s.document_id = tf.document_id JOIN lens l ON l.document_id = tf.document_id AND l.span_id = tf.span_id GROUP BY be.claim_id, tf.document_id, tf.span_id)
SELECT claim_id, span_id, round(v / max(v) OVER (PARTITION BY claim_id, {'substring_index(span_id, ' + chr(39) + ':' + chr(39) + ', 1)' if d.name == 'spark' else 'split_part(span_id, ' + chr(39) + ':' + chr(39) + ', 1)'}), 6) AS score FROM raw""".replace("0.5)", "0.5e0)").replace("2.5)", "2.5e0)").replace("1.5 *", "1.5e0 *").replace("0.75", "0.75e0"))


@plan("documents", "benchmark", "spans", "ranked")
def win_weak_matches(d):
    """Selection by id alone: siblings may both be chosen, a parent only where no supporting child ranks before it."""
    return with_spans(d, f"""{ranked(d)}, s AS (SELECT * FROM top WHERE label = 'supports'),
kept AS (SELECT p.claim_id, p.span_id, p.rank FROM s p WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.claim_id = p.claim_id AND c.parent_id = p.span_id AND c.rank < p.rank))
SELECT claim_id, span_id, place FROM (SELECT claim_id, span_id, cast(row_number() OVER (PARTITION BY claim_id ORDER BY rank) as bigint) AS place FROM kept) k WHERE place <= 3""")


@plan("documents", "benchmark", "spans", "ranked")
def expl_candidates(d):
    """Every candidate with its score, and whether it is gold and was selected."""
    return with_spans(d, f"""{ranked(d)}
SELECT t.claim_id, t.span_id, cast(t.rank as bigint) AS rank, t.label, t.score, g.span_id IS NOT NULL AS gold, m.span_id IS NOT NULL AS selected
FROM top t LEFT JOIN gold g ON g.claim_id = t.claim_id AND g.span_id = t.span_id LEFT JOIN matches m ON m.claim_id = t.claim_id AND m.span_id = t.span_id""")


@plan("documents", "benchmark", "spans", "ranked")
def agg_negative_labels(d):
    """For each negative label, zero rows included: claims that have it, and how often its first span tops the ranking or is selected."""
    return with_spans(d, f"""{ranked(d)}, kinds AS (SELECT 'near_miss' AS label UNION ALL SELECT 'contradicts' UNION ALL SELECT 'insufficient_context'),
neg AS (SELECT t.claim_id, t.span_id, t.label, t.rank FROM top t WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.claim_id = t.claim_id AND g.span_id = t.span_id))
SELECT k.label, count(DISTINCT n.claim_id) AS n_cases, count(n.span_id) AS n_spans, count(CASE WHEN n.rank = 1 THEN 1 END) AS n_top1, count(m.span_id) AS n_selected
FROM kinds k LEFT JOIN neg n ON n.label = k.label LEFT JOIN matches m ON m.claim_id = n.claim_id AND m.span_id = n.span_id GROUP BY k.label""")


@plan("documents", "benchmark", "spans", "ranked")
def jdg_requests(d):
    """One request for each claim and labelled span: gold spans, and the first three others under their label."""
    return with_spans(d, f"""{ranked(d)}, neg AS (SELECT claim_id, span_id, label, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS k FROM (SELECT t.* FROM top t WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.claim_id = t.claim_id AND g.span_id = t.span_id)) x),
wanted AS (SELECT claim_id, span_id, 'supports' AS expected FROM gold UNION SELECT claim_id, span_id, label FROM neg WHERE k <= 3)
SELECT {d.sha("concat(cast(w.claim_id as varchar(20)), ':', w.span_id)")} AS request_id, w.claim_id, w.span_id, w.expected, {d.sha('s.text')} AS source_hash FROM wanted w JOIN spans s ON s.span_id = w.span_id""")


def features() -> str:
    """Feature rows from the events: every rung of the ladder occurs."""
    f = lambda name, prime, scale: f"cast((event_id * {prime}) % 101 as double) / {scale} AS {name}"
    return "f AS (SELECT event_id, " + ", ".join([f("score", 37, 100), f("direct", 53, 100), f("context", 71, 100), f("coverage", 29, 100), f("facet", 83, 100), f("relation", 13, 100), f("mismatch", 17, 100), f("contradiction", 43, 100), f("span_negated", 61, 100), f("intent_negated", 67, 100),
        "event_id % 7 = 0 AS unwanted", "event_id % 11 < 2 AS quantified", "event_id % 13 < 2 AS quantity_off", "event_id % 17 = 3 AS only_not", "event_id % 19 < 2 AS unclear", "event_id % 23 < 3 AS counter", "event_id % 29 < 4 AS denies", "event_id % 31 < 20 AS span_denies", "event_id % 6 AS anchors"]) + " FROM events)"


@plan("events")
def lbl_threshold(d):
    return f"""WITH {features()} SELECT event_id, CASE WHEN counter THEN 'contradicts' WHEN score >= 0.6 THEN 'supports' WHEN score >= 0.6 * 0.82 THEN 'near_miss' ELSE 'reject' END AS label,
round(greatest(0e0, least(1e0, 0.36e0 * mismatch + 0.34e0 * contradiction)) * CASE WHEN span_negated > 0 AND intent_negated > 0 THEN 0.35e0 ELSE 1e0 END, 6) AS polarity_penalty, round(1e0 / (1e0 + exp(-(score - 0.5e0) * 8)), 6) AS sigmoid FROM f"""


# ---- caches, judges, audits

@plan("events")
def mdl_cache(d):
    """The last write of each key, then which of the asked pairs it holds."""
    key = d.sha("concat('{\"document_sha256\":\"', " + d.sha("cast(user_id as varchar(20))") + ", '\",\"query_sha256\":\"', " + d.sha("event_type") + ", '\"}')")
    return f"""WITH log AS (SELECT {key} AS id, value, ts, event_id FROM events WHERE event_id % 3 <> 0),
kept AS (SELECT id, value FROM (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS k FROM log) x WHERE k = 1),
asked AS (SELECT {key} AS id, count(*) AS times FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT a.id, a.times, k.value AS score, k.id IS NOT NULL AS hit FROM asked a LEFT JOIN kept k ON k.id = a.id"""



@plan("documents", "labels")
def agg_suite_audit(d):
    return """WITH c AS (SELECT d.doc_id, d.source, d.lang, CASE l.quality WHEN 1 THEN 'reviewed' WHEN 0 THEN 'rejected' ELSE 'unreviewed' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS dimension, coalesce(source, lang, status, 'all') AS value, count(*) AS n, count(DISTINCT doc_id) AS n_documents
FROM c GROUP BY GROUPING SETS ((source), (lang), (status), ())"""


@plan("labels", "documents")
def agg_sweep(d):
    grid = "(SELECT explode(sequence(1, 19)) AS step)" if d.name == "spark" else "(SELECT unnest(range(1, 20)) AS step)"
    return f"""WITH s AS (SELECT l.doc_id, l.quality, least(1e0, length(d.text) / 2000e0) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
j AS (SELECT step, quality = 1 AS good, score >= step / 20e0 AS called FROM s CROSS JOIN {grid} g),
c AS (SELECT step, count(*) AS n, count(CASE WHEN good AND called THEN 1 END) AS tp, count(CASE WHEN called THEN 1 END) AS called, count(CASE WHEN good THEN 1 END) AS good, count(CASE WHEN good = called THEN 1 END) AS same FROM j GROUP BY step)
SELECT cast(step as bigint) AS step, round(cast(same as double) / n, 6) AS accuracy, round(coalesce(cast(tp as double) / nullif(called, 0), 0), 6) AS precision, round(coalesce(cast(tp as double) / nullif(good, 0), 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(called + good, 0), 0), 6) AS f1 FROM c"""


def queue(d: Spark) -> str:
    anchors = d.only(d.distinct(tokens(d, "text")), lambda x: f"length({x}) >= 3")
    return f"""c AS (SELECT span_id, document_id, kind, text, ordinal, {folded(d, 'text')} AS same, {d.size(anchors)} AS n_anchors FROM spans WHERE kind IN ('bullet', 'sentence', 'table_row') AND length(text) BETWEEN 30 AND 500),
own AS (SELECT *, row_number() OVER (PARTITION BY document_id, same ORDER BY ordinal) AS k FROM c WHERE n_anchors > 0),
first AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS n FROM own WHERE k = 1),
queued AS (SELECT span_id, document_id, kind, text, same, n_anchors FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY document_id, ordinal) AS g FROM first WHERE n <= 40) x WHERE g = 1)"""


@plan("documents", "spans")
def cur_queue(d):
    return with_spans(d, f"{queue(d)} SELECT span_id, document_id, kind, text, n_anchors, 'unreviewed' AS review_status FROM queued")


@plan("documents", "spans")
def agg_curation_audit(d):
    return with_spans(d, f"""{queue(d)}, per AS (SELECT document_id, count(*) AS n FROM queued GROUP BY document_id), sums AS (SELECT count(*) AS n_documents, max(n) AS most FROM per)
SELECT count(*) AS n_items, count(CASE WHEN kind = 'sentence' THEN 1 END) AS n_sentences, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(cast(length(text) as double)), 4) AS mean_length, count(*) - count(DISTINCT same) AS n_surplus,
max(sums.n_documents) AS n_documents, round(cast(max(sums.most) as double) / count(*), 6) AS largest_share FROM queued CROSS JOIN sums""")



@plan("documents", "benchmark", "spans", "ranked")
def trn_pairs(d):
    return with_spans(d, f"""{ranked(d)},
neg AS (SELECT claim_id, span_id, label, score, rank, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS k FROM (SELECT t.* FROM top t WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.claim_id = t.claim_id AND g.span_id = t.span_id)) x),
scale AS (SELECT 'supports' AS label, cast(1 as double) AS target UNION ALL SELECT 'near_miss', cast(0.35 as double) UNION ALL SELECT 'reject', cast(0 as double))
SELECT p.claim_id, p.span_id, p.label, s.target FROM (SELECT claim_id, span_id, 'supports' AS label FROM gold UNION ALL SELECT claim_id, span_id, CASE WHEN label = 'supports' THEN 'near_miss' ELSE label END FROM neg WHERE k <= 3) p JOIN scale s ON s.label = p.label""")


@plan("documents", "benchmark", "spans", "ranked")
def agg_failures(d):
    return with_spans(d, f"""{ranked(d)}, golds AS (SELECT DISTINCT claim_id FROM gold), won AS (SELECT m.claim_id, min(CASE WHEN g.span_id IS NULL THEN 0 ELSE 1 END) AS all_gold FROM matches m LEFT JOIN gold g ON g.claim_id = m.claim_id AND g.span_id = m.span_id GROUP BY m.claim_id),
b AS (SELECT CASE WHEN g.claim_id IS NOT NULL AND w.claim_id IS NULL THEN 'missed_support' WHEN g.claim_id IS NULL AND w.claim_id IS NOT NULL THEN 'false_support' WHEN w.all_gold = 0 THEN 'wrong_span' ELSE 'correct' END AS bucket FROM benchmark b LEFT JOIN golds g ON g.claim_id = b.item_id LEFT JOIN won w ON w.claim_id = b.item_id)
SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")


@plan("documents", "benchmark", "labels")
def val_violations(d):
    return """SELECT 'label without document' AS rule, cast(l.doc_id as bigint) AS id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'document repeats an id', doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'wrong length', doc_id FROM documents WHERE length(text) <> n_chars
UNION ALL SELECT 'empty claim', item_id FROM benchmark WHERE trim(text) = ''
UNION ALL SELECT 'quality out of range', doc_id FROM labels WHERE quality NOT IN (0, 1)"""


@plan("documents", "labels")
def set_operations(d):
    return """WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels)
SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) x UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) y UNION ALL SELECT 'repeated', doc_id FROM (SELECT doc_id FROM (SELECT doc_id FROM b UNION ALL SELECT doc_id FROM b) z GROUP BY doc_id HAVING count(*) > 2) w"""


@plan("documents")
def src_document_ids(d):
    """Ids from paths: runs of other characters become one mark, and repeats get their number."""
    slug = d.replace("lower(concat(source, '/', lang, '.md'))", "[^a-z0-9]+", "_")
    return f"""WITH p AS (SELECT doc_id, {slug} AS slug FROM documents), n AS (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS k FROM p)
SELECT doc_id, CASE WHEN k = 1 THEN slug ELSE concat(slug, '_', k) END AS document_id FROM n"""


@plan("documents")
def agg_split_overlap(d):
    return """WITH s AS (SELECT DISTINCT source AS split, md5(text) AS t FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM s a JOIN s b ON a.t = b.t AND a.split < b.split GROUP BY a.split, b.split"""


def oracle(name: str) -> str:
    return PLANS[name][0](Duck())
