"""DuckDB SQL fragments used by the oracle queries (independent re-statements of the
Spark operators in plain SQL)."""
from __future__ import annotations

WORD = r"\p{L}\p{N}\p{M}_"


def clean(expr: str, lower: bool = False, strip_nl: bool = True) -> str:
    e = f"replace({expr}, chr(10), '')" if strip_nl else expr
    if lower:
        e = f"lower({e})"
    e = f"replace({e}, '''', ' ')"
    e = f"regexp_replace({e}, '&lt;/?.*?&gt;', '&lt;&gt;', 'g')"
    return f"regexp_replace({e}, '[^{WORD} ]', '', 'g')"


def question(expr: str) -> str:
    c = clean(expr)
    return f"(CASE WHEN length({c}) = 0 THEN ' ' ELSE {c} END)"


def lemmas(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, '[{WORD}]+'), lambda t: lower(t))"


# (id, pos, lemma) of the cleaned documents; pos is 0-based
DOC_TOKENS = f"""
doc_tok AS (
  SELECT doc_id AS id, lang, u.pos - 1 AS pos, u.lemma
  FROM (SELECT doc_id, lang, {lemmas(question('text'))} AS lems FROM documents) d,
       LATERAL (SELECT generate_subscripts(d.lems, 1) AS pos, unnest(d.lems) AS lemma) u
)"""

DOC_TOKENS_SIMPLE = f"""
doc_tok AS (
  SELECT doc_id AS id, lang, unnest({lemmas(question('text'))}) AS lemma FROM documents
)"""

BG_FREQ = """
bg AS (
  SELECT lemma, count(*) AS cnt, count(*) / (SELECT count(*) FROM doc_tok)::DOUBLE AS freq
  FROM doc_tok GROUP BY lemma
)"""

N_DOCS = "ndocs AS (SELECT count(*) AS n FROM documents)"

KEYWORDS = """
kw AS (
  SELECT lemma AS keyword, row_number() OVER (ORDER BY df, lemma) AS kw_pos FROM (
    SELECT lemma, count(DISTINCT id) AS df FROM doc_tok WHERE length(lemma) >= 4 GROUP BY lemma
  ) WHERE df >= 0.01 * (SELECT n FROM ndocs) AND df <= 0.2 * (SELECT n FROM ndocs)
  ORDER BY df, lemma LIMIT 20
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def stop_list_cte(seed: list[str], keep: list[str]) -> str:
    seed_sql = ", ".join(f"('{w}')" for w in seed)
    keep_sql = ", ".join(f"('{w}')" for w in keep)
    return f"""
stop AS (
  (SELECT lemma FROM (
     SELECT lemma, row_number() OVER (PARTITION BY lang ORDER BY df DESC, lemma) AS rn FROM (
       SELECT lang, lemma, count(DISTINCT id) AS df FROM doc_tok GROUP BY lang, lemma)) WHERE rn <= 30
   UNION SELECT w FROM (VALUES {seed_sql}) s(w))
  EXCEPT SELECT w FROM (VALUES {keep_sql}) k(w)
)"""


def greedy_sql(rounds: int = 12) -> list[str]:
    """CTEs for the unrolled greedy oracle; expects doc_tok, bg, ndocs, stop."""
    ctes = ["""
post AS (SELECT DISTINCT id, lemma FROM doc_tok)""", """
bnd AS (SELECT greatest(ceil(0.08 * n), 2) AS lo, ceil(0.2 * n) AS hi FROM ndocs)""", """
elig AS (
  SELECT p.lemma, bg.freq FROM (SELECT lemma, count(*) AS df FROM post GROUP BY lemma) p JOIN bg USING (lemma)
  WHERE p.df >= (SELECT lo FROM bnd) AND bg.freq > 0 AND bg.freq < 1 AND p.lemma <> '-PRON-'
    AND p.lemma NOT IN (SELECT lemma FROM stop))""", """
ep AS (SELECT id, lemma FROM post WHERE lemma IN (SELECT lemma FROM elig))""", """
a0 AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS kw WHERE false)"""]
    for r in range(1, rounds + 1):
        ctes.append(f"""
k{r} AS (
  SELECT s.lemma FROM (SELECT lemma, count(*) AS size FROM ep WHERE id NOT IN (SELECT id FROM a{r-1}) GROUP BY lemma) s
  JOIN elig e USING (lemma)
  WHERE s.size >= (SELECT lo FROM bnd) AND s.size <= (SELECT hi FROM bnd)
  ORDER BY e.freq, s.lemma LIMIT 1)""")
        ctes.append(f"""
a{r} AS (
  SELECT id, kw FROM a{r-1}
  UNION ALL
  SELECT DISTINCT ep.id, ep.lemma AS kw FROM ep JOIN k{r} USING (lemma) WHERE ep.id NOT IN (SELECT id FROM a{r-1}))""")
    return ctes


def nb_terms(src: str, id_expr: str, text_expr: str) -> str:
    """Word 1..3-grams after stop-word removal (expects CTE stopl(l))."""
    return f"""
SELECT {id_expr} AS id, unnest(list_concat(t,
    list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
    list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term
FROM (SELECT {id_expr}, list_filter(regexp_extract_all(lower({text_expr}), '[{WORD}]{{2,}}'),
                                    lambda x: NOT list_contains(stopl.l, x)) AS t FROM {src}, stopl)"""


NB2_CTES = [
    "stopl AS (SELECT list(lemma) AS l FROM stop)",
    f"qterms AS ({nb_terms('documents', 'doc_id', 'text')})",
    "tf AS (SELECT id, term, count(*) AS tf FROM qterms GROUP BY id, term)",
    "dfx AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) <= 0.4 * (SELECT n FROM ndocs))",
    "idf AS (SELECT term, ln((1 + (SELECT n FROM ndocs)) / (1 + df)::DOUBLE) + 1 AS idf FROM dfx)",
    "x0 AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term))",
    "X AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x0)",
    "Ff AS (SELECT term, sum(w) AS Ff FROM X GROUP BY term)",
    "tot AS (SELECT sum(w) AS sF, count(DISTINCT term) AS V FROM X)",
    """Xc AS (SELECT d.doc_id AS id, coalesce(s.Xc, 0.0) AS Xc FROM documents d
          LEFT JOIN (SELECT id, sum(w) AS Xc FROM X GROUP BY id) s ON s.id = d.doc_id)""",
    f"kterms AS ({nb_terms('kw', 'keyword', 'keyword')})",
    "ktf AS (SELECT id AS keyword, term, count(*) AS tf FROM kterms GROUP BY id, term)",
    "kq0 AS (SELECT keyword, term, (1 + ln(tf)) * idf AS q FROM ktf JOIN idf USING (term))",
    "kq AS (SELECT keyword, term, q / sqrt(sum(q * q) OVER (PARTITION BY keyword)) AS q FROM kq0)",
    """kst AS (SELECT k.keyword, coalesce(s.K, 0.0) AS K, coalesce(s.c, 0.0) AS c FROM kw k LEFT JOIN
          (SELECT keyword, sum(q) AS K, sum(q * ln(Ff + 1)) AS c FROM kq JOIN Ff USING (term) GROUP BY keyword) s
          ON s.keyword = k.keyword)""",
    """corr AS (SELECT kq.keyword, X.id, sum(kq.q * (ln(Ff.Ff + 1) - ln(Ff.Ff + 1 - X.w))) AS corr
          FROM kq JOIN X USING (term) JOIN Ff USING (term) GROUP BY kq.keyword, X.id)""",
    """sc AS (SELECT a.keyword, a.id, a.K, a.score + coalesce(corr.corr, 0.0) AS score FROM
          (SELECT kst.keyword, Xc.id, kst.K, kst.K * ln(tot.sF + tot.V - Xc.Xc) - kst.c AS score FROM kst, Xc, tot) a
          LEFT JOIN corr ON corr.keyword = a.keyword AND corr.id = a.id)""",
    "pr AS (SELECT keyword, id, K, exp(score - max(score) OVER (PARTITION BY keyword)) AS e FROM sc)",
    "p AS (SELECT keyword, id, K, e / sum(e) OVER (PARTITION BY keyword) AS p FROM pr)",
    "th AS (SELECT keyword, stddev_pop(p) + median(p) + var_pop(p) AS thr, max(K) AS K FROM p GROUP BY keyword)",
    """kept AS (SELECT p.id, p.keyword, p.p, kw.kw_pos FROM p JOIN th USING (keyword) JOIN kw USING (keyword)
          WHERE p.p > th.thr AND th.K > 0)""",
    """best AS (SELECT id, keyword FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, kw_pos) AS rn
          FROM kept) WHERE rn = 1)""",
]


def upper_sql(x: str) -> str:
    # Java (and Python) upper-case the German sharp s to "SS", DuckDB to the capital sharp s
    return f"replace(upper({x}), 'ẞ', 'SS')"


LABEL_LISTS = f"""
ll AS (SELECT doc_id AS id, source AS cluster_id,
  list_transform(list_filter(list_transform(regexp_extract_all(text, '[{WORD}]+'), lambda t: lower(t)),
                             lambda x: NOT list_contains(stopl.l, x)), lambda t: {upper_sql('t')}) AS l
  FROM documents, stopl)"""

GRAMS_1 = "g1 AS (SELECT DISTINCT id, unnest(l) AS gram FROM ll)"
GRAMS_2 = "g2 AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS gram FROM ll)"


def contingency_sql(g: str) -> list[str]:
    return [
        "mem AS (SELECT doc_id AS id, source AS cluster_id FROM documents)",
        f"n11_{g} AS (SELECT cluster_id, gram, count(*) AS n11 FROM {g} JOIN mem USING (id) GROUP BY cluster_id, gram)",
        f"n1_{g} AS (SELECT gram, count(*) AS n1 FROM {g} GROUP BY gram)",
        "nc AS (SELECT cluster_id, count(*) AS nc FROM mem GROUP BY cluster_id)",
        f"""cont_{g} AS (SELECT cluster_id, gram, n11, n1, nc, (SELECT count(*) FROM mem) AS N
           FROM n11_{g} JOIN n1_{g} USING (gram) JOIN nc USING (cluster_id))""",
    ]


def nmi_expr() -> str:
    def plogp(p):
        return f"(CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0.0 END)"

    def term(pxy, px, py):
        return f"(CASE WHEN {pxy} > 0 THEN {pxy} * log2({pxy} / ({px} * {py})) ELSE 0.0 END)"

    N = "N::DOUBLE"
    p11, p10, p01 = f"(n11 / {N})", f"((n1 - n11) / {N})", f"((nc - n11) / {N})"
    p00 = f"((N - n1 - nc + n11) / {N})"
    pt1, pt0, pu1, pu0 = f"(n1 / {N})", f"(1 - n1 / {N})", f"(nc / {N})", f"(1 - nc / {N})"
    info = " + ".join([term(p00, pt0, pu0), term(p01, pt0, pu1), term(p10, pt1, pu0), term(p11, pt1, pu1)])
    h = f"(-({plogp(pt0)} + {plogp(pt1)}) - ({plogp(pu0)} + {plogp(pu1)}))"
    v = f"(CASE WHEN ({info}) <> 0 AND {h} <> 0 THEN 2 * ({info}) / {h} ELSE 0.0 END)"
    sign = f"(CASE WHEN n11 / n1::DOUBLE < nc / {N} THEN -1.0 ELSE 1.0 END)"
    return f"(CASE WHEN n11 > 0 THEN {v} * {sign} ELSE 0.0 END)"


def label_rule_sql(src: str) -> str:
    """A-12 over a table (cluster_id, L1..L4)."""
    def g(x):
        return f"(CASE WHEN instr({x}, ' ') > 0 THEN 2 ELSE 1 END)"

    def inn(a, b):
        return f"(instr({b}, {a}) > 0)"

    in4 = "list_filter([L1, L2, L3], lambda x: instr(L4, x) > 0)"
    in3 = "list_filter([L1, L2], lambda x: instr(L3, x) > 0)"
    case1 = f"""CASE WHEN NOT {inn('L1', 'L2')} THEN [L1, L2] WHEN {g('L3')} = 2 THEN [L2, L3]
        WHEN NOT {inn('L3', 'L2')} THEN [L2, L3] ELSE [L2, L4] END"""
    case2 = f"""CASE WHEN {g('L3')} = 1 AND {g('L4')} = 1 THEN [L1, L2]
        WHEN {g('L3')} = 1 AND len({in4}) = 0 THEN [L1, L2]
        WHEN {g('L3')} = 1 THEN list_filter([L1, L2, L3, L4], lambda x: NOT list_contains({in4}, x))
        WHEN len({in3}) = 0 THEN [L1, L2]
        WHEN len({in3}) = 1 THEN list_filter([L1, L2, L3], lambda x: NOT list_contains({in3}, x))
        ELSE [L3, L4] END"""
    case3 = f"""CASE WHEN NOT {inn('L2', 'L1')} THEN [L1, L2] WHEN {g('L3')} = 2 THEN [L1, L3]
        WHEN NOT {inn('L3', 'L1')} THEN [L1, L3] ELSE [L1, L4] END"""
    res = f"""CASE WHEN {g('L1')} = 1 AND {g('L2')} = 2 THEN {case1}
        WHEN {g('L1')} = 1 AND {g('L2')} = 1 THEN {case2}
        WHEN {g('L1')} = 2 AND {g('L2')} = 1 THEN {case3}
        ELSE [L1, L2] END"""
    return f"SELECT cluster_id, array_to_string(list_filter({res}, lambda x: x IS NOT NULL), ' , ') AS labels FROM {src}"


def textrank_sql(rounds: int = 10) -> list[str]:
    """CTEs for the unrolled text-rank oracle over documents clustered by source
    (expects stopl(l))."""
    ctes = [f"""
sw AS (SELECT d.source AS cluster_id, d.doc_id AS id, u.sent - 1 AS sent,
              list_filter(list_transform(regexp_extract_all(u.s, '[{WORD}]+'), lambda t: lower(t)),
                          lambda x: NOT list_contains(stopl.l, x)) AS w
       FROM documents d, stopl,
            LATERAL (SELECT generate_subscripts(string_split_regex(d.text, '[.!?]+\\s+'), 1) AS sent,
                            unnest(string_split_regex(d.text, '[.!?]+\\s+')) AS s) u)""", """
occ AS (SELECT cluster_id, id, sent, u.pos - 1 AS pos, u.word FROM sw,
        LATERAL (SELECT generate_subscripts(sw.w, 1) AS pos, unnest(sw.w) AS word) u)""", """
vocab AS (SELECT cluster_id, word, min({'id': id, 'sent': sent, 'pos': pos}) AS first FROM occ GROUP BY cluster_id, word)""", """
pr AS (SELECT DISTINCT cluster_id, p.a, p.b FROM
       (SELECT cluster_id, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS p FROM sw))""", """
gg AS (SELECT cluster_id, src, dst, count(*)::DOUBLE AS g FROM
       (SELECT cluster_id, a AS src, b AS dst FROM pr UNION ALL SELECT cluster_id, b, a FROM pr WHERE a <> b)
       GROUP BY cluster_id, src, dst)""", """
edges AS (SELECT cluster_id, src, dst, g / sum(g) OVER (PARTITION BY cluster_id, dst) AS g FROM gg)""", """
r0 AS (SELECT cluster_id, word, 1.0::DOUBLE AS r FROM vocab)""", """
s0 AS (SELECT DISTINCT cluster_id, 0.0::DOUBLE AS s FROM vocab)"""]
    for t in range(1, rounds + 1):
        ctes.append(f"""
r{t} AS (SELECT v.cluster_id, v.word, 0.15 + 0.85 * coalesce(c.gr, 0.0) AS r FROM vocab v LEFT JOIN
         (SELECT e.cluster_id, e.src, sum(e.g * p.r) AS gr FROM edges e
          JOIN r{t-1} p ON p.cluster_id = e.cluster_id AND p.word = e.dst GROUP BY e.cluster_id, e.src) c
         ON c.cluster_id = v.cluster_id AND c.src = v.word)""")
        ctes.append(f"s{t} AS (SELECT cluster_id, sum(r) AS s FROM r{t} GROUP BY cluster_id)")
    stop_terms = " ".join(
        f"WHEN abs(s{t-1}.s - s{t}.s) < 1e-5 THEN {t}" for t in range(1, rounds + 1))
    joins = " ".join(f"JOIN s{t} USING (cluster_id)" for t in range(1, rounds + 1))
    ctes.append(f"stopr AS (SELECT cluster_id, CASE {stop_terms} ELSE {rounds} END AS T FROM s0 {joins})")
    union = " UNION ALL ".join(f"SELECT {t} AS t, cluster_id, word, r FROM r{t}" for t in range(1, rounds + 1))
    ctes.append(f"rall AS ({union})")
    ctes.append("""final AS (SELECT a.cluster_id, a.word, a.r, v.first FROM rall a JOIN stopr s ON s.cluster_id = a.cluster_id
        AND s.T = a.t JOIN vocab v ON v.cluster_id = a.cluster_id AND v.word = a.word)""")
    ctes.append("""best AS (SELECT cluster_id, word FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
        ORDER BY round(r, 9) DESC, first.id DESC, first.sent DESC, first.pos DESC) AS rn FROM final) WHERE rn = 1)""")
    return ctes


# Ward clustering of wp (corpus, a, b, d2), a < b, over the points wn (corpus, id): one merge a round and corpus,
# the pair of the lowest squared height by (height, a, b); the distances from the merged cluster follow by
# Lance-Williams.  wm: merges in order; wl: the root of each point after every step.
WARD_CTES = ["""
ws AS (
  SELECT corpus, 0 AS step, a, b, d2, 1 AS na, 1 AS nb FROM wp
  UNION ALL
  SELECT corpus, any_value(step) + 1, a, b,
         CASE WHEN bool_or(hit) THEN (sum((nk + nm) * d2) - any_value(nk) * any_value(dm)) / (sum(nm) + any_value(nk)) ELSE any_value(d2) END,
         CASE WHEN bool_or(hit AND m_first) THEN sum(nm) ELSE any_value(na) END::INT,
         CASE WHEN bool_or(hit AND NOT m_first) THEN sum(nm) ELSE any_value(nb) END::INT
  FROM (SELECT corpus, step, least(x, y) AS a, greatest(x, y) AS b, d2, dm, hit, CASE WHEN a_in THEN x < y ELSE y < x END AS m_first,
               CASE WHEN a_in THEN nb ELSE na END AS nk, CASE WHEN a_in THEN na ELSE nb END AS nm,
               CASE WHEN x < y THEN na ELSE nb END AS na, CASE WHEN x < y THEN nb ELSE na END AS nb
        FROM (SELECT s.corpus, s.step, s.d2, s.na, s.nb, p.m.d2 AS dm, s.a IN (p.m.a, p.m.b) AS a_in,
                     s.a IN (p.m.a, p.m.b) OR s.b IN (p.m.a, p.m.b) AS hit,
                     CASE WHEN s.a = p.m.b THEN p.m.a ELSE s.a END AS x, CASE WHEN s.b = p.m.b THEN p.m.a ELSE s.b END AS y
              FROM ws s JOIN (SELECT corpus, arg_min({'a': a, 'b': b, 'd2': d2}, {'d2': d2, 'a': a, 'b': b}) AS m
                              FROM ws GROUP BY corpus) p ON p.corpus = s.corpus
              WHERE s.a <> p.m.a OR s.b <> p.m.b))
  GROUP BY corpus, a, b)""", """
wm AS (SELECT corpus, step, m.a AS parent, m.b AS child, sqrt(greatest(m.d2, 0)) AS h FROM (
  SELECT corpus, step, arg_min({'a': a, 'b': b, 'd2': d2}, {'d2': d2, 'a': a, 'b': b}) AS m FROM ws GROUP BY corpus, step))""", """
wl AS (SELECT corpus, id, 0 AS step, id AS root FROM wn
       UNION ALL SELECT l.corpus, l.id, l.step + 1, CASE WHEN l.root = m.child THEN m.parent ELSE l.root END
       FROM wl l JOIN wm m ON m.corpus = l.corpus AND m.step = l.step)""", """
wc AS (SELECT corpus, count(*) AS n FROM wn GROUP BY corpus)"""]


def ward_cut(steps: str, columns: str = "", source: str = "wc") -> str:
    """Labels after `steps` merges (an expression over `source` with corpus and n): clusters numbered by their smallest id."""
    return (f"SELECT l.corpus, {columns} l.id, (dense_rank() OVER (PARTITION BY l.corpus, l.step ORDER BY l.root) - 1)::INT AS label "
            f"FROM wl l JOIN {source} c ON c.corpus = l.corpus AND l.step = {steps}")
