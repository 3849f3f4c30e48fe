"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each string runs on the driver's tables registered as views.  Doubles are
compared as ``round(x, 6) + 0.0`` on both sides and counts as BIGINT.
"""

from __future__ import annotations

from ..operators.checks import FORECAST_NOTE


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


def effect_sql(source: str, keys: list[str], x: str, y: str, first: dict[str, str] | None = None,
               first_order: str = "", z: float = 1.98, raw: bool = False) -> str:
    """Two-group effect of ``x`` on ``y`` per ``keys`` over the CTE body ``source``.

    ``first`` maps output name -> source column taken from the first row in
    ``first_order`` order.
    """
    rnd = (lambda e: e) if raw else r6
    k = ", ".join(keys)
    knn = " AND ".join(f"{c} IS NOT NULL" for c in keys) or "TRUE"
    first = first or {}
    first_cte = ""
    first_join = ""
    first_cols = ""
    if first:
        sel = ", ".join(f"{src} AS {name}" for name, src in first.items())
        first_cte = f""",
fr AS (
  SELECT {k}, {", ".join(first)} FROM (
    SELECT {k}, {sel}, row_number() OVER (PARTITION BY {k} ORDER BY {first_order}) AS rn__
    FROM src WHERE {knn}) WHERE rn__ = 1
)"""
        first_join = f" JOIN fr USING ({k})"
        first_cols = ", " + ", ".join(f"fr.{c}" for c in first)
    return f"""
WITH src AS ({source}),
kept AS (
  SELECT {k}, CAST({x} AS DOUBLE) AS x__, CAST({y} AS DOUBLE) AS y__ FROM src WHERE {knn}
),
st AS (
  SELECT {k},
    count(*) FILTER (WHERE ok AND x__ = 1) AS n1, avg(y__) FILTER (WHERE ok AND x__ = 1) AS m1,
    var_samp(y__) FILTER (WHERE ok AND x__ = 1) AS v1,
    count(*) FILTER (WHERE ok AND x__ = 0) AS n0, avg(y__) FILTER (WHERE ok AND x__ = 0) AS m0,
    var_samp(y__) FILTER (WHERE ok AND x__ = 0) AS v0,
    count(*) FILTER (WHERE ok AND x__ <> 0 AND x__ <> 1) AS n_other,
    count(*) FILTER (WHERE ok) AS n
  FROM (SELECT *, (x__ IS NOT NULL AND NOT isnan(x__) AND y__ IS NOT NULL AND NOT isnan(y__)) AS ok FROM kept)
  GROUP BY {k}
),
ef AS (
  SELECT {k}, n,
    CASE WHEN n1 > 0 AND n0 > 0 AND n_other = 0 THEN m1 - m0 END AS coef,
    CASE WHEN n1 > 0 AND n0 > 0 AND n_other = 0 THEN sqrt(v1 / n1 + v0 / n0) END AS se
  FROM st
),
bd AS (SELECT *, coef - {z} * se AS lo, coef + {z} * se AS hi FROM ef){first_cte}
SELECT {", ".join("bd." + c for c in keys)}{first_cols},
  {rnd("coef")} AS coef, {rnd("se")} AS se, CAST(n AS BIGINT) AS n,
  {rnd("lo")} AS ci_low, {rnd("hi")} AS ci_high,
  CASE WHEN lo > 0 THEN 'liberal' WHEN hi < 0 THEN 'conservative' ELSE 'no_effect' END AS direction
FROM bd{first_join}
"""


EFFECT_BY_WORDING_SRC = """
  SELECT p_type, p_brand, p_name, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag IS NOT NULL THEN 0 END AS x,
         l_extendedprice AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

EFFECT_SPARSE_SRC = """
  SELECT lang, source, doc_id, toxic AS x, n_chars AS y
  FROM documents JOIN labels USING (doc_id)"""


# ----------------------------------------------------------------- special functions in SQL

def erfc_sql(x: str) -> str:
    """erfc of a column reference: power series below 2.5, continued fraction above."""
    ax = f"abs({x})"
    series = (f"list_sum(list_transform(range(0, 60), lambda k: exp((2*k+1)*ln(greatest({ax}, 1e-300))"
              f" + k*ln(4.0) + lgamma(k+1) - lgamma(2*k+2))))")
    frac = f"list_reduce(range(80, 0, -1), lambda acc, m: {ax} + (m*0.5)/acc, {ax})"
    pos = (f"(CASE WHEN {ax} < 2.5 THEN 1 - 2/sqrt(pi()) * exp(-{ax}*{ax}) * {series}"
           f" ELSE exp(-{ax}*{ax}) / (sqrt(pi()) * {frac}) END)")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 2 - {pos} ELSE {pos} END)"


def binom_sf_sql(s: str, n: str, p: float = 0.5) -> str:
    """Exact upper tail as the plain sum of probability terms k = s..n."""
    q = 1.0 - p
    terms = (f"list_transform(range(CAST({s} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda k: "
             f"exp(lgamma({n}+1) - lgamma(k+1) - lgamma({n}-k+1) + k*ln({p}) + ({n}-k)*ln({q})))")
    return (f"(CASE WHEN {s} <= 0 THEN 1.0 WHEN {s} > {n} THEN 0.0 "
            f"ELSE least(greatest(coalesce(list_sum({terms}), 0.0), 0.0), 1.0) END)")


CONTINGENCY_SQL = """
  SELECT CAST(user_id % 5 AS BIGINT) AS domain, event_type AS category,
         CAST(count(*) FILTER (WHERE event_id % 2 = 1) AS BIGINT) AS liberal,
         CAST(count(*) FILTER (WHERE event_id % 2 <> 1) AS BIGINT) AS conservative
  FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2"""


def two_proportion_sql() -> str:
    return f"""
WITH c AS ({CONTINGENCY_SQL}),
t AS (
  SELECT r.domain, r.category || '_vs_' || l.category AS comparison,
         r.liberal AS lib_right, r.conservative AS con_right, l.liberal AS lib_left, l.conservative AS con_left
  FROM c r JOIN c l ON r.domain = l.domain AND l.category = 'view' AND r.category <> 'view'
),
s AS (
  SELECT *, CAST(lib_right AS DOUBLE) / nullif(lib_right + con_right, 0) AS pr,
            CAST(lib_left AS DOUBLE) / nullif(lib_left + con_left, 0) AS pl,
            CAST(lib_right + lib_left AS DOUBLE) / nullif(lib_right + con_right + lib_left + con_left, 0) AS pooled
  FROM t
),
z AS (
  SELECT *, (pr - pl) / nullif(sqrt(pooled * (1 - pooled) * (1.0 / nullif(lib_right + con_right, 0)
                                   + 1.0 / nullif(lib_left + con_left, 0))), 0) AS zz
  FROM s
),
p AS (SELECT *, zz / sqrt(2.0) AS zs FROM z)
SELECT domain, comparison, lib_right, con_right, lib_left, con_left,
       {r6("pr")} AS p_right, {r6("pl")} AS p_left, {r6("pr - pl")} AS difference, {r6("zz")} AS z,
       {r6("0.5 * " + erfc_sql("zs"))} AS p_value_greater
FROM p"""


def bar_counts_sql() -> str:
    return f"""
WITH tp AS ({two_proportion_sql()}),
sides AS (
  SELECT domain, comparison, 0 AS side, split_part(comparison, '_vs_', 1) AS category,
         lib_right AS liberal, con_right AS conservative, p_value_greater FROM tp
  UNION ALL
  SELECT domain, comparison, 1, substr(comparison, strpos(comparison, '_vs_') + 4),
         lib_left, con_left, CAST(NULL AS DOUBLE) FROM tp
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, category ORDER BY comparison, side) AS rn
                 FROM sides) WHERE rn = 1
)
SELECT domain, category, CAST(liberal AS BIGINT) AS liberal, CAST(conservative AS BIGINT) AS conservative,
       CAST(liberal + conservative AS BIGINT) AS total,
       {r6("coalesce(CAST(liberal AS DOUBLE) / nullif(liberal + conservative, 0), 0.0)")} AS liberal_share,
       p_value_greater
FROM firsts"""


def bar_segments_sql() -> str:
    return f"""
WITH b AS ({bar_counts_sql()}),
g AS (SELECT *, 'fig' || CAST(domain // 2 AS VARCHAR) AS figure_group FROM b),
fm AS (SELECT figure_group, max(total) AS fig_max FROM g GROUP BY 1),
dm AS (SELECT domain, max(total) AS dom_max FROM g GROUP BY 1)
SELECT g.figure_group, g.domain, category, liberal, conservative, total,
       {r6("liberal / 2.0")} AS liberal_label_y, {r6("liberal + conservative / 2.0")} AS conservative_label_y,
       liberal_share, {r6("coalesce(CAST(conservative AS DOUBLE) / nullif(total, 0), 0.0)")} AS conservative_share,
       coalesce(p_value_greater < 0.05, false) AS star,
       {r6("total + dom_max * 0.035")} AS star_y, {r6("fig_max * 1.14")} AS y_limit
FROM g JOIN fm USING (figure_group) JOIN dm USING (domain)"""


def bar_layout_sql() -> str:
    """Bars in the order of their first test; labels wrapped word by word at 16 characters."""
    return f"""
WITH tp AS ({two_proportion_sql()}),
sides AS (
  SELECT domain, comparison, 0 AS side, split_part(comparison, '_vs_', 1) || '_share_of_all_events' AS category,
         lib_right AS liberal, con_right AS conservative FROM tp
  UNION ALL
  SELECT domain, comparison, 1, substr(comparison, strpos(comparison, '_vs_') + 4), lib_left, con_left FROM tp
),
firsts AS (
  SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY domain, category ORDER BY comparison, side) = 1),
w AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY comparison, side) - 1 AS x_pos,
         list_transform(string_split(category, '_'), lambda x: upper(x[1]) || lower(substr(x, 2))) AS words
  FROM firsts)
SELECT domain, category, CAST(x_pos AS BIGINT) AS x_pos,
  CASE WHEN category = 'view' THEN 'Views' || chr(10) || 'only' ELSE list_reduce(words, lambda a, b:
    a || CASE WHEN length(list_last(string_split(a, chr(10)))) + 1 + length(b) <= 16 THEN ' ' ELSE chr(10) END || b) END
    AS category_label,
  CASE WHEN domain = 3 THEN 'Third domain' ELSE CAST(domain AS VARCHAR) END AS panel_label,
  CASE WHEN liberal > 0 THEN liberal || chr(10) || printf('(%.1f%%)', 100.0 * liberal / (liberal + conservative)) END
    AS liberal_text,
  CASE WHEN conservative > 0 THEN conservative || chr(10) || printf('(%.1f%%)', 100.0 * conservative / (liberal + conservative)) END
    AS conservative_text
FROM w"""


BINOMIAL_COUNTS_SQL = """
  SELECT lang, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total
  FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang"""


def binomial_tail_sql() -> str:
    return f"""
SELECT lang, correct, total, {r6(binom_sf_sql("correct", "total"))} AS p_value_greater
FROM ({BINOMIAL_COUNTS_SQL})"""


# Fixed parameters of the forecast mapping on the driver tables (see queries.py).
FORECAST_BANK_SQL = """
  SELECT * FROM (VALUES ('ECONOMY', 0), ('LARGE', 1), ('MEDIUM', 0), ('PROMO', 1),
                        ('SMALL', CAST(NULL AS INTEGER)), ('STANDARD', 0)) AS b(p_type, reverse_code)"""


def forecast_verdict_sql() -> str:
    eff = effect_sql(EFFECT_BY_WORDING_SRC, ["p_type", "p_brand"], "x", "y")
    return f"""
WITH e AS ({eff}),
j AS (SELECT e.*, b.reverse_code FROM e LEFT JOIN ({FORECAST_BANK_SQL}) b USING (p_type)),
x AS (
  SELECT *, coalesce(CASE lower(p_brand) WHEN 'brand#7' THEN 'conservative' WHEN 'brand#13' THEN 'liberal' END,
                     CASE WHEN reverse_code = 0 THEN 'liberal' WHEN reverse_code = 1 THEN 'conservative' END)
            AS expected_direction
  FROM j
)
SELECT p_type, p_brand, coef, direction, expected_direction,
       CASE WHEN direction = 'no_effect' THEN 'no_effect'
            WHEN direction = expected_direction THEN 'correct' ELSE 'wrong' END
         AS derived_forecast_result
FROM x"""


def forecast_counts_sql() -> str:
    return f"""
WITH f AS ({forecast_verdict_sql()}),
cats AS (SELECT * FROM (VALUES (0, 'correct'), (1, 'wrong'), (2, 'no_effect')) AS c(verdict_no, verdict))
SELECT verdict_no, verdict, CAST(count(f.derived_forecast_result) AS BIGINT) AS n
FROM cats LEFT JOIN f ON f.derived_forecast_result = cats.verdict GROUP BY verdict_no, verdict"""


def forecast_tests_sql() -> str:
    return f"""
WITH f AS ({forecast_verdict_sql()}),
iss AS (
  SELECT p_type, CASE WHEN c > w THEN 'correct' WHEN w > c THEN 'wrong' ELSE 'no_effect' END AS v
  FROM (SELECT p_type, count(*) FILTER (WHERE derived_forecast_result = 'correct') AS c,
               count(*) FILTER (WHERE derived_forecast_result = 'wrong') AS w FROM f GROUP BY p_type)
),
lv AS (
  SELECT 'prompt' AS level, count(*) FILTER (WHERE derived_forecast_result = 'correct') AS c,
         count(*) FILTER (WHERE derived_forecast_result = 'wrong') AS w, count(*) AS t FROM f
  UNION ALL
  SELECT 'issue', count(*) FILTER (WHERE v = 'correct'), count(*) FILTER (WHERE v = 'wrong'), count(*) FROM iss
),
rows AS (
  SELECT level, 'count_null_as_wrong' AS null_handling, CAST(c AS BIGINT) AS correct, CAST(t AS BIGINT) AS total FROM lv
  UNION ALL
  SELECT level, 'exclude_null', CAST(c AS BIGINT), CAST(c + w AS BIGINT) FROM lv
)
SELECT level, null_handling, correct, total, {r6(binom_sf_sql("correct", "total"))} AS p_value_greater,
       CASE WHEN level = 'prompt' THEN 'wordings' ELSE 'majority of the issue''s correct and wrong wordings' END AS rule
FROM rows"""


def forecast_check_sql() -> str:
    return f"""
WITH c AS ({forecast_counts_sql()}),
w AS (SELECT max(n) FILTER (WHERE verdict = 'correct') AS c, max(n) FILTER (WHERE verdict = 'wrong') AS w,
             max(n) FILTER (WHERE verdict = 'no_effect') AS ne FROM c)
SELECT 'forecast_counts' AS "check",
       'correct=' || c || ', wrong=' || w || ', no_effect=' || ne AS observed,
       'correct=112, wrong=9, no_effect=58' AS expected,
       CASE WHEN c = 112 AND w = 9 AND ne = 58 THEN 'pass' ELSE 'review' END AS status
FROM w"""


# ------------------------------------------------------------------ banks and grid

PART_BANK_SQL = """
  SELECT p_partkey AS issue_no, 'What do you think about ' || p_name || '?' AS prompt,
         CASE WHEN p_size % 10 = 0 THEN 'None' ELSE p_brand || ' , ,' || lower(p_type) END AS keywords,
         array_to_string(list_transform(range(p_size % 4, p_size % 4 + 6, 3), lambda x: CAST(x AS VARCHAR)), ' , ')
           AS endings,
         (['', 'good', ' good , bad ', 'good,bad, safe ,dangerous'])[p_size % 4 + 1] AS labels
  FROM part"""


def clean_list_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda s: trim(s)), lambda s: s <> '')"


def nulled_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('None', '') THEN NULL ELSE {c} END"


def list_normalise_sql() -> str:
    cols = []
    for c in ("keywords", "endings", "labels"):
        lst = f"coalesce({clean_list_sql(nulled_sql(c))}, [])"
        cols.append(f"array_to_string({lst}, ',') AS {c}")
        cols.append(f"CAST(len({lst}) AS BIGINT) AS n_{c}")
    return f"SELECT issue_no, {', '.join(cols)} FROM ({PART_BANK_SQL})"


TEMPLATES_SQL = """(VALUES (0, ' My stance on {} is that it is a'), (1, ' In my opinion, {} is a'),
  (2, ' I think {} is a'), (3, ' I believe that {} is a'), (4, ' My personal opinion on {} is that it is a'),
  (5, ' I personally believe {} is a')) AS t(template_no, template)"""


def _intros_sql() -> str:
    from ..operators.prompts import COVID_INTROS
    vals = ", ".join(f"({i}, '{t}')" for i, t in enumerate(COVID_INTROS))
    return f"(VALUES {vals}) AS p(partisanship, intro)"


GRID_LISTS_SQL = f"""
  SELECT issue_no, prompt, labels,
         list_transform({clean_list_sql("endings")}, lambda s: CAST(s AS INTEGER)) AS el,
         coalesce({clean_list_sql(nulled_sql("keywords"))}, []) AS kl
  FROM ({PART_BANK_SQL})"""


def prompt_grid_sql() -> str:
    return f"""
WITH l AS ({GRID_LISTS_SQL}),
e AS (SELECT *, unnest(range(len(el))) AS ending_pos FROM l),
e2 AS (SELECT *, el[ending_pos + 1] AS ending_id FROM e),
k AS (SELECT *, unnest(CASE WHEN len(kl) = 0 THEN [CAST(NULL AS BIGINT)] ELSE range(len(kl)) END) AS keyword_pos FROM e2),
k2 AS (SELECT *, CASE WHEN keyword_pos IS NULL THEN NULL ELSE kl[keyword_pos + 1] END AS keyword FROM k),
w AS (
  SELECT k2.*, replace(template, '{{}}', coalesce(keyword, '')) AS ending,
         row_number() OVER (ORDER BY issue_no, ending_pos, keyword_pos NULLS FIRST) - 1 AS question_no
  FROM k2 JOIN {TEMPLATES_SQL} ON ending_id = template_no
)
SELECT intro || ' ' || prompt || ending AS prompt, prompt AS issue, partisanship, ending, keyword,
       CAST(question_no AS BIGINT) AS question_no, CAST(question_no * 2 + partisanship AS BIGINT) AS prompt_no,
       issue_no, labels
FROM w CROSS JOIN {_intros_sql()}"""


def grid_unknown_templates_sql() -> str:
    return f"""
WITH l AS ({GRID_LISTS_SQL}),
u AS (SELECT DISTINCT issue_no, unnest(el) AS ending_id FROM l)
SELECT issue_no, ending_id FROM u WHERE ending_id NOT IN (SELECT template_no FROM {TEMPLATES_SQL})"""


def axis_plan_sql() -> str:
    lst = f"coalesce({clean_list_sql('labels')}, [])"
    return f"""
SELECT issue_no, array_to_string({lst}, ',') AS labels, coalesce({lst}[1], '') AS positive_anchor,
       coalesce({lst}[2], '') AS negative_anchor,
       'cosine(response, positive_anchor) - cosine(response, negative_anchor)' AS scoring_rule
FROM ({PART_BANK_SQL})"""


# ------------------------------------------------------------------------------ text

def ending_class_sql() -> str:
    from ..functions.text import STRIP_PATTERN
    from .queries import DOC_RULES
    cases = " ".join(f"WHEN strpos(t, '{n}') > 0 THEN '{lab}'" for n, lab in DOC_RULES)
    return f"""
SELECT doc_id, CASE {cases} ELSE regexp_replace(t, '{STRIP_PATTERN}', '', 'g') END AS end_type
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


def _patterns_sql() -> str:
    from ..operators.text import EXTRA_PATTERNS, STUDY_PATTERNS
    vals = ", ".join("('{}', '{}')".format(n, rx.replace("'", "''")) for n, rx in STUDY_PATTERNS + EXTRA_PATTERNS)
    return f"(VALUES {vals}) AS p(pattern, rx)"


def secret_hits_sql() -> str:
    return f"""
SELECT doc_id, pattern, hits FROM (
  SELECT doc_id, pattern, CAST(len(regexp_extract_all(coalesce(text, ''), rx)) AS BIGINT) AS hits
  FROM documents CROSS JOIN {_patterns_sql()}) WHERE hits > 0"""


def secret_scan_sql() -> str:
    return f"""
WITH h AS ({secret_hits_sql()})
SELECT p.pattern, CAST(count(h.doc_id) AS BIGINT) AS n_texts, CAST(coalesce(sum(h.hits), 0) AS BIGINT) AS n_hits
FROM {_patterns_sql()} LEFT JOIN h ON h.pattern = p.pattern GROUP BY p.pattern"""


def labelling_prompts_sql() -> str:
    from ..operators.text import LABEL_PROMPT_TEMPLATE
    tpl = LABEL_PROMPT_TEMPLATE.replace("'", "''")
    return f"""
WITH r AS (
  SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
  FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL
),
ex AS (SELECT lang, string_agg('- ' || text, chr(10) ORDER BY doc_id) AS examples FROM r WHERE rn <= 5 GROUP BY lang)
SELECT lang, replace(replace('{tpl}', '{{cluster}}', lang), '{{examples}}', examples) AS labeling_prompt FROM ex"""


JUSTIFICATION_PROMPTS_SQL = """
SELECT u.conv_id, u.turn,
       coalesce(u.text, 'nan') || ' ' || coalesce(a.text, 'nan') || '. This is because' AS justification_prompt
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


# --------------------------------------------------------------------- ranks and checks

FIRST_SEEN_RANK_SQL = """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY first_id) AS BIGINT) AS first_seen_rank
FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY coalesce(event_type, '')) AS first_id FROM events)"""

SUMMARY_COUNTS_SQL = """
SELECT 'conversations' AS dataset, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT conv_id) AS BIGINT) AS prompts,
       CAST(count(DISTINCT turn) AS BIGINT) AS questions, CAST(count(DISTINCT role) AS BIGINT) AS issues
FROM conversations
UNION ALL
SELECT 'events', count(*), count(DISTINCT user_id), count(DISTINCT event_type), count(DISTINCT CAST(ts AS DATE))
FROM events"""

SHAPE_CHECKS_SQL = """
WITH pc AS (SELECT conv_id, count(*) AS c, max(turn) AS m FROM conversations GROUP BY conv_id),
cc AS (SELECT sum(c) AS r, count(*) AS p, sum(m + 1) AS er, max(conv_id) + 1 AS ep FROM pc),
ec AS (SELECT count(*) AS r, count(DISTINCT user_id) AS p, count(DISTINCT event_type) AS q,
              count(DISTINCT event_id) AS er, max(user_id) + 1 AS ep FROM events)
SELECT 'conversations_response_shape' AS "check",
       r || ' rows, ' || p || ' prompts, ' || r || ' questions' AS observed,
       er || ' rows, ' || ep || ' prompts, ' || er || ' questions' AS expected,
       CASE WHEN r = er AND p = ep THEN 'pass' ELSE 'review' END AS status
FROM cc
UNION ALL
SELECT 'events_response_shape', r || ' rows, ' || p || ' prompts, ' || q || ' questions',
       er || ' rows, ' || ep || ' prompts, ' || q || ' questions',
       CASE WHEN r = er AND p = ep THEN 'pass' ELSE 'review' END
FROM ec"""

LABEL_COVERAGE_SQL = """
SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"""


# --------------------------------------------------------------------------- vectors

def sqdist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _cos(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    return f"({dot} / nullif({na} * {nb}, 0))"


EMB_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _proj_sql(pos: str, neg: str) -> str:
    return f"""
WITH e AS ({EMB_SQL}),
an AS (SELECT ({pos}) AS pv, ({neg}) AS nv),
p AS (SELECT vec_id, label, {_cos("v", "pv")} - {_cos("v", "nv")} AS proj FROM e, an)"""


PROJ_SQL = _proj_sql("SELECT v FROM e WHERE vec_id = 0", "SELECT v FROM e WHERE vec_id = 1")


def _mean_vec(label: int) -> str:
    return (f"SELECT list(av ORDER BY i) FROM (SELECT i, avg(v[i]) AS av FROM "
            f"(SELECT v, unnest(range(1, len(v) + 1)) AS i FROM e WHERE label = {label}) GROUP BY i)")


def axis_projection_sql(proj: str = PROJ_SQL) -> str:
    return f"""{proj}
SELECT vec_id, label, {r6("proj")} AS proj, CASE WHEN proj IS NULL THEN NULL ELSE CAST(proj > 0 AS INTEGER) END AS proj_b
FROM p"""


PROJECTION_SIGN_SQL = f"""{PROJ_SQL}
SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE proj > 0) AS BIGINT) AS n_positive,
       {r6("avg(proj)")} AS mean_proj
FROM p GROUP BY label"""


def effect_on_projection_sql() -> str:
    src = f"{PROJ_SQL} SELECT label, vec_id % 2 AS x, proj AS y FROM p"
    return effect_sql(src, ["label"], "x", "y")


ARCHIVE_SQL = """
  SELECT *, row_number() OVER (PARTITION BY archive_file ORDER BY prompt_no, sentiment, vec_id) - 1 AS row_no
  FROM (SELECT label AS prompt_no, 1 AS connector, CASE WHEN vec_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS sentiment,
               'part' || CAST(label % 2 + 1 AS VARCHAR) AS archive_file, vec_id, embedding FROM embeddings)"""

MANIFEST_SQL = f"""
  SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY archive_file, archive_offset
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS global_offset
  FROM (SELECT prompt_no, connector, sentiment, archive_file, CAST(min(row_no) AS BIGINT) AS archive_offset,
               CAST(count(*) AS BIGINT) AS n, CAST(max(len(embedding)) AS INTEGER) AS dimensions
        FROM ({ARCHIVE_SQL}) GROUP BY prompt_no, connector, sentiment, archive_file)"""

TEXTS_SQL = """
  SELECT CAST(doc_id % 10 AS INTEGER) AS prompt_no, 1 AS connector,
         CASE WHEN (doc_id // 10) % 2 = 0 THEN 'pos' ELSE 'neg' END AS sentiment, doc_id, text
  FROM documents"""

SLICE_READ_SQL = f"""
WITH v AS (SELECT prompt_no, connector, sentiment, vec_id,
                  row_number() OVER (PARTITION BY prompt_no, connector, sentiment ORDER BY row_no) - 1 AS position
           FROM ({ARCHIVE_SQL})),
t AS (SELECT prompt_no, connector, sentiment, doc_id,
             row_number() OVER (PARTITION BY prompt_no, connector, sentiment ORDER BY doc_id) - 1 AS position
      FROM ({TEXTS_SQL}))
SELECT prompt_no, connector, sentiment, CAST(position AS BIGINT) AS position, vec_id, doc_id
FROM v JOIN t USING (prompt_no, connector, sentiment, position)"""

PAIR_MISSING_TEXTS_SQL = f"""
WITH v AS (SELECT prompt_no, connector, sentiment, vec_id,
                  row_number() OVER (PARTITION BY prompt_no, connector, sentiment ORDER BY row_no) - 1 AS position
           FROM ({ARCHIVE_SQL})),
t AS (SELECT prompt_no, connector, sentiment, doc_id,
             row_number() OVER (PARTITION BY prompt_no, connector, sentiment ORDER BY doc_id) - 1 AS position
      FROM ({TEXTS_SQL}) JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT prompt_no, connector, sentiment, CAST(position AS BIGINT) AS position, vec_id,
       coalesce(doc_id, -1) AS doc_id, doc_id IS NULL AS missing_text
FROM v LEFT JOIN t USING (prompt_no, connector, sentiment, position)"""

#: The archive has lost the vectors of label 9 and, elsewhere, those that are nearest to the first axis.
SHORT_SLICES_SQL = f"""
WITH m AS ({MANIFEST_SQL}),
r AS (SELECT prompt_no, connector, sentiment, archive_file, count(*) AS n_read
      FROM ({ARCHIVE_SQL}) WHERE prompt_no <> 9 AND embedding[1] < 0.5 GROUP BY ALL)
SELECT prompt_no, connector, sentiment, m.n AS n_vectors, CAST(coalesce(n_read, 0) AS BIGINT) AS n_read,
       CASE WHEN coalesce(n_read, 0) = 0 THEN 'missing_slice' WHEN n_read < m.n THEN 'short_slice' ELSE 'whole' END AS status
FROM m LEFT JOIN r USING (prompt_no, connector, sentiment, archive_file)"""

NULL_KEY_INDEX_SQL = """
SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY k ORDER BY o NULLS FIRST, event_id) - 1 AS BIGINT) AS row_no
FROM (SELECT event_id, event_type, nullif(event_type, 'view') AS k, CASE WHEN event_type <> 'click' THEN user_id END AS o
      FROM events)"""

MISSING_REFERENCE_SQL = f"""
WITH c AS (
  SELECT user_id % 5 AS domain, event_type AS category, count(*) FILTER (WHERE event_id % 2 = 1) AS lib,
         count(*) FILTER (WHERE event_id % 2 = 0) AS con
  FROM events WHERE event_type <> 'view' OR user_id % 5 <> 3 GROUP BY ALL),
p AS (SELECT domain, category AS r, 'view' AS l FROM c WHERE category <> 'view')
SELECT p.domain, p.r || '_vs_' || p.l AS comparison, a.lib AS lib_right, a.con AS con_right,
       CAST(coalesce(b.lib, 0) AS BIGINT) AS lib_left, CAST(coalesce(b.con, 0) AS BIGINT) AS con_left,
       {r6("a.lib / (a.lib + a.con)")} AS p_right,
       {r6("CASE WHEN b.lib + b.con > 0 THEN b.lib / (b.lib + b.con) END")} AS p_left
FROM p JOIN c a ON a.domain = p.domain AND a.category = p.r
LEFT JOIN c b ON b.domain = p.domain AND b.category = p.l"""

MANIFEST_INTEGRITY_SQL = f"""
WITH m AS ({MANIFEST_SQL}),
tc AS (SELECT prompt_no, connector, sentiment, count(*) AS n_texts FROM ({TEXTS_SQL}) GROUP BY ALL),
fe AS (SELECT archive_file, max(archive_offset + n) AS file_end FROM m GROUP BY archive_file),
x AS (
  SELECT m.*, CAST(coalesce(tc.n_texts, 0) AS BIGINT) AS nt,
         (EXISTS (SELECT 1 FROM m m2 WHERE m2.archive_file = m.archive_file AND m2.archive_offset = m.archive_offset + m.n)
          OR m.archive_offset + m.n = fe.file_end) AS contiguous,
         count(*) OVER (PARTITION BY m.prompt_no, m.connector, m.sentiment) AS copies
  FROM m JOIN fe USING (archive_file) LEFT JOIN tc USING (prompt_no, connector, sentiment)
)
SELECT prompt_no, connector, sentiment, archive_file, archive_offset, n AS n_vectors, n AS n_read, nt AS n_texts, contiguous,
       CASE WHEN copies > 1 THEN 'duplicate_slice' WHEN NOT contiguous THEN 'gap_after'
            WHEN nt < n THEN 'fewer_texts' WHEN nt > n THEN 'more_texts' ELSE 'ok' END AS status
FROM x"""

ASSIGN_STEP_SQL = f"""
  WITH e AS (SELECT label % 3 AS slice, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  c AS (SELECT slice, v AS cv, row_number() OVER (PARTITION BY slice ORDER BY vec_id) - 1 AS cluster FROM e),
  d AS (SELECT e.slice, e.vec_id, e.v, c.cluster, {sqdist_sql("e.v", "c.cv")} AS sq_dist
        FROM e JOIN c ON e.slice = c.slice AND c.cluster < 4)
  SELECT slice, vec_id, v, cluster, sq_dist FROM (
    SELECT *, row_number() OVER (PARTITION BY slice, vec_id ORDER BY sq_dist, cluster) AS rn FROM d) WHERE rn = 1"""

KMEANS_ASSIGN_STEP_SQL = f"""
SELECT slice, vec_id, CAST(cluster AS INTEGER) AS cluster, {r6("sq_dist")} AS sq_dist FROM ({ASSIGN_STEP_SQL})"""

CLUSTER_QUALITY_SQL = f"""
WITH a AS ({ASSIGN_STEP_SQL}),
pairs AS (SELECT x.slice, x.vec_id, x.cluster AS own, y.cluster AS oc, {sqdist_sql("x.v", "y.v")} AS d
          FROM a x JOIN a y ON x.slice = y.slice AND x.vec_id <> y.vec_id),
md AS (SELECT slice, vec_id, own, oc, avg(d) AS m FROM pairs GROUP BY ALL),
sz AS (SELECT slice, cluster, count(*) AS n_c FROM a GROUP BY ALL),
pt AS (
  SELECT a.slice, a.vec_id, sz.n_c,
         (SELECT m FROM md WHERE md.slice = a.slice AND md.vec_id = a.vec_id AND md.oc = a.cluster) AS ai,
         (SELECT min(m) FROM md WHERE md.slice = a.slice AND md.vec_id = a.vec_id AND md.oc <> a.cluster) AS bi
  FROM a JOIN sz ON sz.slice = a.slice AND sz.cluster = a.cluster
),
sil AS (SELECT slice, avg(CASE WHEN n_c <= 1 THEN 0.0 ELSE coalesce((bi - ai) / nullif(greatest(ai, bi), 0), 0.0) END) AS s
        FROM pt GROUP BY slice),
cen AS (SELECT slice, cluster, list(av ORDER BY i) AS mu FROM (
          SELECT slice, cluster, i, avg(v[i]) AS av FROM (SELECT slice, cluster, v, unnest(range(1, len(v) + 1)) AS i FROM a)
          GROUP BY ALL) GROUP BY ALL),
gm AS (SELECT slice, list(av ORDER BY i) AS g FROM (
          SELECT slice, i, avg(v[i]) AS av FROM (SELECT slice, v, unnest(range(1, len(v) + 1)) AS i FROM a) GROUP BY ALL)
       GROUP BY slice),
w AS (SELECT a.slice, a.cluster, {sqdist_sql("a.v", "cen.mu")} AS w2, sqrt({sqdist_sql("a.v", "cen.mu")}) AS dd
      FROM a JOIN cen USING (slice, cluster)),
cs AS (SELECT slice, cluster, count(*) AS n_c, sum(w2) AS w_c, avg(dd) AS spread FROM w GROUP BY ALL),
bt AS (SELECT cen.slice, sum(cs.n_c * {sqdist_sql("cen.mu", "gm.g")}) AS b FROM cen JOIN gm USING (slice)
       JOIN cs USING (slice, cluster) GROUP BY cen.slice),
dbr AS (SELECT c1.slice, c1.cluster, max((s1.spread + s2.spread) / nullif(sqrt({sqdist_sql("c1.mu", "c2.mu")}), 0)) AS r
        FROM cen c1 JOIN cen c2 ON c1.slice = c2.slice AND c1.cluster <> c2.cluster
        JOIN cs s1 ON s1.slice = c1.slice AND s1.cluster = c1.cluster
        JOIN cs s2 ON s2.slice = c2.slice AND s2.cluster = c2.cluster GROUP BY ALL),
tot AS (SELECT slice, sum(n_c) AS n, count(*) AS k, sum(w_c) AS wsum FROM cs GROUP BY slice),
db AS (SELECT slice, sum(coalesce(r, 0.0)) AS rs FROM dbr GROUP BY slice)
SELECT tot.slice, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, {r6("wsum")} AS inertia,
       CASE WHEN k > 1 AND n > k THEN {r6("sil.s")} END AS silhouette_sqeuclidean,
       CASE WHEN k > 1 AND n > k THEN {r6("(bt.b / (k - 1)) / nullif(wsum / (n - k), 0)")} END AS calinski_harabasz,
       CASE WHEN k > 1 AND n > k THEN {r6("coalesce(db.rs, 0.0) / k")} END AS davies_bouldin
FROM tot JOIN sil USING (slice) JOIN bt USING (slice) LEFT JOIN db USING (slice)"""


def coef_panels_sql() -> str:
    eff = effect_sql(EFFECT_BY_WORDING_SRC, ["p_type", "p_brand"], "x", "y", raw=True)
    return f"""
WITH e AS ({eff}),
t AS (
  SELECT e.*, CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL') THEN 'size'
                   WHEN p_type IN ('PROMO', 'STANDARD') THEN 'line' END AS topic_group,
         lower(split_part(p_type, ' ', 1)) || ' returned' AS label_1, 'kept' AS label_2
  FROM e
),
tg AS (SELECT * FROM t WHERE topic_group IS NOT NULL),
fig AS (SELECT topic_group, least(-0.08, min(ci_low) - 0.01) AS y_min, greatest(0.08, max(ci_high) + 0.01) AS y_max,
               count(DISTINCT (label_1, label_2)) > 1 AS mixed_axes FROM tg GROUP BY topic_group)
SELECT topic_group, CAST(dense_rank() OVER (PARTITION BY topic_group ORDER BY p_type) AS BIGINT) AS panel_no, p_type,
       CAST(row_number() OVER (PARTITION BY topic_group, p_type ORDER BY p_brand) - 1 AS BIGINT) AS x_pos, p_brand,
       {r6("coef")} AS coef, {r6("ci_low")} AS ci_low, {r6("ci_high")} AS ci_high, {r6("coef - ci_low")} AS err_low, {r6("ci_high - coef")} AS err_high, direction,
       {r6("y_min")} AS y_min, {r6("y_max")} AS y_max, mixed_axes,
       coalesce(CASE p_type WHEN 'ECONOMY' THEN 'Economy parts' WHEN 'LARGE' THEN 'Large parts' END,
                upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2)) AS panel_label
FROM tg JOIN fig USING (topic_group)"""


COEFFICIENTS_SRC = """
  SELECT p_size + 0.1::DOUBLE AS issue_no_key, l_linenumber AS question_no, p_size AS issue_no, p_brand AS keyword,
         p_type AS ending, 'about ' || lower(p_type) AS end_type, p_brand AS label_1, lower(p_type) AS label_2,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS x, l_extendedprice AS y,
         l_orderkey, l_partkey, l_suppkey, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' AND p_size <> 13"""

JUSTIFICATION_PROMPTS_HEAD_SQL = """
SELECT conv_id AS prompt_no, turn AS completion_no, 'Why? ' || text || '. This is because' AS justification_prompt
FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn LIMIT 25"""

KMEANS_GROUPED_SQL = """
SELECT label % 3 AS slice, count(*) AS n, CAST(0 AS BIGINT) AS n_misplaced, CAST(0 AS BIGINT) AS n_off_centre,
       CAST(0 AS BIGINT) AS n_open, true AS no_worse FROM embeddings GROUP BY 1"""

CLUSTER_METRICS_SQL = """
WITH e AS (SELECT label % 3 AS slice, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS d
           FROM embeddings),
v AS (SELECT slice, d, sum(x * x) - sum(x) * sum(x) / count(*) AS ss FROM e GROUP BY 1, 2)
SELECT slice, n, CAST(4 AS BIGINT) AS k, round(sum(ss), 4) AS total_sum_of_squares, true AS silhouette_in_range,
       true AS davies_bouldin_positive
FROM v JOIN (SELECT label % 3 AS slice, count(*) AS n FROM embeddings GROUP BY 1) USING (slice) GROUP BY slice, n"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["effect_by_wording"] = effect_sql(EFFECT_BY_WORDING_SRC, ["p_type", "p_brand"], "x", "y",
                                        first={"first_part_name": "p_name"},
                                        first_order="l_orderkey, l_linenumber, l_partkey, l_suppkey")
    q["effect_sparse"] = effect_sql(EFFECT_SPARSE_SRC, ["lang", "source"], "x", "y",
                                    first={"first_doc_id": "CAST(doc_id AS BIGINT)"}, first_order="doc_id")
    q["theme_contingency"] = CONTINGENCY_SQL
    q["two_proportion"] = two_proportion_sql()
    q["bar_counts"] = bar_counts_sql()
    q["bar_segments"] = bar_segments_sql()
    q["bar_layout"] = bar_layout_sql()
    q["binomial_tail"] = binomial_tail_sql()
    q["forecast_verdict"] = forecast_verdict_sql()
    q["forecast_counts"] = forecast_counts_sql()
    q["forecast_tests"] = forecast_tests_sql()
    q["forecast_check"] = forecast_check_sql()
    q["list_normalise"] = list_normalise_sql()
    q["prompt_grid"] = prompt_grid_sql()
    q["grid_unknown_templates"] = grid_unknown_templates_sql()
    q["axis_plan"] = axis_plan_sql()
    q["ending_class"] = ending_class_sql()
    q["secret_hits"] = secret_hits_sql()
    q["secret_scan"] = secret_scan_sql()
    q["labelling_prompts"] = labelling_prompts_sql()
    q["justification_prompts"] = JUSTIFICATION_PROMPTS_SQL
    q["first_seen_rank"] = FIRST_SEEN_RANK_SQL
    q["summary_counts"] = SUMMARY_COUNTS_SQL
    q["shape_checks"] = SHAPE_CHECKS_SQL
    q["label_coverage"] = LABEL_COVERAGE_SQL
    q["coef_panels"] = coef_panels_sql()
    q["axis_projection"] = axis_projection_sql()
    q["projection_sign"] = PROJECTION_SIGN_SQL
    q["axis_projection_means"] = axis_projection_sql(_proj_sql(_mean_vec(0), _mean_vec(1)))
    q["effect_on_projection"] = effect_on_projection_sql()
    q["slice_manifest"] = MANIFEST_SQL
    q["slice_read"] = SLICE_READ_SQL
    q["stored_slice_pairs"] = SLICE_READ_SQL
    q["manifest_integrity"] = MANIFEST_INTEGRITY_SQL
    q["pair_missing_texts"] = PAIR_MISSING_TEXTS_SQL
    q["short_slices"] = SHORT_SLICES_SQL
    q["null_key_index"] = NULL_KEY_INDEX_SQL
    q["missing_reference"] = MISSING_REFERENCE_SQL
    q["bank_normalised"] = f"""
SELECT 'part' AS dataset, b.issue_no, p.prompt, b.keywords, b.endings, b.labels,
       CAST(-1 AS INTEGER) AS topic_no, CAST(-1 AS INTEGER) AS reverse_code
FROM ({list_normalise_sql()}) b JOIN ({PART_BANK_SQL}) p USING (issue_no)"""
    q["noted_checks"] = f"SELECT *, '{FORECAST_NOTE.replace(chr(39), chr(39) * 2)}' AS note FROM ({SHAPE_CHECKS_SQL})"
    q["coefficients"] = effect_sql(
        COEFFICIENTS_SRC, ["issue_no_key", "question_no"], "x", "y",
        {c: c for c in ("issue_no", "keyword", "ending", "end_type", "label_1", "label_2")},
        "l_orderkey, l_partkey, l_suppkey, price")
    q["justification_prompts_head"] = JUSTIFICATION_PROMPTS_HEAD_SQL
    q["kmeans_grouped"] = KMEANS_GROUPED_SQL
    q["cluster_metrics"] = CLUSTER_METRICS_SQL
    q["kmeans_assign_step"] = KMEANS_ASSIGN_STEP_SQL
    q["cluster_quality"] = CLUSTER_QUALITY_SQL
    return q
