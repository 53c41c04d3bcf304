"""DuckDB statements for the same results as ``checks.queries``, written from the definitions."""

from __future__ import annotations

import re

from clickrank.schema import NA_TOKENS

KEPT = 20  # history size of the models

SHOWN = """
docs_n AS (SELECT count(*) AS n FROM documents),
seqd AS (
  SELECT user_id, ts, event_id, value, CAST(event_type IN ('click', 'purchase') AS INTEGER) AS clicked,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq
  FROM events),
shown AS (
  SELECT user_id * 1000000000 + seq // 8 AS impression_id, 'U' || user_id AS user_id, seq // 8 AS page, ts,
         event_id, CAST(seq % 8 AS INTEGER) AS pos, 'N' || (event_id % n) AS news_id, clicked, value
  FROM seqd, docs_n)"""

# A history is the clicks of the ten pages before.
BEHAVIORS = SHOWN + """,
imp AS (
  SELECT impression_id, user_id, page, CAST(min(ts) AS DATE) AS day, strftime(min(ts), '%-m/%-d/%Y %-I:%M:%S %p') AS time,
         string_agg(news_id || '-' || clicked, ' ' ORDER BY pos) AS impressions_str,
         list(clicked ORDER BY pos) AS labels
  FROM shown GROUP BY impression_id, user_id, page),
hist AS (
  SELECT imp.impression_id, list(c.news_id ORDER BY c.ts, c.event_id) AS history
  FROM imp JOIN shown c ON c.user_id = imp.user_id AND c.page BETWEEN imp.page - 10 AND imp.page - 1 AND c.clicked = 1
  GROUP BY 1),
beh AS (SELECT imp.*, hist.history FROM imp LEFT JOIN hist USING (impression_id))"""

SPLIT = """
train AS (SELECT DISTINCT 'U' || user_id AS user_id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-02'),
val AS (SELECT DISTINCT 'U' || user_id AS user_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-02'),
user_index AS (
  SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) AS BIGINT) AS user_idx FROM train
  UNION ALL SELECT user_id, CAST(0 AS BIGINT) FROM val WHERE user_id NOT IN (SELECT user_id FROM train))"""

NEWS = """
news AS (
  SELECT 'N' || doc_id AS news_id, lang AS category, source AS subcategory,
         CASE WHEN trim(translate(text, chr(9) || chr(10), '  ')) <> '' THEN translate(text, chr(9) || chr(10), '  ') END AS title,
         text AS abstract, 'https://news.example/' || doc_id AS url
  FROM documents),
descriptions AS (SELECT source AS category, arg_min(text, doc_id) AS description FROM documents GROUP BY 1)"""

VECTORS = """
nv AS (
  SELECT 'N' || doc_id AS news_id, CAST(embedding AS DOUBLE[]) AS vec
  FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
uv AS (SELECT vec_id AS user_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def _matrix(name: str, rows: int, columns: int, seed: int) -> str:
    """Closed-form weights as a list of columns."""
    return (
        f"{name} AS (SELECT list_transform(range(1, {columns + 1}), lambda j: list_transform(range(1, {rows + 1}), "
        f"lambda i: sin(31 * i + 17 * j + {seed}) / sqrt({rows}))) AS {name}_w)"
    )


LOGITS = VECTORS + f""",
{_matrix('add', 64, 8, 7)},
nl AS (
  SELECT news_id, vec,
         list_sum(list_transform(range(1, 9), lambda j: sin(13 * j + 3) * tanh(list_dot_product(vec, add_w[j])))) AS logit
  FROM nv, add)"""


def _queries(name: str, first: int, second: int, one: str, two: str) -> str:
    """``name``: the query of every user, from closed-form weights and biases."""
    return f"""
{_matrix(f'{name}1', 64, 8, first)},
{_matrix(f'{name}2', 8, 64, second)},
{name}_hidden AS (
  SELECT user_idx, list_transform(range(1, 9), lambda j: greatest(list_dot_product(vec, {name}1_w[j]) + sin({one}) / 8, 0)) AS h
  FROM uv, {name}1),
{name} AS (
  SELECT user_idx, list_transform(range(1, 65), lambda i: tanh(list_dot_product(h, {name}2_w[i]) + sin({two}) / 8)) AS query
  FROM {name}_hidden, {name}2)"""


QUERIES_SQL = _queries("uq", 11, 5, "19 * j + 1", "23 * i + 2")

# Three segments per news item, pooled for every user that meets the item in a history or among candidates.
PERSONAL_NEWS = f"""{_queries("nq", 3, 9, "7 * j + 5", "29 * i + 4")},
seg AS (
  SELECT 'N' || doc_id AS news_id, s AS segment, CAST(embedding AS DOUBLE[]) AS vec
  FROM documents, range(3) AS r(s), embeddings WHERE vec_id = (doc_id + 7 * s) % (SELECT count(*) FROM embeddings)),
cut AS (
  SELECT impression_id, coalesce(user_idx, 0) AS user_idx, coalesce(history, CAST([] AS VARCHAR[]))[1:{KEPT}] AS history
  FROM beh LEFT JOIN user_index USING (user_id)),
used AS (SELECT *, md5(array_to_string(history, ' ')) AS history_key FROM cut),
keyed AS (SELECT DISTINCT user_idx, history_key, history FROM used),
met AS (
  SELECT user_idx, unnest(history) AS news_id FROM keyed
  UNION SELECT user_idx, news_id FROM shown JOIN used USING (impression_id)),
dims AS (SELECT unnest(range(1, 65)) AS d),
met_segments AS (
  SELECT user_idx, news_id, vec, exp(list_dot_product(vec, query)) AS e FROM met JOIN seg USING (news_id) JOIN nq USING (user_idx)),
pn AS (
  SELECT user_idx, news_id, list(x ORDER BY d) AS vec
  FROM (SELECT user_idx, news_id, d, sum(e * vec[d]) / sum(e) AS x FROM met_segments, dims GROUP BY ALL) GROUP BY ALL),
slots AS (SELECT user_idx, history_key, unnest(history) AS news_id FROM keyed),
weighted AS (
  SELECT user_idx, history_key, vec, exp(list_dot_product(vec, query)) AS e
  FROM slots JOIN pn USING (user_idx, news_id) JOIN uq USING (user_idx)),
pooled AS (
  SELECT keyed.user_idx, keyed.history_key, d,
         coalesce(sum(e * vec[d]), 0) / (coalesce(sum(e), 0) + any_value({KEPT} - len(history))) AS x
  FROM keyed LEFT JOIN weighted USING (user_idx, history_key), dims GROUP BY ALL)"""

HISTORIES = f"""
cut AS (SELECT impression_id, coalesce(history, CAST([] AS VARCHAR[]))[1:{KEPT}] AS history FROM beh),
used AS (SELECT impression_id, history, md5(array_to_string(history, ' ')) AS history_key FROM cut),
keyed AS (SELECT DISTINCT history_key, history FROM used),
slots AS (
  SELECT history_key, {KEPT} - len(history) AS pads, unnest(history) AS news_id, generate_subscripts(history, 1) - 1 AS slot
  FROM keyed)"""

USER_VECTORS = HISTORIES + f""",
dims AS (SELECT unnest(range(1, 65)) AS d),
pooled AS (
  SELECT keyed.history_key, d,
         coalesce(sum(exp(logit) * vec[d]), 0) / (coalesce(sum(exp(logit)), 0) + any_value({KEPT} - len(history))) AS x
  FROM keyed LEFT JOIN slots USING (history_key) LEFT JOIN nl USING (news_id), dims
  GROUP BY 1, 2),
user_vec AS (SELECT history_key, list(x ORDER BY d) AS user_vec FROM pooled GROUP BY 1)"""

# Every candidate, the empty one included, against the user vector of its history_key.
CANDIDATE_SCORES = """
extended AS (
  SELECT impression_id, pos, news_id, clicked FROM shown
  UNION ALL SELECT impression_id, CAST(len(labels) AS INTEGER), 'EMPTY_NEWS_ID', 0 FROM imp),
scored AS (
  SELECT impression_id, pos, news_id, clicked,
         coalesce(round(list_dot_product(nv.vec, user_vec), 9), 0) AS score
  FROM extended JOIN used USING (impression_id) JOIN user_vec USING (history_key) LEFT JOIN nv USING (news_id))"""

SCORED = f"{BEHAVIORS}, {LOGITS}, {USER_VECTORS}, {CANDIDATE_SCORES}"

VALUED = f"""{SHOWN},
scored AS (SELECT impression_id, pos, news_id, clicked, floor(value / 5) AS score FROM shown)"""

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos DESC) AS rank,
         row_number() OVER (PARTITION BY impression_id ORDER BY clicked DESC, pos DESC) AS ideal_rank
  FROM scored)"""

# Every pair of a clicked and an unclicked candidate is compared, which is what the area counts.
METRICS = RANKED + """,
pairs AS (
  SELECT p.impression_id, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auc
  FROM scored p JOIN scored n ON p.impression_id = n.impression_id AND p.clicked = 1 AND n.clicked = 0
  GROUP BY 1),
sums AS (
  SELECT impression_id, sum(clicked) AS p, sum(clicked / rank) AS rr,
         sum(CASE WHEN rank <= 5 THEN (2 ** clicked - 1) / log2(rank + 1) ELSE 0 END) AS dcg5,
         sum(CASE WHEN ideal_rank <= 5 THEN (2 ** clicked - 1) / log2(ideal_rank + 1) ELSE 0 END) AS ideal5,
         sum(CASE WHEN rank <= 10 THEN (2 ** clicked - 1) / log2(rank + 1) ELSE 0 END) AS dcg10,
         sum(CASE WHEN ideal_rank <= 10 THEN (2 ** clicked - 1) / log2(ideal_rank + 1) ELSE 0 END) AS ideal10
  FROM ranked GROUP BY 1),
metrics AS (
  SELECT impression_id, CASE WHEN p > 0 THEN dcg5 / ideal5 END AS ndcg_at_5,
         CASE WHEN p > 0 THEN dcg10 / ideal10 END AS ndcg_at_10, auc, CASE WHEN p > 0 THEN rr / p END AS mrr
  FROM sums LEFT JOIN pairs USING (impression_id))"""

_METRIC_COLUMNS = ("ndcg_at_5", "ndcg_at_10", "auc", "mrr")
_AVERAGES = "count(*) AS impressions, count(mrr) AS with_positive, count(auc) AS with_auc, " + ", ".join(
    f"round(avg({m}), 6) AS {m}" for m in _METRIC_COLUMNS
)

# Seed 42, epoch 1, four negatives.
SAMPLE = """
pos_pick AS (
  SELECT impression_id, pos, news_id, clicked, 0 AS pick FROM shown WHERE clicked = 1
  QUALIFY row_number() OVER (PARTITION BY impression_id ORDER BY md5('42:1:' || impression_id || ':' || pos)) = 1),
neg_real AS (
  SELECT impression_id, pos, news_id, clicked,
         row_number() OVER (PARTITION BY impression_id ORDER BY md5('42:1:' || impression_id || ':' || pos)) AS pick
  FROM shown WHERE clicked = 0),
grid AS (SELECT DISTINCT impression_id, unnest(range(1, 5)) AS pick FROM imp),
neg_pick AS (
  SELECT impression_id, coalesce(pos, -1) AS pos, coalesce(news_id, 'EMPTY_NEWS_ID') AS news_id, 0 AS clicked,
         CAST(pick AS INTEGER) AS pick
  FROM grid LEFT JOIN neg_real USING (impression_id, pick)),
picks AS (
  SELECT * FROM pos_pick UNION ALL
  SELECT * FROM neg_pick WHERE impression_id IN (SELECT impression_id FROM pos_pick)),
sample AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY md5('42:1:slot:' || impression_id || ':' || pick)) - 1
         AS INTEGER) AS slot FROM picks),
targets AS (SELECT impression_id, slot AS target FROM sample WHERE clicked = 1)"""

def _fitted(size: int) -> str:
    return f"""
fitted AS (
  SELECT beh.impression_id, CAST(s AS INTEGER) AS slot, coalesce(history[s + 1], 'EMPTY_NEWS_ID') AS news_id
  FROM beh, range(0, {size}) AS r(s))"""


SAMPLED = """
sampled AS (
  SELECT sample.impression_id, sample.clicked, coalesce(round(list_dot_product(nv.vec, user_vec), 9), 0) AS score
  FROM sample JOIN used USING (impression_id) JOIN user_vec USING (history_key) LEFT JOIN nv ON nv.news_id = sample.news_id)"""

# Newton steps for an intercept and one weight.
CLICK_MODEL = SAMPLED + """,
model AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1
  UNION ALL
  SELECT step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT step, b0, b1, sum(clicked - p) AS g0, sum((clicked - p) * score) AS g1, sum(p * (1 - p)) AS h00,
           sum(p * (1 - p) * score) AS h01, sum(p * (1 - p) * score * score) AS h11
    FROM (SELECT step, b0, b1, score, clicked, 1 / (1 + exp(-b0 - b1 * score)) AS p FROM model, sampled WHERE step < 20)
    GROUP BY step, b0, b1)),
fit AS (SELECT b0, b1 FROM model WHERE step = 20)"""


def _epoch_sample(epoch: int) -> str:
    """The sample of another epoch, under names of its own."""
    drawn = SAMPLE.replace("'42:1:", f"'42:{epoch}:")
    return re.sub(r"\b(pos_pick|neg_real|grid|neg_pick|picks|sample|targets)\b", rf"\g<1>_{epoch}", drawn)


def _trained(weight_decay: float, epochs: int = 3) -> str:
    """Newton steps for an intercept and 64 weights, one per epoch, solved by elimination; the last are ``w_<epochs>``."""
    steps = ["w_0 AS (SELECT list_transform(range(65), lambda i: CAST(0 AS DOUBLE)) AS w)"]
    for e in range(epochs):
        steps.append(f"""{_epoch_sample(e)},
rows_{e} AS (
  SELECT clicked, f, 1 / (1 + exp(-list_dot_product(w, f))) AS p
  FROM (SELECT sample_{e}.clicked, list_concat([CAST(1 AS DOUBLE)], list_transform(range(1, 65), lambda i: coalesce(nv.vec[i], 0) * user_vec[i])) AS f
    FROM sample_{e} JOIN used USING (impression_id) JOIN user_vec USING (history_key) LEFT JOIN nv ON nv.news_id = sample_{e}.news_id), w_{e}),
places_{e} AS (SELECT unnest(range(1, 66)) AS i),
half_{e} AS (
  SELECT a.i, b.i AS j, sum(p * (1 - p) * f[a.i] * f[b.i]) / count(*) AS h
  FROM rows_{e}, places_{e} a, places_{e} b WHERE a.i <= b.i GROUP BY ALL),
gram_{e} AS (SELECT i, j, h FROM half_{e} UNION ALL SELECT j, i, h FROM half_{e} WHERE i < j),
slope_{e} AS (
  SELECT i, sum((p - clicked) * f[i]) / count(*) + CASE WHEN i > 1 THEN {weight_decay} * any_value(w[i]) ELSE 0 END AS g
  FROM rows_{e}, places_{e}, w_{e} GROUP BY i),
system_{e} AS (
  SELECT i, list_concat(list(h + CASE WHEN i = j AND i > 1 THEN {weight_decay} ELSE 0 END ORDER BY j), [any_value(g)]) AS line
  FROM gram_{e} JOIN slope_{e} USING (i) GROUP BY i),
solved_{e}(k, m) AS (
  SELECT 1, list(line ORDER BY i) FROM system_{e}
  UNION ALL
  SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda x: x / line[k])
    ELSE list_transform(line, lambda x, j: x - line[k] / m[k][k] * m[k][j]) END)
  FROM solved_{e} WHERE k <= 65),
w_{e + 1} AS (SELECT list_transform(w, lambda x, i: x - m[i][66]) AS w FROM solved_{e}, w_{e} WHERE k = 66)""")
    return ",\n".join(steps)


FITTED = _fitted(KEPT)
NARROW = "md5(coalesce(title, '')) AS title_md5, CAST(length(coalesce(title, '')) AS INTEGER) AS title_length"

TOKENS = r"""
toks AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n]+'), lambda t: t <> '') AS words FROM documents)"""

VOCAB = TOKENS + """,
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM toks) GROUP BY 1 HAVING count(*) >= 2),
vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS id FROM counts)"""

_NA = ", ".join("'" + t + "'" for t in NA_TOKENS)


def _cleaned(column: str, name: str) -> str:
    line = f"translate({column}, chr(9) || chr(10), '  ')"
    return f"CASE WHEN {line} NOT IN ({_NA}) THEN {line} END AS {name}"


def _self_attention() -> str:
    projections = ", ".join(_matrix(n, 64, 64, seed) for n, seed in (("wq", 1), ("wk", 2), ("wv", 3), ("wo", 4)))

    def projected(w: str) -> str:
        return f"list_transform(range(1, 65), lambda j: list_dot_product(vec, {w}_w[j])) AS {w[1]}"

    parts = ", ".join(
        f"(coalesce(sum(e * v[4 * h - {4 - c}]), 0)) / (coalesce(sum(e), 0) + any_value(pads)) AS o{c}" for c in (1, 2, 3, 4)
    )
    return f"""{projections},
proj AS (SELECT news_id, {projected('wq')}, {projected('wk')}, {projected('wv')} FROM nv, wq, wk, wv),
items AS (
  SELECT history_key, slot, 1 AS times, pads, q, k, v FROM slots JOIN proj USING (news_id)
  UNION ALL
  SELECT history_key, len(history), {KEPT} - len(history), {KEPT} - len(history), list_transform(range(64), lambda i: 0.0),
         NULL, NULL FROM keyed WHERE len(history) < {KEPT}),
heads AS (SELECT unnest(range(1, 17)) AS h),
item_pairs AS (
  SELECT a.history_key, a.slot, a.times, a.pads, h, b.v AS v,
         exp(list_dot_product(a.q[4 * h - 3 : 4 * h], b.k[4 * h - 3 : 4 * h]) / 2) AS e
  FROM items a CROSS JOIN heads LEFT JOIN items b ON a.history_key = b.history_key AND b.k IS NOT NULL),
per_head AS (SELECT history_key, slot, times, h, {parts} FROM item_pairs GROUP BY history_key, slot, times, h),
joined AS (
  SELECT history_key, slot, times, flatten(list([o1, o2, o3, o4] ORDER BY h)) AS o FROM per_head GROUP BY 1, 2, 3),
attended AS (
  SELECT history_key, slot, times, list_transform(range(1, 65), lambda j: list_dot_product(o, wo_w[j])) AS vec
  FROM joined, wo)"""


def _vector_digest(vec: str) -> str:
    return f"round({vec}[1], 6) AS x_first, round({vec}[64], 6) AS x_last, round(list_sum({vec}), 6) AS x_sum"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # ---- sources
    sql["s1_read_news"] = f"""SELECT 'N' || doc_id AS news_id, lang AS category, source AS subcategory,
        CASE WHEN trim(translate(text, chr(9) || chr(10), '  ')) <> '' THEN {_cleaned("text", "x")[:-5]} END AS title,
        {_cleaned("text", "abstract")}, 'https://news.example/' || doc_id AS url FROM documents"""
    sql["s2_read_behaviors"] = f"""WITH {BEHAVIORS} SELECT impression_id, user_id, time,
        array_to_string(history, ' ') AS history_str, impressions_str FROM beh"""
    sql["s3_read_descriptions"] = "SELECT source AS category, arg_max(text, doc_id) AS description FROM documents GROUP BY 1"
    sql["s4_write_descriptions"] = f"WITH {NEWS} SELECT category, description FROM descriptions"
    sql["s5_materialize"] = """SELECT user_id, CAST(count(*) AS BIGINT) AS n_events,
        CAST(sum(CAST(event_type IN ('click', 'purchase') AS INTEGER)) AS BIGINT) AS n_clicked FROM events GROUP BY 1"""
    sql["s6_read_splits"] = f"""WITH {BEHAVIORS} SELECT 'small' AS size, CASE WHEN day < DATE '2024-01-02' THEN 'train' ELSE 'val' END AS split,
        impression_id, user_id, CAST(len(labels) AS INTEGER) AS n_candidates, CAST(coalesce(len(history), 0) AS INTEGER) AS n_history
        FROM beh"""

    # ---- projections
    sql["p1_drop_entities"] = f"WITH {NEWS} SELECT * FROM news"
    sql["p2_parse_impressions"] = f"WITH {SHOWN} SELECT impression_id, pos, news_id, clicked FROM shown"
    sql["p3_parse_history"] = f"""WITH {BEHAVIORS} SELECT impression_id, array_to_string(history, '|') AS history,
        CAST(coalesce(len(history), 0) AS INTEGER) AS n_history FROM beh"""
    sql["p4_project_behaviors"] = f"""WITH {BEHAVIORS} SELECT impression_id, user_id, time,
        array_to_string(history, '|') AS history, replace(impressions_str, ' ', '|') AS impressions FROM beh"""
    sql["p5_click_positions"] = f"""WITH {SHOWN} SELECT impression_id,
        coalesce(string_agg(CASE WHEN clicked = 1 THEN CAST(pos AS VARCHAR) END, ' ' ORDER BY pos), '') AS clicked_idxes,
        coalesce(string_agg(CASE WHEN clicked = 0 THEN CAST(pos AS VARCHAR) END, ' ' ORDER BY pos), '') AS non_clicked_idxes
        FROM shown GROUP BY 1"""
    sql["p6_explode_candidates"] = sql["p2_parse_impressions"]
    sql["p7_append_empty_candidate"] = f"""WITH {SHOWN} SELECT impression_id, pos, news_id, clicked FROM shown UNION ALL
        SELECT impression_id, CAST(count(*) AS INTEGER), 'EMPTY_NEWS_ID', 0 FROM shown GROUP BY 1"""
    sql["p8_fit_history"] = f"WITH {BEHAVIORS}, {_fitted(10)} SELECT * FROM fitted"
    sql["p9_label_vector"] = f"WITH {BEHAVIORS} SELECT impression_id, array_to_string(labels, ' ') AS labels FROM beh"
    sql["p10_target_index"] = f"WITH {BEHAVIORS}, {SAMPLE} SELECT * FROM targets"
    sql["p11_all_match"] = f"""WITH {SHOWN} SELECT 'label is 0 or 1' AS condition, bool_and(clicked IN (0, 1)) AS all_match FROM shown
        UNION ALL SELECT 'clicked', bool_and(clicked = 1) FROM shown
        UNION ALL SELECT 'every impression has a click', bool_and(c = 1) FROM (SELECT max(clicked) AS c FROM shown GROUP BY impression_id)"""
    sql["p12_uniq"] = f"WITH {SHOWN} SELECT DISTINCT news_id FROM shown"

    # ---- joins
    sql["j1_candidate_titles"] = f"""WITH {SHOWN}, {NEWS} SELECT impression_id, pos, news_id, clicked, {NARROW}
        FROM shown LEFT JOIN news USING (news_id)"""
    sql["j2_history_titles"] = f"""WITH {BEHAVIORS}, {FITTED}, {NEWS} SELECT impression_id, slot, news_id, {NARROW}
        FROM fitted LEFT JOIN news USING (news_id)"""
    sql["j3_with_empty_news"] = f"WITH {NEWS} SELECT news_id, title FROM news UNION ALL SELECT 'EMPTY_NEWS_ID', ''"
    sql["j4_attach_description"] = f"""WITH {NEWS} SELECT news_id, title, description AS category_description
        FROM news JOIN descriptions ON subcategory = descriptions.category"""
    template = "coalesce('The category is ' || subcategory, '') AS category_description"
    sql["j5_candidate_texts"] = f"""WITH {SHOWN}, {NEWS} SELECT impression_id, pos, news_id, clicked, {NARROW},
        {template} FROM shown LEFT JOIN news USING (news_id)"""
    sql["j5_history_texts"] = f"""WITH {BEHAVIORS}, {FITTED}, {NEWS} SELECT impression_id, slot, news_id,
        {NARROW}, {template} FROM fitted LEFT JOIN news USING (news_id)"""
    sql["j6_attach_user_idx"] = f"""WITH {BEHAVIORS}, {SPLIT} SELECT impression_id, user_id, coalesce(user_idx, 0) AS user_idx
        FROM beh LEFT JOIN user_index USING (user_id)"""
    sql["j7_validation_only_users"] = f"WITH {SPLIT} SELECT user_id FROM val EXCEPT SELECT user_id FROM train"
    sql["j8_missing_keys"] = f"""WITH {SHOWN} SELECT news_id, count(*) AS n_rows FROM shown
        WHERE news_id NOT IN (SELECT 'N' || doc_id FROM labels) GROUP BY 1"""
    sql["j9_attach_user_vector"] = f"""WITH {SHOWN}, {SPLIT}, {VECTORS} SELECT impression_id, pos, user_idx,
        {_vector_digest('vec')} FROM shown JOIN user_index USING (user_id) LEFT JOIN uv USING (user_idx)"""

    # ---- aggregations
    sql["a1_distinct_users"] = "SELECT DISTINCT 'U' || user_id AS user_id FROM events"
    sql["a2_build_user_index"] = f"WITH {SPLIT} SELECT * FROM user_index"
    sql["a3_user_count"] = f"""WITH {SPLIT} SELECT 'train' AS counted, count(*) AS n_users, count(*) + 1 AS model_rows FROM train
        UNION ALL SELECT 'all', count(*), count(*) + 1 FROM user_index"""
    sql["a4_unique_categories"] = f"WITH {NEWS} SELECT DISTINCT 'subcategory' AS level, subcategory AS category FROM news UNION ALL SELECT DISTINCT 'category', category FROM news"
    sql["a5_description_length_stats"] = f"""WITH {TOKENS} SELECT count(*) AS category_count, CAST(max(len(words)) AS INTEGER) AS max_description_length,
        CAST(min(len(words)) AS INTEGER) AS min_description_length, round(avg(len(words)), 6) AS avg_description_length FROM toks"""
    sql["a6_row_count"] = f"WITH {BEHAVIORS} SELECT count(*) AS n_rows FROM beh"
    sql["a7_macro_average"] = f"WITH {VALUED}, {METRICS} SELECT {_AVERAGES} FROM metrics"
    sql["a8_click_stats"] = f"""WITH {SHOWN} SELECT impression_id, CAST(sum(clicked) AS INTEGER) AS n_clicked,
        CAST(sum(1 - clicked) AS INTEGER) AS n_unclicked, CAST(sum(clicked) = 0 AS INTEGER) AS no_positive,
        CAST(sum(1 - clicked) < 4 AS INTEGER) AS few_negatives FROM shown GROUP BY 1"""
    sql["a9_user_set_union"] = f"WITH {SPLIT} SELECT user_id FROM train UNION SELECT user_id FROM val"

    # ---- sampling
    sql["x1_sample_positive"] = f"WITH {BEHAVIORS}, {SAMPLE} SELECT impression_id, pos, news_id, clicked FROM pos_pick"
    sql["x2_sample_negatives"] = f"WITH {BEHAVIORS}, {SAMPLE} SELECT impression_id, pick - 1 AS nth, pos, news_id, clicked FROM neg_pick"
    sql["x3_shuffle_sample"] = f"WITH {BEHAVIORS}, {SAMPLE} SELECT impression_id, slot, pick, pos, news_id, clicked FROM sample"
    sql["x4_seeded_key"] = f"WITH {SHOWN} SELECT impression_id, pos, md5('42:1:' || impression_id || ':' || pos) AS key FROM shown"
    sql["x5_training_examples"] = f"""WITH {BEHAVIORS}, {SAMPLE}, {FITTED}, {NEWS}, {SPLIT},
        items AS (
          SELECT impression_id, 'candidate' AS part, slot, news_id, clicked FROM sample UNION ALL
          SELECT impression_id, 'history', slot, news_id, -1 FROM fitted WHERE impression_id IN (SELECT impression_id FROM targets))
        SELECT impression_id, coalesce(user_idx, 0) AS user_idx, target, part, slot, news_id, clicked, {NARROW}, {template}
        FROM items JOIN targets USING (impression_id) JOIN imp USING (impression_id) LEFT JOIN user_index USING (user_id)
        LEFT JOIN news USING (news_id)"""
    sql["x6_evaluation_examples"] = f"""WITH {BEHAVIORS}, {FITTED}, {NEWS}, {SPLIT},
        items AS (
          SELECT impression_id, 'candidate' AS part, pos AS slot, news_id, clicked FROM shown UNION ALL
          SELECT impression_id, 'candidate', CAST(len(labels) AS INTEGER), 'EMPTY_NEWS_ID', 0 FROM imp UNION ALL
          SELECT impression_id, 'history', slot, news_id, -1 FROM fitted)
        SELECT impression_id, coalesce(user_idx, 0) AS user_idx, array_to_string(labels, ' ') || ' 0' AS labels, part, slot, news_id, clicked,
        {NARROW}, {template}
        FROM items JOIN imp USING (impression_id) LEFT JOIN user_index USING (user_id) LEFT JOIN news USING (news_id)"""
    sql["x7_assign_batches"] = f"""WITH {BEHAVIORS}, placed AS (
          SELECT impression_id, row_number() OVER (ORDER BY md5('42:1:batch:' || impression_id)) - 1 AS place FROM imp)
        SELECT impression_id, CAST(place // 128 AS BIGINT) AS batch, CAST(place % 128 AS BIGINT) AS place FROM placed"""

    # ---- ranking
    sql["w1_rank_candidates"] = f"WITH {VALUED}, {RANKED} SELECT impression_id, pos, clicked, score, rank FROM ranked"
    sql["w2_top_k"] = f"WITH {VALUED}, {RANKED} SELECT impression_id, pos, clicked, score, rank FROM ranked WHERE rank <= 3"
    sql["w3_ideal_rank"] = f"WITH {VALUED}, {RANKED} SELECT impression_id, pos, clicked, ideal_rank FROM ranked"
    sql["w4_dcg_at_k"] = f"WITH {VALUED}, {METRICS} SELECT impression_id, round(dcg5, 6) AS dcg FROM sums"
    sql["w5_ndcg_at_k"] = f"WITH {VALUED}, {METRICS} SELECT impression_id, round(ndcg_at_5, 6) AS ndcg FROM metrics"
    sql["w6_mrr"] = f"WITH {VALUED}, {METRICS} SELECT impression_id, round(mrr, 6) AS mrr FROM metrics"
    sql["w7_auc"] = f"WITH {VALUED}, {METRICS} SELECT impression_id, round(auc, 6) AS auc FROM metrics"
    rounded = ", ".join(f"round({m}, 6) AS {m}" for m in _METRIC_COLUMNS)
    sql["w8_evaluate"] = f"WITH {SCORED}, {METRICS} SELECT impression_id, {rounded} FROM metrics"
    sql["w9_evaluate_run"] = f"WITH {SCORED}, {METRICS} SELECT {_AVERAGES} FROM metrics"

    sql["w9_evaluate_selfattn"] = f"""WITH {BEHAVIORS}, {VECTORS}, {HISTORIES}, {_self_attention()}, {_matrix('add', 64, 8, 7)},
        weighted AS (SELECT history_key, vec, times * exp(list_sum(list_transform(range(1, 9),
          lambda j: sin(13 * j + 3) * tanh(list_dot_product(vec, add_w[j]))))) AS e FROM attended, add),
        dims AS (SELECT unnest(range(1, 65)) AS d),
        pooled AS (SELECT history_key, d, sum(e * vec[d]) / sum(e) AS x FROM weighted, dims GROUP BY 1, 2),
        user_vec AS (SELECT history_key, list(x ORDER BY d) AS user_vec FROM pooled GROUP BY 1),
        {CANDIDATE_SCORES}, {METRICS} SELECT {_AVERAGES} FROM metrics"""
    sql["w9_evaluate_personalized"] = f"""WITH {BEHAVIORS}, {SPLIT}, {VECTORS}, {QUERIES_SQL},
        cut AS (SELECT impression_id, coalesce(user_idx, 0) AS user_idx, coalesce(history, CAST([] AS VARCHAR[]))[1:{KEPT}] AS history
          FROM beh LEFT JOIN user_index USING (user_id)),
        used AS (SELECT *, user_idx || ':' || array_to_string(history, ' ') AS history_key FROM cut),
        keyed AS (SELECT DISTINCT history_key, user_idx, history FROM used),
        slots AS (SELECT history_key, user_idx, unnest(history) AS news_id FROM keyed),
        weighted AS (SELECT history_key, vec, exp(list_dot_product(vec, query)) AS e FROM slots JOIN uq USING (user_idx) JOIN nv USING (news_id)),
        dims AS (SELECT unnest(range(1, 65)) AS d),
        pooled AS (SELECT keyed.history_key, d,
            coalesce(sum(e * vec[d]), 0) / (coalesce(sum(e), 0) + any_value({KEPT} - len(history))) AS x
          FROM keyed LEFT JOIN weighted USING (history_key), dims GROUP BY 1, 2),
        user_vec AS (SELECT history_key, list(x ORDER BY d) AS user_vec FROM pooled GROUP BY 1),
        {CANDIDATE_SCORES}, {METRICS} SELECT {_AVERAGES} FROM metrics"""

    # ---- text
    sql["t1_template_descriptions"] = "SELECT DISTINCT source AS category, 'The category is ' || source AS description FROM documents"
    sql["t2_news_text_none"] = f"WITH {NEWS} SELECT news_id, title FROM news"
    sql["t2_news_text_template"] = f"WITH {NEWS} SELECT news_id, title, 'The category is ' || subcategory AS category_description FROM news"
    sql["t2_news_text_generated"] = sql["j4_attach_description"]
    sql["t3_generation_prompts"] = f"""SELECT DISTINCT source AS category, 'Say what news of the named category deals with.' AS system_prompt,
        'The news category is ' || source AS user_prompt FROM documents"""
    sql["t4_generate_descriptions"] = """SELECT DISTINCT source AS category,
        CASE WHEN source NOT LIKE '%7' THEN 'Articles on: The news category is ' || source END AS description,
        CASE WHEN source LIKE '%7' THEN 'refused' END AS error FROM documents"""
    ids = "CASE WHEN i <= len(seq) THEN seq[i] ELSE 0 END"
    sql["t5_encode_texts"] = f"""WITH {VOCAB},
        kept AS (SELECT doc_id, unnest(words[1:62]) AS token, generate_subscripts(words[1:62], 1) AS nth FROM toks),
        found AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY nth) AS ids FROM kept LEFT JOIN vocab USING (token) GROUP BY 1),
        seqs AS (SELECT doc_id, list_concat([2], coalesce(ids, []), [3]) AS seq FROM toks LEFT JOIN found USING (doc_id))
        SELECT 'N' || doc_id AS news_id, array_to_string(list_transform(range(1, 65), lambda i: {ids}), ' ') AS input_ids,
        CAST(len(seq) AS INTEGER) AS n_ids FROM seqs"""
    sql["t6_encode_text_pairs"] = rf"""WITH {VOCAB},
        sides AS (SELECT doc_id, words AS a, words AS b FROM toks),
        budget AS (SELECT *, len(a) AS la, len(b) AS lb FROM sides),
        kept AS (SELECT doc_id,
          a[1 : CASE WHEN la + lb <= 61 THEN la WHEN least(la, lb) <= 30 THEN CASE WHEN la > lb THEN 61 - lb ELSE la END
                WHEN la > lb THEN 31 ELSE 30 END] AS a,
          b[1 : CASE WHEN la + lb <= 61 THEN lb WHEN least(la, lb) <= 30 THEN CASE WHEN la > lb THEN lb ELSE 61 - la END
                WHEN la > lb THEN 30 ELSE 31 END] AS b FROM budget),
        flat AS (SELECT doc_id, 'a' AS side, unnest(a) AS token, generate_subscripts(a, 1) AS nth FROM kept
          UNION ALL SELECT doc_id, 'b', unnest(b), generate_subscripts(b, 1) FROM kept),
        found AS (SELECT doc_id, side, list(coalesce(id, 1) ORDER BY nth) AS ids FROM flat LEFT JOIN vocab USING (token) GROUP BY 1, 2),
        seqs AS (SELECT doc_id, list_concat(list_concat([2], coalesce(fa.ids, []), [3]), list_concat(coalesce(fb.ids, []), [3])) AS seq
          FROM kept LEFT JOIN (SELECT * FROM found WHERE side = 'a') fa USING (doc_id)
          LEFT JOIN (SELECT * FROM found WHERE side = 'b') fb USING (doc_id))
        SELECT 'N' || doc_id AS news_id, array_to_string(list_transform(range(1, 65), lambda i: {ids}), ' ') AS input_ids,
        CAST(len(seq) AS INTEGER) AS n_ids FROM seqs"""
    sql["t7_build_vocab"] = f"WITH {VOCAB} SELECT token, n, id FROM vocab"
    sql["t8_token_count"] = f"WITH {TOKENS} SELECT 'N' || doc_id AS news_id, CAST(len(words) AS INTEGER) AS n_tokens FROM toks"

    # ---- scoring
    sql["m1_encode_news"] = """SELECT 'N' || doc_id AS news_id, array_to_string(list_transform(range(97, 123),
        lambda c: length(text) - length(replace(text, chr(CAST(c AS INTEGER)), ''))), ' ') AS vec FROM documents"""
    sql["m2_additive_attention_pool"] = f"""WITH {SHOWN}, {LOGITS}, dims AS (SELECT unnest(range(1, 65)) AS d)
        SELECT impression_id, CAST(d - 1 AS INTEGER) AS dim, 
        round(sum(exp(coalesce(logit, 0)) * coalesce(vec[d], 0)) / sum(exp(coalesce(logit, 0))), 6) AS x
        FROM shown LEFT JOIN nl ON nl.news_id = shown.news_id AND pos <> 3, dims GROUP BY 1, 2"""
    sql["m3_personalized_attention_pool"] = f"""WITH {SHOWN}, {SPLIT}, {VECTORS}, {QUERIES_SQL}, dims AS (SELECT unnest(range(1, 65)) AS d),
        weighted AS (SELECT impression_id, nv.vec, exp(list_dot_product(nv.vec, query)) AS e
          FROM shown JOIN user_index USING (user_id) JOIN uq USING (user_idx) JOIN nv USING (news_id))
        SELECT impression_id, CAST(d - 1 AS INTEGER) AS dim, round(sum(e * vec[d]) / sum(e), 6) AS x FROM weighted, dims GROUP BY 1, 2"""
    sql["m4_self_attention"] = f"""WITH {BEHAVIORS}, {VECTORS}, {HISTORIES}, {_self_attention()}
        SELECT history_key, CAST(slot AS INTEGER) AS slot, CAST(times AS INTEGER) AS times, {_vector_digest('vec')} FROM attended"""
    sql["m5_user_vector_additive"] = f"""WITH {BEHAVIORS}, {LOGITS}, {USER_VECTORS}
        SELECT history_key, CAST(d - 1 AS INTEGER) AS dim, round(x, 6) AS x FROM pooled"""
    sql["m6_user_vector_personalized"] = f"""WITH {BEHAVIORS}, {SPLIT}, {VECTORS}, {QUERIES_SQL},
        used AS (SELECT DISTINCT coalesce(user_idx, 0) AS user_idx, coalesce(history, CAST([] AS VARCHAR[]))[1:{KEPT}] AS history
          FROM beh LEFT JOIN user_index USING (user_id)),
        slots AS (SELECT user_idx, history, unnest(history) AS news_id FROM used),
        dims AS (SELECT unnest(range(1, 65)) AS d),
        weighted AS (SELECT user_idx, history, vec, exp(list_dot_product(vec, query)) AS e
          FROM slots JOIN uq USING (user_idx) JOIN nv USING (news_id))
        SELECT user_idx, md5(array_to_string(history, ' ')) AS history_key, CAST(d - 1 AS INTEGER) AS dim,
        round(coalesce(sum(e * vec[d]), 0) / (coalesce(sum(e), 0) + {KEPT} - len(history)), 6) AS x
        FROM used LEFT JOIN weighted USING (user_idx, history), dims GROUP BY user_idx, history, d"""
    sql["m7_user_vector_selfattn"] = f"""WITH {BEHAVIORS}, {VECTORS}, {HISTORIES}, {_self_attention()}, {_matrix('add', 64, 8, 7)},
        weighted AS (SELECT history_key, vec, times * exp(list_sum(list_transform(range(1, 9),
          lambda j: sin(13 * j + 3) * tanh(list_dot_product(vec, add_w[j]))))) AS e FROM attended, add),
        dims AS (SELECT unnest(range(1, 65)) AS d)
        SELECT history_key, CAST(d - 1 AS INTEGER) AS dim, round(sum(e * vec[d]) / sum(e), 6) AS x FROM weighted, dims GROUP BY 1, 2"""
    sql["m8_score_candidates"] = f"WITH {SCORED} SELECT impression_id, pos, news_id, clicked, score FROM scored"
    sql["m9_listwise_loss"] = f"""WITH {SCORED}, {SAMPLE},
        {SAMPLED},
        losses AS (SELECT impression_id, ln(sum(exp(score))) - max(CASE WHEN clicked = 1 THEN score END) AS loss FROM sampled GROUP BY 1)
        SELECT count(*) AS samples, round(avg(loss), 6) AS loss FROM losses"""

    sql["m10_fit_ranker"] = f"""WITH RECURSIVE {SCORED}, {SAMPLE}, {CLICK_MODEL}
        SELECT CAST(0 AS INTEGER) AS place, round(b0, 4) AS weight FROM fit UNION ALL SELECT CAST(1 AS INTEGER), round(b1, 4) FROM fit"""
    sql["m11_score_with_ranker"] = f"""WITH RECURSIVE {SCORED}, {SAMPLE}, {CLICK_MODEL}
        SELECT impression_id, pos, news_id, clicked, round(b0 + b1 * score, 3) AS score FROM scored, fit"""

    weights = "SELECT CAST(unnest(range(65)) AS INTEGER) AS place, round(unnest(w), 6) AS weight FROM w_3"
    sql["m10_train_ranker"] = f"WITH RECURSIVE {SCORED}, {_trained(0)} {weights}"
    sql["m10_train_ranker_decay"] = f"WITH RECURSIVE {SCORED}, {_trained(1e-4)} {weights}"
    judged = """judged AS (
          SELECT impression_id, pos, extended.news_id, clicked, round(w[1] + list_dot_product(w[2:65],
            list_transform(range(1, 65), lambda i: coalesce(nv.vec[i], 0) * user_vec[i])), 9) AS score
          FROM extended JOIN used USING (impression_id) JOIN user_vec USING (history_key) LEFT JOIN nv USING (news_id), w_3)"""
    sql["m11_score_linear"] = f"""WITH RECURSIVE {SCORED}, {_trained(0)}, {judged}
        SELECT impression_id, pos, news_id, clicked, round(score, 6) AS score FROM judged"""
    sql["w9_evaluate_ranker"] = f"""WITH RECURSIVE {SCORED}, {_trained(0)}, {judged},
        {METRICS.replace("scored", "judged")} SELECT {_AVERAGES} FROM metrics"""

    sql["m6_personal_news_vectors"] = f"""WITH {BEHAVIORS}, {SPLIT}, {VECTORS}, {QUERIES_SQL}, {PERSONAL_NEWS}
        SELECT user_idx, news_id, {_vector_digest('vec')} FROM pn"""
    sql["m6_user_vector_personal_news"] = f"""WITH {BEHAVIORS}, {SPLIT}, {VECTORS}, {QUERIES_SQL}, {PERSONAL_NEWS}
        SELECT user_idx, history_key, CAST(d - 1 AS INTEGER) AS dim, round(x, 6) AS x FROM pooled"""
    sql["w9_evaluate_personal_news"] = f"""WITH {BEHAVIORS}, {SPLIT}, {VECTORS}, {QUERIES_SQL}, {PERSONAL_NEWS},
        user_vec AS (SELECT user_idx, history_key, list(x ORDER BY d) AS user_vec FROM pooled GROUP BY ALL),
        extended AS (
          SELECT impression_id, pos, news_id, clicked FROM shown
          UNION ALL SELECT impression_id, CAST(len(labels) AS INTEGER), 'EMPTY_NEWS_ID', 0 FROM imp),
        scored AS (
          SELECT impression_id, pos, extended.news_id, clicked, coalesce(round(list_dot_product(pn.vec, user_vec), 9), 0) AS score
          FROM extended JOIN used USING (impression_id) JOIN user_vec USING (user_idx, history_key)
          LEFT JOIN pn ON pn.user_idx = used.user_idx AND pn.news_id = extended.news_id),
        {METRICS} SELECT {_AVERAGES} FROM metrics"""
    sql["m1_hashed_news"] = f"""WITH {TOKENS},
        flat AS (SELECT doc_id, unnest(words) AS token FROM toks),
        counts AS (
          SELECT doc_id, CAST(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS n
          FROM flat GROUP BY ALL),
        df AS (SELECT bucket, count(*) AS n_docs FROM counts GROUP BY 1)
        SELECT 'N' || doc_id AS news_id, bucket, round(n * ln(((SELECT count(*) FROM documents) + 1) / (n_docs + 1)), 6) AS weight
        FROM counts JOIN df USING (bucket)"""
    sql["x7_batch_files"] = f"""WITH {BEHAVIORS}, placed AS (
          SELECT impression_id, row_number() OVER (ORDER BY md5('42:1:batch:' || impression_id)) - 1 AS nth FROM imp),
        batched AS (SELECT impression_id, CAST(nth // 128 AS BIGINT) AS batch, CAST(nth % 128 AS BIGINT) AS place, CAST(nth // 1024 AS INTEGER) AS run FROM placed)
        SELECT *, min(batch) OVER (PARTITION BY run) AS first, max(batch) OVER (PARTITION BY run) AS last,
        count(*) OVER (PARTITION BY run) AS rows FROM batched"""

    # ---- reports: one run per text method, scored by the number of letters, words and lines of the text
    sql["a10_compare_runs"] = f"""WITH {SHOWN}, {NEWS},
        texts AS (
          SELECT news_id, 'title only' AS method, length(coalesce(title, '')) AS size FROM news UNION ALL
          SELECT news_id, 'template', length(coalesce(title, '') || 'The category is ' || subcategory) FROM news UNION ALL
          SELECT news_id, 'generated', length(coalesce(title, '') || description) FROM news JOIN descriptions ON subcategory = descriptions.category),
        runs AS (SELECT * FROM (VALUES ('short', 'first', -1.0), ('long', 'first', 1.0)) r(model, backbone, sign)),
        scored AS (
          SELECT (method, model) AS run, method, model, backbone, (method, model, impression_id) AS impression_id, pos, clicked,
                 CAST(sign * size AS DOUBLE) AS score
          FROM shown JOIN texts USING (news_id), runs),
        {METRICS},
        means AS (
          SELECT impression_id[1] AS method, impression_id[2] AS model, avg(auc) AS auc, avg(mrr) AS mrr, avg(ndcg_at_5) AS ndcg_at_5,
                 avg(ndcg_at_10) AS ndcg_at_10 FROM metrics GROUP BY 1, 2),
        long AS (UNPIVOT means ON auc, mrr, ndcg_at_5, ndcg_at_10 INTO NAME metric VALUE value),
        wide AS (
          SELECT model, 'first' AS backbone, metric, max(CASE WHEN method = 'title only' THEN value END) AS title_only,
                 max(CASE WHEN method = 'template' THEN value END) AS template,
                 max(CASE WHEN method = 'generated' THEN value END) AS generated FROM long GROUP BY 1, 3)
        SELECT model, backbone, metric, round(title_only, 6) AS title_only, round(template, 6) AS template, round(generated, 6) AS generated,
               round(generated / title_only - 1, 6) AS gain_over_title_only, round(generated / template - 1, 6) AS gain_over_template
        FROM wide"""
    return sql
