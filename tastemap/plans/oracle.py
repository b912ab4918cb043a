"""DuckDB SQL for each registered query, over the same parquet tables.

Doubles are rounded with the same IEEE formula as ``numeric.round_half_up``
at 6 places, so both sides print the same digits.
"""

from __future__ import annotations


def r6(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6)"


def _text2_sql(x: str) -> str:
    """Two-place text, half up on the IEEE value, or N/A for null."""
    return f"coalesce(printf('%.2f', sign({x}) * floor(abs({x}) * 100 + 0.5) / 100), 'N/A')"


# Shared views: ratings from lineitem x orders, canonical ratings, catalogue.
RAW = """
raw AS (
  SELECT o.o_custkey AS user_key, l.l_partkey AS item_id,
         CAST(floor(l.l_quantity / 5) AS INTEGER) AS rating,
         l.l_orderkey, l.l_linenumber, l.l_quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_partkey IS NOT NULL AND o.o_custkey IS NOT NULL)"""

CANON = RAW + """,
canon AS (
  SELECT user_key, item_id,
         max_by(rating, (l_orderkey, l_linenumber, l_quantity)) AS rating
  FROM raw WHERE rating > 0 GROUP BY user_key, item_id)"""

CATALOGUE = CANON + """,
stats AS (
  SELECT item_id, avg(rating) AS average_rating, count(*) AS num_ratings
  FROM canon GROUP BY item_id),
catalogue AS (
  SELECT p.p_partkey AS item_id, p.p_name AS title, s.average_rating,
         coalesce(s.num_ratings, 0) AS num_ratings
  FROM part p LEFT JOIN stats s ON s.item_id = p.p_partkey)"""


SIMILAR_RANKED = "WITH " + CATALOGUE + """,
users AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1),
items AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0),
per_pos AS (
  SELECT pos, avg(x) AS m
  FROM (SELECT unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM users)
  GROUP BY pos),
mean AS (SELECT list(m ORDER BY pos) AS mv FROM per_pos),
dir AS (SELECT list_transform(mv, lambda x: x / sqrt(list_sum(list_transform(mv, lambda y: y * y)))) AS d FROM mean),
proj AS (
  SELECT id, v, list_transform(v, lambda x, i: x - list_sum(list_transform(v, lambda a, j: a * d[j])) * d[i]) AS p
  FROM items, dir),
units AS (
  SELECT id, list_transform(p, lambda x: x / sqrt(list_sum(list_transform(p, lambda y: y * y)))) AS u
  FROM proj
  WHERE sqrt(list_sum(list_transform(p, lambda y: y * y)))
        > 1e-9 * sqrt(list_sum(list_transform(v, lambda y: y * y)))),
pairs AS (
  SELECT a.id AS src_id, b.id AS item_id,
         list_sum(list_transform(a.u, lambda x, i: x * b.u[i])) AS similarity
  FROM units a JOIN units b ON a.id <> b.id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank
  FROM pairs)"""

SIMILAR_TOP5 = SIMILAR_RANKED + f"""
SELECT r.src_id, s.title AS src_title, r.rank, r.item_id, c.title,
       {r6('r.similarity')} AS similarity, {r6('c.average_rating')} AS average_rating, c.num_ratings
FROM ranked r JOIN catalogue c ON c.item_id = r.item_id JOIN catalogue s ON s.item_id = r.src_id
WHERE r.rank <= 5
"""

SIMILAR_REPORT = SIMILAR_RANKED + f"""
SELECT r.src_id, s.title AS src_title, r.rank, r.item_id, c.title,
       sign(r.similarity) * floor(abs(r.similarity) * 1000 + 0.5) / 1000 AS similarity_3dp,
       {_text2_sql('c.average_rating')} AS average_text,
       '/items/' || CAST(r.item_id AS VARCHAR) AS link
FROM ranked r JOIN catalogue c ON c.item_id = r.item_id JOIN catalogue s ON s.item_id = r.src_id
WHERE r.rank <= 20
"""


RATINGS_CANONICAL = "WITH " + CANON + """
SELECT user_key, item_id, rating FROM canon
"""

POPULARITY_FILTERED_COUNTS = "WITH " + CANON + """,
popular AS (SELECT item_id FROM raw GROUP BY item_id HAVING count(*) >= 30),
train AS (SELECT * FROM canon WHERE item_id IN (SELECT item_id FROM popular))
SELECT (SELECT count(*) FROM popular) AS n_popular_items,
       (SELECT count(*) FROM raw WHERE rating > 0 AND item_id IN (SELECT item_id FROM popular)) AS n_raw_rated,
       count(*) AS n_ratings, count(DISTINCT user_key) AS n_users, count(DISTINCT item_id) AS n_items
FROM train
"""

ITEM_STATS = "WITH " + CATALOGUE + f"""
SELECT item_id, title, {r6('average_rating')} AS average_rating, num_ratings FROM catalogue
"""

# Closed-form fold-in at k = 2, lambda 0.1: the values of each half of an embedding are added up.
FOLDIN_K2 = CANON + """,
items AS (SELECT vec_id AS item_id, list_sum(CAST(embedding[1:32] AS DOUBLE[])) AS x0,
                 list_sum(CAST(embedding[33:64] AS DOUBLE[])) AS x1 FROM embeddings),
known AS (SELECT c.user_key, c.item_id, c.rating, i.x0, i.x1
          FROM canon c JOIN items i ON i.item_id = c.item_id),
sums AS (SELECT user_key, sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS d,
                sum(x0 * rating) AS p, sum(x1 * rating) AS q, count(*) AS n
         FROM known GROUP BY user_key),
sol AS (SELECT user_key, n,
               ((d + n * 0.1::DOUBLE) * p - b * q)
                 / ((a + n * 0.1::DOUBLE) * (d + n * 0.1::DOUBLE) - b * b) AS u0,
               ((a + n * 0.1::DOUBLE) * q - b * p)
                 / ((a + n * 0.1::DOUBLE) * (d + n * 0.1::DOUBLE) - b * b) AS u1
        FROM sums)"""

FOLDIN_RANK2 = "WITH " + FOLDIN_K2 + f"""
SELECT user_key, n, {r6('u0')} AS u0, {r6('u1')} AS u1 FROM sol
"""

RECOMMEND_RANK2_TOP10 = "WITH " + FOLDIN_K2 + """,
stats AS (SELECT item_id, avg(rating) AS average_rating, count(*) AS num_ratings
          FROM canon GROUP BY item_id),
catalogue AS (SELECT p.p_partkey AS item_id, p.p_name AS title, s.average_rating,
                     coalesce(s.num_ratings, 0) AS num_ratings
              FROM part p LEFT JOIN stats s ON s.item_id = p.p_partkey),
scores AS (
  SELECT u.user_key, i.item_id, u.u0 * i.x0 + u.u1 * i.x1 AS predicted_score
  FROM sol u CROSS JOIN items i
  WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.user_key = u.user_key AND c.item_id = i.item_id)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_key ORDER BY predicted_score DESC, item_id)
                 AS INTEGER) AS rank
  FROM scores)""" + f"""
SELECT r.user_key, r.rank, r.item_id, c.title, {r6('r.predicted_score')} AS predicted_score,
       {r6('c.average_rating')} AS average_rating, c.num_ratings
FROM ranked r JOIN catalogue c ON c.item_id = r.item_id
WHERE r.rank <= 10
"""

RECOMMEND_LEAVE_LAST_OUT = "WITH " + FOLDIN_K2.replace("""
  FROM raw WHERE rating > 0 GROUP BY user_key, item_id)""", """,
         max((l_orderkey, l_linenumber, rating)) AS seq
  FROM raw WHERE rating > 0 GROUP BY user_key, item_id),
held AS (SELECT user_key, max_by(item_id, (seq, item_id)) AS item_id FROM canon0 GROUP BY user_key),
canon AS (SELECT c.user_key, c.item_id, c.rating FROM canon0 c
          WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_key = c.user_key AND h.item_id = c.item_id))""").replace(
    "canon AS (\n  SELECT user_key", "canon0 AS (\n  SELECT user_key", 1) + """,
scores AS (
  SELECT u.user_key, i.item_id, u.u0 * i.x0 + u.u1 * i.x1 AS predicted_score
  FROM sol u CROSS JOIN items i
  WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.user_key = u.user_key AND c.item_id = i.item_id)),
top AS (
  SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY predicted_score DESC, item_id) AS rank FROM scores
  QUALIFY rank <= 10),
each AS (
  SELECT t.user_key, min(CASE WHEN t.item_id = h.item_id THEN rank END) AS rank
  FROM top t JOIN held h ON h.user_key = t.user_key GROUP BY t.user_key),
means AS (
  SELECT count(*) AS users, count(rank) AS hits, avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS hit_rate,
         avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / rank END) AS mrr,
         avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / log2(rank + 1) END) AS ndcg
  FROM each)
""" + f"""
SELECT users, hits, {r6('hit_rate')} AS hit_rate, {r6('hit_rate / 10')} AS precision, {r6('mrr')} AS mrr,
       {r6('ndcg')} AS ndcg FROM means
"""

def _search(terms: str, least: int = 1) -> str:
    return "WITH " + CATALOGUE + f""",
terms AS ({terms}),
clean AS (SELECT q, lower(trim(q)) AS ql FROM terms WHERE length(trim(q)) >= {least}),
m AS (
  SELECT t.q, c.item_id, c.title, c.average_rating, c.num_ratings,
         CASE WHEN starts_with(lower(c.title), t.ql) THEN 1
              WHEN contains(lower(c.title), ' ' || t.ql) THEN 2 ELSE 3 END AS tier
  FROM clean t JOIN catalogue c ON contains(lower(c.title), t.ql)),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY tier, num_ratings DESC NULLS LAST, item_id)
                 AS INTEGER) AS rank
  FROM m)
SELECT q, rank, item_id, title, {r6('average_rating')} AS average_rating, num_ratings, tier
FROM r WHERE rank <= 10
"""


SEARCH_TOP10 = _search("SELECT * FROM (VALUES ('an'), ('blu'), ('NVIL'), ('zzz')) v(q)")

SEARCH_TITLE_WORDS = _search("""
  WITH words AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
  SELECT DISTINCT q FROM (
    SELECT w AS q FROM words WHERE length(w) > 0
    UNION ALL SELECT upper(substr(w, 1, 3)) FROM words WHERE length(w) > 0)""")

SEARCH_AS_TYPED = _search("""
  WITH words AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
  SELECT DISTINCT substr(w, 1, n) AS q FROM words, (VALUES (1), (2), (3)) v(n) WHERE length(w) > 0""", 2)

SIMILAR_REQUEST_STATUS = r"""
WITH req AS (
  SELECT event_id AS request_id,
         CASE event_type
           WHEN 'click' THEN json_extract_string(props, '$.k')
           WHEN 'purchase' THEN ' ' || json_extract_string(props, '$.k') || ' '
           WHEN 'view' THEN CAST(value AS VARCHAR)
           WHEN 'error' THEN CASE WHEN event_id % 2 = 0
             THEN '99999999999999999999' || json_extract_string(props, '$.k') ELSE props END END AS item_text
  FROM events),
parsed AS (
  SELECT request_id, item_text,
         CASE WHEN regexp_full_match(item_text, '\s*[+-]?[0-9]+(_[0-9]+)*\s*')
              THEN TRY_CAST(replace(regexp_replace(item_text, '\s', '', 'g'), '_', '') AS BIGINT)
         END AS item_id
  FROM req),
model AS (SELECT vec_id AS item_id FROM embeddings WHERE vec_id % 2 = 0)
SELECT request_id, item_id,
       CASE WHEN item_text IS NULL OR length(trim(item_text)) = 0 THEN 'missing_id'
            WHEN item_id IS NULL THEN 'invalid_id'
            WHEN item_id NOT IN (SELECT item_id FROM model) THEN 'unknown_item'
            WHEN item_id NOT IN (SELECT p_partkey FROM part) THEN 'not_found'
            ELSE 'ok' END AS status
FROM parsed
"""

RECOMMEND_REQUEST_STATUS = "WITH " + CANON + """,
model AS (SELECT vec_id AS item_id FROM embeddings),
per_user AS (
  SELECT c.user_key, count(*) AS n_rated, count(m.item_id) AS n_known
  FROM canon c LEFT JOIN model m ON m.item_id = c.item_id GROUP BY c.user_key)
SELECT k.c_custkey AS request_id, k.c_custkey AS user_key,
       coalesce(p.n_rated, 0) AS n_rated, coalesce(p.n_known, 0) AS n_known,
       CASE WHEN k.c_custkey IS NULL THEN 'missing_user'
            WHEN coalesce(p.n_rated, 0) = 0 THEN 'no_rated_items'
            WHEN coalesce(p.n_known, 0) = 0 THEN 'no_known_items'
            ELSE 'ok' END AS status
FROM customer k LEFT JOIN per_user p ON p.user_key = k.c_custkey
"""


VECTOR_USERS = CANON + """,
items AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sol AS (SELECT vec_id AS user_key, CAST(embedding AS DOUBLE[]) AS u FROM embeddings WHERE vec_id % 2 = 1)"""


def _ranked_recs(n: int, users: str | None = None,
                 score: str = "list_sum(list_transform(u.u, lambda a, j: a * i.x[j]))") -> str:
    return "WITH " + (users or VECTOR_USERS) + f""",
stats AS (SELECT item_id, avg(rating) AS average_rating, count(*) AS num_ratings
          FROM canon GROUP BY item_id),
catalogue AS (SELECT p.p_partkey AS item_id, p.p_name AS title, s.average_rating,
                     coalesce(s.num_ratings, 0) AS num_ratings
              FROM part p LEFT JOIN stats s ON s.item_id = p.p_partkey),
scores AS (
  SELECT u.user_key, i.item_id, {score} AS predicted_score
  FROM sol u CROSS JOIN items i
  WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.user_key = u.user_key AND c.item_id = i.item_id)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_key ORDER BY predicted_score DESC, item_id)
                 AS INTEGER) AS rank
  FROM scores),
recs AS (
  SELECT r.*, c.title, c.average_rating, c.num_ratings
  FROM ranked r JOIN catalogue c ON c.item_id = r.item_id WHERE r.rank <= {n})"""


def _text2(x: str) -> str:
    return f"coalesce(printf('%.2f', sign({x}) * floor(abs({x}) * 100 + 0.5) / 100), 'N/A')"


REPORT_PAGES = _ranked_recs(100) + f"""
SELECT user_key, rank, CAST(floor((rank - 1) / 20) + 1 AS INTEGER) AS page,
       CAST(ceil(count(*) OVER (PARTITION BY user_key) / 20) AS INTEGER) AS n_pages,
       CAST(least((floor((rank - 1) / 20) + 1) * 20, count(*) OVER (PARTITION BY user_key))
            AS BIGINT) AS page_end,
       count(*) OVER (PARTITION BY user_key) AS total_items,
       item_id, title,
       {_text2('predicted_score')} AS predicted_text,
       {_text2('average_rating')} AS average_text,
       '/items/' || CAST(item_id AS VARCHAR) AS link
FROM recs
"""

RECOMMEND_VECTORS_TOP10 = _ranked_recs(10) + f"""
SELECT user_key, rank, item_id, title, {r6('predicted_score')} AS predicted_score,
       {r6('average_rating')} AS average_rating, num_ratings FROM recs
"""

RECOMMEND_PLACEHOLDERS = _ranked_recs(10) + f""",
listed AS (SELECT * FROM catalogue WHERE item_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')),
found AS (
  SELECT r.user_key, r.rank, r.item_id, c.title, c.average_rating, c.num_ratings, c.item_id IS NOT NULL AS hit,
         count(c.item_id) OVER (PARTITION BY r.user_key) AS hits
  FROM ranked r LEFT JOIN listed c ON c.item_id = r.item_id WHERE r.rank <= 10)
SELECT user_key, rank, item_id, coalesce(title, 'Item ' || CAST(item_id AS VARCHAR)) AS title,
       {r6('average_rating')} AS average_rating, coalesce(num_ratings, 0) AS num_ratings
FROM found WHERE hit OR hits = 0
"""

RESULT_ENVELOPE_COUNTS = _ranked_recs(10) + """
SELECT user_key, count(*) AS total_items, arg_min(item_id, rank) AS first_item_id,
       arg_max(item_id, rank) AS last_item_id,
       CAST(to_json({'user_key': user_key,
                     'recommendations': list({'item_id': item_id, 'title': title} ORDER BY rank),
                     'total_items': count(*)}) AS VARCHAR) AS json
FROM recs GROUP BY user_key
"""

LIST_PAGES_EXPLODED = "WITH " + RAW + """
SELECT CAST(user_key AS VARCHAR) AS user_key, item_id, rating FROM raw WHERE rating > 0
"""

LIST_PAGES_SUMMARY = "WITH " + RAW + """
SELECT CAST(user_key AS VARCHAR) AS user_key, CAST(ceil(count(*) / 1000) AS BIGINT) AS pages, count(*) AS entries,
       count(*) FILTER (WHERE rating > 0) AS rated, TRUE AS complete
FROM raw GROUP BY user_key
"""

LIST_PAGES_GAP = "WITH " + RAW + """
SELECT CAST(user_key AS VARCHAR) AS user_key,
       CAST(ceil(count(*) / 20) - CASE WHEN count(*) > 20 AND user_key % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pages,
       NOT (count(*) > 20 AND user_key % 7 = 0) AS complete
FROM raw GROUP BY user_key
"""

QUOTA_DAILY = """
SELECT user_id AS client, event_type AS endpoint, date_trunc('day', ts) AS window_start,
       date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS calls,
       CAST(2 AS BIGINT) AS quota
FROM events GROUP BY ALL HAVING count(*) > 2
"""

TRAIN = "WITH " + CANON + """,
popular AS (SELECT item_id FROM raw GROUP BY item_id HAVING count(*) >= 30),
train AS (SELECT * FROM canon WHERE item_id IN (SELECT item_id FROM popular))"""

DENSE_INDEX_USERS = "WITH " + CANON + """
SELECT user_key, CAST(row_number() OVER (ORDER BY user_key) - 1 AS INTEGER) AS user
FROM (SELECT DISTINCT user_key FROM canon)
"""

DENSE_INDEX_EXTENDED = "WITH " + CANON + """,
old AS (SELECT user_key, row_number() OVER (ORDER BY user_key) - 1 AS user
        FROM (SELECT DISTINCT user_key FROM canon WHERE item_id % 2 = 1))
SELECT user_key, CAST(user AS INTEGER) AS user FROM old
UNION ALL
SELECT user_key, CAST((SELECT count(*) FROM old) + row_number() OVER (ORDER BY user_key) - 1 AS INTEGER)
FROM (SELECT DISTINCT user_key FROM canon WHERE user_key NOT IN (SELECT user_key FROM old))
"""

ITEM_STATS_MERGED = "WITH " + CANON + f"""
SELECT item_id, {r6('avg(rating)')} AS average_rating, count(*) AS num_ratings, TRUE AS users_ok
FROM canon GROUP BY item_id
"""

TRAINING_TRIPLES_ROUNDTRIP = TRAIN + """,
ui AS (SELECT user_key, row_number() OVER (ORDER BY user_key) - 1 AS user
       FROM (SELECT DISTINCT user_key FROM train)),
ii AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item
       FROM (SELECT DISTINCT item_id FROM train))
SELECT CAST(ui.user AS INTEGER) AS user, CAST(ii.item AS INTEGER) AS item,
       CAST(t.rating AS FLOAT) AS rating
FROM train t JOIN ui ON ui.user_key = t.user_key JOIN ii ON ii.item_id = t.item_id
"""

ALS_STATIONARY = TRAIN + """
SELECT user_key, count(*) AS n, TRUE AS ok FROM train GROUP BY user_key
"""

FOLDIN_RANK64 = "WITH " + CANON + """
SELECT user_key, count(*) AS n, TRUE AS ok FROM canon
WHERE item_id IN (SELECT vec_id FROM embeddings) GROUP BY user_key
"""

FOLDIN_HOUSEHOLD = "WITH " + RAW + """,
canon AS (
  SELECT DISTINCT CASE WHEN user_key % 3 = 0 THEN 0 ELSE user_key END AS user_key, item_id FROM raw WHERE rating > 0)
SELECT user_key, count(*) AS n, TRUE AS ok FROM canon
WHERE item_id IN (SELECT vec_id FROM embeddings) GROUP BY user_key
"""

ALS_RECOMMEND_CHECKS = TRAIN + """,
model AS (SELECT DISTINCT item_id FROM train)
SELECT user_key, least(10, (SELECT count(*) FROM model) - count(*)) AS n_rows, TRUE AS ranks_ok,
       TRUE AS none_rated, TRUE AS scores_ok
FROM canon WHERE item_id IN (SELECT item_id FROM model)
GROUP BY user_key HAVING count(*) < (SELECT count(*) FROM model)
"""

ALS_SIMILAR_CHECKS = TRAIN + """,
model AS (SELECT DISTINCT item_id FROM train)
SELECT item_id AS src_id, least(10, (SELECT count(*) - 1 FROM model)) AS n_rows, TRUE AS ranks_ok,
       TRUE AS no_self, TRUE AS scores_ok
FROM model
"""

ALS_MODEL_CHECKS = TRAIN + """
SELECT count(DISTINCT item_id) AS n_index, count(DISTINCT item_id) AS n_factors,
       0::BIGINT AS missing, 0::BIGINT AS orphans, 0::BIGINT AS bad_length,
       0::BIGINT AS not_finite
FROM train
"""

MODEL_CHECKS_EMBEDDINGS = """
SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS n_index,
       (SELECT count(*) FROM embeddings) AS n_factors,
       (SELECT count(*) FROM (SELECT DISTINCT p_partkey FROM part) p
         WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)) AS missing,
       (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)) AS orphans,
       (SELECT count(*) FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64) AS bad_length,
       (SELECT count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0)
         AS not_finite
"""

def _daily_calls(more: str = "") -> str:
    return f"""
SELECT user_id AS client, event_type AS endpoint, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
       count(*) AS calls{more}
FROM events GROUP BY 1, 2, 3
"""


QUOTA_HOURLY_BY_ENDPOINT = """
SELECT user_id AS client, event_type AS endpoint, date_trunc('hour', ts) AS window_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS calls,
       CAST(CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS BIGINT) AS quota
FROM events GROUP BY ALL
HAVING count(*) > CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END
"""

QUOTA_HOURLY_ROUTES = """
WITH log AS (
  SELECT user_id AS client, ts, CASE event_type WHEN 'view' THEN 'recommendations' WHEN 'click' THEN 'similar'
                                ELSE 'search' END AS endpoint FROM events),
quotas(endpoint, quota) AS (VALUES ('recommendations', 30::BIGINT), ('similar', 60), ('search', 1000)),
calls AS (
  SELECT client, endpoint, date_trunc('hour', ts) AS window_start, count(*) AS calls FROM log GROUP BY ALL)
SELECT c.client, c.endpoint, c.window_start, c.window_start + INTERVAL 1 HOUR AS window_end, c.calls, q.quota,
       c.calls > q.quota AS over_quota
FROM calls c JOIN quotas q ON q.endpoint = c.endpoint
"""

RECOMMEND_REQUESTS_SERVED = _ranked_recs(10, FOLDIN_K2, "u.u0 * i.x0 + u.u1 * i.x1") + """,
per_user AS (
  SELECT user_key, count(*) AS total_items, arg_min(item_id, rank) AS first_item_id,
         arg_max(item_id, rank) AS last_item_id
  FROM recs GROUP BY user_key),
model AS (SELECT vec_id AS item_id FROM embeddings),
counts AS (
  SELECT c.user_key, count(*) AS n_rated, count(m.item_id) AS n_known
  FROM canon c LEFT JOIN model m ON m.item_id = c.item_id GROUP BY c.user_key),
st AS (
  SELECT k.c_custkey AS request_id, k.c_custkey AS user_key,
         CASE WHEN k.c_custkey IS NULL THEN 'missing_user'
              WHEN coalesce(n.n_rated, 0) = 0 THEN 'no_rated_items'
              WHEN coalesce(n.n_known, 0) = 0 THEN 'no_known_items'
              ELSE 'ok' END AS status, n_known
  FROM customer k LEFT JOIN counts n ON n.user_key = k.c_custkey)
SELECT request_id, status, coalesce(p.total_items, 0) AS total_items, p.first_item_id, p.last_item_id,
       CASE WHEN status = 'ok' THEN n_known END AS n_known,
       CASE WHEN status = 'ok' THEN TRUE END AS solved, CASE WHEN status = 'ok' THEN TRUE END AS counted,
       CASE WHEN status = 'ok' THEN TRUE END AS ordered, CASE WHEN status = 'ok' THEN TRUE END AS none_rated,
       CASE WHEN status = 'ok' THEN TRUE END AS scores_ok
FROM st LEFT JOIN per_user p ON p.user_key = st.user_key AND st.status = 'ok'
"""

SIMILAR_REQUESTS_SERVED = SIMILAR_RANKED + f""",
req AS (
  SELECT event_id AS request_id,
         CASE event_type
           WHEN 'click' THEN json_extract_string(props, '$.k')
           WHEN 'purchase' THEN ' ' || json_extract_string(props, '$.k') || ' '
           WHEN 'view' THEN CAST(value AS VARCHAR)
           WHEN 'error' THEN CASE WHEN event_id % 2 = 0
             THEN '99999999999999999999' || json_extract_string(props, '$.k') ELSE props END END AS item_text
  FROM events),
parsed AS (
  SELECT request_id, item_text,
         CASE WHEN regexp_full_match(item_text, '\\s*[+-]?[0-9]+(_[0-9]+)*\\s*')
              THEN TRY_CAST(replace(regexp_replace(item_text, '\\s', '', 'g'), '_', '') AS BIGINT)
         END AS item_id
  FROM req),
st AS (
  SELECT request_id, item_id,
         CASE WHEN item_text IS NULL OR length(trim(item_text)) = 0 THEN 'missing_id'
              WHEN item_id IS NULL THEN 'invalid_id'
              WHEN item_id NOT IN (SELECT id FROM units) THEN 'unknown_item'
              WHEN item_id NOT IN (SELECT p_partkey FROM part) THEN 'not_found'
              ELSE 'ok' END AS status
  FROM parsed),
sim AS (
  SELECT r.src_id, r.rank, r.item_id, r.similarity
  FROM ranked r JOIN catalogue c ON c.item_id = r.item_id JOIN catalogue s ON s.item_id = r.src_id
  WHERE r.rank <= 20),
env AS (
  SELECT src_id, count(*) AS total_items, arg_min(item_id, rank) AS first_item_id,
         arg_min(similarity, rank) AS best
  FROM sim GROUP BY src_id)
SELECT st.request_id, st.item_id, st.status,
       CASE WHEN st.status = 'ok' THEN c.title END AS src_title,
       CASE WHEN st.status = 'ok' THEN {r6('c.average_rating')} END AS src_average_rating,
       CASE WHEN st.status = 'ok' THEN c.num_ratings END AS src_num_ratings,
       coalesce(env.total_items, 0) AS total_items, env.first_item_id,
       {r6('env.best')} AS best_similarity
FROM st LEFT JOIN env ON env.src_id = st.item_id AND st.status = 'ok'
        LEFT JOIN catalogue c ON c.item_id = st.item_id
"""

REQUEST_REJECTS = f"""
SELECT * FROM (
  SELECT 'similar' AS kind, request_id, status AS reason FROM ({SIMILAR_REQUEST_STATUS})
  UNION ALL
  SELECT 'recommend' AS kind, request_id, status AS reason FROM ({RECOMMEND_REQUEST_STATUS}))
WHERE reason <> 'ok'
"""

ORACLE = {
    "ratings_canonical": RATINGS_CANONICAL,
    "popularity_filtered_counts": POPULARITY_FILTERED_COUNTS,
    "item_stats": ITEM_STATS,
    "foldin_rank2": FOLDIN_RANK2,
    "foldin_pandas": FOLDIN_RANK64,
    "foldin_household": FOLDIN_HOUSEHOLD,
    "recommend_rank2_top10": RECOMMEND_RANK2_TOP10,
    "recommend_vectors_top10": RECOMMEND_VECTORS_TOP10,
    "recommend_placeholders": RECOMMEND_PLACEHOLDERS,
    "foldin_rank64": FOLDIN_RANK64,
    "als_recommend_checks": ALS_RECOMMEND_CHECKS,
    "als_similar_checks": ALS_SIMILAR_CHECKS,
    "similar_blocks_top5": SIMILAR_TOP5,
    "similar_top5": SIMILAR_TOP5,
    "similar_report": SIMILAR_REPORT,
    "search_top10": SEARCH_TOP10,
    "search_title_words": SEARCH_TITLE_WORDS,
    "search_as_typed": SEARCH_AS_TYPED,
    "search_typed_prefixes": SEARCH_AS_TYPED,
    "recommend_leave_last_out": RECOMMEND_LEAVE_LAST_OUT,
    "similar_request_status": SIMILAR_REQUEST_STATUS,
    "recommend_request_status": RECOMMEND_REQUEST_STATUS,
    "request_rejects": REQUEST_REJECTS,
    "report_pages": REPORT_PAGES,
    "result_envelope_counts": RESULT_ENVELOPE_COUNTS,
    "recommend_requests_served": RECOMMEND_REQUESTS_SERVED,
    "similar_requests_served": SIMILAR_REQUESTS_SERVED,
    "list_pages_exploded": LIST_PAGES_EXPLODED,
    "list_pages_summary": LIST_PAGES_SUMMARY,
    "list_pages_stream": LIST_PAGES_EXPLODED,
    "list_pages_gap": LIST_PAGES_GAP,
    "quota_daily": QUOTA_DAILY,
    "quota_daily_stream": QUOTA_DAILY,
    "quota_daily_stream_runs": QUOTA_DAILY,
    "quota_late_stream": _daily_calls(),
    "quota_alarm_stream": _daily_calls(", TRUE AS alarm_ok"),
    "ratings_latest_stream": RATINGS_CANONICAL,
    "quota_hourly_by_endpoint": QUOTA_HOURLY_BY_ENDPOINT,
    "quota_hourly_routes": QUOTA_HOURLY_ROUTES,
    "dense_index_users": DENSE_INDEX_USERS,
    "dense_index_extended": DENSE_INDEX_EXTENDED,
    "item_stats_merged": ITEM_STATS_MERGED,
    "foldin_refreshed": FOLDIN_RANK64.replace("TRUE AS ok", "TRUE AS ok, TRUE AS same"),
    "training_triples_roundtrip": TRAINING_TRIPLES_ROUNDTRIP,
    "als_stationary": ALS_STATIONARY,
    "als_model_checks": ALS_MODEL_CHECKS,
    "model_checks_embeddings": MODEL_CHECKS_EMBEDDINGS,
}
