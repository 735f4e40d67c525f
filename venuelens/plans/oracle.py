"""The registered queries as SQL for an independent engine (DuckDB), over the same tables.

with the Spark jobs.
"""

from __future__ import annotations

import re
from datetime import timedelta

from venuelens.functions.clock import daily_bounds, week_bounds
from venuelens.functions.text import STOP_WORDS
from venuelens.operators import chat as chat_ops
from venuelens.operators import report as report_ops
from venuelens.plans.registry import AS_OF, AS_OF_TEXT, BASE_URL, F0, F1, M0, M1, P0, P1
from venuelens.sources.tables import DAILY_SUMMARY, WEEKLY_REPORT


def _ts(m) -> str:
    return f"TIMESTAMP '{m:%Y-%m-%d %H:%M:%S}'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"

REVIEWS = EVENTS + """, reviews AS (
  SELECT e.event_type AS place_name, 'G-' || e.event_type AS google_id,
    CAST(e.event_id AS VARCHAR) AS review_id,
    CASE WHEN k % 20 <> 7 THEN 'Guest ' || e.user_id END AS author_title,
    CAST(e.user_id AS VARCHAR) AS author_id, d.text AS review_text,
    CASE (k // 5) % 5 WHEN 0 THEN '{}'
      WHEN 1 THEN '{''Food'': 4, ''Service'': 3, ''Atmosphere'': 5}'
      WHEN 2 THEN '{''Food'': null, ''Service'': 2}'
      WHEN 3 THEN '{''Food'': ''x'', ''Service'': 1}'
      ELSE '{"Food": 2, "Atmosphere": 1}' END AS review_questions,
    'https://reviews.example/' || e.event_id AS review_link,
    1 + k % 5 AS review_rating, e.ts AS review_datetime_utc,
    CAST(e.user_id % 50 AS INTEGER) AS author_reviews_count,
    CAST(e.user_id % 30 AS INTEGER) AS author_ratings_count,
    CASE WHEN k % 10 <> 0 THEN (k - 50) / 50.0::DOUBLE END AS sentiment_score
  FROM ev e LEFT JOIN documents d ON d.doc_id = e.event_id)"""

RAW = REVIEWS + """, base AS (
  SELECT * REPLACE (CASE WHEN CAST(review_id AS BIGINT) % 97 <> 0 THEN review_id END AS review_id),
    CAST(review_id AS BIGINT) AS arrival FROM reviews),
 feed AS (SELECT * FROM base UNION ALL
  SELECT * REPLACE ('sent again' AS review_text, arrival + 1000000000000 AS arrival)
  FROM base WHERE author_reviews_count % 7 = 3),
 raw AS (SELECT * REPLACE (date_trunc('second', review_datetime_utc) AS review_datetime_utc) FROM feed)"""

PLACES = "places AS (SELECT DISTINCT event_type AS place_name FROM events)"
PHONES = """phones AS (SELECT CASE n_regionkey WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase'
    WHEN 3 THEN 'signup' END AS place_name, '+91000000' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS phone
  FROM nation WHERE n_regionkey <= 3)"""
SENT = f"""sent AS (SELECT place_name, '{DAILY_SUMMARY}' AS notification_type, DATE '{AS_OF:%Y-%m-%d}' AS sent_date
  FROM places WHERE length(place_name) % 2 = 0)"""
STATE = f"""state AS (SELECT place_name, '{WEEKLY_REPORT}' AS report_type,
  CAST(DATE '2024-01-13' + CAST((length(place_name) - 4) * 3 AS INTEGER) AS DATE) AS last_report_date
  FROM places WHERE length(place_name) > 4)"""

D0, D1 = daily_bounds(AS_OF)
W0, W1, W2 = week_bounds(AS_OF)
_, T1, T2 = week_bounds(AS_OF_TEXT)
IST = "(review_datetime_utc + INTERVAL 330 MINUTE)"
IST_DATE = f"CAST({IST} AS DATE)"
WEEK = REVIEWS + f""", week AS (SELECT *, {IST_DATE} AS review_date FROM reviews
  WHERE review_datetime_utc >= {_ts(W1)} AND review_datetime_utc < {_ts(W2)})"""
POLAR = REVIEWS + f""", split AS (SELECT *, CASE WHEN review_rating >= 4 THEN 'positive' ELSE 'negative' END AS polarity
  FROM reviews WHERE review_datetime_utc >= {_ts(T1)} AND review_datetime_utc < {_ts(T2)}
    AND review_text IS NOT NULL AND review_rating BETWEEN 1 AND 5)"""
STARS = ", ".join(f"count(*) FILTER (WHERE review_rating = {r}) AS stars_{r}" for r in range(1, 6))
NAMED = {5: "five", 4: "four", 3: "three", 2: "two", 1: "one"}
STAR_SUMS = ", ".join(f"sum(CASE WHEN review_rating = {r} THEN 1 ELSE 0 END)::BIGINT AS {n}_star_reviews"
                      for r, n in NAMED.items())
STAR_NAMES = ", ".join(f"{n}_star_reviews" for n in NAMED.values())
TABLE_COLS = ("place_name, google_id, review_id, author_title, author_id, review_text, review_questions, "
              "review_link, review_rating, review_datetime_utc")

DAILY = f"""daily AS (SELECT p.place_name, coalesce(n, 0) AS total_reviews,
    coalesce(a, 0)::DECIMAL(3,1) AS average_rating, {STAR_NAMES}
  FROM places p LEFT JOIN (SELECT place_name, count(*) AS n, round(avg(review_rating), 1) AS a, {STAR_SUMS}
    FROM reviews WHERE review_datetime_utc >= {_ts(D0)} AND review_datetime_utc < {_ts(D1)}
    GROUP BY 1) x USING (place_name))"""

DIST = f"dist AS (SELECT place_name, {STARS} FROM week GROUP BY 1)"
INSIGHT = """insight AS (SELECT place_name, total AS total_reviews,
   CASE best WHEN stars_1 THEN 1 WHEN stars_2 THEN 2 WHEN stars_3 THEN 3 WHEN stars_4 THEN 4 ELSE 5 END AS most_common_rating,
   best AS most_common_count, round((stars_4 + stars_5) * 100.0::DOUBLE / total, 1) AS high_percent,
   round((stars_1 + stars_2) * 100.0::DOUBLE / total, 1) AS low_percent
  FROM (SELECT *, stars_1 + stars_2 + stars_3 + stars_4 + stars_5 AS total,
    greatest(stars_1, stars_2, stars_3, stars_4, stars_5) AS best FROM dist))"""
TREND = f"""spine AS (SELECT place_name, CAST(first_day + CAST(i AS INTEGER) AS DATE) AS review_date FROM
   (SELECT place_name, min(review_date) AS first_day FROM week GROUP BY 1) , range(7) t(i)),
  trend AS (SELECT s.place_name, s.review_date, {STARS},
   count(w.review_rating) AS total, round(avg(w.review_rating), 4) AS average_rating
  FROM spine s LEFT JOIN week w ON w.place_name = s.place_name AND w.review_date = s.review_date GROUP BY 1, 2)"""
EXTREMES = """lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_name ORDER BY total, review_date) AS n FROM trend) WHERE n = 1),
  hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_name ORDER BY total DESC, review_date) AS n FROM trend) WHERE n = 1),
  extremes AS (SELECT hi.place_name, hi.review_date AS most_date, hi.total AS most_count, hi.average_rating AS most_average,
   lo.review_date AS least_date, lo.total AS least_count, lo.average_rating AS least_average, r.a AS lowest_average, r.b AS highest_average
  FROM hi JOIN lo USING (place_name) JOIN (SELECT place_name, min(average_rating) AS a, max(average_rating) AS b FROM trend GROUP BY 1) r USING (place_name))"""
COMPARE = f"""cmp0 AS (SELECT place_name,
   count(*) FILTER (WHERE review_datetime_utc < {_ts(W1)}) AS previous_count,
   count(*) FILTER (WHERE review_datetime_utc >= {_ts(W1)}) AS current_count,
   avg(review_rating) FILTER (WHERE review_datetime_utc < {_ts(W1)}) AS pa,
   avg(review_rating) FILTER (WHERE review_datetime_utc >= {_ts(W1)}) AS ca
  FROM reviews WHERE review_datetime_utc >= {_ts(W0)} AND review_datetime_utc < {_ts(W2)} GROUP BY 1),
 cmp1 AS (SELECT *, CASE WHEN current_count > previous_count THEN 'up' WHEN current_count < previous_count THEN 'down' ELSE 'same' END AS count_change,
   CASE WHEN ca > pa THEN 'up' WHEN ca < pa THEN 'down' ELSE 'same' END AS average_change FROM cmp0),
 comparison AS (SELECT place_name, previous_count, current_count, round(pa, 4) AS previous_average, round(ca, 4) AS current_average,
   count_change, average_change, CASE
    WHEN count_change = 'up' AND average_change = 'up' THEN 'improved'
    WHEN count_change = 'down' AND average_change = 'down' THEN 'dropped'
    WHEN count_change = 'up' AND average_change = 'down' THEN 'more reviews, lower rating'
    WHEN count_change = 'down' AND average_change = 'up' THEN 'fewer reviews, higher rating'
    ELSE 'no significant change' END AS verdict FROM cmp1)"""

MON = "DECIMAL(18,2)"
ITEMWISE = f"""itemwise AS (SELECT p_name AS item_name, p_retailprice::{MON} AS rate, l_quantity::DECIMAL(18,3) AS qty,
   l_extendedprice::{MON} AS total_amount, p_type AS classification, s_name AS restaurant_name, p_brand AS menu_name,
   CAST(l_shipdate AS DATE) AS date
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""
CATS = {"food": "ECONOMY", "liquor": "SMALL", "soft_drinks": "MEDIUM", "beer": "PROMO", "wine": "STANDARD", "smokes": "LARGE"}
_cat_sums = ", ".join(f"coalesce(sum(l_extendedprice::{MON}) FILTER (WHERE p_type = '{t}'), 0)::{MON} AS {c}" for c, t in CATS.items())
BOOK = f"""split AS (SELECT l_orderkey, {_cat_sums} FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
 book AS (SELECT CAST(o_orderdate AS DATE) AS bill_date, o_orderkey AS bill_number, 1 + o_orderkey % 6 AS pax,
   o_totalprice::{MON} AS gross_amount,
   (CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0 END)::{MON} AS cash,
   (CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE 0 END)::{MON} AS credit_card,
   (CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice ELSE 0 END)::{MON} AS company,
   {", ".join(f"coalesce({c}, 0)::{MON} AS {c}" for c in CATS)}
  FROM orders LEFT JOIN split ON l_orderkey = o_orderkey)"""
KOT = f"""kot AS (SELECT l_orderkey AS bill_number, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS kot_time,
   CAST(o_custkey % 40 AS INTEGER) AS table_number, p_name AS item_name, l_quantity::DECIMAL(18,3) AS quantity,
   l_extendedprice::{MON} AS total_amount, CAST(l_shipdate AS DATE) AS date
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""
FOOT = EVENTS + """, footfall AS (SELECT ts AS booking_time, CASE WHEN k % 4 <> 1 THEN ts + to_minutes(k) END AS seated_time,
   CASE k % 3 WHEN 0 THEN 'Walk in' WHEN 1 THEN 'Online' ELSE 'Phone' END AS booking_type, 1 + k % 8 AS pax,
   'Section ' || (user_id % 4) AS sections, 1 + k % 3 AS visit_count,
   CASE k % 4 WHEN 0 THEN 'Seated' WHEN 1 THEN 'Cancelled' WHEN 2 THEN 'No show' ELSE 'Completed' END AS booking_status,
   event_type AS source_of_booking FROM ev)"""
IN_YEAR = f"date >= DATE '{P0}' AND date < DATE '{P1}'"
TICKETS = f"count(*) AS tickets, sum(quantity)::DECIMAL(18,3) AS quantity, sum(total_amount)::{MON} AS amount"

VECTORS = """vec AS (SELECT vec_id AS id, d.text AS page_content, CAST(1 + label % 5 AS INTEGER) AS rating,
   CAST(DATE '2024-01-01' + CAST(vec_id % 30 AS INTEGER) AS DATE) AS day, embedding
  FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id)"""
REQUESTS = """req AS (SELECT vec_id AS request_id, 'what about ' || vec_id AS question,
   1 + label % 5 AS r1, 1 + (label + 1) % 5 AS r2,
   CAST(DATE '2024-01-01' + CAST(vec_id % 26 AS INTEGER) AS DATE) AS d0,
   CAST(DATE '2024-01-01' + CAST(vec_id % 26 AS INTEGER) + CASE WHEN vec_id % 11 = 10 THEN -2 ELSE 6 END AS DATE) AS d1,
   embedding AS qvec FROM embeddings)"""
KNN = VECTORS + ", " + REQUESTS + """, scored AS (SELECT request_id, id, page_content, rating, day,
    round(list_cosine_similarity(qvec::DOUBLE[], embedding::DOUBLE[]), 9) AS s
  FROM req JOIN vec ON rating IN (r1, r2) AND day BETWEEN d0 AND d1),
 knn AS (SELECT request_id, CAST(n AS INTEGER) AS rank, id, page_content, rating, day, s AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, id) AS n FROM scored) WHERE n <= 10)"""

MESSAGES = """msg AS (SELECT CAST(conv_id AS VARCHAR) AS "user", turn, role, CASE
   WHEN role = 'user' AND turn = 0 AND conv_id % 5 = 0 THEN ' Hi! '
   WHEN role = 'user' AND turn = 0 AND conv_id % 5 = 1 THEN 'How''s it going?'
   WHEN role = 'user' AND turn = 2 AND conv_id % 3 = 0 THEN '👎'
   WHEN role = 'user' AND turn = 4 AND conv_id % 4 = 0 THEN 'thanks.'
   WHEN role = 'user' AND turn = 4 AND conv_id % 4 = 1 THEN '👍'
   WHEN role = 'user' AND turn = 6 AND conv_id % 2 = 0 THEN 'What can you do?'
   WHEN role = 'assistant' AND turn = 1 AND conv_id % 2 = 0 THEN
     'Here you are:' || chr(10) || '##| Item | Qty |' || chr(10) || '|------|-----|' || chr(10) || '| Tea ' || conv_id || ' | ' || turn || ' |'
     || chr(10) || '| Total | |' || chr(10) || '##' || chr(10) || 'More:' || chr(10) || '## | A | B |' || chr(10) || '|-|-|' || chr(10)
     || '|' || conv_id || '|x| ## tail'
   WHEN role = 'assistant' AND turn = 3 AND conv_id % 4 = 1 THEN 'No rule ##| A | B |' || chr(10) || '| 1 | ' || conv_id || ' |##'
   ELSE text END AS text FROM conversations)"""


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _phrase(words) -> str:
    return "regexp_matches(text, '^(" + "|".join(words).replace("'", "''") + ")[!?.,]*$', 'i')"


ROUTED = MESSAGES + f""", said AS (SELECT "user", turn, {_strip('text')} AS text FROM msg WHERE role = 'user'),
 faq AS (SELECT *, CASE WHEN {_phrase(chat_ops.GREETINGS)} THEN 'greeting'
   {" ".join(f"WHEN {_phrase(p)} THEN '{n}'" for n, p in chat_ops.FAQ.items())} END AS faq FROM said),
 heavy AS (SELECT *, coalesce(lag(text = '👎') OVER (PARTITION BY "user" ORDER BY turn), false) AS was_down FROM faq WHERE faq IS NULL),
 routed AS (SELECT "user", turn, text, faq AS intent FROM faq WHERE faq IS NOT NULL UNION ALL
  SELECT "user", turn, text, CASE WHEN text = '👎' THEN 'feedback_down' WHEN was_down THEN 'feedback_detail'
   WHEN text = '👍' THEN 'feedback_up' ELSE 'question' END FROM heavy)"""
HISTORY = """asked AS (SELECT m."user", m.turn, m.role, coalesce(r.text, m.text, '') AS text,
   CASE WHEN m.role = 'user' THEN r.intent = 'question' END AS q
  FROM msg m LEFT JOIN routed r ON m.role = 'user' AND r."user" = m."user" AND r.turn = m.turn WHERE m.role IN ('user', 'assistant')),
 kept AS (SELECT * FROM (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY "user" ORDER BY turn
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS answered FROM asked) WHERE answered),
 spoken AS (SELECT "user", turn, (CASE role WHEN 'user' THEN 'User: ' ELSE 'AI: ' END) || text AS line FROM kept),
 history AS (SELECT "user", turn, CAST(len(l) AS INTEGER) AS messages, array_to_string(l, chr(10)) AS history FROM
  (SELECT "user", turn, list(line) OVER (PARTITION BY "user" ORDER BY turn ROWS 6 PRECEDING) AS l FROM spoken))"""


def _tables(strict: bool) -> str:
    """Part, line and cell by nested list expressions; the two forms differ in the cells only."""
    strip = _strip
    if strict:
        inner = rf"regexp_replace({strip('r')}, '^\||\|$', '', 'g')"
        cells = f"list_transform(string_split({inner}, '|'), lambda c: {strip('c')})"
    else:
        cells = f"list_filter(list_transform(string_split(r, '|'), lambda c: {strip('c')}), lambda c: c <> '')"
    fits = "" if strict else "WHERE list_max(list_transform(rows, lambda x: len(x))) = len(headings)"
    return MESSAGES + rf""", parts AS (SELECT "user", turn, string_split(text, '##') AS p FROM msg WHERE contains(text, '##')),
 bodies AS (SELECT "user", turn, unnest(p) AS body, generate_subscripts(p, 1) - 1 AS i FROM parts),
 lines AS (SELECT "user", turn, CAST(i // 2 AS INTEGER) AS table_no, string_split({strip('body')}, chr(10)) AS l FROM bodies WHERE i % 2 = 1),
 ruled AS (SELECT *, list_position(list_transform(l, lambda x: regexp_full_match({strip('x')}, '[-|]+') AND contains(x, '-') AND contains(x, '|')), true) AS rule FROM lines),
 picked AS (SELECT "user", turn, table_no, CASE WHEN rule = 1 THEN l[-1] ELSE l[rule - 1] END AS head,
   list_filter(l[rule + 1:], lambda x: {strip('x')} <> '') AS data FROM ruled WHERE rule > 0),
 celled AS (SELECT "user", turn, table_no, list_transform([head], lambda r: {cells})[1] AS headings,
   list_transform(data, lambda r: {cells}) AS rows FROM picked WHERE len(data) > 0),
 fitting AS (SELECT * FROM celled {fits}),
 each_row AS (SELECT "user", turn, table_no, headings, unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS row_no FROM fitting)
SELECT "user", turn, table_no, CAST(row_no AS INTEGER) AS row_no, CAST(column_no AS INTEGER) AS column_no,
  headings[column_no + 1] AS column_name, value FROM
  (SELECT *, unnest(cells) AS value, generate_subscripts(cells, 1) - 1 AS column_no FROM each_row)"""


STOP = "[" + ", ".join(_q(w) for w in STOP_WORDS) + "]"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}'']+'), lambda t: t <> '' AND NOT list_contains({STOP}, t))"


def _grams(w: str) -> str:
    return (f"list_distinct(list_concat({w}, list_transform(list_zip({w}[:-2], {w}[2:]), "
            f"lambda z: z[1] || ' ' || z[2])))")


PHRASES = POLAR + f""", worded AS (SELECT *, {_words('review_text')} AS w FROM split),
 phrased AS (SELECT place_name, polarity, unnest({_grams('w')}) AS phrase FROM worded),
 counts AS (SELECT place_name, phrase, count(*) FILTER (WHERE polarity = 'positive') AS pos,
   count(*) FILTER (WHERE polarity = 'negative') AS neg FROM phrased GROUP BY 1, 2),
 totals AS (SELECT place_name, count(*) FILTER (WHERE polarity = 'positive') AS pd,
   count(*) FILTER (WHERE polarity = 'negative') AS nd FROM split GROUP BY 1),
 weighed AS (SELECT *, round(ln(((pos + 1)::DOUBLE / (pd + 2)) / ((neg + 1)::DOUBLE / (nd + 2))), 6) AS s
   FROM counts JOIN totals USING (place_name)),
 sided AS (SELECT place_name, CASE WHEN s > 0 THEN 'positive' ELSE 'negative' END AS polarity, phrase, abs(s) AS weight,
   CASE WHEN s > 0 THEN pos ELSE neg END AS reviews FROM weighed WHERE s <> 0),
 phrases AS (SELECT place_name, polarity, phrase, weight, reviews, CAST(n AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY place_name, polarity ORDER BY weight DESC, reviews DESC, phrase) AS n FROM sided) WHERE n <= 20)"""

VOCAB_SOURCES = {
    "dish": "SELECT DISTINCT p_name AS value FROM lineitem JOIN part ON p_partkey = l_partkey",
    "menu": "SELECT DISTINCT p_brand AS value FROM lineitem JOIN part ON p_partkey = l_partkey",
    "item": "SELECT DISTINCT p_name AS value FROM lineitem JOIN part ON p_partkey = l_partkey",
    "department": "SELECT DISTINCT s_name AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey",
    "source": "SELECT DISTINCT source_of_booking AS value FROM footfall",
    "status": "SELECT DISTINCT booking_status AS value FROM footfall",
}
NO_NUMBERS = _strip(r"regexp_replace(value, '\b\d+\b', '', 'g')")
VOCAB = FOOT + ", vocab AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS kind, {NO_NUMBERS} AS value FROM ({s}) WHERE value <> ''"
    for k, s in VOCAB_SOURCES.items()) + ")"


def _trigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, len({x}) + 2), lambda i: substr('  ' || lower({x}) || ' ', CAST(i AS INTEGER), 3)))"


def _mean(cents: str, n: str) -> str:
    """Exact mean of cents over n, halves up, as money."""
    return f"(((2 * ({cents})::HUGEINT + {n}) // (2 * {n}))::DOUBLE / 100)::{MON}"


WORDING = {k: _q(t.replace("%%", "%")) for k, t in report_ops.VERDICT_TEXT.items()}


def _fmt(template: str, *args: str) -> str:
    return f"printf({_q(template)}, {', '.join(args)})" if args else _q(template)


def _fixed(x: str, digits: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'nan' ELSE printf('%.{digits}f', CAST(round({x}, {digits}) AS DOUBLE)) END"


def _insert_new() -> str:
    low = AS_OF_TEXT - timedelta(hours=72)
    cols = TABLE_COLS + ", author_reviews_count, author_ratings_count, arrival"
    return RAW + f""", batch AS (SELECT {cols} FROM raw WHERE review_datetime_utc > {_ts(low)}),
 firsts AS (SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY arrival) AS n FROM batch)
   WHERE n = 1 OR review_id IS NULL)
SELECT {cols} FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.review_id = f.review_id
  AND r.review_datetime_utc <= {_ts(AS_OF_TEXT - timedelta(hours=24))})"""


FRESH = RAW + """, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY arrival) AS n FROM feed)
   WHERE n = 1 OR review_id IS NULL)"""


def _alert_variables() -> str:
    return f"""to_json({{'1': author_title, '2': review_rating || ' star', '3': strftime({IST}, '%H:%M'),
   '4': CASE WHEN coalesce(length(review_text), 0) = 0 THEN 'NO REVIEW WRITTEN'
     ELSE translate(substr(review_text, 1, 200), chr(10) || chr(13), '  ') END,
   '5': review_link, '6': place_name}})::VARCHAR"""


ALERT = "(review_rating <= 3 OR coalesce(length(review_text), 0) > 100)"


def _window_stream(days: int, extra: str) -> str:
    return REVIEWS + f""", days AS (SELECT *, {IST_DATE} AS d FROM reviews),
 placed AS (SELECT *, CAST(d - CAST(i AS INTEGER) AS DATE) AS first_day FROM days, range({days}) t(i)),
 windows AS (SELECT place_name, CAST(first_day AS TIMESTAMP) - INTERVAL 330 MINUTE AS window_start,
   CAST(first_day AS TIMESTAMP) - INTERVAL 330 MINUTE + INTERVAL {days} DAY AS window_end,
   count(*) AS total_reviews, round(avg(review_rating), 4) AS average_rating {extra} FROM placed GROUP BY place_name, first_day)
SELECT * FROM windows WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 8 HOUR"""


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    year_book = f"bill_date >= DATE '{P0}' AND bill_date < DATE '{P1}'"
    week_of = f"CAST(date_trunc('week', {IST}) AS DATE)"
    between_f = f">= TIMESTAMP '{F0} 00:00:00'"
    until_f = f"< TIMESTAMP '{F1} 00:00:00'"
    sun = lambda d: f"({d} - CAST(dayofweek({d}) AS INTEGER))"
    total_cols = f"sum(gross_amount)::{MON} AS total_sales, " + ", ".join(f"sum({c})::{MON} AS {c}_sales" for c in CATS)
    rupees = ("(WITH d AS (SELECT CAST(CAST(round(total_sales, 0) AS BIGINT) AS VARCHAR) AS t) SELECT '₹' || CASE WHEN length(t) <= 3 THEN t ELSE "
              r"regexp_replace(regexp_replace(CASE WHEN length(t) % 2 = 0 THEN '0' ELSE '' END || left(t, length(t) - 3), '(\d\d)', '\1,', 'g'), '^0', '')"
              " || right(t, 3) END FROM d)")
    top3 = f"""top3 AS (SELECT item_name, sum(total_amount)::{MON} AS total_sales, sum(qty)::DECIMAL(18,3) AS total_qty
      FROM itemwise WHERE {IN_YEAR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)"""
    p_sentence = rf"list_filter(list_transform(string_split_regex(review_text, '[.!?\n]+'), lambda x: {_strip('x')}), lambda x: true)"
    out: dict[str, str] = {}

    # sources, sinks, state
    out["reviews_scan"] = w + REVIEWS + f" SELECT {TABLE_COLS}, sentiment_score FROM reviews"
    out["reviews_incremental"] = w + RAW + (
        f" SELECT {TABLE_COLS}, author_reviews_count, author_ratings_count, arrival FROM raw "
        f"WHERE review_datetime_utc > {_ts(AS_OF - timedelta(hours=8))}")
    out["reviews_insert_new"] = w + _insert_new()
    out["sent_log_append"] = w + f"""{PLACES}, {PHONES}, {SENT} SELECT * FROM sent UNION ALL
      SELECT place_name, '{DAILY_SUMMARY}', DATE '{AS_OF:%Y-%m-%d}' FROM places p JOIN phones USING (place_name)
      WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.place_name = p.place_name)"""
    monday = (AS_OF - timedelta(days=AS_OF.weekday())).date()
    out["report_due"] = w + f"""{PLACES}, {STATE} SELECT place_name FROM places p WHERE NOT EXISTS
      (SELECT 1 FROM state s WHERE s.place_name = p.place_name AND s.last_report_date >= DATE '{monday}')"""
    out["report_state_upsert"] = w + f"""{PLACES}, {STATE} SELECT place_name, '{WEEKLY_REPORT}' AS report_type,
      CASE WHEN last_report_date >= DATE '{monday}' THEN last_report_date ELSE DATE '{AS_OF:%Y-%m-%d}' END AS last_report_date
      FROM places LEFT JOIN state USING (place_name)"""
    out["pos_tables_counts"] = """SELECT 'footfall' AS table_name, count(*) AS row_count FROM events
      UNION ALL SELECT 'issue', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
      UNION ALL SELECT 'itemwise', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
      UNION ALL SELECT 'kot', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
      UNION ALL SELECT 'chat_reviews', count(*) FROM events LEFT JOIN documents ON doc_id = event_id
      UNION ALL SELECT 'sales_book', count(*) FROM orders"""
    art = f"_weekly_report_{AS_OF:%Y%m%d}.pdf"
    out["report_artifacts"] = w + f"""{PLACES} SELECT 'The ' || place_name AS place_name, 'The ' || place_name || '{art}' AS artifact_name,
      '{BASE_URL}/The%20' || place_name || '{art}' AS artifact_url,
      '{{"1":"The ' || place_name || '","2":"The%20' || place_name || '{art}"}}' AS variables FROM places"""
    out["vectors_scan"] = w + VECTORS + " SELECT id, page_content, rating, day, CAST(len(embedding) AS INTEGER) AS dims FROM vec"
    out["places_distinct"] = w + PLACES + " SELECT * FROM places"

    # filters
    out["alerts_select"] = w + REVIEWS + (f" SELECT review_id, place_name, review_rating, CAST(length(review_text) AS INTEGER) AS text_length "
                                          f"FROM reviews WHERE {ALERT}")
    out["daily_window_rows"] = w + REVIEWS + (
        " SELECT review_id, place_name, review_rating, review_datetime_utc FROM reviews "
        f"WHERE review_datetime_utc >= {_ts(D0)} AND review_datetime_utc < {_ts(D1)}")
    out["place_match_regex"] = w + REVIEWS + (" SELECT review_id, place_name FROM reviews "
                                              "WHERE regexp_matches(place_name, '(CL|V)I', 'i')")
    out["week_assign"] = w + REVIEWS + (
        f" SELECT review_id, place_name, CASE WHEN {IST_DATE} >= DATE '2024-01-17' THEN 'current' ELSE 'previous' END AS week, "
        f"{IST_DATE} AS review_date FROM reviews WHERE {IST_DATE} BETWEEN DATE '2024-01-10' AND DATE '2024-01-23'")
    out["polarity_split"] = w + REVIEWS + (
        " SELECT review_id, place_name, CASE WHEN review_rating IN (4, 5) THEN 'positive' ELSE 'negative' END AS polarity, "
        "review_text FROM reviews WHERE review_text IS NOT NULL")
    out["retrieval_filter"] = w + VECTORS + ", " + REQUESTS + (
        " SELECT request_id, id, rating, day FROM req JOIN vec ON rating IN (r1, r2) AND day BETWEEN d0 AND d1")
    out["sales_period"] = w + ITEMWISE + f" SELECT * FROM itemwise WHERE {IN_YEAR}"
    known = "EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND CAST(c_custkey AS VARCHAR) = m.\"user\")"
    out["chat_authorised"] = w + MESSAGES + f" SELECT * FROM msg m WHERE {known}"
    out["chat_refused"] = w + MESSAGES + (f" SELECT *, 'You have no access to this data.' AS reply FROM msg m "
                                          f"WHERE role = 'user' AND NOT {known}")

    # alerts and summary
    out["alert_fanout"] = w + REVIEWS + f", {PHONES} SELECT review_id, place_name, phone FROM reviews JOIN phones USING (place_name) WHERE {ALERT}"
    out["alert_messages"] = w + REVIEWS + (f", {PHONES} SELECT review_id, place_name, phone, {_alert_variables()} AS variables "
                                           f"FROM reviews JOIN phones USING (place_name) WHERE {ALERT}")
    out["place_title_alerts"] = w + REVIEWS + (
        " SELECT review_id, google_id, 'The ' || upper(place_name[1]) || substr(place_name, 2) AS title FROM reviews "
        f"WHERE {ALERT} AND place_name IN ('click', 'error', 'signup', 'view')")
    out["alert_chain"] = w + f"""fresh AS ({_insert_new().replace('ev AS', 'WITH ev AS', 1)}), {PHONES}
      SELECT review_id, place_name, phone, {_alert_variables()} AS variables FROM fresh JOIN phones USING (place_name) WHERE {ALERT}"""
    out["daily_summary"] = w + REVIEWS + f", {PLACES}, {DAILY} SELECT * FROM daily"
    out["summary_due"] = w + f"{PLACES}, {SENT} SELECT place_name FROM places WHERE place_name NOT IN (SELECT place_name FROM sent)"
    label = f"{AS_OF - timedelta(days=1):%d %b %Y}"
    fields = ", ".join(f"'{i}': coalesce(CAST({n}_star_reviews AS VARCHAR), 'None')" for i, n in enumerate(NAMED.values(), start=5))
    out["summary_messages"] = w + REVIEWS + f""", {PLACES}, {SENT}, {PHONES}, {DAILY} SELECT place_name, phone, to_json({{'1': place_name, '2': '{label}',
      '3': CAST(total_reviews AS VARCHAR), '4': CASE WHEN average_rating = 0 THEN '0' ELSE CAST(average_rating AS VARCHAR) END, {fields}}})::VARCHAR AS variables
      FROM daily JOIN phones USING (place_name) WHERE place_name NOT IN (SELECT place_name FROM sent)"""

    # weekly report
    out["place_reviews_theta"] = w + REVIEWS + f""", {PLACES}, patterns AS (SELECT DISTINCT unnest([upper(place_name),
      substr(place_name, 2, 1), '^' || substr(place_name, 1, 1) || '.*[ekw]$']) AS pattern FROM places)
      SELECT pattern, place_name, review_id FROM reviews JOIN patterns ON regexp_matches(place_name, pattern, 'i')"""
    sub = lambda n: (f"round(avg(CASE WHEN NOT json_exists(j, '$.{n}') THEN 5 ELSE TRY_CAST(json_extract_string(j, '$.{n}') AS DOUBLE) END), 4)")
    out["report_insights"] = w + WEEK + f""", fixed AS (SELECT *, replace(replace(review_questions, 'null', '0'), '''', '"') AS j FROM week)
      SELECT place_name, {sub('Food')} AS food, {sub('Service')} AS service, {sub('Atmosphere')} AS atmosphere, count(*) AS total_reviews,
      round(avg(review_rating), 4) AS average_rating, count(*) FILTER (WHERE NOT json_valid(j)) AS bad_questions FROM fixed GROUP BY 1"""
    out["rating_distribution"] = w + WEEK + f", {DIST} SELECT * FROM dist"
    out["top_authors"] = w + WEEK + """, c AS (SELECT place_name, author_title, count(*) AS review_count FROM week WHERE author_title IS NOT NULL GROUP BY 1, 2)
      SELECT place_name, author_title, review_count, CAST(n AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY place_name ORDER BY review_count DESC, author_title) AS n FROM c) WHERE n <= 10"""
    out["distribution_insights"] = w + WEEK + f", {DIST}, {INSIGHT} SELECT * FROM insight"
    out["trend_daily"] = w + WEEK + f", {TREND} SELECT * FROM trend"
    out["trend_extremes"] = w + WEEK + f", {TREND}, {EXTREMES} SELECT * FROM extremes"
    out["week_comparison"] = w + REVIEWS + f", {COMPARE} SELECT * FROM comparison"
    out["historic_average"] = w + REVIEWS + f""" SELECT place_name,
      count(*) FILTER (WHERE review_datetime_utc >= {_ts(W1)} AND review_datetime_utc < {_ts(W2)}) AS total_reviews,
      round(coalesce(avg(review_rating) FILTER (WHERE review_datetime_utc >= {_ts(W1)} AND review_datetime_utc < {_ts(W2)}), 0), 2) AS current_average,
      round(avg(review_rating), 2) AS historic_average FROM reviews GROUP BY 1"""
    out["week_over_week"] = w + REVIEWS + f""", weeks AS (SELECT place_name, {week_of} AS week_start, count(*) AS review_count, avg(review_rating) AS a FROM reviews GROUP BY 1, 2)
      SELECT place_name, week_start, review_count, round(a, 4) AS average_rating,
      review_count - lag(review_count) OVER w AS count_delta, round(a - lag(a) OVER w, 4) AS average_delta
      FROM weeks WINDOW w AS (PARTITION BY place_name ORDER BY week_start)"""
    out["polarity_text"] = w + POLAR + """, n AS (SELECT *, row_number() OVER (PARTITION BY place_name, polarity ORDER BY review_datetime_utc, review_id) AS rn FROM split)
      SELECT place_name, polarity, (rn - 1) // 50 AS part_no, count(*) AS review_count, string_agg(review_text, ' ' ORDER BY rn) AS joined_text FROM n GROUP BY 1, 2, 3"""
    out["distribution_weekly"] = w + REVIEWS + f" SELECT place_name, {week_of} AS week_start, {STARS} FROM reviews GROUP BY 1, 2"
    out["sentiment_overall"] = w + REVIEWS + """ SELECT place_name, round(avg(coalesce(sentiment_score, 0)), 6) AS average_sentiment,
      round(count(*) FILTER (WHERE review_rating >= 4)::DOUBLE / count(*), 4) AS positive_share,
      round(count(*) FILTER (WHERE review_rating <= 3)::DOUBLE / count(*), 4) AS negative_share FROM reviews GROUP BY 1"""
    pick = lambda key, texts: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in texts.items()) + " END"
    day = lambda c: f"strftime({c}, '%d %b')"
    dist_text = _fmt(report_ops.DISTRIBUTION_TEXT, "place_name", "most_common_rating", "most_common_count", "total_reviews",
                     "CAST(high_percent AS DOUBLE)", "CAST(low_percent AS DOUBLE)")
    trend_text = _fmt(report_ops.TREND_TEXT, "place_name", "most_count", day("most_date"), _fixed("most_average", 1),
                      "least_count", day("least_date"), _fixed("least_average", 1),
                      _fixed("lowest_average", 1), _fixed("highest_average", 1))
    pa, ca = _fixed("previous_average", 2), _fixed("current_average", 2)
    n_text = {m: _fmt(t, "previous_count", *([] if m == "same" else ["current_count"])) for m, t in report_ops.COUNT_TEXT.items()}
    a_text = {m: _fmt(t, pa, *([] if m == "same" else [ca])) for m, t in report_ops.AVERAGE_TEXT.items()}
    raw = lambda part: re.sub(r"round\(((?:[^()]|\([^()]*\))*), 4\)", r"\1", part)  # the wording rounds raw means
    out["report_text"] = w + WEEK + f""", {DIST}, {INSIGHT}, {raw(TREND)}, {EXTREMES}, {raw(COMPARE)}
      SELECT place_name, {dist_text} AS distribution_text, {trend_text} AS trend_text,
      {_fmt(report_ops.COMPARISON_HEAD, 'place_name')} || {pick('count_change', n_text)} || {pick('average_change', a_text)} || {pick('verdict', WORDING)} AS comparison_text
      FROM insight JOIN extremes USING (place_name) JOIN comparison USING (place_name)"""
    out["dashboard_metrics"] = w + REVIEWS + f""" SELECT place_name, count(*) AS total_reviews, round(avg(review_rating), 4) AS average_rating, {STAR_SUMS}
      FROM reviews GROUP BY GROUPING SETS ((place_name), ())"""

    day_spine = f"""wk AS (SELECT place_name, review_date, count(*) AS n, avg(review_rating) AS a FROM week GROUP BY 1, 2
       UNION ALL SELECT NULL, review_date, count(*), avg(review_rating) FROM week GROUP BY 2),
      whole AS (SELECT place_name, count(*) AS total_reviews, round(avg(review_rating), 4) AS average_rating, {STAR_SUMS}
       FROM reviews GROUP BY GROUPING SETS ((place_name), ())),
      days AS (SELECT place_name, CAST(first_day + CAST(i AS INTEGER) AS DATE) AS review_date FROM
       (SELECT place_name, min(review_date) AS first_day FROM wk GROUP BY 1), range(7) t(i))"""
    out["dashboard_trend"] = w + WEEK + f""", {day_spine} SELECT w.place_name, total_reviews, average_rating, {STAR_NAMES}, d.review_date,
      coalesce(n, 0) AS day_reviews, round(a, 4) AS day_average FROM whole w
      LEFT JOIN days d ON d.place_name IS NOT DISTINCT FROM w.place_name
      LEFT JOIN wk ON wk.place_name IS NOT DISTINCT FROM d.place_name AND wk.review_date = d.review_date"""

    # point of sale
    out["top_items"] = w + ITEMWISE + f""" SELECT item_name, sum(total_amount)::{MON} AS total_sales, sum(qty)::DECIMAL(18,3) AS total_qty
      FROM itemwise WHERE {IN_YEAR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    out["top_items_display"] = w + ITEMWISE + f", {top3} SELECT item_name, {rupees} AS total_sales_amount FROM top3"
    out["pipe_rows"] = w + ITEMWISE + f", {top3} SELECT 'item_name | total_sales_amount' AS header, item_name || ' | ' || {rupees} AS line FROM top3"
    out["best_item_by_month"] = w + ITEMWISE + f""", m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, item_name, sum(total_amount)::{MON} AS total_sales FROM itemwise GROUP BY 1, 2)
      SELECT month, item_name, total_sales FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY total_sales DESC, item_name) AS n FROM m) WHERE n = 1"""
    out["sales_weekly_rollup"] = w + BOOK + f""", weeks AS (SELECT *, CAST({sun('bill_date')} AS DATE) AS sunday FROM book WHERE bill_date >= DATE '{M0}' AND bill_date < DATE '{M1}')
      SELECT CAST((sunday - CAST({sun(f"DATE '{M0}'")} AS DATE)) // 7 + 1 AS VARCHAR) AS week, greatest(sunday, DATE '{M0}') AS week_start,
      least(CAST(sunday + 6 AS DATE), CAST(DATE '{M1}' - 1 AS DATE)) AS week_end, {total_cols} FROM weeks GROUP BY 1, 2, 3
      UNION ALL SELECT 'Total', NULL, NULL, {total_cols} FROM weeks"""
    out["category_sales"] = w + ITEMWISE + f""" SELECT classification, sum(total_amount)::{MON} AS total_sales, sum(qty)::DECIMAL(18,3) AS total_qty
      FROM itemwise WHERE {IN_YEAR} GROUP BY 1"""
    out["category_sales_book"] = w + BOOK + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS category, sum({c})::{MON} AS total_sales FROM book WHERE {year_book}" for c in CATS)
    in_f = f"booking_time {between_f} AND booking_time {until_f}"
    out["footfall_daily"] = w + FOOT + f""" SELECT CAST(booking_time AS DATE) AS booking_date, count(*) AS bookings, sum(pax)::BIGINT AS guests,
      count(*) FILTER (WHERE visit_count > 1) AS repeat_visits FROM footfall WHERE {in_f} GROUP BY 1"""
    out["footfall_by_source"] = w + FOOT + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS bookings, sum(pax)::BIGINT AS guests FROM footfall WHERE {in_f} GROUP BY 2"
        for c in ("source_of_booking", "booking_status", "booking_type", "sections"))
    out["seating_delay"] = w + FOOT + """ SELECT sections, count(*) AS seated, round(avg(date_sub('minute', booking_time, seated_time)), 4) AS average_wait,
      max(date_sub('minute', booking_time, seated_time)) AS longest_wait FROM footfall WHERE seated_time IS NOT NULL GROUP BY 1"""
    out["seating_delay_percentiles"] = w + FOOT + """, waits AS (SELECT sections, date_sub('minute', booking_time, seated_time) AS wait FROM footfall
       WHERE seated_time IS NOT NULL AND booking_time >= DATE '2024-01-05' AND booking_time < DATE '2024-01-25')
      SELECT sections, count(*) AS seated, quantile_disc(wait, 0.5) AS p50, quantile_disc(wait, 0.9) AS p90, quantile_disc(wait, 0.99) AS p99 FROM waits GROUP BY 1"""
    out["issue_by_department"] = f"""SELECT s_name AS issue_name, p_name AS item_name, sum(l_quantity::DECIMAL(18,3))::DECIMAL(18,3) AS quantity,
      sum(l_extendedprice::{MON})::{MON} AS cost, {_mean(f'100 * sum(p_retailprice::{MON})', 'count(*)')} AS average_rate
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
      WHERE CAST(l_shipdate AS DATE) >= DATE '{P0}' AND CAST(l_shipdate AS DATE) < DATE '{P1}' GROUP BY GROUPING SETS ((s_name), (s_name, p_name))"""
    out["kot_items"] = w + KOT + f" SELECT item_name, {TICKETS} FROM kot WHERE {IN_YEAR} GROUP BY 1"
    out["kot_hourly"] = w + KOT + f" SELECT CAST(hour(kot_time) AS INTEGER) AS hour, {TICKETS} FROM kot GROUP BY 1"
    out["kot_tables"] = w + KOT + f" SELECT table_number, {TICKETS} FROM kot GROUP BY 1"
    out["kot_bill_items"] = w + KOT + f""" SELECT bill_number, item_name, sum(quantity)::DECIMAL(18,3) AS quantity, sum(total_amount)::{MON} AS amount
      FROM kot WHERE bill_number IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1, 2"""
    out["financial_summary"] = w + BOOK + f""" SELECT count(*) AS bills, sum(gross_amount)::{MON} AS gross_sales, sum(pax)::BIGINT AS guests,
      {_mean('100 * sum(gross_amount)', 'count(*)')} AS average_bill, {_mean('100 * sum(gross_amount)', 'sum(pax)')} AS spend_per_guest FROM book WHERE {year_book}"""
    out["item_averages"] = w + ITEMWISE + f""" SELECT sum(total_amount)::{MON} AS total_sales, sum(qty)::DECIMAL(18,3) AS quantity,
      {_mean('100 * sum(rate)', 'count(*)')} AS average_rate FROM itemwise WHERE {IN_YEAR}"""
    out["payment_mix"] = w + BOOK + f""", m AS (SELECT sum(cash)::{MON} AS cash, sum(credit_card)::{MON} AS credit_card, sum(company)::{MON} AS company FROM book WHERE {year_book}),
      l AS (UNPIVOT m ON cash, credit_card, company INTO NAME payment VALUE amount)
      SELECT payment, amount, round(amount::DOUBLE * 100 / (SELECT sum(amount) FROM l)::DOUBLE, 2) AS percent FROM l"""
    low = f"review_datetime_utc {between_f} AND review_datetime_utc {until_f}"
    out["low_star_reviews"] = w + REVIEWS + (f" SELECT review_rating AS rating, place_name AS dining, review_datetime_utc AS time, "
                                             f"CAST(review_id AS BIGINT) AS review_no FROM reviews WHERE review_rating <= 2 AND {low}")
    out["review_counts"] = w + REVIEWS + f" SELECT review_rating AS rating, count(*) AS review_count FROM reviews WHERE {low} GROUP BY 1"

    # text, lookup, retrieval
    out["key_phrases"] = w + PHRASES + " SELECT * FROM phrases"
    out["review_digest"] = w + PHRASES + f""", pieces AS (SELECT place_name, polarity, review_datetime_utc, review_id, {p_sentence} AS p FROM split),
      lined AS (SELECT place_name, polarity, review_datetime_utc, review_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM pieces),
      one AS (SELECT place_name, polarity, sentence, min(row(review_datetime_utc, review_id, pos)) AS stood,
        CAST(len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM lined WHERE sentence <> '' GROUP BY 1, 2, 3),
      worded2 AS (SELECT *, {_words('sentence')} AS w FROM one WHERE n_words <= 200),
      hits AS (SELECT place_name, polarity, sentence, stood, n_words, unnest({_grams('w')}) AS phrase FROM worded2),
      heavy AS (SELECT h.place_name, h.polarity, sentence, stood, n_words, round(sum(weight), 6) AS score FROM hits h
        JOIN phrases p ON p.place_name = h.place_name AND p.polarity = h.polarity AND p.phrase = h.phrase GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER w AS n, sum(n_words) OVER w AS run FROM heavy
        WINDOW w AS (PARTITION BY place_name, polarity ORDER BY score DESC, stood, sentence ROWS UNBOUNDED PRECEDING)),
      made AS (SELECT place_name, polarity, sum(n_words)::BIGINT AS n_words, string_agg(sentence, '. ' ORDER BY n) AS digest FROM ranked WHERE run <= 200 GROUP BY 1, 2)
      SELECT s.place_name, s.polarity, coalesce(n_words, 0) AS n_words, coalesce(digest, 'No reviews available.') AS digest FROM
      (SELECT DISTINCT place_name, unnest(['positive', 'negative']) AS polarity FROM reviews
        WHERE review_datetime_utc >= {_ts(T1)} AND review_datetime_utc < {_ts(T2)}) s
      LEFT JOIN made m ON m.place_name = s.place_name AND m.polarity = s.polarity"""
    out["prompt_batch"] = w + REVIEWS + (
        " SELECT review_id, 'Reply kindly to ' || coalesce(author_title, '') || ', who gave ' || review_rating || ' stars and wrote: ' "
        f"|| CASE WHEN coalesce(review_text, '') = '' THEN 'NO REVIEW WRITTEN' ELSE translate(substr(review_text, 1, 200), chr(10) || chr(13), '  ') END "
        f"AS prompt FROM reviews WHERE {ALERT}")
    out["summary_prompts"] = w + POLAR + """, n AS (SELECT *, row_number() OVER (PARTITION BY place_name, polarity ORDER BY review_datetime_utc, review_id) AS rn FROM split)
      SELECT place_name, polarity, (rn - 1) // 50 AS part_no, 'Summarise these ' || polarity || ' reviews of ' || place_name
       || ' in two hundred words at most, from the reviews alone; without any, answer: No reviews available.' || chr(10)
       || string_agg(review_text, ' ' ORDER BY rn) AS prompt FROM n GROUP BY 1, 2, 3"""
    out["answer_prompts"] = w + KNN + """ SELECT request_id, 'Answer from the reviews below and nothing else.' || chr(10) || 'Question: what about ' || request_id
      || chr(10) || 'Reviews:' || chr(10) || string_agg(coalesce(page_content, ''), chr(10) ORDER BY rank) AS prompt FROM knn GROUP BY 1"""
    out["request_parse"] = w + REQUESTS + """ SELECT request_id, CASE WHEN d1 >= d0 THEN question END AS question,
      CASE WHEN d1 >= d0 THEN r1 || ',' || r2 END AS ratings, CASE WHEN d1 >= d0 THEN array_to_string(list_transform(
        generate_series(d0::TIMESTAMP, d1::TIMESTAMP, INTERVAL 1 DAY), lambda x: strftime(x, '%d-%m-%Y')), ',') END AS dates FROM req"""
    out["vocabulary"] = w + VOCAB + " SELECT kind, value FROM vocab"
    out["value_lookup"] = w + VOCAB + f""", named AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE p_name END AS name, CAST(p_partkey % 5 + 2 AS INTEGER) AS cut FROM part),
      terms AS (SELECT DISTINCT substr(name, 1, cut - 1) || substr(name, cut + 1) AS term FROM named),
      t AS (SELECT term, {_trigrams('term')} AS tg FROM terms), vv AS (SELECT kind, value, {_trigrams('value')} AS vg FROM vocab),
      pairs AS (SELECT term, value, kind, len(list_intersect(tg, vg)) AS i, len(tg) AS a, len(vg) AS b, levenshtein(lower(term), lower(value)) AS distance FROM t, vv),
      scored AS (SELECT *, i::DOUBLE / (a + b - i) AS j FROM pairs WHERE i > 0)
      SELECT term, value, kind, round(j, 6) AS jaccard, CAST(distance AS INTEGER) AS distance, CAST(n AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY term ORDER BY j DESC, distance, value, kind) AS n FROM scored) WHERE n <= 8"""
    out["knn_filtered"] = w + KNN + " SELECT * FROM knn"
    out["knn_lsh"], out["value_lookup_lsh"] = out["knn_filtered"], out["value_lookup"]
    out["answer_context"] = w + KNN + """ SELECT request_id, CAST(count(*) AS INTEGER) AS hits, string_agg(coalesce(page_content, ''), chr(10) ORDER BY rank) AS context,
      string_agg(printf('%.9f', score), ',' ORDER BY rank) AS scores FROM knn GROUP BY 1"""

    out["similar_questions"] = r"""WITH said AS (SELECT conv_id * 1000 + turn AS question_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
     u AS (SELECT min(question_id) AS id, text FROM said WHERE turn = 0 GROUP BY text), a AS (SELECT question_id AS id, text FROM said WHERE turn > 0),
     x AS (SELECT side, id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}'']+'), lambda w: w <> '')) AS term
       FROM (SELECT 'c' AS side, * FROM u UNION ALL SELECT 'q', * FROM a)),
     t AS (SELECT side, id, term, count(*) AS tf FROM x GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t WHERE side = 'c' GROUP BY 1),
     w AS (SELECT side, id, t.term, tf * ln(((SELECT count(*) FROM u) + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) AS w FROM t LEFT JOIN f ON f.term = t.term),
     m AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM w),
     p AS (SELECT q.id AS q, c.id AS c, sum(q.w * c.w) AS s FROM m q JOIN m c ON q.term = c.term WHERE q.side = 'q' AND c.side = 'c' GROUP BY 1, 2),
     r AS (SELECT a.id AS q, u.id AS c, round(coalesce(s, 0.0), 9) AS s FROM a CROSS JOIN u LEFT JOIN p ON p.q = a.id AND p.c = u.id),
     b AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS INTEGER) AS rank FROM r)
     SELECT q AS question_id, rank, c AS example_id, text AS example, 'query ' || question_id AS query, s AS score
     FROM b JOIN said ON said.question_id = c AND said.turn = 0 WHERE rank <= 5"""

    # chat
    out["chat_routing"] = w + ROUTED + " SELECT * FROM routed"
    out["chat_intent_counts"] = w + ROUTED + ' SELECT "user", intent, count(*) AS message_count FROM routed GROUP BY 1, 2'
    out["chat_history"] = w + ROUTED + f", {HISTORY} SELECT * FROM history"
    out["chat_latest_user"] = w + ROUTED + f""", {HISTORY}, seven AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY turn DESC) AS n FROM kept) WHERE n <= 7)
      SELECT u."user", coalesce(max_by(s.text, s.turn) FILTER (WHERE s.role = 'user'), '') AS latest_message
      FROM (SELECT DISTINCT "user" FROM msg) u LEFT JOIN seven s ON s."user" = u."user" GROUP BY 1"""
    out["message_tables"] = w + _tables(True)
    out["message_tables_loose"] = w + _tables(False)
    out["message_descriptions"] = w + MESSAGES + f""" SELECT "user", turn, {_strip("string_split(text, '##')[1]")} AS description FROM msg"""
    out["result_pages"] = w + REVIEWS + f""", low AS (SELECT review_datetime_utc AS time, CAST(review_id AS BIGINT) AS review_no, review_rating AS rating, place_name AS dining
      FROM reviews WHERE review_rating <= 2 AND {low}) SELECT *, row_number() OVER (ORDER BY time, review_no) AS row_no,
      (row_number() OVER (ORDER BY time, review_no) - 1) // 30 AS page FROM low"""

    # streams
    late = f"review_datetime_utc <= {_ts(AS_OF - timedelta(hours=8))}"
    out["late_rows"] = w + REVIEWS + (f" SELECT place_name, count(*) FILTER (WHERE NOT {late}) AS accepted, "
                                      f"count(*) FILTER (WHERE {late}) AS too_late FROM reviews GROUP BY 1")
    out["stream_ingest"] = w + FRESH + f" SELECT {TABLE_COLS}, author_reviews_count, author_ratings_count, arrival FROM fresh"
    out["stream_alerts"] = w + FRESH + (f", {PHONES} SELECT review_id, place_name, phone, {_alert_variables()} AS variables "
                                        f"FROM fresh JOIN phones USING (place_name) WHERE {ALERT}")
    out["stream_daily_summary"] = w + _window_stream(1, ", " + STAR_SUMS)
    out["stream_weekly"] = w + _window_stream(7, "")
    out["stream_chat"] = w + ROUTED + f""", {HISTORY} SELECT "user", turn, messages, history, intent FROM history FULL JOIN routed USING ("user", turn)"""
    return out
