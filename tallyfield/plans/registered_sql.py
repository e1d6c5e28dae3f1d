"""The registered queries in SQL, for the check against DuckDB."""

from __future__ import annotations

import re

from tallyfield.functions.missing import NA_TOKENS
from tallyfield.lookups import COUNTRIES, US_STATE_CODES, US_STATES
from tallyfield.plans.shaped import BOOKS_SQL, LISTINGS_SQL


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _listings(sql: str, *views: str) -> str:
    return "WITH " + ", ".join([LISTINGS_SQL, *views]) + sql


def _books(sql: str) -> str:
    return "WITH " + BOOKS_SQL + sql


_CODES = " OR ".join(
    rf"ends_with(regexp_replace(u, '\s+$', ''), ' {code}')" for code in US_STATE_CODES
)
_LOCATED = f"""
located AS (
  SELECT host_location, coalesce(
      list_filter([{_texts(COUNTRIES)}], lambda c: contains(u, c))[1],
      CASE WHEN len(list_filter([{_texts(US_STATES)}], lambda s: contains(u, s))) > 0
           THEN 'UNITED STATES' END,
      CASE WHEN {_CODES} THEN 'UNITED STATES' END,
      'OTHERS') AS clean_country
  FROM (SELECT DISTINCT host_location, upper(host_location) AS u FROM listings
        WHERE host_location IS NOT NULL))
"""
_NAMES = ", ".join(
    f"({rank}, {_texts([name])}, {_texts([label])}, {_texts([re.sub(r'([^\W\d_]+)', r'|\1|', name)])})"
    for rank, (name, label) in enumerate(
        [(c, c) for c in COUNTRIES] + [(s, "UNITED STATES") for s in US_STATES]
    )
)
# Words are put between bars, in the text as in the names, so that only whole words are equal.
_LOCATED_BY_WORD = rf"""
places AS (SELECT DISTINCT host_location, upper(host_location) AS u,
             regexp_replace(upper(host_location), '(\p{{L}}+)', '|\1|', 'g') AS words
           FROM listings WHERE host_location IS NOT NULL),
names(rank, name, label, words) AS (VALUES {_NAMES}),
best AS (
  SELECT host_location, label,
         row_number() OVER (PARTITION BY host_location ORDER BY length(name) DESC, rank) AS place
  FROM places p JOIN names n ON contains(p.words, n.words)),
located AS (
  SELECT p.host_location, coalesce(b.label,
      CASE WHEN {_CODES} THEN 'UNITED STATES' END, 'OTHERS') AS clean_country
  FROM places p LEFT JOIN best b ON b.host_location = p.host_location AND b.place = 1)
"""
_CATEGORY = r"""
  CASE WHEN license IS NULL THEN 'Missing'
       WHEN starts_with(license, 'ES') OR starts_with(license, 'es') THEN 'Long ES codes'
       WHEN starts_with(license, 'VT') OR starts_with(license, 'vt') THEN 'VT codes'
       WHEN starts_with(license, 'AM') OR starts_with(license, 'am') THEN 'AM codes'
       WHEN starts_with(license, 'HM') OR starts_with(license, 'hm') THEN 'HM codes'
       WHEN contains(license, '/') THEN 'Fraction codes'
       WHEN regexp_full_match(license, '\p{Nd}+') THEN 'Numeric-only codes'
       WHEN regexp_full_match(license, '\p{L}+') THEN 'Verbal descriptions'
       ELSE 'Other' END
"""
_FLAGGED = """
flagged AS (
  SELECT *, CASE WHEN price > (SELECT quantile_cont(price, 0.99) FROM listings)
                 THEN 'Outlier' ELSE 'Good' END AS outlier_check
  FROM listings)
"""
_ORDER_FLAG = """CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)
                      THEN 'Outlier' ELSE 'Good' END"""
LINEITEM = (
    "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
_PERCENTS = "[" + ", ".join(str(k / 100) for k in range(1, 101)) + "]"
_BOOK_JSON = """to_json(struct_pack(id := id, title := title, author := author, "year" := "year"))"""

SQL: dict[str, str] = {
    "q1": "SELECT count(*) AS n FROM lineitem",
    "q2": """SELECT count(*) AS n_rows, (SELECT count(*) FROM information_schema.columns
             WHERE table_name = 'orders') AS n_cols FROM orders""",
    "q3": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "q4": """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
             SELECT * FROM g WHERE n = (SELECT max(n) FROM g)""",
    "q5": "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'F'",
    "q6": """SELECT s_nationkey, n FROM (SELECT s_nationkey, count(*) AS n,
             rank() OVER (ORDER BY count(*) DESC) AS r FROM supplier GROUP BY 1) WHERE r = 1""",
    "q6b": """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer
              WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2""",
    "q7": "SELECT round_even(avg(o_totalprice), 0) AS m FROM orders",
    "q8": "SELECT count(*) AS n FROM labels WHERE toxic = 0",
    "q9": """SELECT round_even(avg(l_quantity) FILTER (l_linestatus = 'O')
             / avg(l_quantity) FILTER (l_linestatus = 'F') - 1, 3) * 100 AS pct FROM lineitem""",
    "q10": """SELECT count(*) FILTER (quality IS NULL) AS n
              FROM documents LEFT JOIN labels USING (doc_id)""",
    "q11": """SELECT count(*) FILTER (contains(p_name, 'ring')) AS a,
              count(*) FILTER (starts_with(p_name, 'red')) AS b FROM part""",
    "q12": """SELECT count(*) FILTER (contains(text, 'Apache License')) AS n_apache,
              count(*) FILTER (contains(text, 'MIT License')) AS n_mit FROM documents""",
    "q13": """SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id)
              WHERE (contains(text, '@') OR contains(text, 'http')) AND quality IS NOT NULL
              GROUP BY 1""",
    "q14": "SELECT max(len(string_split(p_name, ' '))) AS m FROM part",
    "q15": """SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(DISTINCT o_custkey) AS n
              FROM orders GROUP BY 1""",
    "q16": r"""SELECT CASE WHEN t IS NULL THEN 'Missing'
                 WHEN starts_with(t, 'An') OR starts_with(t, 'an') THEN 'an'
                 WHEN contains(t, '/') THEN 'slash'
                 WHEN regexp_full_match(t, '\p{Nd}+') THEN 'digits'
                 WHEN regexp_full_match(t, '\p{L}+') THEN 'alpha' ELSE 'Other' END AS c,
               count(*) AS n
               FROM (SELECT string_split(text, ' ')[1] AS t FROM documents) GROUP BY 1""",
    "q17": """SELECT CASE WHEN contains(upper(p_name), 'RED') THEN 'RED'
                WHEN contains(upper(p_name), 'RING') THEN 'RING'
                WHEN contains(upper(p_name), 'BLUE') THEN 'BLUE'
                WHEN contains(upper(p_name), 'GREEN') THEN 'GREEN' ELSE 'OTHERS' END AS c,
              count(*) AS n FROM part GROUP BY 1""",
    "q18a": f"""SELECT unnest(range(1, 101)) AS p, round(unnest(q), 6) AS v
                FROM (SELECT quantile_cont(o_totalprice, {_PERCENTS}) AS q FROM orders)""",
    "q18a_lineitem": f"""SELECT unnest(range(1, 101)) AS p, round(unnest(q), 6) AS v
                FROM (SELECT quantile_cont(l_quantity, {_PERCENTS}) AS q FROM lineitem)""",
    "q18b": f"""SELECT {_ORDER_FLAG} AS f, round(avg(o_totalprice), 4) AS m,
                count(o_totalprice) AS n FROM orders GROUP BY 1""",
    "q18c": f"""SELECT {_ORDER_FLAG} AS f, o_orderpriority, count(*) AS n
                FROM orders GROUP BY 1, 2""",
    "q18d": f"SELECT {_ORDER_FLAG} AS f, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "q18e": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10",
    "schema_table": f"""SELECT "column", CASE kind
          WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
          WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype, n_present
        FROM ({" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", typeof(any_value({c})) AS kind, count({c}) AS n_present FROM lineitem"
            for c in LINEITEM)})""",
    "head": """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
               ORDER BY o_orderkey LIMIT 5""",
    "value_counts": """SELECT event_type, count(*) AS n FROM events
                       WHERE event_type IS NOT NULL GROUP BY 1""",
    "mean_per_group": """SELECT event_type, round(avg(value), 6) AS m FROM events
                         WHERE event_type IS NOT NULL GROUP BY 1""",
    "money_text": "SELECT c_custkey, c_acctbal AS amount FROM customer",
    "clean_text": r"SELECT doc_id, md5(regexp_replace(text, '\s+$', '')) AS hash FROM documents",
    "insert_or_ignore": """SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
        SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FROM orders
        WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
    "json_rows": """SELECT CAST(to_json(struct_pack(event_id := event_id, user_id := user_id,
        event_type := event_type)) AS VARCHAR) AS j FROM events""",
    "json_array": """SELECT CAST(0 AS INTEGER) AS part, CAST(NULL AS BIGINT) AS position,
          '[' AS line UNION ALL
        SELECT 1, c_custkey,
          CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name)) AS VARCHAR) ||
          CASE WHEN row_number() OVER (ORDER BY c_custkey DESC) = 1 THEN '' ELSE ',' END
        FROM customer UNION ALL SELECT 2, NULL, ']'""",
    "json_in": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "first_match": r"""SELECT page_id, coalesce(nullif(
        regexp_extract(url, 'https?://[-a-z0-9]+\.example\.com', 0), ''), 'none') AS h
        FROM pages""",
    "csv_scan": f"""SELECT doc_id, lang, source, n_chars,
        CASE WHEN text NOT IN ({_texts(NA_TOKENS)}) THEN md5(text) END AS hash FROM documents""",
    "csv_scan_split": f"""SELECT doc_id, lang, source, n_chars,
        CASE WHEN text NOT IN ({_texts(NA_TOKENS)}) THEN md5(text) END AS hash FROM documents""",
    "csv_inferred": """SELECT 1003253567000000000 + o_orderkey AS id, o_orderstatus = 'F' AS finished,
        o_totalprice AS price, nullif(o_orderpriority, '5-LOW') AS priority FROM orders""",
    "csv_parquet": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "books_b1": _books("SELECT * FROM books"),
    "books_b1_bucketed": _books("SELECT * FROM books"),
    "books_b2": _books(f"SELECT CAST({_BOOK_JSON} AS VARCHAR) AS json FROM books"),
    "books_b2_array": _books(f"""SELECT CAST(0 AS INTEGER) AS part,
          CAST(NULL AS BIGINT) AS position, '[' AS line UNION ALL
        SELECT 1, id, CAST({_BOOK_JSON} AS VARCHAR) ||
          CASE WHEN id = (SELECT max(id) FROM books) THEN '' ELSE ',' END
        FROM books UNION ALL SELECT 2, NULL, ']'"""),
    "books_seeded": _books("""SELECT * FROM books WHERE id NOT IN (1, 2) UNION ALL
        SELECT * FROM (VALUES (1::BIGINT, '1984', 'George Orwell', 1949::BIGINT),
                              (2, 'Dune', 'Frank Herbert', 1965))"""),
    "books_b3": _books("SELECT * FROM books"),
    "books_b3_array": _books("SELECT * FROM books"),
    "books_b3_responses": _books("SELECT * FROM books"),
    "books_b4": """SELECT doc_id, coalesce(nullif(
        regexp_extract(text, 'https?://[-a-z0-9.]+', 0), ''),
        'Still starting… re-run this cell.') AS url FROM documents""",
    "listings_q1": _listings("SELECT count(*) AS n_rows FROM listings"),
    "listings_q2": "SELECT CAST(18 AS BIGINT) AS n_cols",
    "listings_q3": _listings("SELECT count(DISTINCT host_id) AS n_hosts FROM listings"),
    "listings_q4_counts": _listings("""SELECT host_id, host_name, count(*) AS listing_count
        FROM listings WHERE host_name IS NOT NULL GROUP BY 1, 2"""),
    "listings_q4": _listings("""SELECT host_id, host_name, listing_count FROM (
          SELECT host_id, host_name, count(*) AS listing_count,
                 rank() OVER (ORDER BY count(*) DESC) AS r
          FROM listings WHERE host_name IS NOT NULL GROUP BY 1, 2) WHERE r = 1"""),
    "listings_q5": _listings("""SELECT count(DISTINCT host_id) AS n_superhosts FROM listings
        WHERE host_is_superhost = 't'"""),
    "listings_q6_counts": _listings("""SELECT district, count(*) AS total_listings FROM listings
        WHERE district IS NOT NULL GROUP BY 1"""),
    "listings_q6": _listings("""SELECT district, total_listings FROM (
          SELECT district, count(*) AS total_listings, rank() OVER (ORDER BY count(*) DESC) AS r
          FROM listings WHERE district IS NOT NULL GROUP BY 1) WHERE r = 1"""),
    "listings_q6b": _listings("""SELECT district, neighbourhood, count(*) AS n FROM listings
        WHERE district IS NOT NULL AND neighbourhood IS NOT NULL GROUP BY 1, 2"""),
    "listings_q7": _listings("SELECT round_even(avg(price), 0) AS mean_price FROM listings"),
    "listings_q8": _listings("SELECT count(*) AS n FROM listings WHERE number_of_reviews = 0"),
    "listings_q9": _listings("""SELECT round(round_even(
          avg(reviews_per_month) FILTER (instant_bookable = 't')
          / avg(reviews_per_month) FILTER (instant_bookable = 'f') - 1, 3) * 100, 4)
          AS pct_higher FROM listings"""),
    "listings_q10": _listings("SELECT count(*) - count(license) AS n FROM listings"),
    "listings_q11": _listings("""SELECT count(*) FILTER (contains(license, 'ESFC')) AS n_contains,
        count(*) FILTER (starts_with(license, 'ESFC')) AS n_starts FROM listings"""),
    "listings_q12": _listings("""SELECT count(*) FILTER (contains(license, 'Exempt')) AS n_exempt,
        count(*) FILTER (contains(license, 'En proceso')) AS n_en_proceso FROM listings"""),
    "listings_q13a": _listings("""SELECT host_verifications, count(*) AS n FROM listings
        WHERE host_verifications IS NOT NULL GROUP BY 1"""),
    "listings_q13b": _listings("""SELECT host_identity_verified, count(*) AS n FROM listings
        WHERE (contains(host_verifications, 'email') OR contains(host_verifications, 'work_email'))
          AND host_identity_verified IS NOT NULL GROUP BY 1"""),
    "listings_q13b_printed": _listings("""SELECT nullif(count(*), 0) AS n FROM listings
        WHERE contains(host_verifications, 'email') AND host_identity_verified = 'f'"""),
    "listings_q13_intended": _listings("""SELECT count(DISTINCT host_id) AS n_hosts FROM listings
        WHERE host_verifications IS NULL OR NOT contains(host_verifications, 'email')"""),
    "listings_q14": _listings("""SELECT max(amenities_count) AS max_amenities,
        count(*) - count(amenities_count) AS n_unread FROM listings"""),
    "listings_q15": _listings("""SELECT registered_year, n FROM (
          SELECT CAST(year(host_since) AS VARCHAR) AS registered_year, count(*) AS n,
                 rank() OVER (ORDER BY count(*) DESC) AS r
          FROM listings WHERE host_since IS NOT NULL GROUP BY 1) WHERE r = 1"""),
    "listings_q15_intended": _listings("""SELECT registered_year, n FROM (
          SELECT CAST(year(host_since) AS VARCHAR) AS registered_year,
                 count(DISTINCT host_id) AS n,
                 rank() OVER (ORDER BY count(DISTINCT host_id) DESC) AS r
          FROM listings WHERE host_since IS NOT NULL GROUP BY 1) WHERE r = 1"""),
    "listings_q16a": _listings(f"""SELECT {_CATEGORY} AS license_category, count(*) AS n
        FROM listings GROUP BY 1"""),
    "listings_q16b": _listings(f"""SELECT {_CATEGORY} AS license_category, license, count(*) AS n
        FROM listings WHERE license IS NOT NULL GROUP BY 1, 2"""),
    "listings_q17a": _listings("""SELECT host_location, count(*) AS n FROM listings
        WHERE host_location IS NOT NULL GROUP BY 1"""),
    "listings_q17b": _listings(
        """SELECT clean_country, host_location, count(*) AS n
           FROM listings JOIN located USING (host_location) GROUP BY 1, 2""",
        _LOCATED,
    ),
    "listings_q17c": _listings(
        """SELECT clean_country, count(*) AS n
           FROM listings JOIN located USING (host_location) GROUP BY 1""",
        _LOCATED,
    ),
    "listings_q17c_intended": _listings(
        """SELECT clean_country, count(*) AS n
           FROM listings JOIN located USING (host_location)
           WHERE clean_country <> 'SPAIN' GROUP BY 1""",
        _LOCATED_BY_WORD,
    ),
    **dict.fromkeys(
        ["listings_country", "listings_country_by_row"],
        _listings(
            """SELECT listing_id, clean_country
               FROM listings LEFT JOIN located USING (host_location)""",
            _LOCATED,
        ),
    ),
    "listings_q18a": _listings(
        f"""SELECT unnest(range(1, 101)) AS percentile, round(unnest(q), 6) AS price
            FROM (SELECT quantile_cont(price, {_PERCENTS}) AS q FROM listings)"""
    ),
    **dict.fromkeys(["listings_q18b", "listings_q18b_stored"], _listings(
        """SELECT outlier_check, round(avg(price), 4) AS mean_price, count(price) AS n_price,
             round(avg(number_of_reviews), 4) AS mean_reviews,
             round(avg(amenities_count), 4) AS mean_amenities,
             round(avg(occupancy), 4) AS mean_occupancy
           FROM flagged GROUP BY 1""",
        _FLAGGED,
    )),
    "listings_q18c": _listings(
        "SELECT outlier_check, property_type, count(*) AS n FROM flagged GROUP BY 1, 2",
        _FLAGGED,
    ),
    "listings_q18d": _listings(
        """SELECT outlier_check, district, count(*) AS n FROM flagged
           WHERE district IS NOT NULL GROUP BY 1, 2""",
        _FLAGGED,
    ),
    "listings_q18e": _listings(
        """SELECT listing_id, price AS cleaned_price, number_of_reviews, amenities_count
           FROM flagged WHERE outlier_check = 'Outlier'
           ORDER BY number_of_reviews DESC, listing_id LIMIT 10""",
        _FLAGGED,
    ),
}
