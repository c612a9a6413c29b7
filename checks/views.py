"""Driver tables seen as a place catalog.

Each view is one SELECT written so that Spark and DuckDB read it alike; the few
spellings that differ go through `Dialect`.  The views are the common input of a
query and of the SQL it is compared with; the query logic itself is written twice,
once as a Spark job and once as plain SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larder import taxonomy
from larder.catalog import Catalog
from larder.functions.text import fold_sql

RAW = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@dataclass(frozen=True)
class Dialect:
    name: str

    def fold(self, x: str) -> str:
        return fold_sql(x) if self.name == "spark" else f"strip_accents(lower({x}))"

    def stamp(self, seconds: str) -> str:
        if self.name == "spark":
            return f"timestamp_seconds({seconds})"
        return f"make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT))"

    def epoch(self, ts: str) -> str:
        if self.name == "spark":
            return f"unix_seconds(CAST({ts} AS TIMESTAMP))"
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def rows(self, alias: str, columns: list[str], values: list[tuple]) -> str:
        def lit(v):
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, (int, float)):
                return str(v)
            return "'" + str(v).replace("'", "''") + "'"

        body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in values)
        return f"(VALUES {body}) AS {alias}({', '.join(columns)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"

    def words(self, x: str) -> str:
        return f"split({x}, ' ')" if self.name == "spark" else f"string_split({x}, ' ')"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def _pick(key: str, values: list[str]) -> str:
    """CASE that picks values[key % len]."""
    n = len(values)
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({key}) % {n} {arms} END)"


KINDS = ["Phở Bò", "Cà Phê", "Bún Chả", "Cơm Tấm", "Trà Sữa", "Quán Chay", "Bánh Mì",
         "Lẩu Gà", "Hủ Tiếu", "Kem", "Nhà Hàng", "Bếp", "Karaoke"]
OWNERS = ["Sài Gòn", "Hương", "Đông Ba", "Ngọc Lan", "Cô Ba", "Út Lành", "Hạnh",
          "Phúc Lộc", "Mây"]
PROFILES = ["món nóng ấm bụng cho ngày mưa", "đồ uống mát lạnh", "quán yên tĩnh để làm việc",
            "bún phở đậm đà", "ăn vặt giòn cay"]
DISHES = ["Phở bò", "Bún riêu", "Cơm tấm", "Trà sữa trân châu", "Bánh xèo", "Gỏi cuốn"]

_VIEWS: dict[str, object] = {}
_DEPENDS: dict[str, list[str]] = {}


def view(*depends: str):
    def register(make):
        _VIEWS[make.__name__] = make
        _DEPENDS[make.__name__] = list(depends)
        return make

    return register


@view("customer", "orders")
def place(d: Dialect) -> str:
    name = f"concat({_pick('c_custkey', KINDS)}, ' ', {_pick('c_custkey * 7', OWNERS)}, ' ', CAST(c_custkey % 23 AS STRING))"
    return f"""
    SELECT id, name, {d.fold('name')} AS normalized_name, CAST(NULL AS STRING) AS description,
           id AS location_id, CASE WHEN id % 4 = 0 THEN concat('+84 28 ', CAST(id AS STRING)) END AS phone,
           CASE WHEN id % 5 = 0 THEN concat('https://p', CAST(id AS STRING), '.example') END AS website_url,
           CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(1 + id % 4 AS INT) END AS price_level,
           CASE WHEN id % 10 = 0 THEN NULL ELSE CAST((id * 7) % 51 AS DOUBLE) / 10 END AS rating,
           CASE WHEN id % 9 = 0 THEN NULL ELSE CAST((id * 13) % 500 AS INT) END AS review_count,
           status,
           CASE WHEN id % 3 = 0 THEN NULL ELSE {_pick('id', PROFILES)} END AS semantic_profile,
           {d.stamp('1600000000 + last_order')} AS updated_at
    FROM (
      SELECT c_custkey AS id, {name} AS name,
             CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'active' END AS status,
             coalesce(last_order, 0) + c_custkey % 5 AS last_order
      FROM {{customer}} LEFT JOIN (
        SELECT o_custkey, max({d.epoch('o_orderdate')}) - 600000000 AS last_order FROM {{orders}} GROUP BY o_custkey
      ) AS o ON o_custkey = c_custkey
    ) AS c"""


@view("customer", "nation", "region")
def location(d: Dialect) -> str:
    return """
    SELECT c_custkey AS id, concat(CAST(c_custkey AS STRING), ' Nguyễn Huệ') AS address_line,
           r_name AS district, n_name AS city, 'VN' AS country_code,
           concat(CAST(c_custkey AS STRING), ' Nguyễn Huệ, ', r_name, ', ', n_name) AS formatted_address,
           CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(10.35 AS DOUBLE) + ((c_custkey * 37) % 1000) * CAST(0.0008 AS DOUBLE) END AS lat,
           CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(106.35 AS DOUBLE) + ((c_custkey * 91) % 1000) * CAST(0.0007 AS DOUBLE) END AS lon
    FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey"""


@view("customer", "part")
def category(d: Dialect) -> str:
    return """
    SELECT lower(c_mktsegment) AS id, c_mktsegment AS name, lower(c_mktsegment) AS slug,
           CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS description, true AS is_active
    FROM (SELECT DISTINCT c_mktsegment FROM {customer}) AS s
    UNION ALL
    SELECT lower(p_type), p_type, lower(p_type), 'building', CAST(NULL AS STRING), p_type <> 'PROMO'
    FROM (SELECT DISTINCT p_type FROM {part}) AS t"""


@view("customer", "orders", "lineitem", "part")
def place_category(d: Dialect) -> str:
    return """
    SELECT DISTINCT place_id, category_id, 'scan' AS source, CAST(1 AS DOUBLE) AS confidence FROM (
      SELECT c_custkey AS place_id, lower(c_mktsegment) AS category_id FROM {customer} WHERE c_custkey % 6 <> 0
      UNION ALL
      SELECT o_custkey, lower(p_type) FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
      JOIN {part} ON p_partkey = l_partkey WHERE l_quantity >= 45
    ) AS u"""


@view("orders", "lineitem", "part")
def dish(d: Dialect) -> str:
    name = f"CASE WHEN p_partkey % 3 = 0 THEN {_pick('p_partkey', DISHES)} ELSE p_name END"
    return f"""
    SELECT place_id * 1000000 + p_partkey AS id, place_id, name, {d.fold('name')} AS normalized_name,
           CASE WHEN p_partkey % 4 = 0 THEN concat('with ', p_brand) END AS description,
           p_retailprice AS price_amount, 'VND' AS currency_code, qty >= 50 AS is_popular,
           CASE WHEN p_size % 11 = 0 THEN 'unavailable' ELSE 'available' END AS status, p_partkey
    FROM (SELECT o_custkey AS place_id, l_partkey, sum(l_quantity) AS qty
          FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey) AS s
    JOIN (SELECT *, {name} AS name FROM {{part}}) AS p ON p_partkey = l_partkey"""


@view()
def food_attribute(d: Dialect) -> str:
    rows = [(i, *row) for i, row in enumerate(taxonomy.FOOD_ATTRIBUTES)]
    return (
        "SELECT CAST(id AS INT) AS id, code, name, normalized, dimension, code <> 'snail' AS is_active FROM "
        + d.rows("a", ["id", "code", "name", "normalized", "dimension"], rows)
    )


@view("dish")
def dish_attribute(d: Dialect) -> str:
    return f"""
    SELECT id AS dish_id, CAST(p_partkey % {len(taxonomy.FOOD_ATTRIBUTES)} AS INT) AS attribute_id FROM {{dish}}"""


@view("customer")
def hours(d: Dialect) -> str:
    days = d.rows("w", ["day"], [(i,) for i in range(1, 8)])
    return f"""
    SELECT place_id * 10 + day AS id, place_id, CAST(day AS INT) AS day_of_week, opens_min, closes_min,
           (place_id + day) % 8 = 0 AS is_closed, closes_min < opens_min AS spans_next_day
    FROM (
      SELECT c_custkey AS place_id, day, CAST((((c_custkey + day) * 13) % 24) * 60 AS INT) AS opens_min,
             CAST(((((c_custkey + day) * 13) % 24) * 60 + 600) % 1440 AS INT) AS closes_min
      FROM {{customer}} CROSS JOIN {days}
    ) AS h"""


@view("documents", "customer")
def review(d: Dialect) -> str:
    return f"""
    SELECT doc_id AS id, doc_id % n AS place_id, doc_id % n AS place_source_id, CAST(doc_id AS STRING) AS external_review_id,
           CAST(doc_id % 6 AS DOUBLE) AS rating, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS content,
           CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {d.stamp('1704067200 + doc_id * 3600')} END AS reviewed_at,
           lang AS language_code, doc_id % 5 <> 0 AS is_visible
    FROM {{documents}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) AS c"""


@view("pages", "customer")
def image(d: Dialect) -> str:
    return """
    SELECT page_id AS id, page_id % n AS place_id, page_id % 3 AS place_source_id, url,
           CASE WHEN page_id % 2 = 0 THEN concat('photo ', CAST(page_id AS STRING)) END AS alt_text,
           CAST(page_id % 4 AS INT) AS sort_order, page_id % 3 = 0 AS is_cover,
           CASE WHEN page_id % 10 = 9 THEN 'restricted' ELSE 'active' END AS status
    FROM {pages} CROSS JOIN (SELECT greatest(count(*) / 10, 1) AS m, CAST(greatest(floor(count(*) / 10), 1) AS BIGINT) AS n FROM {customer}) AS c"""


@view()
def data_source(d: Dialect) -> str:
    rows = [
        (1, taxonomy.SCAN_PROVIDER, "Maps scan", "https://maps.example", True),
        (2, "fixture", "Fixture", None, False),
        (3, "google_maps", "Maps API", None, False),
        (4, "import", "Bulk import", None, True),
        (5, "partner", "Partner feed", None, True),
    ]
    return (
        "SELECT CAST(id AS INT) AS id, code, name, base_url, is_active FROM "
        + d.rows("s", ["id", "code", "name", "base_url", "is_active"], rows)
    )


_PROVIDER = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"


@view("events", "customer")
def place_source(d: Dialect) -> str:
    return f"""
    SELECT data_source_id * 1000000 + place_id AS id, place_id, data_source_id,
           concat('ext-', CAST(place_id AS STRING)) AS external_id,
           CASE WHEN place_id % 6 = 1 THEN NULL
                ELSE concat('https://maps.example/place/', CAST(place_id AS STRING), '/data=!3d', CAST(10 + place_id % 3 AS STRING), '.5!4d', CAST(106 + place_id % 2 AS STRING), '.25') END AS source_url,
           concat('Source ', CAST(place_id AS STRING)) AS source_name, rating AS source_rating,
           CASE WHEN place_id % 4 = 0 THEN NULL ELSE CAST(seen AS INT) END AS source_review_count,
           raw_data, first_seen_at, last_seen_at,
           CASE WHEN place_id % 8 = 3 THEN 'missing' ELSE 'active' END AS status
    FROM (
      SELECT event_id % n AS place_id, {_PROVIDER} AS data_source_id, count(*) AS seen,
             min(ts) AS first_ts, max(ts) AS last_ts, max(props) AS raw_data, max(CASE WHEN value <= 5 THEN value END) AS rating,
             {d.stamp('min(' + d.epoch('ts') + ')')} AS first_seen_at, {d.stamp('max(' + d.epoch('ts') + ')')} AS last_seen_at
      FROM {{events}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) AS c
      GROUP BY event_id % n, {_PROVIDER}
    ) AS s"""


@view("events")
def crawl_run(d: Dialect) -> str:
    return f"""
    SELECT event_id AS id, {_PROVIDER} AS data_source_id,
           CASE WHEN event_id % 10 = 0 THEN 'refresh' ELSE 'discovery' END AS job_type,
           concat('{{{{"query": "q', CAST(event_id % 20 AS STRING), '", "location": "d', CAST(event_id % 7 AS STRING), ', City"}}}}') AS target,
           CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' ELSE 'completed' END AS status,
           CASE WHEN event_id % 4 = 2 THEN NULL ELSE {d.stamp(d.epoch('ts'))} END AS started_at,
           CASE WHEN event_id % 4 IN (0, 3) THEN {d.stamp(d.epoch('ts') + ' + 60')} END AS finished_at,
           CAST(event_id % 50 AS INT) AS records_found, CAST(event_id % 50 / 2 AS INT) AS records_processed
    FROM {{events}}"""


@view("events")
def processing_record(d: Dialect) -> str:
    return f"""
    SELECT event_id AS id, event_id AS crawl_run_id, concat('ext-', CAST(user_id AS STRING)) AS external_id,
           CASE event_id % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'normalization' ELSE 'matching' END AS stage,
           CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'pending' ELSE 'processing' END AS status,
           CAST(user_id % 7 AS INT) AS attempt_count, props AS error_details,
           CASE WHEN event_id % 6 = 0 THEN NULL ELSE {d.stamp(d.epoch('ts'))} END AS processed_at
    FROM {{events}}"""


@view("embeddings", "customer")
def vector(d: Dialect) -> str:
    return f"""
    SELECT vec_id AS id, vec_id % n AS place_id, embedding,
           CASE WHEN vec_id % 2 = 0 THEN 'm@doc:v3' ELSE 'old@doc:v2' END AS model,
           concat('h', CAST(vec_id % 50 AS STRING)) AS content_hash,
           {d.stamp('1700000000 + vec_id')} AS created_at
    FROM {{embeddings}} CROSS JOIN (SELECT CAST(greatest(floor(count(*) / 10), 1) AS BIGINT) AS n FROM {{customer}}) AS c"""


@view("events", "customer")
def saved(d: Dialect) -> str:
    return f"""
    SELECT user_id, event_id % n AS place_id, {d.stamp('min(' + d.epoch('ts') + ')')} AS created_at
    FROM {{events}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) AS c
    WHERE event_type = 'purchase' GROUP BY user_id, event_id % n"""


TEXTS = ["bún", "phở bò", "cơm tấm", "small ring", "quán trà sữa", "cà phê sài gòn", "xyzw",
         "red", "bánh xèo giòn", "100%_"]
TASTES = ["Nóng", "cay", "ring", "Đậm đà", "ngọt"]
SORTS = ["rating", "relevance", "newest", "distance"]


@view("supplier", "nation", "region")
def request(d: Dialect) -> str:
    """One search per supplier; every condition appears in some of them."""
    return f"""
    SELECT s_suppkey AS request_id,
           CASE WHEN s_suppkey % 3 = 0 THEN {_pick('s_suppkey', TEXTS)} END AS query,
           CASE WHEN s_suppkey % 7 = 1 THEN {_pick('CAST(floor(s_suppkey / 7) AS BIGINT)', ['building', 'economy', 'promo', 'small'])} END AS category,
           CASE WHEN s_suppkey % 5 = 2 THEN {_pick('CAST(floor(s_suppkey / 5) AS BIGINT)', TASTES)} END AS taste,
           CASE WHEN s_suppkey % 4 = 1 THEN n_name END AS city,
           CASE WHEN s_suppkey % 6 = 5 THEN lower(substr(r_name, 1, 3)) END AS district,
           CASE WHEN s_suppkey % 4 = 2 THEN CAST(s_suppkey % 5 AS DOUBLE) END AS min_rating,
           CASE WHEN s_suppkey % 11 = 3 THEN CAST(1 + s_suppkey % 4 AS INT) END AS price_level,
           CASE WHEN s_suppkey % 3 = 1 THEN CAST(10.35 AS DOUBLE) + ((s_suppkey * 53) % 100) * CAST(0.008 AS DOUBLE) END AS latitude,
           CASE WHEN s_suppkey % 3 = 1 THEN CAST(106.35 AS DOUBLE) + ((s_suppkey * 29) % 100) * CAST(0.007 AS DOUBLE) END AS longitude,
           CASE WHEN s_suppkey % 6 = 1 THEN CAST(500 + (s_suppkey % 9) * 1500 AS DOUBLE) END AS radius_m,
           s_suppkey % 9 = 4 AS open_now,
           {_pick('CAST(floor(s_suppkey / 3) AS BIGINT)', SORTS)} AS sort,
           CAST(5 + s_suppkey % 20 AS INT) AS page_limit,
           CAST(CASE WHEN s_suppkey % 8 = 7 THEN 10 ELSE 0 END AS INT) AS page_offset
    FROM {{supplier}} JOIN {{nation}} ON n_nationkey = s_nationkey JOIN {{region}} ON r_regionkey = n_regionkey"""


# Moment at which every opening-hours condition is evaluated: Wednesday 2024-06-05 13:30 UTC.
NOW_SECONDS = 1_717_594_200


def _ordered(names: list[str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in done:
            return
        for parent in _DEPENDS[name]:
            visit(parent)
        done.append(name)

    for name in names:
        visit(name)
    return done


_HOLE = re.compile(r"\{([a-z_]+)\}")


def duck(*names: str) -> str:
    """WITH clause that defines the named views and all they build on."""
    parts = []
    for name in _ordered(list(names)):
        body = _HOLE.sub(r"\1", _VIEWS[name](DUCK)).replace("{{", "{").replace("}}", "}")
        parts.append(f"{name} AS MATERIALIZED ({body})")
    return "WITH " + ",\n".join(parts) + "\n"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    if name in RAW:
        return raw(spark, sf_dir, name)
    body = _VIEWS[name](SPARK)
    inputs = {parent: frame(spark, sf_dir, parent) for parent in _DEPENDS[name]}
    return spark.sql(body, **inputs)


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    return Catalog(**{n: frame(spark, sf_dir, n) for n in names})
