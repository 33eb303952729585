"""One query or more for every operator; the text runs on both engines unless ``ORACLE`` has another."""

from __future__ import annotations

import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.shared import shared_path
from .tpch import QUERIES as TPCH

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
DATES = ("l_shipdate", "o_orderdate")


SQL: dict[str, str] = {
    # sources and results
    "S01_select": "SELECT DISTINCT c_mktsegment AS segment, c_nationkey FROM customer WHERE c_acctbal > 0 ORDER BY segment DESC, c_nationkey LIMIT 20 OFFSET 3",
    "S07_table_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '2001-01-01' AND l_discount > 0.05",
    "S08_values_source": "SELECT 1 AS one, 'x' AS s, 2.5e0 AS d, TRUE AS b, DATE '2020-02-29' AS day, CAST(NULL AS integer) AS nothing",
    "S09_result_collector": "SELECT n_nationkey, n_name FROM nation",
    # filters and expressions
    "F01_filter": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'",
    "F02_project": "SELECT c.*, c_acctbal * 2 AS twice, n.n_name AS nation FROM customer c JOIN nation n ON c_nationkey = n_nationkey",
    "F03_comparison": """SELECT count(*) AS n, count(CASE WHEN l_quantity = 10 THEN 1 END) AS eq, count(CASE WHEN l_quantity <> 10 THEN 1 END) AS ne,
        count(CASE WHEN l_quantity < 10 THEN 1 END) AS lt, count(CASE WHEN l_quantity <= 10 THEN 1 END) AS le, count(CASE WHEN l_quantity > 10 THEN 1 END) AS gt,
        count(CASE WHEN l_quantity >= 10 THEN 1 END) AS ge, count(CASE WHEN l_returnflag < 'N' THEN 1 END) AS text_lt, count(CASE WHEN l_shipdate < DATE '1998-01-01' THEN 1 END) AS day_lt,
        count(CASE WHEN 0e0 / 0e0 = 0e0 / 0e0 THEN 1 END) AS nan_equals, count(CASE WHEN 0e0 / 0e0 > 1e0 / 0e0 THEN 1 END) AS nan_last FROM lineitem""",
    "F04_logic": """SELECT x, y, x AND y AS conj, x OR y AS disj, NOT x AS neg FROM
        (SELECT CASE r_regionkey WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN NULL ELSE TRUE END AS x FROM region) a
        CROSS JOIN (SELECT CASE r_regionkey WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN NULL ELSE FALSE END AS y FROM region) b""",
    "F05_is_null": "SELECT o_orderkey, l_orderkey IS NULL AS alone, l_orderkey IS NOT NULL AS matched FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 7 AND l_quantity > 40",
    "F06_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 7 AND l_shipdate NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    "F07_in_list": "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49) AND p_type NOT IN ('PROMO', 'SMALL') AND (p_size IN (7, NULL) OR p_size = 49)",
    "F08_like": "SELECT p_partkey, p_name LIKE '%1_' AS tens FROM part WHERE p_brand LIKE 'Brand#_3' AND p_type NOT LIKE '%O%' AND p_name LIKE p_name",
    "F09_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS price, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status FROM orders",
    "F10_cast": """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS bigint) AS whole, l_quantity::integer AS q, CAST(l_orderkey AS varchar) AS t, CAST(l_discount > 0.05 AS integer) AS flag,
        CAST(l_shipdate AS date) AS day, CAST('2.5' AS integer) AS half, CAST('0x1F' AS integer) AS hex, CAST('1_000' AS bigint) AS parted, CAST('1e999' AS double) AS inf, CAST(2.5e0 AS integer) AS even, CAST('yes' AS boolean) AS yes, CAST(l_quantity AS varchar) AS qt FROM lineitem""",
    # joins
    "J01_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_custkey + 0 = c_custkey",
    "J02_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "J03_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region, (SELECT 1 AS one) q",
    "J04_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000",
    "J05_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 350000",
    "J06_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    "J07_using": "SELECT a.n_name, k, b.r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a JOIN (SELECT r_name, r_regionkey AS k FROM region) b USING (k)",
    "J08_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "J09_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "J10_null_aware_anti": """SELECT n_nationkey, 'plain' AS kind FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
        AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 1e9)
        AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey NOT IN (SELECT CASE WHEN s_suppkey > 3 THEN s_suppkey END FROM supplier))""",
    "J11_multiway": "SELECT s.s_name, n.n_name, r.r_name, m.n_name AS other FROM supplier s JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON s.s_nationkey = n.n_nationkey LEFT JOIN nation m ON m.n_nationkey = n.n_nationkey + 1",
    "J12_one_row_cross": "SELECT s_suppkey, s_acctbal > (SELECT avg(s_acctbal) FROM supplier) AS above, (SELECT count(*) FROM nation) AS nations FROM supplier",
    "J13_derived_key": "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS broke, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS worst FROM nation",
    # subqueries
    "Q01_scalar": "SELECT c_custkey, c_acctbal - (SELECT min(c_acctbal) FROM customer) AS over FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) ORDER BY (SELECT 1), c_custkey",
    "Q02_scalar_guard": "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey = 1000) AS none, (SELECT n_name FROM nation WHERE n_nationkey = 7) AS one FROM region",
    "Q03_correlated_scalar": "SELECT p_partkey FROM part WHERE p_size > (SELECT avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)",
    "Q04_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) AND NOT EXISTS (SELECT * FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0) AND EXISTS (SELECT 1 FROM region)",
    "Q05_in_query": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "Q06_correlated_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > c_acctbal * 40)",
    "Q07_derived": "SELECT a, total FROM (SELECT l_returnflag, sum(l_quantity) FROM lineitem GROUP BY l_returnflag) AS x (a, total) WHERE total > 0",
    "Q08_with": "WITH big (k, price) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000), both_ways AS (SELECT a.k FROM big a JOIN big b ON a.k = b.k), orders AS (SELECT k FROM both_ways) SELECT k FROM orders",
    # aggregates
    "A01_group_by": "SELECT c_mktsegment, c_nationkey % 5 AS bucket, count(*) AS n FROM customer GROUP BY 1, bucket, c_mktsegment",
    "A02_ungrouped": "SELECT count(*) AS n, sum(o_totalprice) AS nothing, min(o_orderstatus) AS least FROM orders WHERE o_orderkey < 0",
    "A03_count_star": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "A04_count": "SELECT count(o_orderkey) AS orders, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "A05_sum_integer": "SELECT l_returnflag, CAST(sum(l_partkey) AS bigint) AS big, CAST(sum(l_linenumber) AS bigint) AS small, CAST(sum(-l_suppkey) AS bigint) AS negative FROM lineitem GROUP BY l_returnflag",
    "A06_sum_double": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    "A07_avg": "SELECT p_brand, round(avg(p_retailprice), 6) AS price, round(avg(p_size), 6) AS size FROM part GROUP BY p_brand",
    "A08_min_max": "SELECT l_linestatus, min(l_shipdate)::date AS first, max(l_shipdate)::date AS last, min(l_quantity) AS least, max(l_returnflag) AS flag, max(l_quantity > 25) AS any_big FROM lineitem GROUP BY l_linestatus",
    "A09_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS bigint) AS numbers, avg(DISTINCT l_linenumber) AS mean, max(DISTINCT l_quantity) AS most FROM lineitem GROUP BY l_returnflag",
    "A10_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)",
    "A11_post_aggregate": "SELECT l_returnflag, round(sum(l_extendedprice) / count(*) + 1, 4) AS mean, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY l_returnflag",
    "A12_select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber % 2 AS odd FROM lineitem",
    # order and limit
    "O01_order_by": "SELECT s_name, s_acctbal AS balance FROM supplier ORDER BY s_nationkey % 3, balance DESC, 1",
    "O02_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey DESC, c_custkey LIMIT 50",
    "O03_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 + 5 OFFSET 7",
    "O04_top_n": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "O05_distinct_order": "SELECT DISTINCT o_orderpriority AS p, o_orderstatus FROM orders ORDER BY o_orderstatus, p LIMIT 7",
    # numbers
    "M01_add_subtract_multiply": "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS a, l_linenumber - 10 AS b, l_linenumber * l_linenumber AS c, l_quantity * l_linenumber AS d, l_orderkey - 0.5e0 AS e FROM lineitem",
    "M02_divide": "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, l_quantity / (l_linenumber - 1) AS maybe_infinite, (l_linenumber - 1) / (l_linenumber - 1) AS maybe_nan FROM lineitem",
    "M03_modulo_integer": "SELECT l_orderkey, l_linenumber, l_partkey % 7 AS a, -l_partkey % 7 AS b, l_partkey % (l_linenumber - 1) AS by_zero FROM lineitem",
    "M04_modulo_double": "SELECT l_orderkey, l_linenumber, l_extendedprice % 7e0 AS a, -l_quantity % 3.5e0 AS b, l_quantity % (l_linenumber - 1e0) AS by_zero FROM lineitem",
    "M05_sign": "SELECT s_suppkey, -s_acctbal AS a, +s_nationkey AS b, - - s_suppkey AS c FROM supplier",
    "M06_abs": "SELECT s_suppkey, abs(s_acctbal) AS a, abs(s_nationkey - 12) AS b, abs(-s_suppkey) AS c FROM supplier",
    "M07_round": "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS a, round(l_extendedprice / 7, 2) AS b, round(l_extendedprice, -2) AS c, round(l_orderkey, -2) AS d, round(1.005e0, 2) AS e FROM lineitem",
    "M08_floor_ceil": "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS a, ceil(l_extendedprice / 3) AS b, floor(-l_tax - 0.5e0) AS c, ceiling(1e300) AS d FROM lineitem",
    # text
    "T01_concat": "SELECT c_custkey, c_name || '-' || c_nationkey || '/' || (c_acctbal > 0) || NULL AS nothing, c_name || ':' || c_custkey AS label, 'b' || c_acctbal AS balance FROM customer",
    "T02_length": "SELECT p_partkey, length(p_name) AS n, length('éß日') AS three, length('') AS zero FROM part",
    "T03_upper_lower": "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM part",
    "T04_substring": "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name FROM -3) AS b, substr(p_name, 0, 2) AS c, substring(p_name, 4, -2) AS d, substring(p_name FROM p_size % 6 FOR 2) AS e FROM part",
    "T05_like": "SELECT n_name, n_name LIKE 'NATION\\_%' AS literal_backslash, n_name LIKE '%\\_1%' AS none, n_name LIKE '%_1%' AS one FROM nation",
    # dates
    "D01_literal": "SELECT o_orderkey FROM orders WHERE o_orderdate = DATE '1997-06-15' OR o_orderdate = '1998-1-5'",
    "D02_parts": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS n FROM orders",
    "D03_dayofweek": "SELECT o_orderkey, dayofweek(o_orderdate) AS w FROM orders",
    "D04_extract": "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(dow FROM o_orderdate) AS w, extract(doy FROM o_orderdate) AS n, extract(quarter FROM o_orderdate) AS q FROM orders",
    "D05_date_plus": "SELECT o_orderkey, o_orderdate::date + 30 AS later, o_orderdate::date - 45 AS earlier, 7 + o_orderdate::date AS week FROM orders",
    "D06_date_minus": "SELECT o_orderkey, o_orderdate::date - DATE '1995-01-01' AS days FROM orders",
    "D07_interval": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-31' + INTERVAL '1' month AND o_orderdate < DATE '1998-12-01' - INTERVAL '90' day AND o_orderdate <> DATE '1996-02-29' + INTERVAL '1 year'",
    # conditions
    "C01_coalesce": "SELECT c_custkey, coalesce(o_orderkey, -c_custkey, 0) AS k, coalesce(NULL, o_totalprice, 1) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "C02_nullif": "SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 1) AS n, nullif(l_returnflag, 'R') AS f, nullif(l_linenumber, 1.0e0) AS d FROM lineitem",
    # scans, filters, aggregates, joins and sorts in isolation
    "micro_scan_count": "SELECT count(*) AS n FROM lineitem",
    "micro_scan_sum": "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem",
    "micro_scan_minmax": "SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_partkey) AS c, max(l_partkey) AS d FROM lineitem",
    "micro_scan_expr": "SELECT round(sum(l_extendedprice * 2e0 + l_partkey), 2) AS s FROM lineitem",
    "micro_filter_1pct": "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity < 2 AND l_discount < 0.05",
    "micro_filter_10pct": "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity <= 5",
    "micro_filter_50pct": "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity <= 25",
    "micro_filter_90pct": "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity <= 45",
    "micro_filter_and": "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 25 AND l_extendedprice > 500 AND l_linenumber < 4",
    "micro_filter_str_eq": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'",
    "micro_filter_like": "SELECT count(*) AS n FROM part WHERE p_name LIKE '%99%'",
    "micro_filter_date": "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01'",
    "micro_agg_few": "SELECT l_linenumber, round(sum(l_extendedprice), 2) AS s, count(*) AS n, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber LIMIT 10",
    "micro_agg_many": "SELECT count(*) AS n, round(sum(sv), 2) AS s, CAST(sum(c) AS bigint) AS c FROM (SELECT l_orderkey, sum(l_extendedprice) AS sv, count(*) AS c FROM lineitem GROUP BY l_orderkey) q",
    "micro_agg_2keys": "SELECT count(*) AS n, round(sum(sv), 2) AS s FROM (SELECT l_suppkey, l_shipdate, sum(l_extendedprice) AS sv FROM lineitem GROUP BY l_suppkey, l_shipdate) q",
    "micro_agg_str": "SELECT p_name, count(*) AS n, round(avg(p_retailprice), 4) AS a FROM part GROUP BY p_name ORDER BY p_name LIMIT 10",
    "micro_distinct": "SELECT count(DISTINCT l_partkey) AS n, count(DISTINCT l_returnflag) AS m FROM lineitem",
    "micro_join_small": "SELECT round(sum(l_extendedprice * s_acctbal), 0) AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "micro_join_large": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "micro_topn": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "micro_sort": "SELECT round(sum(x), 2) AS s, count(*) AS n FROM (SELECT l_extendedprice AS x FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber OFFSET 100) a",
    "micro_agg_1m": "SELECT count(*) AS n, round(sum(sv), 2) AS s FROM (SELECT l_orderkey, l_linenumber, sum(l_extendedprice) AS sv FROM lineitem GROUP BY l_orderkey, l_linenumber) q",
    "micro_join_1m": "SELECT round(sum(l_extendedprice * p_retailprice), 0) AS s FROM lineitem JOIN part ON l_partkey = p_partkey",
    "micro_distinct_str": "SELECT count(DISTINCT p_name) AS n, count(DISTINCT p_brand) AS m FROM part",
    # groups and joins after the usual database benchmark for data frames
    "h2o_g1": "SELECT l_returnflag, CAST(sum(l_linenumber) AS bigint) AS v1 FROM lineitem GROUP BY l_returnflag",
    "h2o_g2": "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS bigint) AS v1 FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "h2o_g3": "SELECT l_partkey, CAST(sum(l_linenumber) AS bigint) AS v1, round(avg(l_extendedprice), 4) AS v3 FROM lineitem GROUP BY l_partkey",
    "h2o_g4": "SELECT l_suppkey, round(avg(l_linenumber), 6) AS v1, round(avg(l_quantity), 6) AS v2, round(avg(l_extendedprice), 4) AS v3 FROM lineitem GROUP BY l_suppkey",
    "h2o_g5": "SELECT l_orderkey, CAST(sum(l_linenumber) AS bigint) AS v1, round(sum(l_quantity), 2) AS v2, round(sum(l_extendedprice), 2) AS v3 FROM lineitem GROUP BY l_orderkey",
    "h2o_g7": "SELECT l_partkey, max(l_quantity) - min(l_linenumber) AS v FROM lineitem GROUP BY l_partkey",
    "h2o_g10": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS v3, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus",
    "h2o_j1": "SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN nation ON l_linenumber = n_nationkey",
    "h2o_j2": "SELECT l_orderkey, l_linenumber, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "h2o_j3": "SELECT l_orderkey, l_linenumber, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25",
    "h2o_j4": "SELECT o_orderkey, c_name FROM orders JOIN (SELECT c_custkey, 'c' || c_custkey AS k, c_name FROM customer) c ON 'c' || o_custkey = c.k",
    "h2o_j5": "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    **TPCH,
}

#: Where DuckDB needs other words for the same: text of doubles, remainders by zero.
ORACLE: dict[str, str] = {
    "M03_modulo_integer": "SELECT l_orderkey, l_linenumber, l_partkey % 7 AS a, -l_partkey % 7 AS b, CASE WHEN l_linenumber <> 1 THEN l_partkey % (l_linenumber - 1) END AS by_zero FROM lineitem",
    "A01_group_by": "SELECT c_mktsegment, c_nationkey % 5 AS bucket, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey % 5",
    "D01_literal": "SELECT o_orderkey FROM orders WHERE o_orderdate = DATE '1997-06-15' OR o_orderdate = DATE '1998-01-05'",
}


def engine(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.attach(t, f"{sf_dir}/{t}.parquet", DATES)
    return e


def _made(e: Engine) -> None:
    e.query_all("CREATE TABLE made (k BIGINT NOT NULL, label VARCHAR, price DOUBLE, day DATE)")


def create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    _made(e)
    e.query_all("CREATE TABLE IF NOT EXISTS made (other INTEGER)")
    return e.query("SELECT count(*) AS n, max(k) AS k FROM made")


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    _made(e)
    e.query_all("DROP TABLE made; DROP TABLE IF EXISTS made; CREATE TABLE made (z INTEGER); INSERT INTO made VALUES (1)")
    return e.query("SELECT z FROM made")


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    _made(e)
    e.query_all("INSERT INTO made VALUES (1, 'one', 1.5, DATE '2020-01-01'), (2, NULL, 2, '2021-02-03'); INSERT INTO made (price, k) VALUES (0.1, 1 + 2)")
    return e.query("SELECT * FROM made")


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    _made(e)
    e.query_all("INSERT INTO made SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders; INSERT INTO made (k, price) SELECT -k, price * 2 FROM made WHERE price > 200000")
    return e.query("SELECT k, label, price, day FROM made")


def copy_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = engine(spark, sf_dir), shared_path(spark, "customer-csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.option("sep", "|").option("header", True).csv(path)
    e.query_all("CREATE TABLE loaded (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR)")
    e.query_all(f"COPY loaded FROM '{path}' (DELIMITER '|', HEADER)")
    return e.query("SELECT * FROM loaded")


_EXPLAINED = "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND c_nationkey < 12 GROUP BY c_mktsegment"


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the plan that EXPLAIN shows: how often it has an operator, and the filters that reach the scans."""
    text = engine(spark, sf_dir).query("EXPLAIN " + _EXPLAINED).first()[0]
    logical, _, physical = text.partition("== Physical Plan ==")
    facts = {"joins": len(re.findall(r"\bJoin ", logical)), "aggregates": len(re.findall(r"\bAggregate ", logical)), "scans": len(re.findall(r"FileScan parquet", physical)), "estimates": int("sizeInBytes" in logical)}
    facts |= {f"pushed {c}": int(bool(re.search(rf"PushedFilters: \[[^\]]*\({c},", physical))) for c in ("o_totalprice", "c_nationkey", "c_custkey")}
    return spark.createDataFrame(list(facts.items()), "fact string, n long")


def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What EXPLAIN ANALYZE measures: the rows of the result, of each filter, and whether estimates stand beside them."""
    text = engine(spark, sf_dir).query("EXPLAIN ANALYZE " + _EXPLAINED).first()[0]
    filters = sorted(int(n) for n in re.findall(r"Filter \([^\n]*number of output rows: (\d+)", text))
    rows = [("result", int(re.search(r"result rows: (\d+)", text)[1])), ("fewer filtered", filters[0]), ("more filtered", filters[-1]), ("estimates", int("estimated rows: " in text)), ("build rows", int("build rows: " in text or "ShuffledHashJoin" in text or "SortMergeJoin" in text))]
    return spark.createDataFrame(rows, "fact string, n long")


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    _made(e)
    e.query_all("INSERT INTO made SELECT n_nationkey, n_name, 1.0, NULL FROM nation; INSERT INTO made SELECT 100 + r_regionkey, r_name, NULL, NULL FROM region; CHECKPOINT; CHECKPOINT")
    return e.query("SELECT k, label, price FROM made")


def multi_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query_all("CREATE TABLE a (x BIGINT); INSERT INTO a SELECT n_nationkey FROM nation; SELECT x FROM a WHERE x > 3;")[-1]


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "database")
    first = Engine(spark, path).attach("part", f"{sf_dir}/part.parquet")
    first.query_all("CREATE TABLE kept (k BIGINT NOT NULL, brand VARCHAR); INSERT INTO kept SELECT p_partkey, p_brand FROM part")
    return Engine(spark, path).query("SELECT brand, count(*) AS n FROM kept GROUP BY brand")


def shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..__main__ import Shell

    out = io.StringIO()
    Shell(engine(spark, sf_dir), out).loop([".maxrows 100\n", ".tables\n", "SELECT n_nationkey, n_name, n_regionkey\n", "FROM nation ORDER BY 1;\n", ".schema region\n", ".quit\n", "SELECT 1;\n"])
    return spark.createDataFrame([(k, re.sub(r"\s+", " ", x).strip()) for k, x in enumerate(out.getvalue().splitlines())], "line int, text string")


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, least and greatest value exactly; of the estimated distinct values, whether they are within a tenth."""
    e = engine(spark, sf_dir)
    found = e.stats("customer")
    exact = e.tables.frame("customer")
    counts = exact.agg(*[F.count_distinct(c).alias(c) for c in exact.columns]).first().asDict()
    known = F.element_at(F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(n))]), F.col("column"))
    return found.select("column", "nulls", "least", "greatest", (F.abs(F.col("distinct") - known) * 10 <= known + 10).alias("distinct_fits"))


_STATS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest, true AS distinct_fits FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
_SHELL_SQL = """
    WITH shown AS (
        SELECT 1 AS part, row_number() OVER (ORDER BY t) AS k, t AS text FROM (VALUES ('customer'), ('lineitem'), ('nation'), ('orders'), ('part'), ('region'), ('supplier')) x(t)
        UNION ALL SELECT 2, 1, 'n_nationkey | n_name | n_regionkey' UNION ALL SELECT 2, 2, '-RULE-'
        UNION ALL SELECT 3, n_nationkey, n_nationkey || ' | ' || n_name || ' | ' || n_regionkey FROM nation
        UNION ALL SELECT 4, 1, '(' || count(*) || ' rows)' FROM nation UNION ALL SELECT 5, 1, 'region (r_regionkey int, r_name string)'
    )
    SELECT CAST(row_number() OVER (ORDER BY part, k) - 1 AS integer) AS line, CASE text WHEN '-RULE-' THEN '-------------+-' || repeat('-', (SELECT greatest(6, max(length(n_name))) FROM nation)) || '-+-------------' ELSE text END AS text FROM shown
"""
_EXPLAIN_SQL = "SELECT * FROM (VALUES ('joins', CAST(1 AS bigint)), ('aggregates', 1), ('scans', 2), ('estimates', 1), ('pushed o_totalprice', 1), ('pushed c_nationkey', 1), ('pushed c_custkey', 0)) x(fact, n)"
_ANALYZE_SQL = """
    WITH sizes AS (SELECT (SELECT count(*) FROM customer WHERE c_nationkey < 12) AS c, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS o)
    SELECT 'result' AS fact, count(DISTINCT c_mktsegment) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND c_nationkey < 12
    UNION ALL SELECT 'fewer filtered', least(c, o) FROM sizes UNION ALL SELECT 'more filtered', greatest(c, o) FROM sizes UNION ALL SELECT 'estimates', 1 UNION ALL SELECT 'build rows', 1
"""

STATEMENTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "S02_create_table": (create_table, "SELECT CAST(0 AS bigint) AS n, CAST(NULL AS bigint) AS k"),
    "S03_drop_table": (drop_table, "SELECT CAST(1 AS integer) AS z"),
    "S04_insert_values": (insert_values, "SELECT * FROM (VALUES (CAST(1 AS bigint), 'one', CAST(1.5 AS double), DATE '2020-01-01'), (2, NULL, 2, DATE '2021-02-03'), (3, NULL, 0.1, NULL)) AS made(k, label, price, day)"),
    "S05_insert_select": (insert_select, "SELECT o_orderkey AS k, o_orderpriority AS label, o_totalprice AS price, CAST(o_orderdate AS date) AS day FROM orders UNION ALL SELECT -o_orderkey, NULL, o_totalprice * 2, NULL FROM orders WHERE o_totalprice > 200000"),
    "S06_copy_from_csv": (copy_from_csv, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "S10_explain": (explain, _EXPLAIN_SQL),
    "S11_explain_analyze": (explain_analyze, _ANALYZE_SQL),
    "S12_checkpoint": (checkpoint, "SELECT CAST(n_nationkey AS bigint) AS k, n_name AS label, CAST(1 AS double) AS price FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, NULL FROM region"),
    "S13_multi_statement": (multi_statement, "SELECT CAST(n_nationkey AS bigint) AS x FROM nation WHERE n_nationkey > 3"),
    "S14_persistence": (persistence, "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand"),
    "S15_shell": (shell, _SHELL_SQL),
    "S16_table_stats": (table_stats, _STATS_SQL),
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = tuple(t for t in TABLES if t in sql)
    return lambda spark, sf_dir: engine(spark, sf_dir, tables).query(sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(q) for n, q in SQL.items()} | {n: f for n, (f, _) in STATEMENTS.items()}
ORACLES: dict[str, str] = {**SQL, **ORACLE, **{n: q for n, (_, q) in STATEMENTS.items() if q}}
