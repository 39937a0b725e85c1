"""Registered queries of the library's operators on the driver's tables, with their SQL.

Orders become observations: status is the source, priority the concept, the customer's nation the entity, the
order's year the year, its total price the value. Monthly sums by nation and priority are long series.
Every query runs over whole tables. Floats are rounded to six places, arrays are joined to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.windows import first_by, islands, nearest
from tessera.operators import core, experiments, forecast, marts, quality
from tessera.params import CoreParams, MartParams
from tessera.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PARAMS = CoreParams(year_min=1996, year_max=2000, dependence_min_shared=30, dependence_min_share=0.05, dependence_tolerance=0.25, conflict_tolerance=0.10)
MART_PARAMS = MartParams(year_min=1995, year_max=2001, trend_start=1995, trend_min_points=4, trend_min_span=4, ref_year=2000, base_year=1996, tolerance=1, change_min_span=3, min_countries=10)


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            # Components are reached by a recursive part.
            ORACLES[name] = sql.replace("WITH ", "WITH RECURSIVE ", 1) if "reach AS" in sql else sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column) -> F.Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All floating columns rounded."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations. Prices ending in .x1 lose their value; every 7th order is said twice over."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(nations.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderpriority").alias("concept"),
        F.col("n_name").alias("country"),
        F.col("n_regionkey").alias("region"),
        F.year("o_orderdate").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period_text"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("value"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderkey").alias("row_num"),
    )


OBS = """obs AS (
  SELECT o_orderstatus AS source, o_orderpriority AS concept, n_name AS country, n_regionkey AS region, CAST(year(o_orderdate) AS INTEGER) AS year,
         strftime(o_orderdate, '%Y-%m') AS period_text, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS value, c_mktsegment AS segment, o_orderkey AS row_num
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# Fixed to the sources of the observations, the best first.
SOURCES = (("F", 1), ("O", 2), ("P", 3))
SOURCES_SQL = "sources(source, priority) AS (VALUES ('F', 1), ('O', 2), ('P', 3))"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source string, priority int")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selected row for each source and cell: the latest period, then the smallest row number."""
    rows = obs(spark, sf_dir).where("value is not null").withColumn("is_headline", F.col("segment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"))
    return core.select_headline(rows, ("source", "country", "concept", "year"), order=[F.col("period_text").desc_nulls_first(), F.col("row_num")])


CHOSEN = f"""{OBS}, flagged AS (SELECT *, segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS is_headline FROM obs WHERE value IS NOT NULL),
chosen AS (SELECT *, CAST(count(*) FILTER (WHERE is_headline) OVER w AS BIGINT) AS n_candidates,
             is_headline AND row_number() OVER (PARTITION BY source, country, concept, year ORDER BY CASE WHEN is_headline THEN 0 ELSE 1 END, period_text DESC NULLS FIRST, row_num) = 1 AS is_selected
           FROM flagged WINDOW w AS (PARTITION BY source, country, concept, year)),
selected AS (SELECT * FROM chosen WHERE is_selected)"""


@register("headline_selection", f"WITH {CHOSEN} SELECT row_num, is_headline, n_candidates, is_selected, CASE WHEN NOT is_headline THEN NULL WHEN n_candidates = 1 THEN 'single_candidate' ELSE 'source_priority_then_latest_period' END AS selection_rule FROM chosen")
def headline_selection(spark, sf_dir):
    return chosen(spark, sf_dir).select("row_num", "is_headline", "n_candidates", "is_selected", "selection_rule")


@register("standardize_union", "SELECT kind, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) + 0.0 AS total, CAST(count(period_text) AS BIGINT) AS n_period FROM (SELECT 'order' AS kind, o_totalprice AS value, CAST(o_orderdate AS VARCHAR) AS period_text FROM orders UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier UNION ALL SELECT 'customer', c_acctbal, NULL FROM customer) t GROUP BY kind")
def standardize_union(spark, sf_dir):
    none = F.lit(None).cast("string").alias("period_text")
    parts = [
        table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("string").alias("period_text")),
        table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("value"), none),
        table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("value"), none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 2) + 0.0).alias("total"), F.count("period_text").alias("n_period"))


@register(
    "cascade_lookup",
    """WITH places AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) || ' ' WHEN 2 THEN 'k' || n_nationkey WHEN 3 THEN 'The ' || replace(n_name, '_', ' ') ELSE 'nowhere' END AS place
               FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT p.c_custkey, coalesce(a.n_name, b.n_name, c.n_name, d.n_name) AS country,
       CASE WHEN a.n_name IS NOT NULL THEN 'exact' WHEN b.n_name IS NOT NULL THEN 'normalized' WHEN c.n_name IS NOT NULL THEN 'iso2' WHEN d.n_name IS NOT NULL THEN 'alias' END AS country_resolution
FROM places p LEFT JOIN nation a ON a.n_name = p.place LEFT JOIN nation b ON b.n_name = upper(trim(p.place))
LEFT JOIN nation c ON 'K' || c.n_nationkey = upper(trim(p.place)) LEFT JOIN nation d ON 'the' || regexp_replace(lower(d.n_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(p.place), '[^a-z0-9]', '', 'g')""",
)
def cascade_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    countries = nations.select(F.col("n_name").alias("iso3"), F.concat(F.lit("K"), F.col("n_nationkey")).alias("iso2"), F.col("n_name").alias("name"))
    aliases = nations.select(F.concat(F.lit("The "), F.col("n_name")).alias("alias"), F.col("n_name").alias("iso3"), F.lit("variant").alias("alias_type"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.col("c_custkey") % 5
    place = F.when(at == 0, F.col("n_name")).when(at == 1, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).when(at == 2, F.concat(F.lit("k"), F.col("n_nationkey"))).when(at == 3, F.concat(F.lit("The "), F.replace("n_name", F.lit("_"), F.lit(" ")))).otherwise("nowhere")
    found = core.resolve_country(rows.select("c_custkey", place.alias("place")), core.country_keys(countries, aliases))
    return found.select("c_custkey", "country", "country_resolution")


_DEFECTS = """seeded AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS country, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INTEGER) END AS year,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS value, CASE WHEN l_partkey % 14 = 0 THEN 'n/a' END AS value_text, l_suppkey % 19 = 0 AS unexpected_dim,
         CASE WHEN l_linestatus = 'O' AND l_suppkey % 23 = 0 THEN NULL ELSE 'total' END AS sex FROM lineitem)"""


def _defects(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        F.when(c("l_orderkey") % 13 != 0, c("l_returnflag")).alias("country"), F.when(c("l_orderkey") % 17 != 0, F.year("l_shipdate")).alias("year"),
        F.when(c("l_partkey") % 7 != 0, c("l_quantity")).alias("value"), F.when(c("l_partkey") % 14 == 0, "n/a").alias("value_text"),
        F.lit(2.0).alias("valid_min"), F.lit(45.0).alias("valid_max"), (c("l_suppkey") % 19 == 0).alias("unexpected_dim"),
        F.when(~((c("l_linestatus") == "O") & (c("l_suppkey") % 23 == 0)), "total").alias("sex"), F.lit("total").alias("wealth_quintile"), F.lit("total").alias("residence"),
    )


_REASON = """CASE WHEN country IS NULL THEN 'unknown_country' WHEN year IS NULL OR year < 1996 OR year > 2000 THEN 'invalid_year' WHEN value IS NULL AND value_text IS NOT NULL THEN 'unparseable_value'
  WHEN value IS NULL THEN 'no_value' WHEN value < 2 OR value > 45 THEN 'out_of_range' WHEN unexpected_dim OR sex IS NULL THEN 'unmapped_vocabulary' END"""


@register("reject_reasons", f"WITH {_DEFECTS}, r AS (SELECT {_REASON} AS reason FROM seeded) SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL")
def reject_reasons(spark, sf_dir):
    return _defects(spark, sf_dir).select(F.coalesce(core.reject_reason(1996, 2000), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "exact_duplicates",
    f"""WITH {_DEFECTS}, r AS (SELECT *, {_REASON} AS reason FROM seeded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM r WHERE reason IS NULL)
SELECT coalesce(reason, 'kept') AS reject_reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN k > 1 THEN 'exact_duplicate' END AS reason FROM ranked UNION ALL SELECT reason FROM r WHERE reason IS NOT NULL) GROUP BY ALL""",
)
def exact_duplicates(spark, sf_dir):
    reasoned = _defects(spark, sf_dir).withColumn("reason", core.reject_reason(1996, 2000))
    marked = core.mark_duplicates(reasoned, ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return marked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("n"))


@register("duplicate_documents", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS INTEGER) AS dup_rank FROM documents")
def duplicate_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang", "source", F.lit(None).cast("string").alias("reason"))
    return core.mark_duplicates(rows, ("h", "lang", "source"), ("doc_id",)).select("doc_id", "dup_rank")


@register(
    "vocab_crosswalk",
    """WITH v(source, code, canonical) AS (VALUES ('F', 'BUILDING', 'total'), ('F', 'MACHINERY', 'male'), ('O', 'BUILDING', 'total'), ('P', 'AUTOMOBILE', 'female'))
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'total' ELSE canonical END AS sex FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN v ON v.source = o_orderstatus AND v.code = c_mktsegment""",
)
def vocab_crosswalk(spark, sf_dir):
    vocabulary = spark.createDataFrame([("sex", "F", "BUILDING", "total"), ("sex", "F", "MACHINERY", "male"), ("sex", "O", "BUILDING", "total"), ("sex", "P", "AUTOMOBILE", "female"), ("residence", "F", "BUILDING", "urban")], "dimension string, source string, source_value string, canonical string")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    coded = rows.select("o_orderkey", F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderkey") % 9 != 0, F.col("c_mktsegment")).alias("sex_raw"))
    return core.crosswalk(coded, vocabulary, "sex", "sex_raw", "sex").select("o_orderkey", "sex")


@register(
    "row_flags",
    """SELECT flags, CAST(count(*) AS BIGINT) AS n FROM (SELECT concat_ws(',', CASE WHEN low IS NOT NULL AND high IS NOT NULL AND (l_quantity < low OR l_quantity > high) THEN 'bounds_violation' END, CASE WHEN NOT regexp_matches(period, '^[0-9]{4}$') THEN 'noncanonical_period' END) AS flags
FROM (SELECT l_quantity, CASE WHEN l_suppkey % 5 <> 0 THEN 5.0 + l_linenumber END AS low, CASE WHEN l_partkey % 6 <> 0 THEN 40.0 END AS high, CASE WHEN l_orderkey % 8 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%Y') END AS period FROM lineitem) t) GROUP BY ALL""",
)
def row_flags(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        "l_quantity", F.when(c("l_suppkey") % 5 != 0, 5.0 + c("l_linenumber")).alias("low"), F.when(c("l_partkey") % 6 != 0, 40.0).alias("high"),
        F.when(c("l_orderkey") % 8 == 0, F.lit(None)).when(c("l_orderkey") % 3 == 0, F.date_format("l_shipdate", "yyyy-MM")).otherwise(F.date_format("l_shipdate", "yyyy")).alias("period"),
    )
    return rows.select(F.array_join(core.row_flags("l_quantity", "low", "high", "period"), ",").alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


# --- monthly series ----------------------------------------------------------------------------------------


def series(spark, sf_dir) -> DataFrame:
    """Monthly mean price by nation and priority; month counts from year 0."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("iso3"), F.col("o_orderpriority").alias("concept"), month.alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


SERIES = """series AS (SELECT c_nationkey AS iso3, o_orderpriority AS concept, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@register(
    "temporal_outlier",
    f"""WITH {SERIES}, n AS (SELECT *, [x FOR x IN [lag(value, 2) OVER w, lag(value) OVER w, lead(value) OVER w, lead(value, 2) OVER w] IF x IS NOT NULL] AS a FROM series WINDOW w AS (PARTITION BY iso3, concept ORDER BY year)),
m AS (SELECT *, list_median(a) AS med FROM n), d AS (SELECT *, list_median([abs(x - med) FOR x IN a]) AS mad FROM m)
SELECT iso3, concept, year, len(a) >= 3 AND abs(value - med) > greatest(3.5 * 1.4826 * mad, 0.2 * abs(med), 0.1) AS outlier FROM d""",
)
def temporal_outlier(spark, sf_dir):
    return core.temporal_outliers(series(spark, sf_dir), ("iso3", "concept")).select("iso3", "concept", "year", "outlier")


@register(
    "flat_runs",
    """WITH daily AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, CAST(least(count(*), 2) AS DOUBLE) + 0.05 AS value FROM events GROUP BY ALL),
b AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 AND value = lag(value) OVER w THEN 0 ELSE 1 END AS brk FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY day) AS run FROM b)
SELECT user_id, day, count(*) OVER (PARTITION BY user_id, run) >= 4 AS flat_run FROM i""",
)
def flat_runs(spark, sf_dir):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    daily = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg((F.least(F.count("*"), F.lit(2)).cast("double") + 0.05).alias("value"))
    return core.flat_runs(daily, ("user_id",), order="day").select("user_id", "day", "flat_run")


@register(
    "activity_islands",
    """WITH d AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, g""",
)
def activity_islands(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day")).distinct()
    return days.withColumn("g", islands(["user_id"], "day")).groupBy("user_id", "g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).drop("g")


# --- dependence, reconciliation, marts ------------------------------------------------------------------------


class Layer:
    """Core frames of the observations; the selected rows and the reconciled cells are read by several steps."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.selected = cut(chosen(spark, sf_dir).where("is_selected").select("source", "country", "region", "concept", "year", "value", "period_text", "row_num"))
        found = core.source_dependence(self.selected, sources(spark), PARAMS)
        self.dependence = found.withColumn("dependent", F.col("dependent") & (F.col("concept") != "1-URGENT"))  # so that there are single groups too
        self.groups = core.evidence_groups(self.selected, self.dependence)
        self.reconciled = core.reconcile(self.selected, self.groups, sources(spark), PARAMS)
        self.fact = self.selected.withColumns({"is_headline": F.lit(True), "is_selected": F.lit(True), "quality_flags": F.array().cast("array<string>"), "source_file": F.col("source")})

    @property
    def panel(self) -> DataFrame:
        return marts.panel(self.reconciled, self.fact)

    @property
    def pool(self) -> DataFrame:
        return experiments.build_pool(self.fact, self.groups, self.reconciled)


_DEPENDENCE = f"""{CHOSEN}, {SOURCES_SQL},
pairs AS (SELECT a.concept, a.source AS source_a, b.source AS source_b, a.value AS va, b.value AS vb FROM selected a JOIN sources sa ON sa.source = a.source JOIN selected b USING (concept, country, year) JOIN sources sb ON sb.source = b.source WHERE sb.priority > sa.priority),
dep AS (SELECT concept, source_a, source_b, CAST(count(*) AS BIGINT) AS n_shared, CAST(count(*) FILTER (WHERE abs(va - vb) <= 0.25 * greatest(abs(va), abs(vb))) AS BIGINT) AS n_within,
          quantile_cont(CASE WHEN greatest(abs(va), abs(vb)) = 0 THEN 0 ELSE abs(va - vb) / greatest(abs(va), abs(vb)) END, 0.5) AS median_rel_diff FROM pairs GROUP BY ALL),
dependence AS (SELECT *, n_within / n_shared AS share_within, n_shared >= 30 AND n_within / n_shared >= 0.05 AND concept <> '1-URGENT' AS dependent FROM dep)"""


@register("source_dependence", f"WITH {_DEPENDENCE} SELECT concept, source_a, source_b, n_shared, n_within, round(median_rel_diff, 6) + 0.0 AS median_rel_diff, round(share_within, 6) + 0.0 AS share_within, dependent FROM dependence")
def source_dependence(spark, sf_dir):
    return rounded(Layer(spark, sf_dir).dependence)


_GROUPS = f"""{_DEPENDENCE}, nodes AS (SELECT DISTINCT concept, source FROM selected),
edges AS (SELECT concept, source_a AS x, source_b AS y FROM dependence WHERE dependent UNION ALL SELECT concept, source_b, source_a FROM dependence WHERE dependent),
e2 AS (SELECT concept, source AS x, source AS y FROM nodes UNION SELECT * FROM edges),
reach AS (SELECT concept, x, y FROM e2 UNION SELECT r.concept, r.x, e.y FROM reach r JOIN e2 e ON e.concept = r.concept AND e.x = r.y),
groups AS (SELECT concept, x AS source, string_agg(y, '+' ORDER BY y) AS group_label, CAST(count(*) AS BIGINT) AS n_members FROM reach GROUP BY concept, x)"""


@register("evidence_groups", f"WITH {_GROUPS} SELECT concept, source, group_label, n_members FROM groups")
def evidence_groups(spark, sf_dir):
    return Layer(spark, sf_dir).groups.select("concept", "source", "group_label", "n_members")


_RECONCILED = f"""{_GROUPS}, cand AS (SELECT s.country, s.concept, s.year, s.source, p.priority, s.value, g.group_label FROM selected s JOIN sources p ON p.source = s.source JOIN groups g ON g.concept = s.concept AND g.source = s.source),
grp AS (SELECT country, concept, year, group_label, count(*) AS n, min(priority) AS priority, arg_min(value, priority) AS value, arg_min(source, priority) AS source, CASE WHEN count(*) > 1 AND avg(value) <> 0 THEN (max(value) - min(value)) / abs(avg(value)) ELSE 0 END AS inner_spread FROM cand GROUP BY ALL),
cell AS (SELECT country, concept, year, CAST(sum(n) AS BIGINT) AS n_sources, CAST(count(*) AS BIGINT) AS n_evidence_groups, arg_min(value, priority) AS reconciled_value, arg_min(source, priority) AS reconciled_source,
  CASE WHEN count(*) > 1 THEN max(value) - min(value) END AS spread_abs, CASE WHEN count(*) > 1 AND avg(value) <> 0 THEN (max(value) - min(value)) / abs(avg(value)) END AS spread_rel, max(inner_spread) AS inner_spread FROM grp GROUP BY country, concept, year),
reconciled AS (SELECT *, coalesce(spread_rel > 0.10, false) AS conflict, inner_spread > 0.05 AS within_group_disagreement FROM cell)"""


@register("reconcile", f"WITH {_RECONCILED} SELECT country, concept, year, n_sources, n_evidence_groups, round(reconciled_value, 6) + 0.0 AS reconciled_value, reconciled_source, round(spread_abs, 6) + 0.0 AS spread_abs, round(spread_rel, 6) + 0.0 AS spread_rel, conflict, round(inner_spread, 6) + 0.0 AS max_within_group_spread_rel, within_group_disagreement, group_values FROM reconciled JOIN (SELECT country, concept, year, string_agg(group_label || '=' || CAST(round(value * 100) AS BIGINT), ',' ORDER BY group_label) AS group_values FROM grp GROUP BY country, concept, year) v USING (country, concept, year)")
def reconcile(spark, sf_dir):
    cents = F.transform(F.map_entries("group_values"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 100).cast("bigint").cast("string")))
    return rounded(Layer(spark, sf_dir).reconciled.withColumn("group_values", F.array_join(cents, ",")))


_PANEL = f"""{_RECONCILED}, panel AS (SELECT country, concept, year, reconciled_value AS value, reconciled_source, n_sources, n_evidence_groups,
  CASE WHEN conflict THEN 'conflict' WHEN n_evidence_groups > 1 THEN 'cross_validated' ELSE 'single_evidence_group' END AS quality_tier, false AS outlier_flag, within_group_disagreement AS source_disagreement, false AS flat_run FROM reconciled)"""


@register("panel", f"WITH {_PANEL} SELECT country, concept, year, round(value, 6) + 0.0 AS value, reconciled_source, n_sources, n_evidence_groups, quality_tier, outlier_flag, source_disagreement, flat_run FROM panel")
def panel(spark, sf_dir):
    return rounded(Layer(spark, sf_dir).panel)


@register(
    "country_latest",
    f"WITH {_PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY country, concept ORDER BY year DESC) AS rn, count(*) OVER (PARTITION BY country, concept) AS n, min(year) OVER (PARTITION BY country, concept) AS f, max(year) OVER (PARTITION BY concept) AS l FROM panel) SELECT country, concept, year AS latest_year, round(value, 6) + 0.0 AS value, quality_tier, f AS first_year, CAST(n AS BIGINT) AS n_observations, l - year AS years_behind FROM r WHERE rn = 1",
)
def country_latest(spark, sf_dir):
    return rounded(marts.latest(Layer(spark, sf_dir).panel))


@register(
    "trend",
    f"""WITH {_PANEL} SELECT country, concept, min(year) AS window_start, max(year) AS window_end, CAST(count(*) AS BIGINT) AS n_points, round(arg_min(value, year), 6) + 0.0 AS value_start, round(arg_max(value, year), 6) + 0.0 AS value_end,
  round(arg_max(value, year) - arg_min(value, year), 6) + 0.0 AS absolute_change, round(regr_slope(value, year), 6) + 0.0 AS linear_slope_per_year, round(regr_r2(value, year), 6) + 0.0 AS linear_r2, round(CASE WHEN min(value) > 0 THEN exp(regr_slope(ln(CASE WHEN value > 0 THEN value END), year)) - 1 END, 6) + 0.0 AS annual_pct_change
  FROM panel WHERE year >= 1995 GROUP BY country, concept HAVING count(*) >= 4 AND max(year) - min(year) >= 4""",
)
def trend(spark, sf_dir):
    return rounded(marts.trend(Layer(spark, sf_dir).panel, params=MART_PARAMS))


@register(
    "region_year",
    f"""WITH {_PANEL}, m AS (SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n_possible FROM nation GROUP BY ALL)
SELECT n.n_regionkey AS region, p.concept, p.year, CAST(count(*) AS BIGINT) AS n_countries, m.n_possible, round(avg(value), 6) + 0.0 AS mean_value, round(quantile_cont(value, 0.5), 6) + 0.0 AS median_value, round(min(value), 6) + 0.0 AS min_value, round(max(value), 6) + 0.0 AS max_value,
  round(quantile_cont(value, 0.25), 6) + 0.0 AS p25_value, round(quantile_cont(value, 0.75), 6) + 0.0 AS p75_value, round(count(*) / m.n_possible, 6) + 0.0 AS coverage_share FROM panel p JOIN nation n ON n.n_name = p.country JOIN m ON m.region = n.n_regionkey GROUP BY n.n_regionkey, p.concept, p.year, m.n_possible""",
)
def region_year(spark, sf_dir):
    members = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))
    return rounded(marts.region_year(Layer(spark, sf_dir).panel, members, region="region"))


def _association_sql(values: str, basis: str) -> str:
    return f"""WITH {_PANEL}, solid AS (SELECT * FROM panel WHERE quality_tier <> 'conflict'), {values},
sides AS (SELECT a.concept AS a, b.concept AS b, a.value AS va, b.value AS vb FROM vals a JOIN vals b ON a.country = b.country AND a.concept < b.concept),
placed AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0::DOUBLE AS rb FROM sides),
agg AS (SELECT a, b, count(*) AS n, corr(ra, rb) AS rho, corr(va, vb) AS r FROM placed GROUP BY a, b HAVING count(*) >= 10)
SELECT a AS indicator_a, b AS indicator_b, CAST(n AS BIGINT) AS n_countries, round(rho, 6) + 0.0 AS spearman_rho, round(r, 6) + 0.0 AS pearson_r,
  round(CASE WHEN n > 3 AND abs(rho) < 1 THEN tanh(atanh(rho) - 1.96::DOUBLE / sqrt(n - 3)) END, 6) + 0.0 AS rho_ci_low, round(CASE WHEN n > 3 AND abs(rho) < 1 THEN tanh(atanh(rho) + 1.96::DOUBLE / sqrt(n - 3)) END, 6) + 0.0 AS rho_ci_high FROM agg"""


_NEAR = lambda name, ref: f"{name} AS (SELECT country, concept, value, year FROM (SELECT *, row_number() OVER (PARTITION BY country, concept ORDER BY abs(year - {ref}), year) AS rn FROM solid WHERE abs(year - {ref}) <= 1) t WHERE rn = 1)"


def _association(spark, sf_dir, values):
    p = Layer(spark, sf_dir).panel
    return rounded(marts.rank_association(values(p, MART_PARAMS).withColumn("ordinal", F.col("concept")), "country", "ordinal", "concept", "value", 10))


@register("association_level", _association_sql(_NEAR("vals", 2000), "level"))
def association_level(spark, sf_dir):
    return _association(spark, sf_dir, marts.level_values)


@register("association_change", _association_sql(_NEAR("e", 2000) + ", " + _NEAR("s", 1996) + ", vals AS (SELECT e.country, e.concept, e.value - s.value AS value FROM e JOIN s ON s.country = e.country AND s.concept = e.concept WHERE e.year - s.year >= 3)", "change"))
def association_change(spark, sf_dir):
    return _association(spark, sf_dir, marts.change_values)


@register(
    "equity_gap",
    f"""WITH {OBS}, {SOURCES_SQL}, g AS (SELECT source, concept, country, year, period_text, max(value) FILTER (WHERE segment = 'BUILDING') AS va, max(value) FILTER (WHERE segment = 'MACHINERY') AS vb FROM obs WHERE value IS NOT NULL AND segment IN ('BUILDING', 'MACHINERY')
  GROUP BY ALL HAVING count(*) FILTER (WHERE segment = 'BUILDING') = 1 AND count(*) FILTER (WHERE segment = 'MACHINERY') = 1),
c AS (SELECT g.*, row_number() OVER (PARTITION BY country, concept, year ORDER BY priority, period_text DESC NULLS LAST) AS rn, count(*) OVER (PARTITION BY country, concept, year) AS n FROM g JOIN sources USING (source))
SELECT country, concept, year, source, period_text, round(va, 6) + 0.0 AS value_a, round(vb, 6) + 0.0 AS value_b, round(va / nullif(vb, 0), 6) + 0.0 AS ratio, round(va - vb, 6) + 0.0 AS difference, CAST(n AS BIGINT) AS n_candidate_pairs FROM c WHERE rn = 1""",
)
def equity_gap(spark, sf_dir):
    rows = obs(spark, sf_dir).where("value is not null").join(sources(spark), "source")
    pairs = marts.paired_gaps(rows, "segment", "segment", ("building", "BUILDING"), ("machinery", "MACHINERY"), ("source", "priority", "concept", "country", "year", "period_text"))
    keys = ["country", "concept", "year"]
    counted = pairs.join(pairs.groupBy(*keys).agg(F.count("*").alias("n_candidate_pairs")), keys)
    best = first_by(counted, keys, [F.col("priority"), F.col("period_text").desc_nulls_last()])
    return rounded(best.select(*keys, "source", "period_text", "value_a", "value_b", scalars.ratio(F.col("value_a"), F.col("value_b")).alias("ratio"), (F.col("value_a") - F.col("value_b")).alias("difference"), "n_candidate_pairs"))


@register(
    "data_trust",
    f"""WITH {_PANEL} SELECT concept, CAST(count(*) AS BIGINT) AS n_values, CAST(count(DISTINCT country) AS BIGINT) AS n_countries, min(year) AS year_min, max(year) AS year_max, round(count(*)::DOUBLE / (25 * 7), 6) + 0.0 AS grid_coverage, round(avg((quality_tier = 'cross_validated')::INT), 6) + 0.0 AS share_cross_validated,
  round(avg((quality_tier = 'single_evidence_group')::INT), 6) + 0.0 AS share_single_evidence, round(avg((quality_tier = 'conflict')::INT), 6) + 0.0 AS share_conflict, 0.0::DOUBLE AS share_outlier_flag, round(avg(source_disagreement::INT), 6) + 0.0 AS share_source_disagreement, 0.0::DOUBLE AS share_flat_run FROM panel GROUP BY concept""",
)
def data_trust(spark, sf_dir):
    return rounded(marts.data_trust(Layer(spark, sf_dir).panel, 25, MART_PARAMS))


# --- data quality -------------------------------------------------------------------------------------------


def quality_obs(spark, sf_dir) -> DataFrame:
    """Observations with the columns of the quality engine; the statuses stand for the three sources."""
    rows = obs(spark, sf_dir)
    c = F.col
    name = F.when(c("source") == "F", "who").when(c("source") == "O", "unicef").otherwise("worldbank")
    return rows.select(
        name.alias("source"), "concept", F.when(c("row_num") % 29 != 0, c("country")).alias("iso3"), F.when(c("row_num") % 10 == 0, c("year").cast("string")).otherwise(c("period_text")).alias("period_text"),
        F.when(c("row_num") % 31 != 0, c("year")).alias("year"), "value", F.when(c("row_num") % 22 != 0, F.lit("x")).alias("value_text"), F.when(c("row_num") % 2 == 0, F.lit(1000.0)).alias("low"), F.when(c("row_num") % 3 != 0, F.lit(400000.0)).alias("high"), c("segment").alias("dim_key"),
    )


_QOBS = f"""{OBS}, q AS (SELECT CASE source WHEN 'F' THEN 'who' WHEN 'O' THEN 'unicef' ELSE 'worldbank' END AS source, concept, CASE WHEN row_num % 29 <> 0 THEN country END AS iso3, CASE WHEN row_num % 10 = 0 THEN CAST(year AS VARCHAR) ELSE period_text END AS period_text,
  CASE WHEN row_num % 31 <> 0 THEN year END AS year, value, CASE WHEN row_num % 22 <> 0 THEN 'x' END AS value_text, CASE WHEN row_num % 2 = 0 THEN 1000.0::DOUBLE END AS low, CASE WHEN row_num % 3 <> 0 THEN 400000.0::DOUBLE END AS high, segment AS dim_key FROM obs)"""
_NATIONS = [f"NATION_{i}" for i in range(20)]
_IN = "iso3 IN (" + ", ".join(f"'{n}'" for n in _NATIONS) + ")"
_BAD = {
    "missing_rate": ("completeness", "value IS NULL"),
    "unparseable_rate": ("validity", "value IS NULL AND value_text IS NOT NULL"),
    "out_of_range_rate": ("validity", "value IS NOT NULL AND (value < 2000 OR value > 450000)"),
    "bounds_violation_rate": ("validity", "value IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL AND (value < low OR value > high)"),
    "invalid_year_rate": ("validity", "year IS NULL OR year < 1996 OR year > 2000"),
    "invalid_country_rate": ("validity", f"iso3 IS NULL OR NOT ({_IN})"),
    "noncanonical_period_rate": ("consistency", "period_text IS NULL OR NOT regexp_matches(period_text, '^[0-9]{4}$')"),
}
_BAD["invalid_row_rate"] = ("validity", " OR ".join(f"({_BAD[m][1]})" for m in ("unparseable_rate", "out_of_range_rate", "bounds_violation_rate", "invalid_year_rate", "invalid_country_rate")))
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {m}" for m, (_, c) in _BAD.items())
_ROW_LEVEL = f"""{_QOBS}, a AS (SELECT source, concept, count(*) AS n, {_COUNTS}, count(*) - count(DISTINCT (iso3, period_text, dim_key, value_text)) AS exact_duplicate_rate, count(DISTINCT iso3) AS countries FROM q GROUP BY source, concept),
row_level AS ({" UNION ALL ".join([f"SELECT source, concept, '{d}' AS dimension, '{m}' AS metric, {m} / n AS value, CAST({m} AS BIGINT) AS numerator, CAST(n AS BIGINT) AS denominator FROM a" for m, d in [*((m, d) for m, (d, _) in _BAD.items()), ("exact_duplicate_rate", "uniqueness")]])}
  UNION ALL SELECT source, concept, 'completeness', 'records_received', n, n, NULL FROM a UNION ALL SELECT source, concept, 'completeness', 'countries_present', countries, NULL, NULL FROM a)"""


def _ranges(spark, sf_dir):
    return quality_obs(spark, sf_dir).select("concept").distinct().withColumns({"lo": F.lit(2000.0), "hi": F.lit(450000.0)})


def _row_level(spark, sf_dir):
    return quality.row_level(quality_obs(spark, sf_dir), _ranges(spark, sf_dir), _NATIONS, (1996, 2000))


@register("dq_row_level", f"WITH {_ROW_LEVEL} SELECT source, concept, dimension, metric, round(value, 6) + 0.0 AS value, numerator, denominator FROM row_level")
def dq_row_level(spark, sf_dir):
    return rounded(_row_level(spark, sf_dir).drop("scope", "details"))


_GRAIN = f"""g AS (SELECT source, concept, iso3, year, count(*) AS c FROM q WHERE year IS NOT NULL AND iso3 IS NOT NULL GROUP BY ALL), n AS (SELECT source, concept, count(*) AS n, count(DISTINCT (iso3, year)) FILTER (WHERE value IS NOT NULL AND year BETWEEN 1996 AND 2000 AND {_IN}) AS cells FROM q GROUP BY ALL),
h AS (SELECT source, concept, count(*) AS cells, count(*) FILTER (WHERE c > 1) AS amb, coalesce(sum(c) FILTER (WHERE c > 1), 0) AS amb_rows FROM g GROUP BY ALL),
grain AS (SELECT source, concept, 'completeness' AS dimension, 'grid_coverage' AS metric, cells / 100.0::DOUBLE AS value, CAST(cells AS BIGINT) AS numerator, CAST(100 AS BIGINT) AS denominator FROM n
  UNION ALL SELECT h.source, h.concept, 'uniqueness', 'grain_ambiguity_rate', amb_rows / n.n, CAST(amb_rows AS BIGINT), n.n FROM h JOIN n USING (source, concept) UNION ALL SELECT source, concept, 'uniqueness', 'ambiguous_cell_rate', amb / cells, amb, cells FROM h)"""


def _grain(spark, sf_dir):
    return quality.coverage_and_grain(quality_obs(spark, sf_dir), _NATIONS, (1996, 2000))


@register("dq_coverage_and_grain", f"WITH {_QOBS}, {_GRAIN} SELECT source, concept, dimension, metric, round(value, 6) + 0.0 AS value, CAST(numerator AS BIGINT) AS numerator, CAST(denominator AS BIGINT) AS denominator FROM grain")
def dq_coverage_and_grain(spark, sf_dir):
    return rounded(_grain(spark, sf_dir).drop("scope", "details"))


@register(
    "dq_fanout",
    f"""WITH {_QOBS}, s AS (SELECT concept, source, iso3, year, count(*) AS c FROM q WHERE year IS NOT NULL AND iso3 IS NOT NULL GROUP BY ALL), v AS (SELECT concept, count(DISTINCT (iso3, year)) AS any_cells FROM q WHERE value IS NOT NULL AND year IS NOT NULL GROUP BY ALL)
SELECT w.concept, CAST(count(*) AS BIGINT) AS shared_cells, CAST(sum(w.c * b.c * u.c) AS BIGINT) AS naive_rows, CAST(any_value(v.any_cells) AS BIGINT) AS any_cells FROM s w JOIN s b USING (concept, iso3, year) JOIN s u USING (concept, iso3, year) JOIN v USING (concept) WHERE w.source = 'who' AND b.source = 'worldbank' AND u.source = 'unicef' GROUP BY w.concept""",
)
def dq_fanout(spark, sf_dir):
    return quality.naive_fanout(quality_obs(spark, sf_dir))


@register(
    "dq_conflicts",
    f"""WITH {_QOBS} SELECT w.concept, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE greatest(w.value, b.value, u.value) - least(w.value, b.value, u.value) > 0.10 * (w.value + b.value + u.value) / 3.0) AS BIGINT) AS conflicting
FROM q w JOIN q b USING (concept, iso3, year) JOIN q u USING (concept, iso3, year) WHERE w.source = 'who' AND b.source = 'worldbank' AND u.source = 'unicef' AND w.value IS NOT NULL AND b.value IS NOT NULL AND u.value IS NOT NULL GROUP BY w.concept""",
)
def dq_conflicts(spark, sf_dir):
    return quality.naive_conflicts(quality_obs(spark, sf_dir))


@register(
    "dq_scores",
    f"""WITH {_ROW_LEVEL}, {_GRAIN}, base AS (SELECT source, concept, dimension, numerator AS num, denominator AS den FROM (SELECT * FROM row_level UNION ALL SELECT * FROM grain) WHERE metric IN ('missing_rate', 'invalid_row_rate', 'grain_ambiguity_rate', 'noncanonical_period_rate')),
p AS (SELECT CASE WHEN grouping(source) = 1 THEN 'overall' WHEN grouping(concept) = 1 THEN 'source' ELSE 'series' END AS scope, coalesce(source, '') AS source, coalesce(concept, '') AS concept, dimension, 1 - sum(num) / sum(den) AS score FROM base GROUP BY GROUPING SETS ((source, concept, dimension), (source, dimension), (dimension)))
SELECT scope, source, concept, dimension AS metric, round(score, 6) + 0.0 AS value FROM p UNION ALL SELECT scope, source, concept, 'composite', round(sum(score) / 4, 6) + 0.0 FROM p GROUP BY ALL HAVING count(*) = 4""",
)
def dq_scores(spark, sf_dir):
    metrics = _row_level(spark, sf_dir).unionByName(_grain(spark, sf_dir))
    return rounded(quality.scores(metrics).select("scope", "source", "concept", "metric", "value"))


@register(
    "dq_compare",
    f"WITH {_ROW_LEVEL}, b AS (SELECT source, concept, metric, value FROM row_level), s AS ({' UNION ALL '.join(f'SELECT source, concept, ' + repr(m) + f' AS metric, count(*) FILTER (WHERE {c}) / count(*) AS value FROM q WHERE value IS NOT NULL AND year IS NOT NULL GROUP BY source, concept' for m, (_, c) in _BAD.items())}) SELECT b.source, b.concept, b.metric, round(b.value, 6) + 0.0 AS before, round(s.value, 6) + 0.0 AS after, round(s.value - b.value, 6) + 0.0 AS change FROM b JOIN s USING (source, concept, metric)",
)
def dq_compare(spark, sf_dir):
    rows, ranges = quality_obs(spark, sf_dir), _ranges(spark, sf_dir)
    level = lambda df: quality.row_level(df, ranges, _NATIONS, (1996, 2000)).where(F.col("metric").isin(list(_BAD)))
    return rounded(quality.compare(level(rows), level(rows.where("value is not null and year is not null"))).select("source", "concept", "metric", "before", "after", "change"))


@register(
    "source_agreement",
    f"""WITH {CHOSEN}, p AS (SELECT a.concept, a.source AS source_a, b.source AS source_b, a.value AS va, b.value AS vb, CASE WHEN greatest(abs(a.value), abs(b.value)) = 0 THEN 0 ELSE abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) END AS d FROM selected a JOIN selected b USING (concept, country, year) WHERE a.source < b.source)
SELECT concept, source_a, source_b, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(d, 0.5), 6) + 0.0 AS median_rel_diff, round(avg((d > 0.10)::INT), 6) + 0.0 AS share_over_10pct, round(avg((va = vb)::INT), 6) + 0.0 AS share_exact FROM p GROUP BY ALL HAVING count(*) >= 5""",
)
def source_agreement(spark, sf_dir):
    return rounded(quality.pairwise_agreement(Layer(spark, sf_dir).selected.withColumnRenamed("country", "iso3")))


@register(
    "source_profile",
    f"WITH {_QOBS}, g AS (SELECT source, concept, iso3, year, count(*) AS c FROM q GROUP BY ALL) SELECT source, concept, CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(DISTINCT iso3) AS BIGINT) AS n_countries, min(year) AS year_min, max(year) AS year_max, CAST(count(*) FILTER (WHERE c > 1) AS BIGINT) AS repeated_cells FROM g GROUP BY source, concept",
)
def source_profile(spark, sf_dir):
    return quality.source_profile(quality_obs(spark, sf_dir))


@register(
    "wilson",
    """WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), p AS (SELECT *, k::DOUBLE / n AS p, 1.96::DOUBLE AS z FROM g)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) + 0.0 AS ci_low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) + 0.0 AS ci_high FROM p""",
)
def wilson(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return rounded(counts.select("lang", "n", "k", low.alias("ci_low"), high.alias("ci_high")))


@register(
    "reversals",
    f"""WITH {SERIES}, l AS (SELECT *, lag(value, 4) OVER w AS v_prev, lag(year, 4) OVER w AS y_prev, value > 200000 AS f FROM series WINDOW w AS (PARTITION BY iso3, concept ORDER BY year))
SELECT l.iso3, l.concept, l.year, round(l.value - l.v_prev, 4) + 0.0 AS rise, (SELECT CAST(count(*) AS BIGINT) FROM l x WHERE x.iso3 = l.iso3 AND x.concept = l.concept AND x.year BETWEEN l.year - 4 AND l.year AND x.f) AS n_flagged FROM l WHERE y_prev = year - 4""",
)
def reversals(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("outlier_flag", F.col("value") > 200000)
    return marts.reversals(rows, ("iso3", "concept")).select("iso3", "concept", "year", (F.round("rise", 4) + 0.0).alias("rise"), "n_flagged")


@register(
    "nearest_asof",
    """SELECT user_id, event_type, event_id, CAST(day AS INTEGER) AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(day - 15), day, event_id) AS rn FROM (SELECT user_id, event_type, event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events) e WHERE abs(day - 15) <= 5) t WHERE rn = 1""",
)
def nearest_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    daily = first_by(rows, ("user_id", "event_type", "day"), [F.col("event_id")])
    return nearest(daily, ("user_id", "event_type"), "day", 15, 5).select("user_id", "event_type", "event_id", "day")


# --- fault injection ------------------------------------------------------------------------------------------


_POOL = f"""{_RECONCILED}, pool AS (SELECT s.source, s.row_num, s.country, s.concept, s.year, s.value, r.conflict OR r.within_group_disagreement AS cell_flagged,
  CAST(count(*) OVER (PARTITION BY s.source, s.country, s.concept ORDER BY s.year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS BIGINT) AS n_neighbours, g.group_label, CAST(count(*) OVER (PARTITION BY s.country, s.concept, s.year, g.group_label) AS BIGINT) AS cell_members
  FROM selected s JOIN groups g ON g.concept = s.concept AND g.source = s.source JOIN reconciled r ON r.country = s.country AND r.concept = s.concept AND r.year = s.year)"""


@register("fault_pool", f"WITH {_POOL} SELECT source, row_num, cell_flagged, n_neighbours, group_label, cell_members FROM pool")
def fault_pool(spark, sf_dir):
    return Layer(spark, sf_dir).pool.select("source", "row_num", "cell_flagged", "n_neighbours", "group_label", "cell_members")


def _faulted(spark, sf_dir):
    """Every 20th pool row is a fault; rows of nations 0-9 are rejected, of others flagged or changed."""
    layer = Layer(spark, sf_dir)
    pool = cut(layer.pool)
    faults = pool.where("row_num % 20 = 0").select("source_file", "row_num", "country", "concept", "year", F.col("value").alias("original_value"), F.lit("value_change").alias("fault_type"), F.array(F.lit("flagged:temporal_outlier"), F.lit("flagged:conflict")).alias("expected"), "n_neighbours", "cell_members", "source")
    rejected = pool.where("row_num % 40 = 0").select("source_file", "row_num", F.lit("out_of_range").alias("reason"))
    flags = F.when(F.col("row_num") % 60 == 0, F.array(F.lit("temporal_outlier"))).when(F.col("row_num") % 7 == 0, F.array(F.lit("bounds_violation"))).otherwise(F.array().cast("array<string>"))
    value = F.when(F.col("row_num") % 100 == 0, F.col("value") * 2).otherwise(F.col("value"))
    fact = pool.where("row_num % 40 <> 0 and row_num % 140 <> 20").select("source_file", "row_num", "country", "concept", "year", value.alias("value"), flags.alias("quality_flags"))
    return pool, faults, rejected, fact, layer.reconciled


@register(
    "fault_outcomes",
    f"""WITH {_POOL}, f AS (SELECT p.*, r.conflict, r.within_group_disagreement AS within FROM pool p JOIN reconciled r ON r.country = p.country AND r.concept = p.concept AND r.year = p.year WHERE row_num % 20 = 0),
x AS (SELECT source, row_num, CASE WHEN row_num % 40 = 0 THEN 'rejected:out_of_range' WHEN row_num % 140 = 20 THEN 'lost' ELSE nullif(concat_ws(',', CASE WHEN row_num % 60 = 0 THEN 'flagged:temporal_outlier' END, CASE WHEN within THEN 'flagged:within_group_disagreement' END, CASE WHEN conflict THEN 'flagged:conflict' END, CASE WHEN row_num % 60 <> 0 AND row_num % 7 = 0 THEN 'flagged:bounds_violation' END), '') END AS l FROM f)
SELECT source, row_num, coalesce(l, CASE WHEN row_num % 100 = 0 THEN 'silent' ELSE 'recovered' END) AS labels, coalesce(contains(l, 'flagged:temporal_outlier') OR contains(l, 'flagged:conflict'), false) AS correct FROM x""",
)
def fault_outcomes(spark, sf_dir):
    _, faults, rejected, fact, reconciled = _faulted(spark, sf_dir)
    return experiments.classify_outcomes(faults, rejected, fact, reconciled).select("source", "row_num", F.array_join("labels", ",").alias("labels"), "correct")


@register(
    "false_positives",
    f"""WITH {_POOL}, clean AS (SELECT * FROM pool WHERE NOT cell_flagged), u AS (SELECT * FROM clean WHERE row_num % 20 <> 0)
SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'flagged:bounds_violation' AS label FROM u WHERE row_num % 7 = 0) t GROUP BY label""",
)
def false_positives(spark, sf_dir):
    pool, faults, rejected, fact, reconciled = _faulted(spark, sf_dir)
    return experiments.false_positives(pool, faults, rejected, fact, reconciled)


@register(
    "naive_loader",
    f"WITH {OBS} SELECT concept, country, year, round(arg_max(value, row_num), 6) + 0.0 AS value FROM obs WHERE source = 'F' AND segment IN ('BUILDING', 'MACHINERY') AND value IS NOT NULL GROUP BY ALL",
)
def naive_loader(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("iso3"), F.lit("").alias("un_subregion"))
    rows = obs(spark, sf_dir).select(F.col("source"), "concept", F.col("country").alias("place"), "year", "value", F.when(F.col("segment").isin("BUILDING", "MACHINERY"), "SEX_BTSX").otherwise("other").alias("sex_raw"), F.lit(None).cast("string").alias("wealth_raw"), F.lit("f").alias("source_file"), "row_num")
    concepts = [r.concept for r in rows.select("concept").distinct().collect()]
    return rounded(forecast.naive_panel(rows, nations, concepts, source="F").select("concept", F.col("iso3").alias("country"), "year", "value"))


# --- forecasting --------------------------------------------------------------------------------------------------

_BACKTEST = f"""{SERIES}, o AS (SELECT *, row_number() OVER w AS n_history, first(year) OVER p AS fy, first(value) OVER p AS fv, count(*) OVER t AS nt, regr_slope(value, year) OVER t AS slope, regr_intercept(value, year) OVER t AS icpt FROM series
  WINDOW w AS (PARTITION BY iso3, concept ORDER BY year), p AS (PARTITION BY iso3, concept ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), t AS (PARTITION BY iso3, concept ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
b AS (SELECT o.iso3, o.concept, o.year AS origin_year, s.year AS target_year, s.year - o.year AS horizon, CAST(o.n_history AS BIGINT) AS n_history, s.value AS actual, o.value AS last_value,
  greatest(0, least(300000, CASE WHEN nt >= 2 THEN icpt + slope * s.year ELSE o.value END)) AS linear_trend_5, greatest(0, least(300000, CASE WHEN o.year > fy THEN o.value + (o.value - fv) / (o.year - fy) * (s.year - o.year) ELSE o.value END)) AS average_change
  FROM o JOIN series s ON s.iso3 = o.iso3 AND s.concept = o.concept AND s.year - o.year BETWEEN 1 AND 10 WHERE o.n_history >= 5 AND s.value > 0),
backtest AS (SELECT * EXCLUDE (last_value), greatest(0, least(300000, last_value)) AS last_value FROM b)"""


def _series_ranges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("concept")).distinct().withColumns({"lo": F.lit(0.0), "hi": F.lit(300000.0)})


def _backtest(spark, sf_dir):
    return forecast.backtest(series(spark, sf_dir), _series_ranges(spark, sf_dir))


def _register_backtest(model: str) -> None:
    # Prices have few decimals, so forecasts would often lie half-way between rounded values; over pi they don't.
    @register(f"backtest_{model}", f"WITH {_BACKTEST} SELECT iso3, concept, origin_year, target_year, horizon, round({model} / pi(), 4) + 0.0 AS pred_over_pi, round(abs({model} - actual) / actual, 6) + 0.0 AS ape FROM backtest")
    def query(spark, sf_dir):
        return _backtest(spark, sf_dir).select("iso3", "concept", "origin_year", "target_year", "horizon", (F.round(F.col(f"pred_{model}") / F.pi(), 4) + 0.0).alias("pred_over_pi"), r6(F.col(f"ape_{model}")).alias("ape"))


for _model in forecast.BASELINES:
    _register_backtest(_model)

_BUCKET = "CASE WHEN horizon = 1 THEN '1' WHEN horizon <= 3 THEN '2-3' WHEN horizon <= 5 THEN '4-5' ELSE '6-10' END"
_SUMMARY = f"{_BACKTEST}, long AS ({' UNION ALL '.join(f'SELECT concept, iso3, {_BUCKET} AS bucket, ' + repr(m) + f' AS model, abs({m} - actual) / actual AS ape FROM backtest' for m in forecast.BASELINES)}), summary AS (SELECT concept, bucket, model, CAST(count(*) AS BIGINT) AS n_instances, CAST(count(DISTINCT iso3) AS BIGINT) AS n_countries, quantile_cont(ape, 0.5) AS median_ape FROM long GROUP BY ALL)"


@register("backtest_summary", f"WITH {_SUMMARY} SELECT concept, bucket, model, n_instances, n_countries, round(median_ape, 6) + 0.0 AS median_ape FROM summary")
def backtest_summary(spark, sf_dir):
    return rounded(forecast.summarize(_backtest(spark, sf_dir), resamples=None))


@register("backtest_intervals")
def backtest_intervals(spark, sf_dir):
    return rounded(forecast.summarize(_backtest(spark, sf_dir)))


@register(
    "gate",
    f"""WITH {_SUMMARY}, c AS (SELECT concept, iso3, count(*) AS n FROM series GROUP BY ALL), v AS (SELECT concept, count(*) FILTER (WHERE n >= 8) AS k FROM c GROUP BY ALL), best AS (SELECT DISTINCT ON (concept) * FROM summary WHERE bucket = '4-5' ORDER BY concept, median_ape, model)
SELECT v.concept, k >= 20 AS C1_data, coalesce(median_ape >= 0.05, false) AS C2_headroom, coalesce(n_instances >= 200 AND n_countries >= 20, false) AS C3_evaluable, model AS best_baseline, round(median_ape, 6) + 0.0 AS best_median_ape, coalesce(n_instances, 0) AS n_instances, coalesce(n_countries, 0) AS n_countries,
  k >= 20 AND coalesce(median_ape >= 0.05, false) AND coalesce(n_instances >= 200 AND n_countries >= 20, false) AS supports_forecasting FROM v LEFT JOIN best USING (concept)""",
)
def gate(spark, sf_dir):
    rows = series(spark, sf_dir)
    return rounded(forecast.gate(forecast.data_volume(rows), forecast.summarize(_backtest(spark, sf_dir), resamples=None), min_countries=20))


@register(
    "data_volume",
    f"""WITH {SERIES}, g AS (SELECT *, year - lag(year) OVER (PARTITION BY iso3, concept ORDER BY year) AS gap FROM series), c AS (SELECT concept, iso3, count(*) AS n FROM series GROUP BY ALL)
SELECT a.concept, a.countries, a.countries_with_history, a.median_observations, b.median_gap_years, b.share_annual FROM (SELECT concept, CAST(count(*) AS BIGINT) AS countries, CAST(count(*) FILTER (WHERE n >= 8) AS BIGINT) AS countries_with_history, quantile_cont(n, 0.5) + 0.0 AS median_observations FROM c GROUP BY concept) a
JOIN (SELECT concept, quantile_cont(gap, 0.5) + 0.0 AS median_gap_years, round(avg((gap = 1)::INT), 6) + 0.0 AS share_annual FROM g GROUP BY concept) b USING (concept)""",
)
def data_volume(spark, sf_dir):
    return rounded(forecast.data_volume(series(spark, sf_dir)))


@register(
    "instances",
    f"""WITH {SERIES}, f AS (SELECT s.*, row_number() OVER w AS nh, first(value) OVER w AS fv, first(year) OVER w AS fy, max(value) OVER (PARTITION BY iso3, concept ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS v1, max(value) OVER (PARTITION BY iso3, concept ORDER BY year RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS v3, max(value) OVER (PARTITION BY iso3, concept ORDER BY year RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING) AS v5 FROM series s WINDOW w AS (PARTITION BY iso3, concept ORDER BY year)),
g AS (SELECT *, ln(value / v1) AS d1, ln(value / v3) AS d3, ln(value / v5) AS d5 FROM f), h AS (SELECT *, CASE WHEN count(d1) OVER r >= 3 THEN stddev_pop(d1) OVER r END AS vol5 FROM g WINDOW r AS (PARTITION BY iso3, concept ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT h.iso3, h.concept, h.year AS origin_year, s.year - h.year AS horizon, round(ln(s.value / h.value), 6) + 0.0 AS y, round(ln(h.value), 6) + 0.0 AS level, round(d1, 6) + 0.0 AS dlog1, round(d3, 6) + 0.0 AS dlog3, round(d5, 6) + 0.0 AS dlog5, round(CASE WHEN h.year > fy THEN ln(h.value / fv) / (h.year - fy) END, 6) + 0.0 AS avg_dlog, round(vol5, 6) + 0.0 AS vol5,
  round(CASE WHEN h.concept <> '1-URGENT' THEN ln(x.value) END, 6) + 0.0 AS x_level FROM h JOIN series s ON s.iso3 = h.iso3 AND s.concept = h.concept AND s.year - h.year BETWEEN 1 AND 10 LEFT JOIN series x ON x.iso3 = h.iso3 AND x.year = h.year AND x.concept = '1-URGENT' WHERE nh >= 6""",
)
def instances(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("un_subregion", F.lit(""))
    concepts = [r.concept for r in rows.select("concept").distinct().orderBy("concept").collect()]
    built = forecast.build_instances(rows, _series_ranges(spark, sf_dir), concepts)
    return rounded(built.select("iso3", "concept", "origin_year", "horizon", "y", "level", "dlog1", "dlog3", "dlog5", "avg_dlog", "vol5", F.col(f"`x_{concepts[0]}_level`").alias("x_level")))


@register(
    "paired_degradation",
    f"""WITH {_BACKTEST}, a AS (SELECT *, abs(last_value - actual) / actual AS c, abs(linear_trend_5 - actual) / actual AS n, abs(average_change - actual) / actual AS p FROM backtest), d AS (SELECT concept, iso3, unnest([{{'k': 'naive', 'v': n - c}}, {{'k': 'pipeline', 'v': p - c}}, {{'k': 'naive_minus_pipeline', 'v': n - p}}]) AS x FROM a)
SELECT concept, x.k AS comparison, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT iso3) AS BIGINT) AS n_countries, round(quantile_cont(x.v, 0.5), 6) + 0.0 AS median_delta FROM d GROUP BY ALL""",
)
def paired_degradation(spark, sf_dir):
    tested = _backtest(spark, sf_dir)
    side = lambda m: tested.select("concept", "iso3", "origin_year", "horizon", F.col(f"ape_{m}").alias("ape_baseline"))
    paired = forecast.paired_frames(side("last_value"), side("linear_trend_5"), side("average_change"), models=("baseline",))
    return rounded(forecast.degradation(paired, "baseline", resamples=None))


# --- scalars, json, contracts ----------------------------------------------------------------------------------


@register("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("name_normalize", "SELECT doc_id, CAST(length(name) AS BIGINT) AS n_chars, sha256(name) AS name_sha256 FROM (SELECT doc_id, regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', '', 'g') AS name FROM documents)")
def name_normalize(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("doc_id", scalars.normalize_name(F.col("text")).alias("name"))
    return names.select("doc_id", F.length("name").cast("long").alias("n_chars"), F.sha2("name", 256).alias("name_sha256"))


@register("typed_values", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN ' ' || value || ' ' WHEN event_id % 5 = 1 THEN 'n/a' WHEN event_id % 5 = 2 THEN NULL ELSE CAST(event_id AS VARCHAR) || '.0' END AS DOUBLE) IS NOT NULL AS typed, CASE WHEN event_id % 5 >= 3 THEN event_id END AS whole, CASE WHEN event_id % 2 = 0 THEN CAST(year(ts) AS INTEGER) END AS year FROM events")
def typed_values(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(e % 5 == 1, "n/a").when(e % 5 == 2, F.lit(None)).otherwise(F.concat(e.cast("string"), F.lit(".0")))
    period = F.when(e % 2 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.concat(F.lit("FY"), F.date_format("ts", "yyyy")))
    return table(spark, sf_dir, "events").select("event_id", scalars.typed_double(text).isNotNull().alias("typed"), F.when(e % 5 >= 3, scalars.typed_long(text)).alias("whole"), scalars.year_of(period).alias("year"))


@register(
    "schema_contract",
    "SELECT * FROM (SELECT 'orders' AS source, coalesce(string_agg(r, ',' ORDER BY r) FILTER (WHERE r NOT IN (SELECT column_name FROM (DESCRIBE orders))), '') AS missing, (SELECT coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE column_name NOT IN ('o_orderkey', 'o_totalprice', 'o_custkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority')), '') FROM (DESCRIBE orders)) AS unexpected FROM (VALUES ('o_orderkey'), ('o_totalprice')) t(r) "
    "UNION ALL SELECT 'events', coalesce(string_agg(r, ',' ORDER BY r) FILTER (WHERE r NOT IN (SELECT column_name FROM (DESCRIBE events))), ''), (SELECT coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE column_name NOT IN ('event_id', 'missing_field', 'ts', 'user_id', 'event_type', 'value')), '') FROM (DESCRIBE events)) FROM (VALUES ('event_id'), ('missing_field')) t(r)) x",
)
def schema_contract(spark, sf_dir):
    """Required and known columns of the tables against what their files have."""
    wanted = {"orders": (["o_orderkey", "o_totalprice"], ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]), "events": (["event_id", "missing_field"], ["ts", "user_id", "event_type", "value"])}
    rows = []
    for name, (required, known) in wanted.items():
        have = set(table(spark, sf_dir, name).columns)
        rows.append((name, ",".join(sorted(set(required) - have)), ",".join(sorted(have - set(required) - set(known)))))
    return spark.createDataFrame(rows, "source string, missing string, unexpected string")


@register("snapshot_checksums", "SELECT page_id, sha256(html) AS checksum FROM pages")
def snapshot_checksums(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("checksum"))


@register("semi_anti", "SELECT o_orderstatus AS source, CAST(count(*) FILTER (WHERE big) AS BIGINT) AS n_in, CAST(count(*) FILTER (WHERE NOT big) AS BIGINT) AS n_out FROM (SELECT o_orderstatus, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS big FROM orders) t GROUP BY ALL")
def semi_anti(spark, sf_dir):
    orders, big = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    inside = orders.join(big, "o_orderkey", "left_semi").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("n_in"))
    outside = orders.join(big, "o_orderkey", "left_anti").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("n_out"))
    return inside.join(outside, "source", "full_outer").na.fill(0, ["n_in", "n_out"])


@register("top_rises", f"WITH {SERIES}, l AS (SELECT *, lag(value, 4) OVER w AS v, lag(year, 4) OVER w AS y FROM series WINDOW w AS (PARTITION BY iso3, concept ORDER BY year)) SELECT iso3, concept, year, round(value - v, 4) + 0.0 AS rise FROM l WHERE y = year - 4 ORDER BY value - v DESC, iso3, concept, year LIMIT 8")
def top_rises(spark, sf_dir):
    rows = marts.reversals(series(spark, sf_dir), ("iso3", "concept"), flag=None)
    return rows.orderBy(F.col("rise").desc(), "iso3", "concept", "year").limit(8).select("iso3", "concept", "year", (F.round("rise", 4) + 0.0).alias("rise"))
