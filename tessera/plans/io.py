"""Queries over readers, sinks and small column functions: tables are written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import formulas as M
from tessera.functions import text as R
from tessera.operators import gates as G
from tessera.operators import joins as J
from tessera.operators import pareto as P
from tessera.plans.analytics import _r
from tessera.plans.registry import query, read
from tessera.session import work_path
from tessera.sources import lines as L
from tessera.sources import tables as TB

c = F.col


def _path(spark, name):
    return work_path(spark, name)


def _csv(df, name, **options):
    path = _path(df.sparkSession, name)
    df.write.option("header", True).options(**options).csv(path)
    return path


_SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_typed(spark, d):
    """A typed scan of what the CSV sink wrote."""
    path = _path(spark, "csv")
    TB.write_csv(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return TB.read_csv(spark, path, _SUPPLIER)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def csv_pruned(spark, d):
    path = _path(spark, "csv")
    TB.write_csv(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return TB.read_csv(spark, path, _SUPPLIER, ["s_suppkey", "s_acctbal"])


def _schema(text):
    return T.StructType.fromDDL(text)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal, NULL::INTEGER AS absent FROM customer")
def csv_tolerant(spark, d):
    """Fields that aren't numbers are null, and so is a column that the file lacks."""
    damaged = read(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 10 == 0, "n/a").otherwise(c("c_acctbal").cast("string")).alias("c_acctbal"))
    return TB.read_csv_or_empty(spark, _csv(damaged, "csv"), _schema("c_custkey long, c_acctbal double, absent int"), ["c_custkey"])


@query("SELECT n_nationkey, n_name FROM nation")
def first_source(spark, d):
    """The first of several paths that has rows: one is missing, one has none."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_name")
    paths = [_path(spark, "none"), _csv(nation.limit(0), "csv"), _csv(nation, "csv"), _csv(nation.limit(1), "csv")]
    return TB.read_first(spark, paths, _schema("n_nationkey int, n_name string"))


@query("SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE / 4 AS tau, CAST(c_custkey % 3 AS INTEGER) AS seed FROM customer")
def files_of_runs(spark, d):
    """Parameters of runs from the names of their directories."""
    rows = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.concat(F.lit("tau"), (c("c_nationkey") / 4).cast("string"), F.lit("_seed"), (c("c_custkey") % 3).cast("string")).alias("run"))
    path = _path(spark, "runs")
    rows.write.partitionBy("run").option("header", True).csv(path)
    return TB.read_runs(spark, f"{path}/run=*/*.csv", _schema("c_custkey long, c_acctbal double"), r"tau([0-9.]+)_seed(\d+)", {"tau": "double", "seed": "int"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus, CAST(o_orderkey % 2 AS INTEGER) AS generation FROM orders")
def appended_generations(spark, d):
    """Appends of frames with other columns to a table with a frozen layout."""
    o, path = read(spark, d, "orders").withColumn("generation", (c("o_orderkey") % 2).cast("int")), _path(spark, "log")
    layout = _schema("o_orderkey long, o_totalprice double, o_orderstatus string, generation int")
    TB.append_generation(o.where("generation = 0").select("generation", "o_orderkey", "o_totalprice", "o_custkey"), path, layout)
    TB.append_generation(o.where("generation = 1").select("o_orderstatus", "o_orderkey", "generation"), path, layout)
    return spark.read.schema(layout).parquet(path)


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_by_name(spark, d):
    s, cu = read(spark, d, "supplier"), read(spark, d, "customer")
    return TB.union_all([s.select(c("s_suppkey").alias("key"), c("s_name").alias("name"), c("s_acctbal").alias("acctbal")), cu.select(c("c_mktsegment").alias("segment"), c("c_custkey").alias("key"), c("c_name").alias("name"))])


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def metrics_file(spark, d):
    path = _path(spark, "metrics")
    TB.write_metrics(read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")), path)
    return spark.read.schema("o_orderpriority string, n long, mean double").json(path)


@query("SELECT n_name || ': ' || count(*) || ' customers' AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def report_file(spark, d):
    path = _path(spark, "report")
    n = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(read(spark, d, "nation")), c("c_nationkey") == c("n_nationkey"))
    TB.write_report(n.select(F.concat(c("n_name"), F.lit(": "), c("n").cast("string"), F.lit(" customers"))), path)
    return spark.read.text(path)


@query(r"SELECT p_partkey, replace(p_brand, '#', '\#') || ' & ' || replace(p_type || ' 5%_x', '%_', '\%\_') || ' & ' || p_size || ' & -- \\' AS line FROM part")
def latex_lines(spark, d):
    p = read(spark, d, "part").withColumn("kind", F.concat("p_type", F.lit(" 5%_x"))).withColumn("none", F.lit(None).cast("string"))
    return p.select("p_partkey", TB.latex_rows(["p_brand", "kind", "p_size", "none"]).alias("line"))


@query("SELECT l_orderkey || chr(9) || l_linenumber AS line FROM lineitem")
def gzip_lines(spark, d):
    path = _path(spark, "gz")
    read(spark, d, "lineitem").select(F.concat_ws("\t", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))).write.option("compression", "gzip").text(path)
    return TB.read_gzip_lines(spark, path, 4).select(F.array_join("fields", "\t").alias("line"))


@query("SELECT p_partkey - 1 AS line_no, p_partkey || ' ' || p_type AS value FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM (SELECT p_partkey + 1 AS p_partkey, p_type FROM part WHERE p_type LIKE '%ECONOMY%')) WHERE n <= 100")
def lines_until(spark, d):
    """The first hundred lines that match, by a reader that stops there."""
    path = _path(spark, "lines")
    p = read(spark, d, "part").select("p_partkey", F.concat((c("p_partkey") + 1).cast("string"), F.lit(" "), c("p_type")).alias("value"))
    p.orderBy("p_partkey").select("value").coalesce(1).write.option("compression", "gzip").text(path)
    L.register(spark)
    found = spark.read.format("lines").option("path", path).option("accept", "ECONOMY").option("stop", "100").load()
    return found.select("line_no", "value")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def varying_columns(spark, d):
    """Without the columns that are constant or mostly missing."""
    p = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(3.5).alias("same"), F.when(c("p_size") == 1, c("p_size")).alias("rare"), F.when(c("p_size") < 0, 1.0).alias("none"))
    return p.select(G.prune_columns(p, p.columns))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%ECONOMY%' THEN p_retailprice ELSE -1e9 END AS gain, CASE WHEN p_type LIKE '%ECONOMY%' THEN -p_size::DOUBLE ELSE -1e9 END AS price FROM part")
def objective_values(spark, d):
    ok = c("p_type").contains("ECONOMY")
    return read(spark, d, "part").select("p_partkey", P.objectives_of(c("p_retailprice"), ok, -1e9).alias("gain"), P.objectives_of(-c("p_size").cast("double"), ok, -1e9).alias("price"))


@query("SELECT p_partkey, round(p_retailprice * 1000.0 / nullif(p_size - 10, 0), 6) AS cp, round(0.13 / nullif(0.8 * 1000.0 * (p_retailprice * 1000.0 / nullif(p_size - 10, 0)), 0), 15) AS diffusivity FROM part")
def heat_and_diffusivity(spark, d):
    cp = M.mass_heat_capacity(c("p_retailprice"), (c("p_size") - 10).cast("double"))
    return read(spark, d, "part").select("p_partkey", F.round(cp, 6).alias("cp"), F.round(M.diffusivity(F.lit(0.13), F.lit(0.8), cp), 15).alias("diffusivity"))


@query("SELECT p_partkey, p_retailprice * (p_size <= 25)::INT AS up, -p_retailprice * (p_size <= 25)::INT + 0.0 AS down, NULL::DOUBLE AS missing FROM part")
def signed_fitness(spark, d):
    ok = (c("p_size") <= 25).cast("int")
    return read(spark, d, "part").select("p_partkey", M.fitness(c("p_retailprice"), True, ok).alias("up"), (M.fitness(c("p_retailprice"), False, ok) + 0.0).alias("down"), M.fitness(F.lit(None).cast("double"), True, ok).alias("missing"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_brand, ''), lambda x: CASE x WHEN 'B' THEN 0 WHEN 'r' THEN 1 WHEN '#' THEN 2 WHEN '1' THEN 3 ELSE 9 END), ' ') AS codes, array_to_string(list_transform(string_split(p_brand, ''), lambda x: CASE WHEN x IN ('B', 'r', '#', '1') THEN x ELSE '?' END), '') AS back FROM part")
def coded_characters(spark, d):
    table = {"B": 0, "r": 1, "#": 2, "1": 3}
    codes = R.encode(c("p_brand"), table, 9)
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(codes, lambda k: k.cast("string")), " ").alias("codes"), R.decode(codes, table, "?").alias("back"))


@query("SELECT event_id, len(string_split(CAST(value AS VARCHAR), '.')) AS parts FROM (SELECT event_id, CAST(value::DECIMAL(18, 2) AS VARCHAR) AS value FROM events)")
def component_counts(spark, d):
    return read(spark, d, "events").select("event_id", R.fragments(c("value").cast("decimal(18,2)").cast("string")).cast("long").alias("parts"))


@query("""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE value > 90 GROUP BY 1, 2)
SELECT CAST(coalesce(a.day, b.day) AS VARCHAR) AS day, a.v AS click, b.v AS error FROM (SELECT * FROM e WHERE event_type = 'click') a FULL JOIN (SELECT * FROM e WHERE event_type = 'error') b ON a.day = b.day""")
def aligned_curves(spark, d):
    e = read(spark, d, "events").where("value > 90").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.max("value").alias("v"))
    return J.aligned([e.where(c("event_type") == t).select("day", c("v").alias(t)) for t in ("click", "error")], "day")


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 20")
def gate_with_bypass(spark, d):
    """One gate that counts and one that is switched off."""
    p = read(spark, d, "part")
    gates = [(c("p_size") <= 20, True), (c("p_retailprice") > 1e9, False)]
    return p.where(G.holds(*[F.lit(not on) | pred for pred, on in gates])).select("p_partkey", "p_size")
