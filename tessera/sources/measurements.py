"""Text lines of measurement tables to records: headers carry a compound, rows pair temperatures with values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import exact_quantiles, linear_spots, with_group_values

HEADER = r"^\s*(\d+)\s+((?:[A-Z][a-z]?\d*)+)\s+(.+?)\s+\[(\d{2,7}-\d{2}-\d)\]"
TEMPERATURES = r"^\s*T/K\s+(.+)$"
VALUES = r"^\s*eps\s+(.+)$"
REFERENCE = r"\s+(\d{2}[A-Z][A-Z0-9]*)$"


def records(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """compound_no, formula, name, cas, t_k, epsilon, ref for every pair of a temperature row and the value row after it.

    The state machine is a few carried-forward windows over each file's lines.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = lambda k: F.last(F.when(F.col(text).rlike(HEADER), F.regexp_extract(text, HEADER, k)), ignorenulls=True).over(w)
    # an empty row after a header clears the temperatures of the compound before
    temps = F.last(F.when(F.col(text).rlike(TEMPERATURES), F.regexp_extract(text, TEMPERATURES, 1)).when(F.col(text).rlike(HEADER), F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumns({"compound_no": part(1).cast("int"), "formula": part(2), "name": part(3), "cas": part(4), "_t": temps})
    rows = rows.where(F.col(text).rlike(VALUES) & (F.coalesce(F.col("_t"), F.lit("")) != ""))
    body = F.regexp_extract(text, VALUES, 1)
    rows = rows.withColumn("ref", F.nullif(F.regexp_extract(body, REFERENCE, 1), F.lit(""))).withColumn("_v", F.trim(F.regexp_replace(body, REFERENCE, "")))
    pairs = F.arrays_zip(F.split(F.trim("_t"), r"\s+").alias("t"), F.split("_v", r"\s+").alias("e"))
    out = rows.select(*keys, order, "compound_no", "formula", "name", "cas", "ref", F.posexplode(pairs).alias("place", "p"))
    return out.select(*keys, order, "place", "compound_no", "formula", "name", "cas", F.col("p.t").try_cast("double").alias("t_k"), F.col("p.e").try_cast("double").alias("epsilon"), "ref")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("t_k") > 10) & (F.col("t_k") < 700) & (F.col("epsilon") > 0) & (F.col("epsilon") < 2e5))


def at_25c(rows: DataFrame, at: float = 298.15, near: float = 1.0, widest: float = 30.0) -> DataFrame:
    """One estimate per compound: the median of direct values near 25 C, else a line between close neighbours, else none."""
    t, e = F.col("t_k"), F.col("epsilon")
    keys = ["compound_no", "name", "cas"]
    g = rows.groupBy(*keys).agg(
        F.max_by(F.struct(t, e), F.when(t < at, t)).alias("lo"), F.min_by(F.struct(t, e), F.when(t > at, t)).alias("hi"),
        F.count(F.lit(1)).alias("n_measurements"), F.min(t).alias("t0"), F.max(t).alias("t1"),
    )
    direct = exact_quantiles(rows.where(F.abs(t - at) <= near), keys, e, linear_spots([0.5])).select(*keys, F.col("quantiles")[0].alias("direct"))
    g = with_group_values(g, keys, direct)
    lo, hi = F.col("lo"), F.col("hi")
    usable = (lo["t_k"] < at) & (hi["t_k"] > at) & (hi["t_k"] - lo["t_k"] <= widest)
    line = lo["epsilon"] + (hi["epsilon"] - lo["epsilon"]) * (at - lo["t_k"]) / (hi["t_k"] - lo["t_k"])
    return g.select(
        "compound_no", "name", "cas", F.coalesce("direct", F.when(usable, line)).alias("dc_25c"),
        F.when(F.col("direct").isNotNull(), "direct").when(usable, "interpolated").otherwise("no_25C_available").alias("dc_method"),
        "n_measurements", F.format_string("%.1f-%.1f", "t0", "t1").alias("t_range_k"),
    )


def resolve(names: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """smiles and source of each key: the first cached table that knows it, in order."""
    out, held = names, []
    for k, (table, value, label) in enumerate(tables):
        found = table.groupBy(key).agg(F.min(value).alias(f"_v{k}"))
        out = out.join(found, key, "left")
        held.append((f"_v{k}", label))
    source = F.lit(None).cast("string")
    for v, label in reversed(held):
        source = F.when(F.col(v).isNotNull(), label).otherwise(source)
    value = F.coalesce(*[F.col(v) for v, _ in held])
    return out.withColumn("smiles", value).withColumn("source", source).drop(*[v for v, _ in held])
