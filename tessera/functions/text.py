"""String functions: folds, names, paths, readable numbers, n-grams and a line parser."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stash

#: Most rows of an n-gram table that the driver and the workers hold.
MODEL_ROWS = 1_000_000


def md5_fold(key: Column, folds: int) -> Column:
    """The MD5 of the key as a number modulo folds, by eight digits at a time."""
    digest = F.md5(key.cast("string").cast("binary"))
    out = F.lit(0).cast("long")
    for k in range(4):
        out = F.pmod(out * ((1 << 32) % folds) + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(folds).cast("long"))
    return out.cast("int")


def path_params(path: Column, pattern: str, names: list[str]) -> list[Column]:
    return [F.regexp_extract(path, pattern, k + 1).alias(n) for k, n in enumerate(names)]


def name_variants(name: Column) -> Column:
    """Spellings of a name worth looking up: trimmed, without brackets, without a stereo prefix, with Greek letters spelt."""
    base = F.trim(name)
    plain = F.trim(F.regexp_replace(base, r"\([^)]*\)", ""))
    stereo = F.regexp_replace(plain, r"^(?:[RSEZDL]|cis|trans)-", "")
    greek = F.regexp_replace(F.regexp_replace(stereo, "α", "alpha"), "β", "beta")
    return F.filter(F.array_distinct(F.array(base, plain, stereo, greek)), lambda x: x != "")


def plus_minus(mean: Column, sd: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f +/- %.{decimals}f", mean, sd)


def ellipsis(text: Column, length: int) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def ngrams(df: DataFrame, text: str, n: int) -> DataFrame:
    """prefix, next, count: the character n-gram table over whole texts."""
    chars = F.char_length(text)
    starts = F.when(chars > n, F.sequence(F.lit(1), chars - n)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(F.substring(F.col(text), i, F.lit(n)).alias("prefix"), F.substring(F.col(text), i + n, F.lit(1)).alias("next")))
    return df.select(F.explode(grams).alias("g")).groupBy("g.prefix", "g.next").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """char, idx: the distinct characters in code point order."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).where("char <> ''").distinct()
    return chars.withColumn("idx", (F.row_number().over(Window.orderBy("char")) - 1).cast("int"))  # as many rows as characters exist


def encode(text: Column, table: dict[str, int], unknown: int) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(lookup, c), F.lit(unknown)))


def decode(codes: Column, table: dict[str, int], unknown: str = "") -> Column:
    """The string of a list of numbers; numbers outside the table give `unknown`."""
    lookup = F.create_map(*[F.lit(x) for c, k in table.items() for x in (k, c)])
    return F.array_join(F.transform(codes, lambda k: F.coalesce(F.try_element_at(lookup, k), F.lit(unknown))), "")


def balanced(text: Column) -> Column:
    """Brackets close in order and ring digits pair up."""
    chars = F.split(text, "")
    depth = F.aggregate(chars, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (a["ok"] & (a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0) >= 0)).alias("ok")))
    rings = F.size(F.filter(chars, lambda c: c.rlike("^[0-9]$"))) % 2 == 0
    return (depth["d"] == 0) & depth["ok"] & rings


def fragments(text: Column) -> Column:
    return F.size(F.split(text, r"\."))


def generate(model: dict[str, list[tuple[str, int]]], seeds: DataFrame, n: int, longest: int, start: str, end: str) -> DataFrame:
    """seed, text: strings drawn from an n-gram model (a bounded table), each fixed by its seed."""
    import random

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for seed in f["seed"]:
                r, text = random.Random(int(seed)), start
                while len(text) < longest + len(start):
                    options = model.get(text[-n:])
                    if not options:
                        break
                    c = r.choices([o for o, _ in options], [w for _, w in options])[0]
                    if c == end:
                        break
                    text += c
                out.append(text[len(start) :])
            yield pd.DataFrame({"seed": f["seed"], "text": out})

    return seeds.mapInPandas(run, "seed long, text string")


def generate_from(counts: DataFrame, seeds: DataFrame, n: int, longest: int, start: str, end: str, most: int = MODEL_ROWS) -> DataFrame:
    """seed, text: generate() by a table of prefix, next, n of any size; beyond `most` rows each character is a join."""
    counts = stash(counts.select("prefix", "next", "n"), "ngrams")
    if counts.count() <= most:
        model: dict[str, list[tuple[str, int]]] = {}
        for r in sorted(counts.collect(), key=lambda r: (r.prefix, r.next)):
            model.setdefault(r.prefix, []).append((r.next, r.n))
        return generate(model, seeds, n, longest, start, end)
    import random

    def pick(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ends = [], []
                for seed, text, done, options in zip(*(col.to_pylist() for col in batch.columns)):
                    if not done and options:
                        r = random.Random(seed)
                        for _ in range(k):
                            r.random()
                        c = r.choices([o["next"] for o in options], [o["n"] for o in options])[0]
                        done, text = c == end, text if c == end else text + c
                    else:
                        done = True
                    texts.append(text)
                    ends.append(done)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(ends, pa.bool_())], names=["seed", "text", "done"])

        return run

    options = stash(counts.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("next", "n"))).alias("options")), "options")
    rows = stash(seeds.select(F.col("seed").cast("long").alias("seed"), F.lit(start).alias("text"), F.lit(False).alias("done")), "drawn")
    for k in range(longest):
        if rows.where("not done").isEmpty():
            break
        found = rows.withColumn("prefix", F.when(~F.col("done"), F.substring("text", -n, n))).join(options, "prefix", "left")
        rows = stash(found.select("seed", "text", "done", "options").mapInArrow(pick(k), "seed long, text string, done boolean"), "drawn")
    return rows.select("seed", F.expr(f"substring(text, {len(start) + 1})").alias("text"))


def carried(df: DataFrame, keys: list[str], order: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """A line state machine: each pattern's first group, carried forward to the lines after it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for name, pattern in patterns.items():
        hit = F.regexp_extract(text, pattern, 1)
        df = df.withColumn(name, F.last(F.when(hit != "", hit), ignorenulls=True).over(w))
    return df
