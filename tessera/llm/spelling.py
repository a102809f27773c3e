"""Spelling variants by full neighbourhood generation: every word's neighbours are spelt out and looked up in the vocabulary.

All strings one deletion, replacement or insertion away over the observed alphabet are emitted, each once by its
construction: of a run of equal characters the last is deleted, a character is inserted behind an equal one only, and
replacements differ from what they replace.  Strings of a length that no other word has are left out.  A hash join with
the vocabulary leaves exactly the near words, so no distance is measured.  Work grows with the vocabulary times word length times alphabet, never with pairs of words.

Defined results: a null text has no words; a null id reads as the empty string; repeated rows are counted as often as
they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, stash

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word in so many (by checksum of id and word) loses a character.
SLIP = 199
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: Words whose neighbourhoods one task spells out.
WORDS_A_TASK = 20_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word and n: the runs of letters of all texts, lower-cased in ASCII, after the slips."""
    runs = F.regexp_extract_all(F.translate(docs[text_col].cast("string"), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    words = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("word")).where(F.char_length("word") >= least_chars)
    h = F.crc32(F.concat(F.col("_id"), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("_h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    slipped = words.withColumn("_h", h).select(F.when(F.col("_h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_chars)
    return slipped.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def observed_alphabet(words: DataFrame) -> list[str]:
    """The characters of all words; the pattern of a run bounds how many there are."""
    return sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r[0])


def neighbourhoods(words: DataFrame, alphabet: list[str]) -> DataFrame:
    """word and _near: all distinct strings one deletion, replacement or insertion away, of a length that another word has.

    Each place of a word is a row before its candidates are spelt out, so a very long word is no very long row.
    """
    n = F.char_length("word")
    lengths = words.groupBy(n.alias("_l")).agg(F.count(F.lit(1)).alias("_k"))
    what = lambda shift, **on: F.struct((F.col("_l") + shift).alias("_n"), *[F.lit(on.get(k, False)).alias(k) if not isinstance(on.get(k), Column) else on[k].alias(k) for k in ("less", "same", "more")])
    asked = lengths.select(F.explode(F.array(what(1, less=True), what(0, same=F.col("_k") > 1), what(-1, more=True))).alias("_a")).groupBy("_a._n").agg(*[F.max(f"_a.{k}").alias(k) for k in ("less", "same", "more")])
    # a thousand candidates and more for each word: tasks by words, not by bytes
    dealt = words.select("word").repartition(max(1, -(-words.count() // WORDS_A_TASK))).withColumn("_n", n)
    few = asked.count() <= BROADCAST_IDS
    place = dealt.join(F.broadcast(asked) if few else asked, "_n").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    part = lambda first: F.substring(F.col("word"), first, F.col("_n"))
    i = F.col("_i")
    place = place.select("word", "less", "same", "more", (i < F.col("_n")).alias("inside"), F.substring(F.col("word"), F.lit(1), i).alias("head"), F.substring(F.col("word"), i + 1, F.lit(1)).alias("char"), part(i + 1).alias("rest"), part(i + 2).alias("tail"))
    none = F.array().cast("array<string>")
    others = F.array_remove(F.array(*map(F.lit, alphabet)), F.col("char"))
    last = F.col("char") != F.substring("tail", 1, 1)  # of a run of equal characters
    near = F.concat(
        F.when(F.col("less") & F.col("inside") & last, F.array(F.concat("head", "tail"))).otherwise(none),
        F.when(F.col("same") & F.col("inside"), F.transform(others, lambda c: F.concat("head", c, "tail"))).otherwise(none),
        F.when(F.col("more"), F.transform(others, lambda c: F.concat("head", c, "rest"))).otherwise(none),
    )
    return place.select("word", F.explode(near).alias("_near"))


def near_words(words: DataFrame, alphabet: list[str], small: bool) -> DataFrame:
    """word, n_near, form and form_n: how many near words each has, and the most frequent one (ties: the first by code points)."""
    known = words.select(F.col("word").alias("_near"), F.col("n").alias("_n"))
    found = neighbourhoods(words, alphabet).join(F.broadcast(known) if small else known.hint("shuffle_hash"), "_near")
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col("_near").alias("w")))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.w").alias("form"), (-F.col("_b.m")).alias("form_n"))


def follow(forms: DataFrame) -> DataFrame:
    """word and root: word -> form followed to the end, in rounds that double the distance; n rises at every step, so there are no cycles."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        next_ = stash(at.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        at = next_.drop("_moved")
        if next_.where("_moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, **limits: int) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    words = stash(vocabulary(docs, id_col, text_col, **limits), "words")
    small = words.count() <= BROADCAST_IDS
    near = near_words(words, observed_alphabet(words), small)
    leads = F.col("form_n") >= times * F.col("n")
    rows = stash(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("form")).alias("form"), F.when(leads, F.col("form_n")).alias("form_n")), "variants")
    roots = follow(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_UTF8 = "string_split(w, '')"
# the checksum of <id>:<word> in UTF-8, a character at a time; letters beyond ASCII have two bytes here
_BYTES = f"list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: ascii(x)::BIGINT) || flatten(list_transform({_UTF8}, lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"

#: Near words meet by what is left without a character, or with one character hidden.
VARIANTS_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{RUN}')) AS w FROM documents),
t AS (SELECT doc_id, w, count(*) AS k FROM r GROUP BY ALL HAVING length(w) >= {LEAST_CHARS}),
h AS (SELECT w, k, {_CRC} AS h FROM t),
u AS (SELECT CASE WHEN h % {SLIP} = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM u WHERE length(word) >= {LEAST_CHARS} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM i),
p AS (SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.less UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.less),
b AS (SELECT p.word, count(*) AS n_near, min({{'m': -p.n, 'w': encode(p.near)}}) AS b FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.b.m >= {TIMES} * v.n THEN decode(b.b.w) END AS form, CASE WHEN -b.b.m >= {TIMES} * v.n THEN -b.b.m END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(root, d) AS root FROM c GROUP BY 1) USING (word)
"""
