"""Quotation linking: conversations in reply order without quotes, in DataFrame functions only.

Lines that begin with > marks are quotes; their number is the level, and lines of one level in a row are a
passage.  Passages, and their lines, are normalised (lower case, white space as one space) and hashed, as are
the unquoted lines and the whole unquoted text of every message.  A window over (conversation, hash) in turn
order gives each quoted unit the latest earlier message that holds it, so repeated texts never multiply.  A
message answers the message that most quoted characters link to, the later one if tied, or else the message
before it.  A conversation is written in reply order: every message is followed by its answers, each with all that
answers it, in turn order (the path of answered messages, compared place by place).

Conversations come in parts of a fixed number of turns, and parts of very many messages (one turn, or none, for all
of them) in shards by hash, so that no group is unbounded; a message whose original is in another part or shard
follows the message before it.

Defined results: a null text is an empty message; equal rows count once; rows without a turn are a part of
their own, -1; quotes without an original are removed and link nothing; of several messages of the answered turn
the first is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = 512
#: Messages of a part from which on it is dealt into shards of about PART.
CROWD = 4 * PART
#: The last of the marks that a line begins with; no group, since Java's matcher calls itself for each turn of one.
MARKS = r"^[ \t>]*>"


def _norm(c):
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))


def _key(c):
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit(1)).alias("h2"))


def messages(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, plain (without quotes) and m, a hash that tells messages of one turn apart."""
    rows = conv.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.distinct().withColumn("m", F.xxhash64("role", "text"))
    plain = F.trim(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(MARKS)), "\n"))
    return rows.withColumn("plain", F.when(F.col("text").contains(">"), plain).otherwise(F.trim("text")))


def quoted_units(msgs: DataFrame) -> DataFrame:
    """conv_id, turn, m, level, unit: the passages of every level, and their lines."""
    lines = msgs.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "m", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))
    lines = lines.select("conv_id", "turn", "m", "pos", level.alias("level"), F.regexp_replace("line", MARKS + r"[ \t]?", "").alias("content"))
    order = Window.partitionBy("conv_id", "turn", "m").orderBy("pos")
    new = F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1)
    lines = lines.withColumn("new", new).withColumn("passage", F.sum("new").over(order)).where("level > 0")
    whole = lines.groupBy("conv_id", "turn", "m", "passage", "level").agg(F.sort_array(F.collect_list(F.struct("pos", "content")))["content"].alias("parts"), F.count(F.lit(1)).alias("n"))
    whole = whole.where("n > 1").select("conv_id", "turn", "m", "level", _norm(F.array_join("parts", " ")).alias("unit"))
    return lines.select("conv_id", "turn", "m", "level", _norm(F.col("content")).alias("unit")).union(whole).where("unit <> ''")


def links(msgs: DataFrame) -> DataFrame:
    """conv_id, turn, m, reply_to, n_quoted, n_linked (units): the answered turn of each message with quotes."""
    quoted = quoted_units(msgs).select("conv_id", "turn", "m", "level", _key("unit").alias("key"), F.length("unit").alias("size"))
    lines = F.filter(F.split("plain", "\n"), lambda x: F.trim(x) != "")
    units = msgs.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.transform(lines, _norm), F.array(_norm(F.col("plain")))))).alias("unit")).where("unit <> ''")
    source = units.select("conv_id", "turn", _key("unit").alias("key")).join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").distinct()
    both = quoted.select("conv_id", "key", "turn", "m", "level", "size", F.lit(None).cast("long").alias("held")).union(
        source.select("conv_id", "key", "turn", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("turn"))
    )
    before = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("target", F.max("held").over(before)).where("m is not null")
    each = found.groupBy("conv_id", "turn", "m", "target").agg(F.sum(F.when(F.col("level") == 1, F.col("size")).otherwise(0)).alias("direct"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("target").isNotNull(), F.struct("direct", "all", "target")))
    linked = F.sum(F.when(F.col("target").isNotNull(), F.col("n")).otherwise(0))
    return each.groupBy("conv_id", "turn", "m").agg(best.alias("best"), F.sum("n").alias("n_quoted"), linked.alias("n_linked")).select("conv_id", "turn", "m", F.col("best.target").alias("reply_to"), "n_quoted", "n_linked")


def chat(conv: DataFrame, part: int = PART, crowd: int = CROWD) -> DataFrame:
    """conv_id, part, shard (0 unless the part is crowded), n_messages, n_quoted, n_linked and chat, one line group for each message in reply order."""
    msgs = messages(conv)
    linked = links(msgs).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("m").alias("_m"), "reply_to", "n_quoted", "n_linked")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("m") == F.col("_m"))
    rows = msgs.join(linked, same, "left").select("conv_id", "turn", "role", "plain", "reply_to", "n_quoted", "n_linked")
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.when(F.col("reply_to").isNotNull(), F.concat(F.lit(" re:"), F.col("reply_to").cast("string"))).otherwise(F.lit("")), F.lit("|>\n"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long")).withColumn("line", F.concat(head, F.col("plain")))
    keys = ["conv_id", "part"]
    crowds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.ceil(F.col("n") / part).alias("_n"))
    rows = rows.join(crowds, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("line", "turn"), F.col("_n")), F.lit(0)).cast("long"))
    out = rows.groupBy(*keys, "shard").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.coalesce(F.sum("n_quoted"), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce(F.sum("n_linked"), F.lit(0)).cast("long").alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("turn", "line", "reply_to"))).alias("m"),
    )
    return out.select(*keys, "shard", "n_messages", "n_quoted", "n_linked", F.when(F.exists("m", lambda x: x["reply_to"].isNotNull()), F.array_join(in_reply_order("m"), "\n")).otherwise(F.array_join(F.col("m")["line"], "\n")).alias("chat"))


def in_reply_order(messages: str):
    """The lines of a sorted array of (turn, line, reply_to), every message before its answers."""
    m = F.col(messages)
    # the place of each answered message; without one, the message before
    up = F.transform(m, lambda x, i: F.when(x["reply_to"].isNotNull() & (F.array_position(m["turn"], x["reply_to"]) > 0), F.array_position(m["turn"], x["reply_to"]) - 1).otherwise(i - 1).cast("int"))
    paths = F.aggregate(
        F.sequence(F.lit(0), F.size(m) - 1),
        F.array().cast("array<array<int>>"),
        lambda done, i: F.concat(done, F.array(F.concat(F.coalesce(F.get(done, F.get(up, i)), F.array().cast("array<int>")), F.array(i)))),
    )
    return F.transform(F.sort_array(F.arrays_zip(paths.alias("path"), m["line"].alias("line"))), lambda x: x["line"])


CHAT_SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN contains(text, '>') THEN trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t>]*>')), chr(10)), ' ')
              ELSE trim(text, ' ') END AS plain
  FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
raw AS (SELECT conv_id, turn, role, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM msgs WHERE regexp_matches(text, '(?m)^[ \t]*>')),
lines AS (SELECT conv_id, turn, role, text, pos, length(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) AS level,
                 regexp_replace(line, '^[ \t>]*>[ \t]?', '') AS content FROM raw),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, role, text ORDER BY pos) AS passage FROM (
           SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn, role, text ORDER BY pos) THEN 0 ELSE 1 END AS new FROM lines)),
units AS (
  SELECT conv_id, turn, role, text, level, lower(trim(regexp_replace(content, '[ \t\r\n]+', ' ', 'g'), ' ')) AS unit FROM runs WHERE level > 0
  UNION ALL
  SELECT conv_id, turn, role, text, level, lower(trim(regexp_replace(string_agg(content, ' ' ORDER BY pos), '[ \t\r\n]+', ' ', 'g'), ' '))
  FROM runs WHERE level > 0 GROUP BY conv_id, turn, role, text, passage, level HAVING count(*) > 1),
quoted AS (SELECT * FROM units WHERE unit <> ''),
source AS (SELECT DISTINCT conv_id, turn, unit FROM (
  SELECT conv_id, turn, lower(trim(regexp_replace(unnest(list_append(string_split(plain, chr(10)), plain)), '[ \t\r\n]+', ' ', 'g'), ' ')) AS unit FROM msgs) WHERE unit <> ''),
found AS (SELECT q.*, (SELECT max(s.turn) FROM source s WHERE s.conv_id = q.conv_id AND s.unit = q.unit AND s.turn < q.turn) AS target FROM quoted q),
each AS (SELECT conv_id, turn, role, text, target, sum(CASE WHEN level = 1 THEN length(unit) ELSE 0 END) AS direct, sum(length(unit)) AS total, count(*) AS n
         FROM found GROUP BY ALL),
best AS (SELECT conv_id, turn, role, text, max(CASE WHEN target IS NOT NULL THEN {'direct': direct, 'total': total, 'target': target} END).target AS reply_to,
                sum(n) AS n_quoted, sum(CASE WHEN target IS NOT NULL THEN n ELSE 0 END) AS n_linked FROM each GROUP BY ALL),
said AS (SELECT m.conv_id, CAST(coalesce(floor(m.turn / 512), -1) AS BIGINT) AS part, m.turn, reply_to, n_quoted, n_linked,
                '<|' || coalesce(m.role, '') || CASE WHEN reply_to IS NOT NULL THEN ' re:' || reply_to ELSE '' END || '|>' || chr(10) || m.plain AS line
         FROM msgs m LEFT JOIN best b ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.turn IS NOT DISTINCT FROM b.turn AND m.role IS NOT DISTINCT FROM b.role AND m.text = b.text),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, line, reply_to NULLS FIRST) - 1 AS i FROM said),
answers AS (SELECT p.*, coalesce((SELECT min(q.i) FROM placed q WHERE q.conv_id IS NOT DISTINCT FROM p.conv_id AND q.part = p.part AND q.turn = p.reply_to), p.i - 1) AS up FROM placed p),
tree AS (SELECT conv_id, part, i, [i] AS path FROM answers WHERE up < 0
         UNION ALL SELECT a.conv_id, a.part, a.i, list_append(t.path, a.i) FROM answers a JOIN tree t ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.part = t.part AND a.up = t.i)
SELECT a.conv_id, a.part, 0::BIGINT AS shard, count(*) AS n_messages, CAST(coalesce(sum(n_quoted), 0) AS BIGINT) AS n_quoted, CAST(coalesce(sum(n_linked), 0) AS BIGINT) AS n_linked,
       string_agg(line, chr(10) ORDER BY path) AS chat
FROM answers a JOIN tree t ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.part = t.part AND a.i = t.i GROUP BY a.conv_id, a.part
"""
