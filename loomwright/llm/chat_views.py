"""Multi-party perspective rotation (operator 2): each speaker in turn as the assistant.

For every participant of a conversation its dialogue is rendered with that speaker's turns as the assistant's and
the others' as turns of named users; turns of a system role are context, the same for everyone. The mask lists the
stretches (code points, end exclusive) of the assistant's words, which alone are to be learnt from.

A rendition is one row and holds the whole dialogue, however long. Dialogues that are too large for a row can be cut on
demand: with ``part_turns`` each rendition comes in parts of so many turns, by position, each opened by the system turns
that open the dialogue; the parts in order hold every turn once beside these. Everything is DataFrame functions.

Cases: a null role is the speaker ``unknown``, a null text an empty turn, a null turn number counts as 0; turns
with equal numbers follow by role and text; repeated rows are repeated turns; a row without a conversation id is a
dialogue of its own, as nothing tells whom it answers (equal rows share one); a dialogue of system turns alone has no
rendition; a speaker without a turn in a part has an empty mask there; an empty table gives no rows; further columns are
ignored. Nothing in a text or a name can pass for a mark of the format, and no name can end its line: in a name the signs
of marks, what ends a line and ``%`` are written as ``%`` and their code, so different names stay different.

Offsets are running sums, taken once for a dialogue with everyone named: a speaker's own headers differ from that by the same
length in every turn, so a span moves by it for each own turn before. A rendition costs time in its length, however many turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYSTEM = ("system",)
OPEN, CLOSE = "<|", "|>"
# How names show the signs of marks, what may end a line, and the sign of these codes, which comes first.
CODES = {"%": "%25", "<": "%3C", "|": "%7C", ">": "%3E", "\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D", "\x1c": "%1C", "\x1d": "%1D", "\x1e": "%1E", "\x85": "%85", "\u2028": "%u2028", "\u2029": "%u2029"}


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(OPEN), F.lit("< |"))


def _name(role: Column) -> Column:
    """A role's name as a header may hold it."""
    return reduce(lambda name, code: F.replace(name, F.lit(code[0]), F.lit(code[1])), CODES.items(), role)


def _parts(rows: DataFrame, key: list[str], system: tuple[str, ...], part_turns: int) -> DataFrame:
    """The turns with their ``part``, cut by position; the turns that open the dialogue are in all of them."""
    dialogue = W.partitionBy(*key)
    is_system = F.col("x.r").isin(*system)
    placed = rows.withColumn("last", F.floor((F.count("*").over(dialogue) - 1) / part_turns))
    placed = placed.withColumn("opens", is_system & (F.col("at") < F.min(F.when(~is_system, F.col("at"))).over(dialogue)))
    part = F.floor(F.col("at") / part_turns)
    spread = placed.withColumn("part", F.explode(F.when(F.col("opens"), F.sequence(part, F.col("last"))).otherwise(F.array(part))))
    return spread.drop("last", "opens")


def rotate(turns: DataFrame, system: tuple[str, ...] = SYSTEM, part_turns: int | None = None) -> DataFrame:
    """``conv_id``, ``speaker``, ``part`` (0 for whole dialogues), ``n_turns``, ``n_learnt`` turns, the rendered ``text`` and its ``mask`` (start:end, comma-joined)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    number = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    conv_id = F.col("conv_id").cast("long")
    alone = F.when(conv_id.isNull(), F.xxhash64(number, role, F.col("text").cast("string")))
    key = ["conv_id", "alone"]
    rows = turns.select(conv_id.alias("conv_id"), alone.alias("alone"), F.struct(number.alias("n"), role.alias("r"), _clean(F.col("text")).alias("t")).alias("x"))
    names = lambda found: F.filter(found, lambda r: ~r.isin(*system))
    placed = rows.withColumn("at", F.row_number().over(W.partitionBy(*key).orderBy("x")) - 1)
    placed = placed.withColumn("part", F.lit(0).cast("long")) if part_turns is None else _parts(placed, key, system, part_turns)
    header = lambda name: F.concat(F.lit(OPEN), name, F.lit(CLOSE + "\n"))
    said = placed.select(
        *key, "part", "at", F.col("x.r").alias("r"),
        header(F.when(F.col("x.r").isin(*system), F.col("x.r")).otherwise(F.concat(F.lit("user name="), _name(F.col("x.r"))))).alias("h"),
        F.concat(F.col("x.t"), F.lit(OPEN + "end" + CLOSE + "\n")).alias("b"),
    )
    before = F.sum(F.length("h") + F.length("b")).over(W.partitionBy(*key, "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    said = said.withColumn("before", F.coalesce(before, F.lit(0)))
    turned = said.groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct("at", "r", "h", "b", "before"))).alias("turns"))
    if part_turns is None:
        found = turned.withColumn("speaker", F.explode(names(F.array_distinct(F.transform("turns", lambda t: t["r"])))))
    else:
        speakers = rows.groupBy(*key).agg(F.collect_set("x.r").alias("found")).select(*(F.col(k).alias(f"_{k}") for k in key), F.explode(names(F.col("found"))).alias("speaker"))
        found = turned.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("alone").eqNullSafe(F.col("_alone")))

    own_header = header(F.lit("assistant"))
    own = lambda t: t["r"] == F.col("speaker")
    # By so much each own header is longer or shorter than the one that names the speaker.
    moved = F.length(own_header) - F.length(header(F.concat(F.lit("user name="), _name(F.col("speaker")))))

    def span(t: Column, k: Column) -> Column:
        begin = t["before"] + k * F.col("moved") + F.length(own_header)
        return F.concat_ws(":", begin.cast("string"), (begin + F.length(t["b"]) - 1).cast("string"))  # with the end mark, without the line's end

    mine = found.withColumn("moved", moved).withColumn("mine", F.filter("turns", own))
    return mine.select(
        "conv_id", "speaker", "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("mine").cast("long").alias("n_learnt"),
        F.array_join(F.transform("turns", lambda t: F.concat(F.when(own(t), own_header).otherwise(t["h"]), t["b"])), "").alias("text"),
        F.array_join(F.transform("mine", span), ",").alias("mask"),
    )


_SQL_NAME = reduce(lambda name, code: f"replace({name}, {f'chr({ord(code[0])})'}, '{code[1]}')", CODES.items(), "r")
#: The same as DuckDB SQL. Lengths and offsets count code points there too.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN hash(turn, role, text) END AS alone, coalesce(turn, 0) AS n, coalesce(role, 'unknown') AS r, replace(coalesce(text, ''), '{OPEN}', '< |') AS t FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, alone, r AS speaker FROM rows WHERE r NOT IN ('system')
), pieces AS (
  SELECT s.conv_id, s.alone, s.speaker, n, r, t, r = speaker AS own,
    '{OPEN}' || CASE WHEN r IN ('system') THEN r WHEN r = speaker THEN 'assistant' ELSE 'user name=' || {_SQL_NAME} END || '{CLOSE}' || chr(10) AS h,
    t || '{OPEN}end{CLOSE}' || chr(10) AS b
  FROM rows JOIN speakers s ON rows.conv_id IS NOT DISTINCT FROM s.conv_id AND rows.alone IS NOT DISTINCT FROM s.alone
), placed AS (
  SELECT *, sum(length(h) + length(b)) OVER w - length(b) AS begin, sum(length(h) + length(b)) OVER w - 1 AS stop
  FROM pieces WINDOW w AS (PARTITION BY conv_id, alone, speaker ORDER BY n, r, t ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, 0 AS part, count(*) AS n_turns, count(*) FILTER (own) AS n_learnt,
  string_agg(h || b, '' ORDER BY n, r, t) AS text,
  coalesce(string_agg(CAST(begin AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY n, r, t) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, alone, speaker"""
