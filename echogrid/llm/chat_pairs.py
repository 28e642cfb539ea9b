"""Preference formatting of chosen and rejected conversations (operator 1).

A pair's longest common prefix of turns (same role, same text) is rendered once as the prompt;
what follows in each conversation is its completion. A completion's mask is the lengths of its
pieces in code points, each with whether it is learnt: an assistant's text and its end mark
are, headers and other roles' turns are not. DataFrame functions only.

Rows: a null role or text is an empty one. Turns stand in the order of their numbers (nulls
first), equal numbers by role and text, repeated rows stay. A row without a conversation's id is
a conversation of its own, of one turn and no partner, so such rows never meet in one group. If one
conversation begins with the whole other one, the other's completion is empty and its mask an
empty array. A conversation is one row, however long. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL, END, LEARNT = "<|", "|>\n", "<|end|>\n", "assistant"


def neighbours(turns: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected``: pairs out of a plain table of conversations.

    Each conversation is chosen once; its rejected twin keeps the first half of its turns
    (rounded down) and goes on with the turns of the partner from there. Partners are the
    conversations whose ids differ in the last bit; without one only the half stays. Both
    stand in one group of one shuffle.
    """
    own = F.struct(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    two = turns.where(F.col("conv_id").isNotNull()).select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair"), own.alias("t")).groupBy("pair").agg(F.sort_array(F.collect_list("t")).alias("all"))

    def side(bit: int) -> Column:
        return F.transform(F.filter("all", lambda t: F.pmod(t["conv_id"], F.lit(2)) == bit), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    def spliced(a: str, b: str) -> Column:
        half = F.floor(F.size(a) / 2).cast("int")
        return F.concat(F.slice(a, F.lit(1), half), F.slice(b, half + 1, F.size(b)))

    sides = two.select("pair", side(0).alias("even"), side(1).alias("odd"))
    number = F.shiftleft("pair", 1)
    pairs = F.array(F.struct(number.alias("conv_id"), F.col("even").alias("chosen"), spliced("even", "odd").alias("rejected")), F.struct((number + 1).alias("conv_id"), F.col("odd").alias("chosen"), spliced("odd", "even").alias("rejected")))
    named = sides.select(F.inline(F.filter(pairs, lambda p: F.size(p["chosen"]) > 0)))
    turn = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = turns.where(F.col("conv_id").isNull()).select(F.lit(None).cast("long").alias("conv_id"), F.array(turn).alias("chosen"))
    return named.unionByName(alone.withColumn("rejected", F.slice("chosen", 1, 0)))


def render(turns: Column) -> Column:
    """The text of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(TAIL), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """``array<struct<n: int, learnt: boolean>>``: a header and a body for each turn."""
    head = lambda t: F.struct((F.length(t["role"]) + len(HEAD + TAIL)).alias("n"), F.lit(False).alias("learnt"))
    body = lambda t: F.struct((F.length(t["text"]) + len(END)).alias("n"), (t["role"] == LEARNT).alias("learnt"))
    return F.flatten(F.transform(turns, lambda t: F.array(head(t), body(t))))


def format_pairs(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``.

    ``pairs``: ``key, chosen, rejected`` with arrays of ``struct<role: string, text: string>``.
    """
    differs = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    common = F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int")
    cut = pairs.select(key, "chosen", "rejected", common.alias("k"))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.size(c), F.lit(1)))
    parts = cut.select(key, "k", F.slice("chosen", F.lit(1), F.col("k")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(key, F.col("k").cast("long").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), render(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def flat(formatted: DataFrame) -> DataFrame:
    """Masks as text ``n:0,n:1,...``; the other columns as they are."""
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["n"].cast("string"), F.when(m["learnt"], ":1").otherwise(":0"))), ",")
    return formatted.withColumns({c: text(c) for c in ("chosen_mask", "rejected_mask")})


SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS c
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT NULL, [{{'role': coalesce(role, ''), 'text': coalesce(text, '')}}] FROM conversations WHERE conv_id IS NULL),
s AS (
  SELECT a.conv_id, a.c AS c, list_concat(a.c[1:len(a.c) // 2], coalesce(b.c, [])[len(a.c) // 2 + 1:]) AS r
  FROM t a LEFT JOIN t b ON b.conv_id = xor(a.conv_id, 1)),
d AS (
  SELECT *, coalesce(list_min([i FOR i IN range(1, greatest(len(c), len(r)) + 1) IF c[i] IS DISTINCT FROM r[i]]) - 1, len(c)) AS k FROM s)
SELECT conv_id, CAST(k AS BIGINT) AS n_prompt_turns,
  coalesce(array_to_string([{{0}} FOR x IN c[1:k]], ''), '') AS prompt,
  coalesce(array_to_string([{{0}} FOR x IN c[k + 1:]], ''), '') AS chosen,
  coalesce(array_to_string([{{1}} FOR x IN c[k + 1:]], ','), '') AS chosen_mask,
  coalesce(array_to_string([{{0}} FOR x IN r[k + 1:]], ''), '') AS rejected,
  coalesce(array_to_string([{{1}} FOR x IN r[k + 1:]], ','), '') AS rejected_mask
FROM d
""".replace("{0}", f"'{HEAD}' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)").replace("{1}", f"(length(x.role) + {len(HEAD + TAIL)}) || ':0,' || (length(x.text) + {len(END)}) || CASE WHEN x.role = '{LEARNT}' THEN ':1' ELSE ':0' END")
