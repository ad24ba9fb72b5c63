"""Preference pairs: the shared start of two conversations is the prompt, and each goes on as a masked completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
SEED = "pairs-1"
#: Turns of this role are learned from; what others say is only read.
LEARNED = "assistant"


def _turn(role: Column, text: Column) -> Column:
    """A turn as text. Markers inside it are broken up, so no text can end its turn."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit(MIDDLE), safe(text), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _turn(t.role, t.text)), "")


def _mask(turns: Column) -> Column:
    """Learned spans (start, end) of the rendered turns, in code points: text and end mark of each learned turn."""
    sized = F.transform(
        turns,
        lambda t: F.struct(
            F.length(_turn(t.role, t.text)).cast("long").alias("all"),
            F.length(F.concat(F.lit(OPEN), F.replace(F.coalesce(t.role, F.lit("")), F.lit(OPEN), F.lit("< |")), F.lit(MIDDLE))).cast("long").alias("head"),
            F.coalesce(t.role == LEARNED, F.lit(False)).alias("learned"),
        ),
    )
    kind = "array<struct<start:long,end:long>>"
    return F.aggregate(
        sized,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("s")),
        lambda a, t: F.struct(
            (a.at + t["all"]).alias("at"),
            F.when(t.learned, F.concat(a.s, F.array(F.struct((a.at + t.head).alias("start"), (a.at + t["all"]).alias("end"))))).otherwise(a.s).alias("s"),
        ),
        lambda a: a.s,
    )


def pairs(turns: DataFrame, pair: Column, rejected: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt, chosen, rejected, their numbers of turns, and masks.

    ``pair`` numbers the pair of a turn's conversation and ``rejected`` says which side it is. The turns of a side
    are in the order of turn, role, text, nulls first; turns are equal when role and text are, null to null. The prompt is the longest
    common prefix, rendered once and never learned; each completion is the rest of its side, with the spans of the
    assistant's turns to learn. A completion is empty when its side is the prefix of the other. A pair with one side
    has no common prefix: the side is all completion and the missing one is null. Repeated turns are turns. Rows with
    a null conversation are no pair and go. An example is one row, so a conversation must fit into a row.
    """
    return _paired(_sides(turns, pair, rejected, id_col, turn_col, role_col, text_col))


def alternatives(turns: DataFrame, pair: Column, second: Column, seed: str = SEED, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pairs, as pairs() returns them, of each conversation (chosen) and the same one with another reply (rejected).

    For tables without pairs. ``pair`` puts two conversations together, ``second`` tells them apart. The rejected side
    is the conversation up to one of its learned turns after the first turn, chosen by a keyed hash of its id, and then the
    last learned turn of its partner; a conversation without such a turn is cut after its first. So the prompt has
    a turn at least. A partner that is missing or has no learned turn gives no reply, and the rejected completion is
    empty. pair_id and chosen_id are the conversation's id and rejected_id is its partner's. One shuffle, by pair.
    """
    both = _sides(turns, pair, second, id_col, turn_col, role_col, text_col)
    side = lambda id_, other, mine, theirs: F.struct(F.col(id_).alias("id"), F.col(other).alias("other"), F.col(mine).alias("t"), F.col(theirs).alias("o"))
    each = both.select(F.explode(F.array(side("chosen_id", "rejected_id", "c", "r"), side("rejected_id", "chosen_id", "r", "c"))).alias("x")).select("x.*").filter("id is not null")
    learned = lambda t: F.coalesce(t.role == LEARNED, F.lit(False))
    places = F.filter(F.transform("t", lambda t, i: F.when(learned(t) & (i > 0), i + 1)), lambda i: i.isNotNull())
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    each = each.withColumn("places", places)
    cut = F.coalesce(F.try_element_at("places", (number % F.greatest(F.size("places"), F.lit(1)) + 1).cast("int")), F.lit(2))
    reply = F.slice(F.filter("o", learned), F.lit(-1), F.lit(1))
    reply = F.when(F.size(F.filter("o", learned)) > 0, reply).otherwise(F.slice("o", F.lit(1), F.lit(0)))
    return _paired(each.select(F.col("id").alias("pair_id"), F.col("id").alias("chosen_id"), F.col("other").alias("rejected_id"), F.col("t").alias("c"), F.concat(F.slice("t", F.lit(1), cut - 1), reply).alias("r")))


def _sides(turns: DataFrame, pair: Column, rejected: Column, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """pair_id, chosen_id, rejected_id, c, r: the turns of both sides, in order."""
    rows = turns.select(pair.alias("pair_id"), rejected.alias("no"), col(id_col).alias("id"), F.struct(col(turn_col).alias("turn"), col(role_col).alias("role"), col(text_col).alias("text")).alias("x"))
    rows = rows.filter("pair_id is not null and no is not null")
    side = lambda no: F.collect_list(F.when(F.col("no") == no, F.col("x")))
    ids = lambda no: F.min(F.when(F.col("no") == no, F.col("id")))
    return rows.groupBy("pair_id").agg(ids(False).alias("chosen_id"), ids(True).alias("rejected_id"), F.sort_array(side(False)).alias("c"), F.sort_array(side(True)).alias("r"))


def _paired(both: DataFrame) -> DataFrame:
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), shorter), F.slice("r", F.lit(1), shorter), lambda a, b: a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text))
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("k", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rest = lambda name: F.slice(name, F.col("k") + 1, F.greatest(F.size(name) - F.col("k"), F.lit(0)))
    cut = both.select("pair_id", "chosen_id", "rejected_id", F.slice("c", F.lit(1), F.col("k")).alias("p"), rest("c").alias("c"), rest("r").alias("r"), (F.size("c") == 0).alias("no_c"), (F.size("r") == 0).alias("no_r"))
    here = lambda flag, value: F.when(~F.col(flag), value)
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.size("p").cast("long").alias("prompt_turns"),
        F.size("c").cast("long").alias("chosen_turns"),
        F.size("r").cast("long").alias("rejected_turns"),
        _rendered(F.col("p")).alias("prompt"),
        here("no_c", _rendered(F.col("c"))).alias("chosen"),
        here("no_r", _rendered(F.col("r"))).alias("rejected"),
        here("no_c", _mask(F.col("c"))).alias("chosen_mask"),
        here("no_r", _mask(F.col("r"))).alias("rejected_mask"),
    )
