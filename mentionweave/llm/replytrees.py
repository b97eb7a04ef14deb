"""Reply trees to training conversations: paths from root to leaf, ranked, and formatted with a loss mask. DataFrame functions only.

Messages point to the message that they answer. Paths are found by self-joins whose steps double:

1. `climbs`: after round k every message knows its 2^k-th ancestor and what is between (number of messages, sum of scores), from two
   halves of round k - 1. After log2(depth) rounds every message knows its root, its depth and the score of its branch; one that does takes no
   further part but as what others climb to.
2. Leaves are ranked within their root, and the best are chosen, before any path is written out.
3. `paths`: a chosen path starts as its leaf; each round, from the longest step to the shortest, adds to every message of a path so far the
   one that many steps up. Rows double from round to round and end as the rows of the output, so that all rounds together move twice that.

Ids travel alone; texts join them once, at the end. Many answers to one message make no group: an answer looks up its parent.

`Template` turns a path into one string. Every turn is [INST]role[/INST]text</s>; a control string within a role or a text gets a backslash after
its first character, and one that has backslashes there already gets one more, so that what is read back is what was written and no text can
end a turn. The loss mask has for each turn null or the (start, length) of the characters of its text in that turn, escapes included.

Defined results: a message whose parent is not in the table is a root, as is one without a parent; messages on a circle of answers, and those
that hang from one, have no root and are in no path; of rows with one id the least counts; rows without an id are left out; null scores count as
0; ties of branches go to the lesser leaf id; null roles and texts are empty; bytes that are no UTF-8 are the characters that Spark reads
in them; an empty table gives no rows. A conversation is one row of the output however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Control strings, as patterns of what comes after their first character and any backslashes.
_CONTROL = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the roles whose texts are under the loss mask."""

    learned: Sequence[str] = ("assistant",)

    @staticmethod
    def escape(text: Column) -> Column:
        return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")

    def turn(self, role: Column, text: Column) -> Column:
        """struct(piece, loss): a turn as text, and what of it is learned."""
        inside, head = self.escape(F.coalesce(text, F.lit(""))), F.concat(F.lit("[INST]"), self.escape(F.coalesce(role, F.lit(""))), F.lit("[/INST]"))
        loss = F.when(role.isin(*self.learned), F.struct((F.length(head) + 1).alias("start"), F.length(inside).alias("length")))
        return F.struct(F.concat(head, inside, F.lit("</s>")).alias("piece"), loss.alias("loss"))

    @staticmethod
    def pieces(formatted: Column) -> Column:
        """The turns of a formatted conversation, without their ends."""
        cut = F.split(formatted, "</s>", -1)
        return F.slice(cut, 1, F.size(cut) - 1)

    def read(self, formatted: Column) -> Column:
        """array(struct(role, text)) of a formatted conversation."""

        def one(piece: Column) -> Column:
            parts = F.split(piece, r"\[/INST\]", 2)
            return F.struct(self.unescape(F.substring(parts[0], len("[INST]") + 1, 1 << 30)).alias("role"), self.unescape(parts[1]).alias("text"))

        return F.transform(self.pieces(formatted), one)

    def learned_texts(self, formatted: Column, loss: Column) -> Column:
        """The texts under the loss mask, in order, read through the mask's places."""
        both = F.filter(F.arrays_zip(self.pieces(formatted).alias("piece"), loss.alias("loss")), lambda z: z["loss"].isNotNull())
        return F.transform(both, lambda z: self.unescape(F.substr(z["piece"], z["loss"]["start"], z["loss"]["length"])))


def climbs(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, root, depth, score of the branch down to it for every message that has a root; the tables of ancestors 1, 2, 4... steps up).

    `messages`: id, parent, score; ids distinct. What a round makes is a table of its own, so that no round computes an earlier one again.
    """
    known = messages.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    state = messages.select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).join(known, "parent", "left")
    up = F.when(F.col("known"), F.col("parent"))
    state = written(state.select("id", up.alias("up"), F.coalesce(up, "id").alias("root"), F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("depth"), "score"), "tree-climb")
    bound = state.count().bit_length()  # a longer climb than there are messages goes in circles
    steps: list[DataFrame] = []
    climbing, there = state.where("up is not null"), state.where("up is null")
    while len(steps) <= bound and not climbing.isEmpty():
        steps.append(climbing)
        half = climbing.unionByName(there).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        moved = climbing.join(half, "up").select("id", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"))
        moved = written(moved, "tree-climb")
        climbing, there = moved.where("up is not null"), there.unionByName(moved.where("up is null"))
    return there.drop("up"), steps


def branches(messages: DataFrame, reached: DataFrame, best: int | None) -> DataFrame:
    """leaf, root, depth, score, rank: the leaves whose branches score best within their root."""
    leaves = reached.join(messages.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "id"))
    ranked = leaves.select(F.col("id").alias("leaf"), "root", "depth", "score", rank.alias("rank"))
    return ranked if best is None else ranked.where(F.col("rank") <= best)  # with a bound, tasks keep that many a root before they shuffle


def paths(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """leaf, id, below: the messages of each chosen path, and how far below them its leaf is."""
    rows = chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("below"))
    for k in range(len(steps) - 1, -1, -1):
        joined = rows.join(steps[k].select("id", "up"), "id", "left")
        both = F.array(F.struct("id", "below"), F.struct(F.col("up").alias("id"), (F.col("below") + (1 << k)).alias("below")))
        rows = joined.select("leaf", F.explode(F.filter(both, lambda x: x["id"].isNotNull())).alias("of")).select("leaf", "of.id", "of.below")
    return rows


def conversations(messages: DataFrame, best: int | None = 1, template: Template = Template(), carried: Sequence[str] = ()) -> DataFrame:
    """root, leaf, rank, score, n_turns, formatted, loss and the root's `carried` columns, a row a chosen path.

    `messages`: id, parent (of one type), score, role, text, and `carried` ones.
    """
    given = messages.where("id is not null")
    order = F.row_number().over(Window.partitionBy("id").orderBy("parent", "score", "role", "text"))
    given = written(given.withColumn("once", order).where("once = 1").drop("once"), "tree-messages")
    reached, steps = climbs(given.select("id", "parent", "score"))
    chosen = written(branches(given, reached, best), "tree-branches")
    turns = paths(chosen, steps).join(given.select("id", template.turn(F.col("role"), F.col("text")).alias("turn"), *carried), "id")
    turns = turns.groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("below")).alias("at"), "turn.piece", "turn.loss"))).alias("turns"), *[F.max_by(c, "below").alias(c) for c in carried]
    )
    made = turns.select(
        "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"), F.col("turns.loss").alias("loss"), *carried
    )
    return chosen.join(made, "leaf").select("root", "leaf", "rank", "score", "n_turns", "formatted", "loss", *carried)


def chained(turns: DataFrame, mark: str = "") -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) as messages, each the answer to the row before it; ties by role and text.

    Rows without a conversation are one. `mark` goes before the ids.
    """
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(own)
    numbered = turns.select("conv_id", "role", "text", at.alias("at"))
    name = F.concat(F.lit(mark), F.coalesce(F.col("conv_id").cast("string"), F.lit("?")))
    return numbered.select(
        F.concat_ws("/", name, "at").alias("id"), F.when(F.col("at") > 1, F.concat_ws("/", name, F.col("at") - 1)).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text", "conv_id",
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, from the output alone."""
    turns = template.read(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(template.learned_texts(F.col("formatted"), F.col("loss")), "")
    return formatted.select(
        "conv_id", F.size(template.pieces(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
