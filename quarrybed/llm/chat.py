"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with `>` quote; the number of markers is the level. Lines of one level that follow each other are a
passage; an empty line, quoted or not, ends it. Passages are normalised (markers off, case and white space folded, lines
joined by blanks), so a quotation that was wrapped anew is the same passage. A passage's original is the first earlier
message of the conversation that says it unquoted: hashes of the passage's first words are joined to hashes of the
messages' word windows, and what meets is compared as a whole. Only conversations with a quote take part in this.

A message replies to the message that most words of its passages of the first level come from (the later one of two
equals). Where only deeper passages link, the outermost of them decide: who quotes X through somebody else replies to the
last earlier message that itself replies to X by quoting it, or to X if there is none. Without any linked
passage the reply is to the message before. Quotes are then taken out, and messages are placed in reply order: a
reply always follows what it replies to, so the order of turns is a reply order.

Edge cases: null texts are empty; rows without conv_id form the conversation null; messages that share a
(conv_id, turn) are told apart by role and text and are one place in the reply chain; a null turn is a place of its
own, first of all, that nothing replies to; repeated rows all stay; quotes of text that no earlier message holds stay
unlinked; a message of quotes only ends up empty; very long texts are cut into words once; an empty table gives no rows;
other columns of the messages, whatever their names, are left out.
No step gathers a conversation in one task: places and predecessors go by blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rounds, persist_shared

#: Fixed value: quote markers at the start of a line.
MARKS = r"^[ \t]*(>[ \t]?)+"
BLOCK = 1024
#: Words whose hash a passage is looked up by; passages of fewer words by all of theirs.
NEEDLE = 4


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normalised(line: Column) -> Column:
    """Without markers, lower-cased, white space folded."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def quoting(messages: DataFrame) -> DataFrame:
    """conv_id of the conversations with a quote."""
    return messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()


def said(messages: DataFrame) -> DataFrame:
    """conv_id, turn and words (folded, between blanks) of what messages say unquoted."""
    own = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.when(quote_level(x) == 0, normalised(x))), lambda x: x.isNotNull() & (x != ""))
    return messages.select("conv_id", "turn", F.array_join(own, " ").alias("words")).where("words <> ''")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, words and n of every quoted passage."""
    line = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), quote_level(x).alias("level"), normalised(x).alias("s")))
    kept = messages.select("conv_id", "turn", line.alias("_l"))
    # passages as a fold over the lines: (level, words, open), where only an open one of the same level goes on
    one = "struct<level:int,words:string,open:boolean>"
    fold = F.expr(
        f"""aggregate(_l, cast(array() as array<{one}>), (a, x) -> case
            when x.s = '' or x.level = 0 then if(size(a) > 0 and element_at(a, -1).open,
                concat(slice(a, 1, size(a) - 1), array(named_struct('level', element_at(a, -1).level, 'words', element_at(a, -1).words, 'open', false))), a)
            when size(a) > 0 and element_at(a, -1).open and element_at(a, -1).level = x.level then
                concat(slice(a, 1, size(a) - 1), array(named_struct('level', x.level, 'words', concat(element_at(a, -1).words, ' ', x.s), 'open', true)))
            else concat(a, array(named_struct('level', x.level, 'words', x.s, 'open', true))) end)"""
    )
    # messages without a quoted line need no fold
    some = kept.where(F.exists("_l", lambda x: (x["level"] > 0) & (x["s"] != "")))
    rows = some.select("conv_id", "turn", F.posexplode(fold).alias("place", "p"))
    return rows.select("conv_id", "turn", "place", F.col("p.level").alias("level"), F.col("p.words").alias("words"), F.size(F.split("p.words", " ")).alias("n"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def linked_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, n (words) and origin of every quoted passage; origin is null where no earlier message says it."""
    convs = persist_shared(quoting(messages), "quoting").select(F.col("conv_id").alias("_q"))
    rows = messages.join(convs, _same("conv_id", "_q"), "left_semi")
    p = persist_shared(passages(rows), "passages")
    key = lambda w, i, n: F.xxhash64(F.slice(w, i, n))
    probes = p.withColumn("_w", F.split("words", " ")).withColumn("_k", F.least("n", F.lit(NEEDLE)))
    probes = probes.withColumn("_h", key(F.col("_w"), 1, F.col("_k"))).drop("_w")
    # windows of the needle's length, and for short passages of one to three words
    w = said(rows).withColumn("_w", F.split("words", " ")).withColumn("_m", F.size("_w"))
    sizes = w.withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(NEEDLE)))))
    windows = sizes.select(F.col("conv_id").alias("_c"), F.col("turn").alias("origin"), "_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_m") - F.col("_k") + 1), lambda i: F.xxhash64(F.slice("_w", i, F.col("_k")))))).alias("_h"))
    windows = windows.select("_c", "origin", F.col("_k").alias("_wk"), F.col("_h").alias("_wh")).distinct()
    met = probes.join(windows, _same("conv_id", "_c") & (F.col("_k") == F.col("_wk")) & (F.col("_h") == F.col("_wh")) & (F.col("origin") < F.col("turn")))
    met = met.select("conv_id", "turn", "place", "words", "origin")
    texts = w.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.concat(F.lit(" "), "words", F.lit(" ")).alias("_said"))
    whole = met.join(texts, _same("conv_id", "_c") & (F.col("origin") == F.col("_t"))).where(F.contains("_said", F.concat(F.lit(" "), "words", F.lit(" "))))
    first = whole.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("words").alias("_v")).agg(F.min("origin").alias("origin"))
    return p.join(first, _same("conv_id", "_c") & (F.col("turn") == F.col("_t")) & (F.col("words") == F.col("_v")), "left").select("conv_id", "turn", "level", "n", "origin")


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quoted and n_linked (passages) and quoted_turn: what each quoting message replies to."""
    p = persist_shared(linked_passages(messages), "links")
    counts = p.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("origin").alias("n_linked"))
    votes = p.where(F.col("origin").isNotNull()).groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max_by(F.struct("level", "origin"), F.struct((-F.col("level")).alias("l"), "n", "origin")).alias("b"))
    best = best.select("conv_id", "turn", F.col("b.level").alias("level"), F.col("b.origin").alias("origin"))
    direct = best.where("level = 1").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_by"), F.col("origin").alias("_of"))
    deep = best.where("level > 1").join(direct, _same("conv_id", "_c") & (F.col("origin") == F.col("_of")) & (F.col("_by") < F.col("turn")), "left")
    deep = deep.groupBy("conv_id", "turn", "origin").agg(F.max("_by").alias("_by")).select("conv_id", "turn", F.coalesce("_by", "origin").alias("quoted_turn"))
    to = best.where("level = 1").select("conv_id", "turn", F.col("origin").alias("quoted_turn")).unionByName(deep)
    to = to.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "quoted_turn")
    return counts.join(to, _same("conv_id", "_c") & (F.col("turn") == F.col("_t")), "left").select("conv_id", "turn", "n_quoted", "n_linked", "quoted_turn")


def without_quotes(text: Column) -> Column:
    lines = F.filter(lines_of(text), lambda x: quote_level(x) == 0)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """rows with their number from 0 in a conversation, by blocks of turns."""
    keyed = rows.withColumn("_b", F.floor(F.col("turn") / BLOCK))
    sizes = keyed.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id", "_b").orderBy(*order)) - 1)
    joined = ranked.join(starts, _same("conv_id", "_c") & _same("_b", "_sb"))
    return joined.withColumn(out, (F.col("_from") + F.col("_r")).cast("bigint")).drop("_b", "_c", "_sb", "_from", "_r")


def reply_tree(messages: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, turn, place (from 0), reply_to, n_quoted, n_linked: one row for each place in a conversation."""
    nodes = numbered(messages.select("conv_id", "turn").distinct(), ["turn"], "place").withColumn("_b", F.floor(F.col("place") / BLOCK))
    ends = nodes.groupBy("conv_id", "_b").agg(F.max_by("turn", "place").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("conv_id").orderBy("_b")))
    e = ends.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_eb"), "_before")
    within = Window.partitionBy("conv_id", "_b").orderBy("place")
    placed = nodes.withColumn("_prev", F.lag("turn").over(within)).join(e, _same("conv_id", "_c") & (F.col("_b") == F.col("_eb")))
    placed = placed.select("conv_id", "turn", "place", F.coalesce("_prev", "_before").alias("prev"))
    q = links.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "n_quoted", "n_linked", "quoted_turn")
    out = placed.join(q, _same("conv_id", "_c") & _same("turn", "_t"), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("conv_id", "turn", "place", F.coalesce("quoted_turn", "prev").alias("reply_to"), F.col("quoted_turn").isNotNull().alias("_jumps"), count("n_quoted"), count("n_linked"))


def with_depth(tree: DataFrame) -> DataFrame:
    """tree with depth, the number of replies above a message. Where no quotation links, that is the place in the chain;
    in the other conversations pointers double in each round."""
    tree = persist_shared(tree, "tree")
    jumping = persist_shared(tree.where("_jumps").select(F.col("conv_id").alias("_j")).distinct(), "jumping")
    # a null turn has nothing behind it that replies to it, so the chain starts anew after it
    nulls = tree.where("turn is null").select(F.col("conv_id").alias("_nc")).distinct()
    plain = tree.join(jumping, _same("conv_id", "_j"), "left_anti").join(nulls, _same("conv_id", "_nc"), "left_anti").withColumn("depth", F.col("place"))
    rest = tree.join(jumping.select("_j").unionByName(nulls.select(F.col("_nc").alias("_j"))).distinct(), _same("conv_id", "_j"), "left_semi")
    rounds = Rounds(tree.sparkSession, "depth")
    state = rounds.put(rest.withColumn("_at", F.col("reply_to")).withColumn("depth", F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("bigint")))
    while not state.where(F.col("_at").isNotNull()).isEmpty():
        up = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("_at").alias("_next"), F.col("depth").alias("_d"))
        joined = state.join(up, _same("conv_id", "_c") & (F.col("_at") == F.col("_t")), "left")
        state = rounds.put(joined.select(*rest.columns, F.col("_next").alias("_at"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    return plain.unionByName(state.drop("_at")).drop("_jumps")


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, reply_to, depth, n_quoted, n_linked and position (from 0, gapless)."""
    rows = messages.select("conv_id", "turn", "role", "text")
    tree = with_depth(reply_tree(rows, quote_links(rows)))
    t = tree.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "reply_to", "depth", "n_quoted", "n_linked")
    out = numbered(rows, ["turn", "role", "text"], "position").join(t, _same("conv_id", "_c") & _same("turn", "_t"))
    return out.select("conv_id", "turn", "role", without_quotes(F.col("text")).alias("text"), "reply_to", "depth", "n_quoted", "n_linked", "position")


def transcripts(formatted: DataFrame, part: int = BLOCK) -> DataFrame:
    """Conversations as text, in parts of `part` places at most: conv_id, part, n_messages, transcript."""
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n"))
    groups = formatted.groupBy("conv_id", F.floor(F.col("position") / part).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("position", said.alias("said"))))
    return groups.agg(F.count(F.lit(1)).alias("n_messages"), ordered.alias("m")).select(
        "conv_id", "part", "n_messages", F.array_join(F.transform("m", lambda x: x["said"]), "").alias("transcript")
    )
