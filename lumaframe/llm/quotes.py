"""Chat formatting by quotation linking: replies are found by what they quote, and quotes are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.scratch import Scratch

#: Messages of a conversation are numbered in stretches of so many turns, so that no task holds a whole long one.
STRETCH = 1024
_PREFIX = r"^(?:[ \t]*>)+[ \t]?"
#: A line (or two, the first beginning with "On") that names the writer of the deeper quote below it.
_ATTRIBUTION = r"(?:^|\n)((?:>[ \t]?)*)(?:On [^\n]{0,300}\n\1)?(?![ \t]*>)[^\n]{0,300}?\b(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*\r?(?=\n(?:\1[ \t\r]*\n){0,3}\1[ \t]?>)"
#: From such a line on, a message without > signs is quoted.
_ORIGINAL = r"(?:^|\n)[ \t]*-{2,}[ \t]*(?:Original Message|Original message|Forwarded message|Forwarded Message|Ursprüngliche Nachricht|Mensaje original|Message d'origine)[ \t]*-{2,}[ \t]*\r?(?=\n|$)"
_HEADER = r"^(?:From|Sent|Date|To|Cc|Subject|Reply-To|Von|Gesendet|An|Betreff):[ \t]"


def normal(passage: Column) -> Column:
    """Lower case, letters and digits of any script, single spaces: the same however it was wrapped."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def _digest(passage: Column) -> Column:
    return F.sha2(normal(passage), 256)


def quote_lines(text: Column) -> Column:
    """Array of (depth, body, blank) of each line; depth counts the leading > signs and the marks of an original message above.

    Lines that only say who wrote the quote below them are left out; below a
    mark, header lines are blank.
    """

    def line(s: Column, above: Column) -> Column:
        body = F.regexp_replace(s, _PREFIX, "")
        signs = F.char_length(F.regexp_replace(F.regexp_extract(s, _PREFIX, 0), "[^>]", ""))
        return F.struct((signs + above).cast("int").alias("depth"), body.alias("body"), (body.rlike(r"^\s*$") | ((above > 0) & body.rlike(_HEADER))).alias("blank"))

    parts = F.split(F.regexp_replace(text, _ATTRIBUTION, ""), _ORIGINAL)
    return F.flatten(F.transform(parts, lambda part, k: F.transform(F.split(part, "\n"), lambda s: line(s, k))))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row: a one-element transform binds it to a variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(lines: Column) -> Column:
    """Array of (depth, passage): consecutive lines of one depth, joined; blank lines end a passage. Linear in the lines."""

    def runs(ls: Column) -> Column:
        at = lambda i: F.get(ls, i)
        edge = lambda i: (i == 0) | (i == F.size(ls)) | at(i)["blank"] | at(i - 1)["blank"] | (at(i)["depth"] != at(i - 1)["depth"])

        def between(edges: Column) -> Column:
            def run(k: Column) -> Column:
                begin, end = F.get(edges, k), F.get(edges, k + 1)
                passage = F.array_join(F.transform(F.slice(ls, begin + 1, end - begin), lambda x: x["body"]), "\n")
                return F.when(~at(begin)["blank"], F.struct(at(begin)["depth"].alias("depth"), passage.alias("passage")))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), run), lambda r: r.isNotNull())

        return _bound(F.filter(F.sequence(F.lit(0), F.size(ls)), edge), between)

    return _bound(lines, runs)


def _latest_before(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes (c, t, depth, h, size) with s, the latest earlier turn of the sources (c, s, h) that has the passage.

    As-of: quotes and sources of a passage are put in the order of turns,
    first inside each stretch of turns, then over the stretches, so no quote
    meets a source as a pair and no task holds all turns of a popular passage.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = quotes.select("c", "h", F.col("t").alias("turn"), F.lit(0).alias("kind"), "depth", "size", none(sources.schema["s"].dataType, "s"))
    said = sources.select("c", "h", F.col("s").alias("turn"), F.lit(1).alias("kind"), none("int", "depth"), none("int", "size"), "s")
    both = asked.unionByName(said).withColumn("stretch", F.expr(f"floor(turn / {STRETCH})"))
    inside = Window.partitionBy("c", "h", "stretch").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.where("kind = 1").groupBy("c", "h", "stretch").agg(F.max("s").alias("latest"))
    every = both.select("c", "h", "stretch").distinct().join(carried, ["c", "h", "stretch"], "left")
    every = every.select("c", "h", "stretch", F.max("latest").over(Window.partitionBy("c", "h").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = both.withColumn("here", F.last("s", ignorenulls=True).over(inside)).where("kind = 0").join(every, ["c", "h", "stretch"])
    return found.select("c", F.col("turn").alias("t"), "depth", "size", F.coalesce("here", "before").alias("s")).where("s is not null")


def _reply_order(threads: DataFrame, scratch: Scratch) -> DataFrame:
    """threads (c, thread, up: the thread it branches from) as c, thread and thread_place: each behind ``up``, with all that branches from it, in the order of turns.

    A walk through the tree enters and leaves every thread once; each step of
    the walk points to the next. Pointers double until they reach the end, so
    a step learns how many threads are entered from it on, in as many rounds
    as the count of threads has bits. No row holds more than one step.
    """
    staged = threads.withColumn("stretch", F.expr(f"floor(thread / {STRETCH})"))
    firsts = staged.groupBy("c", "up", "stretch").agg(F.min("thread").alias("first"))
    # Nulls of up are equal here, so they are compared as such.
    later = firsts.select("c", F.col("up").alias("_up"), F.col("stretch").alias("_stretch"), F.lead("first").over(Window.partitionBy("c", "up").orderBy("stretch")).alias("later")).withColumnRenamed("c", "_c")
    beside = staged.withColumn("beside", F.lead("thread").over(Window.partitionBy("c", "up", "stretch").orderBy("thread")))
    beside = beside.join(later, (F.col("c") == F.col("_c")) & F.col("up").eqNullSafe(F.col("_up")) & (F.col("stretch") == F.col("_stretch")))
    beside = beside.select("c", "thread", "up", F.coalesce("beside", "later").alias("beside"))
    below = firsts.where("up is not null").groupBy("c", F.col("up").alias("thread")).agg(F.min("first").alias("below"))
    step = lambda thread, leaves: F.struct(thread.alias("thread"), F.lit(leaves).alias("leaves"))
    enter = F.struct(step(F.col("thread"), False).alias("at"), F.when(F.col("below").isNotNull(), step(F.col("below"), False)).otherwise(step(F.col("thread"), True)).alias("next"), F.lit(1).cast("long").alias("n"))
    leave = F.struct(step(F.col("thread"), True).alias("at"), F.when(F.col("beside").isNotNull(), step(F.col("beside"), False)).when(F.col("up").isNotNull(), step(F.col("up"), True)).alias("next"), F.lit(0).cast("long").alias("n"))
    walk = scratch.write(beside.join(below, ["c", "thread"], "left").select("c", F.inline(F.array(enter, leave))), "walk")
    while not walk.where("next is not null").isEmpty():
        ahead = walk.select("c", F.col("at").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        walk = scratch.write(walk.join(ahead.hint("merge"), ["c", "next"], "left").select("c", "at", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "walk")
    entered = walk.where("not at.leaves").select("c", "at.thread", "n")
    count = entered.groupBy("c").agg(F.count("*").alias("_all"))
    return entered.join(count, "c").select("c", "thread", (F.col("_all") - F.col("n")).alias("thread_place"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row for each different message: what it answers, its thread and place, and its text without quotes.

    Returns conv_col, turn_col, role_col, parent_turn (the turn it answers,
    null for the first), thread_turn (the turn its thread begins with),
    thread_place (long, from 0: the thread's number in reply order), place
    (long, from 0 in its thread), quote_depth (deepest quote), quoted
    (depth and turn of the message that each level of its quotes is from, as
    far as one was found, by depth) and message (its text without quoted
    lines, what follows an original message's mark, and the lines that name the
    writer of a quote). Ordering by conv_col, thread_place and place gives each conversation in reply order: a reply comes after what
    it answers, and a thread's messages stand together.

    A level of quotes is from the earlier message whose passage, whole text or
    line it holds: the longest such passage counts, then the latest turn. A
    message answers the one that its outermost quotes are from. Without such a
    quote it answers the latest earlier turn. A message
    that answers any but the latest earlier turn begins a thread.

    Rows with a null conversation or turn belong nowhere and come back with
    nulls for parent, thread, both places and quoted. A null text is an empty message.
    Rows equal in all four columns are one message; different messages of one
    turn follow each other by role and text, and the first of them stands for
    the turn where it is quoted. Other columns are ignored.
    """
    scratch = scratch or Scratch(messages.sparkSession)
    plain = messages.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    parsed = plain.select("c", "t", "role", F.explode(F.array(quote_lines(F.col("text")))).alias("lines"))  # a generated column is computed once
    own = F.transform(F.filter("lines", lambda x: x["depth"] == 0), lambda x: x["body"])
    parsed = parsed.select("c", "t", "role", F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n")).alias("message"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["depth"])), F.lit(0)).alias("quote_depth"), _runs(F.col("lines")).alias("runs"))
    parsed = scratch.write(parsed, "messages")
    placed = parsed.where("c is not null and t is not null")

    quotes = placed.where("quote_depth > 0").select("c", "t", F.explode(F.filter("runs", lambda r: r["depth"] > 0)).alias("run"))
    quotes = quotes.select("c", "t", "run.depth", F.explode(F.concat(F.array("run.passage"), F.split("run.passage", "\n"))).alias("p"))
    quotes = quotes.select("c", "t", "depth", _digest(F.col("p")).alias("h"), F.char_length(normal(F.col("p"))).alias("size")).where("size > 0").distinct()
    talked = placed.join(placed.where("quote_depth > 0").select("c").distinct(), "c", "left_semi")  # only conversations that quote at all
    passages = F.filter("runs", lambda r: r["depth"] == 0)
    sources = talked.select("c", F.col("t").alias("s"), F.explode(F.concat(F.array("message"), F.transform(passages, lambda r: r["passage"]), F.flatten(F.transform(passages, lambda r: F.split(r["passage"], "\n"))))).alias("p"))
    sources = sources.select("c", "s", _digest(F.col("p")).alias("h")).distinct()
    levels = _latest_before(quotes, sources).groupBy("c", "t", "depth").agg(F.max(F.struct("size", "s")).alias("best")).select("c", "t", "depth", F.col("best.s").alias("turn"))
    found = scratch.write(levels.groupBy("c", "t").agg(F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("quoted")), "quoted")
    first = F.get(F.filter("quoted", lambda q: q["depth"] == 1), F.lit(0))["turn"]

    turns = placed.select("c", "t").distinct().withColumn("stretch", F.expr(f"floor(t / {STRETCH})"))
    before = Window.partitionBy("c", "stretch").orderBy("t")
    ends = turns.groupBy("c", "stretch").agg(F.max("t").alias("end"))
    ends = ends.select("c", "stretch", F.lag("end").over(Window.partitionBy("c").orderBy("stretch")).alias("last_end"))
    chain = turns.withColumn("prev", F.lag("t").over(before)).join(ends, ["c", "stretch"]).select("c", "t", "stretch", F.coalesce("prev", "last_end").alias("prev"))
    chain = chain.join(found.select("c", "t", first.alias("answered")), ["c", "t"], "left").withColumn("parent", F.coalesce("answered", "prev")).drop("answered")
    chain = chain.withColumn("starts", F.col("prev").isNull() | (F.col("parent") != F.col("prev")))

    # A thread runs from its first message to the next one's; the latest start carries over stretches.
    start = F.when(F.col("starts"), F.col("t"))
    inside = F.last(start, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    carried = chain.groupBy("c", "stretch").agg(F.max(start).alias("latest"))
    carried = carried.select("c", "stretch", F.max("latest").over(Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    chain = chain.withColumn("inside", inside).join(carried, ["c", "stretch"]).withColumn("thread", F.coalesce("inside", "carry")).drop("inside", "carry")
    chain = scratch.write(chain, "turns")

    heads = chain.where("starts").select("c", F.col("thread"), F.col("parent").alias("at"))
    up = heads.join(chain.select("c", F.col("t").alias("at"), F.col("thread").alias("up")), ["c", "at"], "left").select("c", "thread", "up")
    order = _reply_order(scratch.write(up, "threads"), scratch)

    messages_of = placed.join(chain.select("c", "t", "stretch", "parent", "thread"), ["c", "t"])
    counts = messages_of.groupBy("c", "thread", "stretch").agg(F.count("*").alias("n"))
    counts = counts.select("c", "thread", "stretch", F.coalesce(F.sum("n").over(Window.partitionBy("c", "thread").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("c", "thread", "stretch").orderBy("t", "role", "message"))
    messages_of = messages_of.join(found, ["c", "t"], "left").withColumn("quoted", F.coalesce("quoted", F.array().cast(found.schema["quoted"].dataType)))
    out = messages_of.withColumn("rank", rank).join(counts, ["c", "thread", "stretch"]).join(order, ["c", "thread"])
    out = out.select("c", "t", "role", F.col("parent").alias("parent_turn"), F.col("thread").alias("thread_turn"), "thread_place", (F.col("rank") + F.col("skip") - 1).cast("long").alias("place"), "quote_depth", "quoted", "message")
    lost = parsed.where("c is null or t is null").select("c", "t", "role", *[F.lit(None).cast(out.schema[x].dataType).alias(x) for x in ("parent_turn", "thread_turn", "thread_place", "place")], "quote_depth", F.lit(None).cast(out.schema["quoted"].dataType).alias("quoted"), "message")
    return out.union(lost).select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("role").alias(role_col), "parent_turn", "thread_turn", "thread_place", "place", F.col("quote_depth").cast("long").alias("quote_depth"), "quoted", "message")
