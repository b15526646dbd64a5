"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' tokens cut a conversation: the tokens after the system turn are divided into strides of what
the budget leaves beside the system turn and the history.  Turns within one stride make a window, and a turn that
crosses into the next makes its own, so no turn is ever cut and no window is over budget unless a single turn is.
Every window starts with the conversation's system turn and repeats the turns that began in the last
``history_tokens`` before it; of these nothing is trained again: the loss mask has each assistant turn once, in
the window where it is new.

Turns are numbered once: sorted by ranges, which cut a conversation of very many turns, and written to the folder that
the cluster shares.  Prefix sums run within a range and over the ranges' totals; only numbers take part until the turns
of the windows are known, and texts come last, by the turns' numbers.  A turn that very many windows repeat (a
conversation's system turn) is dealt over several tasks.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn.  In roles and texts a backslash is put behind every
backslash and behind the first character of every control string, the template's own and those of common chat templates; this
is undone by dropping the backslash behind each backslash, ``<`` and ``[``.

Defined results: a null role or text is empty; turns are ordered by ``turn`` (null first), then role, then text;
repeated rows are turns of their own; rows with a null ``conv_id`` are one conversation; only a first turn with
role ``system`` is the system turn; further columns are ignored; an empty table gives no windows; a window is one row,
however long its turns are, and :func:`verdicts` needs a row for a whole conversation, of 2 GB at most, as its
contract has one checksum of it.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.tables import checkpoint_dir, spread_join

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BUDGET_TOKENS, HISTORY_TOKENS = 2_048, 256
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
_CONTROL = r"\\|<(?=\||/?s>)|\[(?=/?INST\])"
_ESCAPED = r"([\\<\[])\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def estimated_tokens(text: Column) -> Column:
    """Words and signs of a text."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def numbered(conversations: DataFrame, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The turns' texts (``row``, ``role``, ``text``), and the turns themselves, without texts.

    The latter have ``conv_id``, ``row`` (which sorts all turns), ``role``, ``tokens``, ``pos`` (from 1), ``before`` (tokens of
    all earlier turns), ``n_turns`` of the conversation, and of its system turn ``sys_row`` and ``sys_tokens``.
    """
    checkpoint_dir(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (estimated_tokens(F.col("text")) if tokens is None else tokens.cast("long")) + TURN_TOKENS)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).checkpoint()

    light = placed.select("conv_id", "range", "row", "role", "tokens")
    first = F.min(F.struct("row", "role", "tokens")).alias("first")
    totals = light.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), first)
    ranges = Window.partitionBy("conv_id").orderBy("range")
    earlier, every = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first("first").over(every)
    system = lead["role"] == "system"
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum0"),
        F.sum("n").over(every).alias("n_turns"), F.when(system, lead["row"]).alias("sys_row"), F.when(system, lead["tokens"]).otherwise(0).alias("sys_tokens"),
    )
    inside = Window.partitionBy("conv_id", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = light.select("*", F.count("*").over(inside).alias("at"), F.sum("tokens").over(inside).alias("upto"))
    joined = at.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    turns = joined.select("conv_id", "row", "role", "tokens", (F.col("at") + F.col("n0")).alias("pos"), (F.col("upto") - F.col("tokens") + F.col("sum0")).alias("before"), "n_turns", "sys_row", "sys_tokens")
    return placed.select("row", "role", "text"), turns.checkpoint()


def windows(conversations: DataFrame, budget_tokens: int = BUDGET_TOKENS, history_tokens: int = HISTORY_TOKENS, tokens: Column | None = None) -> DataFrame:
    """``conv_id``, ``window``, ``n_tokens``, ``n_turns``, ``n_repeated``, ``formatted``, ``loss``.

    The first ``n_repeated`` turns of a window stand in an earlier one too; ``loss`` has the spans (``start`` from 0, ``size``,
    in code points of ``formatted``) of the assistant texts that are new.  The stride is no shorter than the
    history, so a window is over budget if its system turn takes more than the budget less twice the history.
    """
    texts, turns = numbered(conversations, tokens)
    is_system = F.coalesce(F.col("row") == F.col("sys_row"), F.lit(False))
    stride = F.greatest(F.lit(budget_tokens - history_tokens) - F.col("sys_tokens"), F.lit(history_tokens))
    rest = turns.where(~is_system).withColumn("start", F.col("before") - F.col("sys_tokens")).withColumn("stride", stride)
    first, last = F.floor(F.col("start") / F.col("stride")), F.floor((F.col("start") + F.col("tokens") - 1) / F.col("stride"))
    new = rest.withColumn("window", (first * 2 + F.when(last > first, 1).otherwise(0)).cast("long"))

    # the turns that began shortly before a window, found by stretches as long as the history
    spans = new.groupBy("conv_id", "window", "sys_row", "sys_tokens").agg(F.min("start").alias("from"))
    stretches = spans.select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w_window"), "from", F.floor(F.col("from") / history_tokens).alias("stretch"))
    stretch = F.floor(F.col("start") / history_tokens)
    near = rest.select("conv_id", "row", "tokens", "start", F.explode(F.array(stretch, stretch + 1)).alias("near"))
    history = near.join(stretches, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("near") == F.col("stretch"))).where((F.col("start") < F.col("from")) & (F.col("start") >= F.col("from") - history_tokens))

    own = new.select("conv_id", "window", "row", "tokens", F.lit(False).alias("again"))
    own = own.unionByName(history.select("conv_id", F.col("w_window").alias("window"), "row", "tokens", F.lit(True).alias("again")))
    own = own.unionByName(turns.where(is_system & (F.col("n_turns") == 1)).select("conv_id", F.lit(0).cast("long").alias("window"), "row", "tokens", F.lit(False).alias("again")))
    kept = spans.where("sys_row is not null").select("conv_id", "window", F.col("sys_row").alias("row"), F.col("sys_tokens").alias("tokens"), (F.col("from") > 0).alias("again")).checkpoint()
    times = kept.groupBy("row").agg(F.count("*").alias("times"))
    systems = texts.join(times, "row")
    pieces = own.join(texts, "row").unionByName(spread_join(kept, systems, ["row"], "times", kept.count()).drop("times"))

    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    pieces = pieces.select("conv_id", "window", "tokens", F.struct("row", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), "again", ((F.col("role") == "assistant") & ~F.col("again")).alias("target")).alias("turn"))
    grouped = pieces.groupBy("conv_id", "window").agg(F.sum("tokens").alias("n_tokens"), F.sort_array(F.collect_list("turn")).alias("turns"))
    no_spans = F.array().cast("array<struct<start:int,size:int>>")
    laid = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("end"), no_spans.alias("loss")),
        lambda acc, t: F.struct(
            (acc["end"] + F.length(t["piece"])).alias("end"),
            F.when(t["target"], F.concat(acc["loss"], F.array(F.struct((acc["end"] + t["head"]).alias("start"), t["body"].alias("size"))))).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    return grouped.select("conv_id", "window", "n_tokens", F.size("turns").alias("n_turns"), F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), laid["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and trained texts of each window, parsed from ``formatted`` and ``loss`` alone.

    ``conv_id``, ``window``, ``n_repeated``, ``turns``: array of (role, text), ``targets``: array of texts.
    """
    # a raw "<|" is never part of a role or text
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.col("n_turns"))
    parts = F.transform(pieces, lambda p: F.split(p, r"<\|(?:text|end)\|>", -1))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["size"])))
    return formatted.select("conv_id", "window", "n_repeated", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def verdicts(formatted: DataFrame) -> DataFrame:
    """The digest of :func:`windows` for each conversation, of what is new in each window."""
    back = read_back(formatted)
    new = F.slice("turns", F.col("n_repeated") + 1, F.size("turns"))
    told = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv_id", "window", F.size(new).cast("long").alias("n"), told.alias("told"), F.array_join("targets", "").alias("loss"), "chars")
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("loss")).alias("loss_chars"), F.sort_array(F.collect_list(F.struct("window", "told", "loss"))).alias("all"))
    digest = lambda name: F.sha2(F.array_join(F.transform("all", lambda w: w[name]), "").cast("binary"), 256)
    return whole.select("conv_id", "n_turns", digest("told").alias("turns_sha256"), "loss_chars", digest("loss").alias("loss_sha256"), "formatted_chars")
