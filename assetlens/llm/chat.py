"""Chat formatting with Spark expressions only.

Template of a conversation (one string)::

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_part|>TEXT...]<|im_end|>\\n ...

Adjacent turns of one role share a block; ``<|im_part|>`` keeps them apart, so the original
turns can be read back.  Control strings inside texts or roles get a backslash after their
first character (one more if there are some already), which ``unescaped`` takes away again.

Turns are collected in two steps: chunks of ``CHUNK_TURNS`` turn numbers are sorted, merged by
array aggregation and rendered first, then the few chunk results of a conversation are put
together, so one very long conversation is rendered by many tasks and is gathered only as the
rendered value that the result needs anyway.

Cases: null text or role counts as empty; null ``turn`` sorts first; rows of equal turn are
ordered by role, then text, and repeated rows are all kept; a null ``conv_id`` is a
conversation of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, PART, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>\n"
#: What may follow "<" or "[" to make a control string (fixed values; regular expressions).
RESERVED = (r"s>", r"/s>", r"SYS>>", r"/SYS>>", r"INST\]", r"/INST\]", r"\|im_start\|>", r"\|im_sep\|>", r"\|im_part\|>", r"\|im_end\|>", r"\|endoftext\|>")
CHUNK_TURNS = 128
LEARNED = "assistant"

_CONTROL = "|".join(RESERVED)


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)(?={_CONTROL})", r"$1\\$2")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)(?={_CONTROL})", "$1$2")


def _between(before: Column, after: Column) -> Column:
    """What stands between two turns: a part mark within a role, else the end and start of blocks."""
    return F.when(before == after, F.lit(PART)).otherwise(F.concat(F.lit(CLOSE + OPEN), after, F.lit(SEP)))


_RANGES = "array<struct<start:int,end:int>>"


def _rendered(turns: Column) -> Column:
    """Sorted turns of one part -> (first, last role, text, loss), where adjacent turns of one role are merged."""
    start = F.struct(F.lit(None).cast("string").alias("role"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"), F.array().cast(_RANGES).alias("loss"))

    def add(acc: Column, x: Column) -> Column:
        joint = F.when(acc["role"].isNull(), F.lit("")).otherwise(_between(acc["role"], x["role"]))
        lo = acc["at"] + F.length(joint)
        hi = lo + F.length(x["text"])
        own = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        loss = F.when(x["role"] == LEARNED, F.concat(acc["loss"], own)).otherwise(acc["loss"])
        return F.struct(x["role"].alias("role"), hi.alias("at"), F.concat(acc["pieces"], F.array(joint, x["text"])).alias("pieces"), loss.alias("loss"))

    def finish(acc: Column) -> Column:
        return F.struct(turns[0]["role"].alias("first"), acc["role"].alias("last"), F.array_join(acc["pieces"], "").alias("text"), acc["at"].alias("size"), acc["loss"].alias("loss"))

    return F.aggregate(turns, start, add, finish)


def format_chats(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, text, loss, n_blocks).

    ``loss`` is the loss mask: ranges of code points of ``text``, ends exclusive, in order.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / chunk_turns).alias("chunk"),
        F.struct("turn", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text")).alias("row"),
    )
    # Rows of one turn number may be any number: a chunk is cut into parts of bounded length again.
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / chunk_turns).cast("int"))
    parts = chunks.select("conv_id", "chunk", F.transform(numbers, lambda k: F.struct(k.alias("number"), F.slice("rows", k * chunk_turns + 1, chunk_turns).alias("turns"))).alias("parts"))
    rendered = parts.select("conv_id", F.transform("parts", lambda p: F.struct(F.col("chunk"), p["number"].alias("number"), _rendered(p["turns"]).alias("part"))).alias("parts"))
    whole = rendered.groupBy("conv_id").agg(F.transform(F.sort_array(F.flatten(F.collect_list("parts"))), lambda p: p["part"]).alias("parts"))

    def placed(part: Column, i: Column) -> Column:
        before = F.get(F.col("parts"), i - 1)["last"]
        lead = F.when(i == 0, F.concat(F.lit(OPEN), part["first"], F.lit(SEP))).otherwise(_between(before, part["first"]))
        return F.struct(lead.alias("lead"), part["text"].alias("text"), part["size"].alias("size"), part["loss"].alias("loss"))

    def shifted(acc: Column, p: Column) -> Column:
        base = acc["at"] + F.length(p["lead"])
        ranges = F.transform(p["loss"], lambda r: F.struct((r["start"] + base).alias("start"), (r["end"] + base).alias("end")))
        return F.struct((base + p["size"]).alias("at"), F.concat(acc["loss"], ranges).alias("loss"))

    out = whole.select("conv_id", F.transform("parts", placed).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(CLOSE))
    loss = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast(_RANGES).alias("loss")), shifted)["loss"]
    out = out.select("conv_id", text.alias("text"), loss.alias("loss"))
    return out.withColumn("n_blocks", (F.size(F.split("text", r"\Q" + OPEN + r"\E", -1)) - 1).cast("long"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``: array of (role, text) read back from the formatted ``text``."""

    def block(b: Column) -> Column:
        halves = F.split(b, r"\Q" + SEP + r"\E", 2)
        body = F.replace(halves[1], F.lit(CLOSE), F.lit(""))
        role = unescaped(halves[0])
        return F.transform(F.split(body, r"\Q" + PART + r"\E", -1), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    blocks = F.split("text", r"\Q" + OPEN + r"\E", -1)
    return formatted.withColumn("turns", F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block)))


def learned_text(text: Column, loss: Column) -> Column:
    """All of ``text`` under the loss mask, in order, without escapes.

    Ranges are cut out of stretches of CHUNK_TURNS ranges: a long text isn't walked through for each.
    """
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(loss) - 1) / CHUNK_TURNS).cast("int")), lambda k: F.slice(loss, k * CHUNK_TURNS + 1, CHUNK_TURNS))

    def stretch(g: Column) -> Column:
        lo = F.element_at(g, 1)["start"]
        return F.struct(lo.alias("at"), g.alias("ranges"), F.substring(text, lo + 1, F.element_at(g, -1)["end"] - lo).alias("text"))

    def read(s: Column) -> Column:
        return F.array_join(F.transform(s["ranges"], lambda r: unescaped(F.substring(s["text"], r["start"] - s["at"] + 1, r["end"] - r["start"]))), "")

    return F.when(F.size(loss) > 0, F.array_join(F.transform(F.transform(groups, stretch), read), "")).otherwise("")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Digest of the formatted conversations, from the formatted output alone."""
    back = parse_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("learned", learned_text(F.col("text"), F.col("loss"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
