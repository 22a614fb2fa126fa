r"""Chat formatting with a grammar round trip (native DataFrame code).

Template of a turn: ``### `` role ``: `` text, newline, ``</turn>``, newline. A conversation
is its turns one after the other. The grammar is deterministic:

    conversation = { turn }
    turn         = "### " role ": " body "\n</turn>\n"
    role         = characters without ":", "#", "<" and newline; %25 %3A %23 %3C %0A stand for % : # < newline
    body         = characters in which every "### " and "</turn>" has a backslash before it

The parser cuts at the turn ends, takes role and body from each piece, drops one
backslash of each run before a control string, and decodes the role. A body that
holds a bare control string is no body.

Formatting is a round trip: every turn is first rendered as it is, parsed back and
compared with its source; the parts that do not come back (bare control strings, or
backslashes that the parser would drop) are escaped, rendered, parsed and compared
again. Escaped turns always come back, so the ladder has two steps; a turn that
fails both raises an error. Since a turn ends with a newline and starts with "#", no turn
end can span two turns, and conversations of such turns parse into just them.
``parse_conversations`` reads whole conversations and compares each turn with a
fingerprint of its source taken before rendering; a difference raises an error.

The loss mask of a conversation is run-length coded, one (prompt, loss, close) triple of code
points per turn, in order; the triples add up to the length of the text.

A map-side partial ``collect_list`` packs the turns of a task before the one shuffle, so a
conversation with many rows arrives as one row per map task. The text of a conversation
is one value, so a conversation has to fit in a row (2 GB).

Rows: null text and null role are empty; turns are ordered by turn number (null first), then
role, then rendered text; repeated rows are turns of their own; rows without
conv_id are one conversation. Other columns are ignored. No rows give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crmlake.llm.common import documents, written

# the template (fixed values)
HEAD, SEP, END = "### ", ": ", "\n</turn>\n"
CONTROL = "### |</turn>"
ROLE_CODES = [("%", "%25"), (":", "%3A"), ("#", "%23"), ("<", "%3C"), ("\n", "%0A")]
HEADER = r"\A### ([^:#<\n]*): "
RUN = r"(?<!\\)"              # only at the start of a run of backslashes: linear on any text
BARE = RUN + "(?:" + CONTROL + ")"
LOSS_ROLES = ("assistant",)


def escape_text(text: Column) -> Column:
    """One backslash before each control string and the backslashes that precede it."""
    return F.regexp_replace(text, RUN + r"(\\*+(?:" + CONTROL + "))", r"\\$1")


def unescape_text(body: Column) -> Column:
    return F.regexp_replace(body, RUN + r"\\(\\*+(?:" + CONTROL + "))", "$1")


def escape_role(role: Column) -> Column:
    for char, code in ROLE_CODES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def parse_turn(piece: Column) -> Column:
    """Struct (role, text, head: length of the header) of a turn without its end; null when it is no turn."""
    head = F.length(F.regexp_extract(piece, HEADER, 0))
    body = F.substr(piece, head + 1)
    parsed = F.struct(unescape_role(F.regexp_extract(piece, HEADER, 1)).alias("role"),
                      unescape_text(body).alias("text"), head.alias("head"))
    return F.when((head > 0) & ~F.rlike(body, F.lit(BARE)), parsed)


def rendered(role: Column, text: Column) -> Column:
    """The first rendering of the turn that parses back into ``role`` and ``text``."""
    out = F.raise_error(F.lit("a turn does not survive its round trip"))
    for r, t in ((escape_role(role), escape_text(text)), (role, text)):
        piece = F.concat(F.lit(HEAD), r, F.lit(SEP), t)
        # a turn end inside the piece would cut it; it holds a bare control string, so parse_turn says null
        back = parse_turn(piece)
        same = back["role"].eqNullSafe(role) & back["text"].eqNullSafe(text)
        out = F.when(same, piece).otherwise(out)
    return out


def fingerprint(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted, mask (array of prompt, loss, close) and sources (a fingerprint of each source turn)."""
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.select("conv_id", F.struct(
        "turn", "role", rendered(F.col("role"), F.col("text")).alias("piece"),
        fingerprint(F.col("role"), F.col("text")).alias("source")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def triple(t):
        head = F.length(F.regexp_extract(t["piece"], HEADER, 0))
        body = F.length(t["piece"]) - head
        loss = F.when(t["role"].isin(*loss_roles), body).otherwise(0)
        return F.struct((head + body - loss).alias("prompt"), loss.alias("loss"), F.lit(len(END)).alias("close"))
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["piece"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", triple).alias("mask"), F.col("turns.source").alias("sources"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, loss: the unescaped text under the mask), read from text and mask alone
    and compared with ``sources``."""
    end = F.lit(END)
    pieces = F.split(F.substr(F.col("formatted"), F.lit(1), F.length("formatted") - len(END)), END)
    whole = F.endswith("formatted", end) & (F.size("pieces") == F.size("mask"))
    cut = formatted.withColumn("pieces", pieces)
    turns = F.transform(F.arrays_zip("pieces", "mask"), lambda z: F.struct(
        parse_turn(z["pieces"]).alias("turn"), F.length(z["pieces"]).alias("n"), z["mask"].alias("mask"),
        unescape_text(F.substr(z["pieces"], z["mask"]["prompt"] + 1, z["mask"]["loss"])).alias("loss")))
    cut = cut.withColumn("read", F.when(whole, turns))
    # the mask has to cover the piece: prompt + loss = its length (the close is the turn's end)
    fits = F.forall("read", lambda t: t["n"] == t["mask"]["prompt"] + t["mask"]["loss"])
    found = F.transform("read", lambda t: fingerprint(t["turn"]["role"], t["turn"]["text"]))
    same = F.coalesce(F.col("read").isNotNull() & fits & (found == F.col("sources")), F.lit(False))
    read = F.transform("read", lambda t: F.struct(t["turn"]["role"].alias("role"), t["turn"]["text"].alias("text"),
                                                  t["loss"].alias("loss")))
    wrong = F.raise_error(F.concat(F.lit("not read back as it was written: conversation "),
                                   F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return cut.select("conv_id", "formatted", F.when(same, read).otherwise(wrong).alias("turns"))


def digest(parsed: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("all"),
                        F.array_join(F.col("turns.loss"), "").alias("under_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("under_loss").cast("long").alias("loss_chars"),
                      F.sha2("under_loss", 256).alias("loss_sha256"), "formatted_chars")


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """The contract's digests of all conversations and of conversation -7, from the written text and mask."""
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digest(parse_conversations(written(format_conversations(rows.unionByName(extra)), "chat")))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (SELECT *, regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g') AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || body || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
