"""Chat formatting with DataFrame functions only.

A declarative :class:`Template` names the control strings, the roles whose text bears
loss and the finite-state machine of permitted turn orders.  ``format_chats`` groups
rows into conversations, runs the machine with ``aggregate`` and emits text segments
with a loss flag each; ``read_back`` recovers the turns and the loss text from them.

Edge cases: a null text or role is an empty one; a null conversation id is a
conversation of its own; rows are ordered by turn (null first), ties by role and text,
repeated rows are all kept; an empty table gives no rows; extra columns are ignored.
A conversation that the machine refuses is still formatted, with ``valid`` false and
``bad_turn`` the first refused position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks an escaped control string; between the first two characters of the marker.
ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``sep`` + text + ``close`` for each turn."""

    open: str = "<|im_start|>"
    sep: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("asked", "answered")


def escape(text: Column) -> Column:
    """Put one more mark into every ``<`` marks ``|``, so that no control string is left."""
    return F.regexp_replace(text, f"<({ESCAPE}*)\\|", f"<$1{ESCAPE}|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"<({ESCAPE}*){ESCAPE}\\|", "<$1|")


def _machine(roles: Column, t: Template) -> Column:
    """struct(state, position of the first refused turn or null)."""
    table = F.create_map(*[F.lit(x) for s, row in t.moves.items() for r, to in row.items() for x in (f"{s}|{r}", to)])

    def step(acc: Column, role: Column) -> Column:
        to = F.element_at(table, F.concat(acc["state"], F.lit("|"), role))
        ok = acc["bad"].isNull() & to.isNotNull()
        return F.struct(
            F.when(ok, to).otherwise(F.lit("refused")).alias("state"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
            (acc["at"] + F.lit(1)).alias("at"),
        )

    first = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(roles, first, step)


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, bad_turn, segments array<struct<text, loss>>, formatted."""
    t = template
    turns = F.array_sort(
        F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    )
    chats = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))

    def pieces(x: Column) -> Column:
        mark = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            mark(F.concat(F.lit(t.open), F.url_encode(x["role"]), F.lit(t.sep)), no),
            mark(escape(x["text"]), x["role"].isin(*t.loss_roles)),
            mark(F.lit(t.close), no),
        )

    run = _machine(F.transform("turns", lambda x: x["role"]), t)
    return (
        chats.withColumn("run", run)
        .withColumn("segments", F.flatten(F.transform("turns", pieces)))
        .select(
            "conv_id",
            (F.col("run.bad").isNull() & F.col("run.state").isin(*t.accept)).alias("valid"),
            F.col("run.bad").alias("bad_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``turns`` parsed from the formatted text and ``loss_text`` from the mask."""
    t = template
    # The text ends with a close marker, so the last part of the split is empty.
    parts = F.split(F.col("formatted"), "\\Q" + t.close + "\\E", -1)
    heads = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.instr(p, t.sep)
        return F.struct(
            F.url_decode(F.substring(p, F.lit(len(t.open) + 1), at - F.lit(len(t.open) + 1))).alias("role"),
            unescape(F.substring(p, at + F.lit(len(t.sep)), F.length(p))).alias("text"),
        )

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.withColumn("turns", F.transform(heads, turn)).withColumn("loss_text", F.array_join(loss, ""))


def digest(chats: DataFrame) -> DataFrame:
    """The figures that a reader can compare with the input."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
