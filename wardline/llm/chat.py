"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, then a template.

Everything is a column expression. A record is a JSON document; its nested field paths are hashed, and the hash
selects one of the declared layouts (messages with role and content, prompt and response, instruction, ...).
The template marks turns, escapes control strings inside texts so that they can be read back, and keeps the
spans of the text to learn from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.texts import named, others

# The marks of the template, and the strings that common chat templates treat as control strings.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = [r"\|im_start\|>", r"\|im_sep\|>", r"\|im_end\|>", r"\|endoftext\|>", "s>", "/s>", "<SYS>>", "</SYS>>", r"INST\]", r"/INST\]"]
CONTROL_PATTERN = r"(<|\[)(" + "|".join(CONTROLS) + ")"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout of records: ``paths`` is the shape its fingerprint is taken from (see ``shape``).

    Either ``items`` is the path of a list of messages with fields ``role`` and ``text``, whose roles are renamed
    where ``rename`` is set, or ``fields`` lists the role and path of each turn; ``optional`` paths that are
    empty give no turn, and ``joined`` paths are appended to the turn before after a blank line.
    """

    name: str
    paths: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    rename: bool = False
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()
    joined: tuple[str, str] | None = None


LAYOUTS = [
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", items="messages"),
    Layout("messages_empty", "OBJECT<messages: ARRAY<>>", items="messages"),
    Layout("sharegpt", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", items="conversations", role="from", text="value", rename=True),
    Layout("sharegpt_empty", "OBJECT<conversations: ARRAY<>>", items="conversations", role="from", text="value", rename=True),
    Layout("prompt", "OBJECT<prompt, response>", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", "OBJECT<completion, prompt>", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", "OBJECT<prompt, response, system>", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", "OBJECT<instruction, output>", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", "OBJECT<input, instruction, output>", fields=(("user", "instruction"), ("assistant", "output")), joined=("instruction", "input")),
    Layout("nested", "OBJECT<data: OBJECT<answer: OBJECT<text>, question: OBJECT<text>>>", fields=(("user", "data.question.text"), ("assistant", "data.answer.text"))),
]


def shape(record: Column) -> Column:
    """The nested field paths of a variant without the types of leaves: ``OBJECT<messages: ARRAY<OBJECT<content, role>>>``.

    Fields come in the order of their names; a list stands for all its members together.
    """
    leaf = r"[A-Z_]+(?:\(\d+,\d+\))?"
    paths = F.regexp_replace(F.schema_of_variant(record), rf": {leaf}(?=[,>])", "")
    return F.regexp_replace(paths, rf"ARRAY<{leaf}>", "ARRAY<>")


def fingerprint(shaped: Column) -> Column:
    return F.xxhash64(shaped)


def _item_turns(record: Column, layout: Layout) -> Column:
    listed = F.variant_get(record, f"$.{layout.items}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
    renames = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])

    def turn(item: Column) -> Column:
        role = F.coalesce(item[layout.role], F.lit(""))
        role = F.coalesce(F.try_element_at(renames, role), role) if layout.rename else role
        return F.struct(role.alias("role"), F.coalesce(item[layout.text], F.lit("")).alias("text"))

    return F.transform(listed, turn)


def _field_turns(record: Column, layout: Layout) -> Column:
    value = lambda path: F.coalesce(F.variant_get(record, f"$.{path}", "string"), F.lit(""))
    turns = []
    for role, path in layout.fields:
        text = value(path)
        if layout.joined and layout.joined[0] == path:
            extra = value(layout.joined[1])
            text = F.when(extra == "", text).otherwise(F.concat(text, F.lit("\n\n"), extra))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    listed = F.array(*turns)
    dropped = [role for role, path in layout.fields if path in layout.optional]
    return F.filter(listed, lambda t: ~(t["role"].isin(*dropped) & (t["text"] == ""))) if dropped else listed


def canonical_turns(records: DataFrame, record: str = "record", layouts: list[Layout] | None = None) -> DataFrame:
    """``records`` with ``layout`` and ``turns`` (role and text) by the fingerprint of their JSON ``record``.

    Both are null for a record of no declared layout, for text that is not JSON, and for a null record: such
    rows stay, so that nothing is lost unseen. Null texts and roles are empty. Other columns stay; columns
    named like a result are replaced.
    """
    layouts = layouts or LAYOUTS
    kept = [c for c in others(records, ["layout", "turns"]) if c != record]
    parsed = records.select(*[named(records, c) for c in kept], F.try_parse_json(named(records, record)).alias("_record"))
    marked = parsed.withColumn("_print", fingerprint(shape(F.col("_record"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for own in reversed(layouts):
        hit = F.col("_print") == fingerprint(F.lit(own.paths))
        layout = F.when(hit, own.name).otherwise(layout)
        built = _item_turns(F.col("_record"), own) if own.items else _field_turns(F.col("_record"), own)
        turns = F.when(hit, built.cast(TURNS)).otherwise(turns)
    return marked.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """A backslash breaks every control string; backslashes are doubled first, so ``unescape`` is exact."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_PATTERN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_turns(chats: DataFrame, learned: str = "assistant") -> DataFrame:
    """``chats`` with ``formatted`` and ``loss_spans`` (start and length in code points) of their ``turns``.

    The loss mask covers the (escaped) texts of role ``learned``. No turns give an empty text; null turns give
    nulls.
    """
    segments = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape(t["role"]), F.lit(SEPARATOR)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned).alias("loss")
        ),
    )
    size = lambda s: F.char_length(s["head"]) + F.char_length(s["body"]) + len(END)
    with_sizes = chats.withColumn("_segments", segments).withColumn("_sizes", F.transform("_segments", size))
    spans = F.transform(
        "_segments",
        lambda s, i: F.struct(
            (F.aggregate(F.slice("_sizes", F.lit(1), i), F.lit(0).cast("int"), lambda a, x: a + x) + F.char_length(s["head"])).alias("start"),
            F.char_length(s["body"]).alias("length"), s["loss"].alias("loss"),
        ),
    )
    return with_sizes.withColumns({
        "formatted": F.array_join(F.transform("_segments", lambda s: F.concat(s["head"], s["body"], F.lit(END))), ""),
        "loss_spans": F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"])),
    }).drop("_segments", "_sizes")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>", 2))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def as_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn rows as one JSON record per conversation, each in the plainest layout that can hold it.

    A user and an assistant turn become a prompt or an instruction record, with a system turn before them a
    system prompt; others list messages. Turns go by number, ties by role and text. Null texts and roles are
    empty, rows with a null key are one conversation.
    """
    ordered = F.array_sort(F.collect_list(F.struct(named(rows, turn).alias("turn"), F.coalesce(named(rows, role), F.lit("")).alias("role"), F.coalesce(named(rows, text), F.lit("")).alias("text"))))
    chats = rows.groupBy(named(rows, key).alias("conv_id")).agg(ordered.alias("t"))
    roles, at = F.transform("t", lambda x: x["role"]), lambda i: F.col("t")[i]["text"]
    odd = F.pmod(F.col("conv_id"), F.lit(2)) == 1
    shared = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    other = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    return chats.select(
        "conv_id",
        F.when(pair & odd, F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("output"))))
        .when(pair, F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(triple, F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response"))))
        .when(odd & shared, F.to_json(F.struct(F.transform("t", lambda x: F.struct(other[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
        .alias("record"),
    )
