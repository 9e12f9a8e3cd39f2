"""Chat text from conversations: a finite-state machine over roles and a declarative template.

A template names the markers of a turn, the roles whose text is learned from, the
control strings that no text may forge, and the transitions between roles. The
machine checks the order of turns; the formatter emits segments (marker, text,
marker), each with its loss flag: only the text of a learned role carries loss,
never a marker.

Escaping is reversible: a backslash, and the first character of every control
string inside a text, become a backslash and a digit. A control string's first
character occurs nowhere else in a control string (checked when the template is
made), so an escaped text holds none and none arises at a seam.

Conversations are dealt out by id and stream through in order of turn, so memory
holds one turn, however long the conversation.

Defined results: rows go by turn, nulls last, ties by role and then text; a null
text or role is empty; a null id is a conversation of its own; an unknown, missing
or misplaced role makes the conversation invalid (``valid`` false) but is formatted
all the same; repeated rows are turns of their own; an empty table gives an empty
result. Extra columns don't matter: only the four named ones are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers, control strings, learned roles and allowed transitions (from "" at the start)."""
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self):
        first = {c[0] for c in self.control}
        if not {self.open, self.close} <= set(self.control):
            raise ValueError("the markers must be control strings")
        if any(x in first or x == "\\" for c in self.control for x in c[1:]) or "\\" in first or len(first) > 8:
            raise ValueError("a control string's first character must occur nowhere else in one; no backslashes")


CHATML = Template()


class Formatter:
    """Escaping, formatting and reading back for one template."""

    def __init__(self, template: Template = CHATML):
        self.t = template
        first = sorted({c[0] for c in template.control})
        self.code = {"\\": "\\0", "\n": "\\9"} | {c: f"\\{i}" for i, c in enumerate(first, 1)}
        self.char = {v: k for k, v in self.code.items()}
        found = "|".join(re.escape(c) for c in sorted(template.control, key=len, reverse=True))
        self.special = re.compile(rf"\\|(?={found}).", re.S)
        self.escaped = re.compile(r"\\[0-9]")
        head, tail = re.escape(template.open), re.escape(template.close + template.after_turn)
        self.turn = re.compile(rf"{head}(.*?){re.escape(template.after_role)}(.*?){tail}", re.S)

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: self.code[m.group()], text)

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", self.code["\n"])

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: self.char[m.group()], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """One turn as (text, loss) segments."""
        t = self.t
        return [(t.open + self.escape_role(role) + t.after_role, False), (self.escape(text), role in t.learned),
                (t.close + t.after_turn, False)]

    def allowed(self, state: str | None, role: str) -> str | None:
        """The machine's next state; None once the order is broken."""
        return role if state is not None and role in self.t.order.get(state, ()) else None


def format_conversations(convs: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments in order: conv_id, turn_no, seg_no, role, text, loss, valid (so far).

    The rows of a conversation follow each other in one partition.
    """
    t = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    kind = convs.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now, state, turn_no, seg_no = Formatter(template), object(), "", 0, 0
        for b in batches:
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if conv != now:
                    now, state, turn_no, seg_no = conv, "", 0, 0
                state = f.allowed(state, role)
                for part, loss in f.segments(role, text):
                    out.append((conv, turn_no, seg_no, role, part, loss, state is not None))
                    seg_no += 1
                turn_no += 1
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["conv_id", "turn_no", "seg_no", "role", "text", "loss", "valid"])

    return t.mapInArrow(run, f"conv_id {kind}, turn_no bigint, seg_no bigint, role string, text string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template = CHATML, ordered: bool = False) -> DataFrame:
    """Per conversation, from the formatted text and its loss flags alone: the contract's counts and digests.

    ``ordered``: the rows come as ``format_conversations`` emits them; otherwise they are dealt and sorted again.
    """
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seg_no")
    s = segments.select("conv_id", "text", "loss", "valid")
    kind = s.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        now, held, row_type = object(), None, None

        def done(c: dict) -> tuple:
            if c["rest"]:
                raise ValueError("the formatted text doesn't end with a turn")
            return (c["conv"], c["turns"], c["all"].hexdigest(), c["chars"], c["learn"].hexdigest(), c["formatted"], c["valid"])

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [row_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            row_type, out = b.schema.field(0).type, []
            for conv, text, loss, valid in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if conv != now:
                    if held:
                        out.append(done(held))
                    now = conv
                    held = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "learn": hashlib.sha256(), "chars": 0,
                            "formatted": 0, "valid": True, "rest": ""}
                held["formatted"] += len(text)
                held["valid"] &= valid
                if loss:
                    learned = f.unescape(text)
                    held["chars"] += len(learned)
                    held["learn"].update(learned.encode("utf-8", "surrogatepass"))
                held["rest"] += text
                if text.endswith(f.t.close + f.t.after_turn):
                    at = 0
                    for m in f.turn.finditer(held["rest"]):
                        if m.start() != at:
                            raise ValueError("text between turns")
                        at = m.end()
                        role, said = f.unescape(m.group(1)), f.unescape(m.group(2))
                        held["turns"] += 1
                        held["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    held["rest"] = held["rest"][at:]
            if out:
                yield batch(out)
        if held:
            yield batch([done(held)])

    return s.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                             "formatted_chars bigint, valid boolean")


def op3_chat(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """Contract rows: all conversations, and number -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = convs.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        "role", "text").unionByName(extra)
    return read_back(format_conversations(rows), ordered=True)
