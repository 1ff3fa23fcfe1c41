"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says what opens and closes a turn, which role may follow which, and whose text
carries loss. Texts are escaped so that no control string can stand inside one, and reading
the formatted text back gives the turns again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.tables import table


@dataclass(frozen=True)
class Template:
    """``mark`` opens a turn, ``after_role`` ends its header, ``close`` ends the turn; ``order``
    is the machine: state to role to state, from "start"; a conversation may end in ``ends``."""

    mark: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    order: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
        }
    )
    ends: frozenset = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        """A backslash goes before every backslash and every character that begins a control string."""
        return self._begins.sub(lambda m: "\\" + m[0], text)

    @property
    def _begins(self) -> re.Pattern:
        marks = (self.mark.strip(), self.after_role.strip(), self.close.strip())
        return re.compile("|".join(["\\\\", *(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks)]))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def check(self, roles: list[str]) -> tuple[bool, int]:
        """Whether the order is valid, and the first turn that breaks it, or how many there are."""
        state = "start"
        for k, role in enumerate(roles):
            state = self.order.get(state, {}).get(role)
            if state is None:
                return False, k
        return state in self.ends, len(roles)

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """The formatted text in pieces, each with its loss flag."""
        out = []
        for role, text in turns:
            out.append((self.mark + self.escape(role) + self.after_role, False))
            out.append((self.escape(text), role in self.loss_roles))
            out.append((self.close, False))
        return out

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text; raises where it isn't one."""

        def until(end: str, at: int) -> tuple[str, int]:
            begin = at
            while True:
                stop, slash = formatted.find(end, at), formatted.find("\\", at)
                if stop < 0:
                    raise ValueError(f"no end of what begins at {begin}")
                if slash < 0 or stop < slash:
                    return self.unescape(formatted[begin:stop]), stop + len(end)
                at = slash + 2

        turns, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.mark, at):
                raise ValueError(f"no turn at {at}")
            role, at = until(self.after_role, at + len(self.mark))
            text, at = until(self.close, at)
            turns.append((role, text))
        return turns


def _formatted(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                valid, stopped, texts, spans = [], [], [], []
                for rows in part.column(1).to_pylist():
                    turns = [(r["role"], r["text"]) for r in rows]
                    ok, k = template.check([r for r, _ in turns])
                    pieces, begin, own = template.segments(turns), 0, []
                    for piece, loss in pieces:
                        own.append({"begin": begin, "end": begin + len(piece), "loss": loss})
                        begin += len(piece)
                    valid.append(ok)
                    stopped.append(k)
                    texts.append("".join(p for p, _ in pieces))
                    spans.append(own)
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(valid), pa.array(stopped, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)],
                    names=["conv_id", "valid", "valid_turns", "formatted", "segments"],
                )

    return run


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, valid, valid_turns, formatted, segments)``, one row a conversation.

    ``segments`` are the pieces of ``formatted``, as code points from ``begin`` to before
    ``end``, with their loss flags. ``valid`` says whether the machine accepts the order of
    roles, ``valid_turns`` how many turns it took; invalid conversations are formatted too.

    Turns stand in the order of ``turn``, a null turn first, ties by role and text; repeated
    rows are turns of their own. Null texts and roles are empty. Rows with a null conv_id are
    one conversation. An empty table gives an empty table. Other columns are neither read nor
    returned. A conversation is one row of the result and has to fit a task.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(
        _formatted(template or Template()), "conv_id long, valid boolean, valid_turns long, formatted string, segments array<struct<begin: bigint, end: bigint, loss: boolean>>"
    )


def _read_back(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k in range(batch.num_rows):
                formatted = batch.column(1)[k].as_py()
                turns = template.read(formatted)
                loss = "".join(template.unescape(formatted[s["begin"] : s["end"]]) for s in batch.column(2)[k].as_py() if s["loss"])
                spoken = "".join(f"{r}\n{t}\n" for r, t in turns)
                row = (batch.column(0)[k].as_py(), len(turns), _sha(spoken), len(loss), _sha(loss), len(formatted), batch.column(3)[k].as_py())
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and digests of formatted conversations, from nothing but the text and its segments."""
    return formatted.select("conv_id", "formatted", "segments", "valid").mapInArrow(
        _read_back(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


#: A conversation whose texts look like the template's own control strings.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))


# the format is not SQL's to check, but all that is read back is, and the length follows from
# the escapes
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(role) + length(text) + length('### : ' || ' </turn>' || chr(10))
      + length(regexp_replace(text, '[^\\]', '', 'g')) + length(regexp_replace(role, '[^\\]', '', 'g'))
      + length(text) - length(replace(text, '</turn>', '/turn>'))
      + length(text) - length(replace(text, ':', ''))
      + length(regexp_replace(regexp_replace(text, '#{3,}', '<\0>', 'g'), '<##(#+)>|[^<]|<', '\1', 'g'))
    ) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?ua(t+a|ua)*') AS valid
FROM g
"""
