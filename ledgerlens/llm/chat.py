"""Chat formatting: layouts are told apart by a fingerprint of their nested field paths.

A record is JSON. Its field paths (list items as `[]`) that any mapping mentions are sorted and hashed; the hash selects
a declarative mapping, which says where the turns are. So a record with further fields, in any order, is still known.
Turns are written as `<|im_start|>role\\ntext<|im_end|>\\n`. In texts a backslash goes in before the bar of every `<|`
(and `<\\|` gets another), so that no text holds a control string and the change can be undone; in roles a backslash
marks line feeds. The loss mask is a span of each assistant turn's piece.

Nulls: a null role or text is empty, a null or unparsable record or one whose layout is unknown gives one row with a
null piece and its fingerprint. Equal turn numbers are ordered by role and text, null first. A conversation is never
held whole: its pieces are rows in order, and reading back streams over them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import batched

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: `flat` names (role, path) in order, or `items` a list with role and text fields."""

    name: str
    flat: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        if self.items:
            return {self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}
        return {p for _, p in self.flat} | ({self.role, self.text} - {""})


_SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn_row", role="role", text="text"),
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("conversations", items="conversations", role="from", text="value", roles=_SPOKEN),
    Mapping("instruction", flat=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=frozenset({"system", "input"})),
    Mapping("prompt_completion", flat=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"})),
    Mapping("prompt_response", flat=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"})),
    Mapping("question_answer", flat=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=frozenset({"system"})),
)


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """Every nested field path of a JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else str(k)
            yield path
            yield from field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, f"{at}[]")


def path_hash(paths: Iterable[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(set(paths))), 0)


class Layouts:
    """Mappings by the fingerprint of their paths, with and without the optional ones."""

    def __init__(self, mappings: Iterable[Mapping] = MAPPINGS) -> None:
        self.known: set[str] = set()
        self.by_hash: dict[str, Mapping] = {}
        for m in mappings:
            self.known |= m.paths()
            for n in range(len(m.optional) + 1):
                for gone in combinations(sorted(m.optional), n):
                    key = path_hash(m.paths() - set(gone))
                    if self.by_hash.setdefault(key, m) is not m:
                        raise ValueError(f"mappings {m.name} and {self.by_hash[key].name} have the same paths")

    def fingerprint(self, record: object) -> str:
        return path_hash(p for p in field_paths(record) if p in self.known)

    def turns(self, record: object) -> tuple[str, list[tuple[str, str]] | None]:
        """The fingerprint, and the canonical (role, text) turns, None if no mapping has it."""
        key = self.fingerprint(record)
        m = self.by_hash.get(key)
        if m is None or not isinstance(record, dict):
            return key, None
        if m.items:
            rows = record[m.items] if isinstance(record[m.items], list) else []
            found = [(_plain(r.get(m.role)), _plain(r.get(m.text))) for r in rows if isinstance(r, dict)]
        elif m.flat:
            found = [(role, _plain(record[path])) for role, path in m.flat if path in record and not (path in m.optional and not record[path])]
        else:
            found = [(_plain(record[m.role]), _plain(record[m.text]))]
        return key, [(m.roles.get(role, role), text) for role, text in found]


def _plain(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn's piece, and the span in it that is learned (empty at the end if none is)."""
    head = START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    body = escape(text)
    whole = head + body + END + "\n"
    return (whole, len(head), len(head) + len(body)) if role == LEARNED else (whole, len(whole), len(whole))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    found = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        role = unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head))
        found.append((role, unescape(body[: body.rindex(END)])))
    return found


FORMATTED = "seq bigint, layout string, piece string, loss_from int, loss_to int"


def formatted(records: DataFrame, conv: str, record: Column, order: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv, seq, layout, piece, loss_from, loss_to), conversations together and each in order.

    `record` is the JSON of a row; rows of one conversation are put in `order`. Pieces of one conversation follow each
    other in their partition and their concatenation is the formatted conversation.
    """
    columns = [F.col(conv), *[F.col(c) for c in order], record.alias("__record")]
    dealt = records.select(*columns).repartition(conv).sortWithinPartitions(conv, *order).select(conv, "__record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts, last, seq = Layouts(mappings), object(), 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv_id != last:
                    last, seq = conv_id, 0
                try:
                    key, turns = layouts.turns(json.loads(text)) if text is not None else ("", None)
                except ValueError:
                    key, turns = "", None
                for role, said in turns or []:
                    out.append((conv_id, seq, key, *piece(role, said)))
                    seq += 1
                if turns is None:
                    out.append((conv_id, None, key, None, None, None))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [conv, "seq", "layout", "piece", "loss_from", "loss_to"])

    return batched(dealt).mapInArrow(run, f"{conv} {records.schema[conv].dataType.simpleString()}, {FORMATTED}")


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(pieces: DataFrame, conv: str) -> DataFrame:
    """One row a conversation, read back from its pieces as `formatted` leaves them, in a stream of constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind = pa.int64()

        def closed() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            kind = batch.schema.field(0).type
            rows, out = zip(*[c.to_pylist() for c in batch.columns]) if batch.num_rows else (), []
            for conv_id, _, _, text, a, b in rows:
                if state is None or state[0] != conv_id:
                    if state is not None:
                        out.append(closed())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if text is None:
                    continue
                for role, said in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(text[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield _digest_batch(out, conv, kind)
        if state is not None:
            yield _digest_batch([closed()], conv, kind)

    return pieces.select(conv, "seq", "layout", "piece", "loss_from", "loss_to").mapInArrow(
        run, f"{conv} {pieces.schema[conv].dataType.simpleString()}, {DIGEST}"
    )


def _digest_batch(rows: list[tuple], conv: str, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [conv, *[x.split()[0] for x in DIGEST.split(", ")]])


#: The conversation that every digest table holds besides the given ones; its text looks like control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
