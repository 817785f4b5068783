"""Chat formatting with schema fingerprints.

A record is a JSON object in any of several layouts. Its schema is the set of
its nested field paths with their kinds (`messages[].role:string`), in which names have
their dots, brackets, colons, line ends and backslashes escaped, so that no two schemas read alike; the hash
of that set selects a declarative mapping, and the mapping turns the record
into canonical turns (role, text). Turns are then written with a template
whose control strings cannot come from a text: backslash and `<|` are escaped
inside texts and roles, and reading back undoes that exactly. The loss mask is
a list of code point ranges, one for each assistant text.

Defined results:
 - a record that is null, not JSON, or of no known schema: no turns, with its fingerprint and the error;
 - null text or role: empty; null fields have no path, like missing ones, and null items of a list are no turns;
 - null conv_id, where turns are rows: an id like any other, so its rows are one conversation;
 - a conversation without turns: the empty string;
 - rows of equal turn: by role, then text; repeated rows: each is a turn;
 - very long texts: whole; an unpaired surrogate from a JSON escape: U+FFFD;
 - an empty table gives an empty result; other columns are not read.
A conversation is one record and so the unit that a task holds.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Either `turns` is the path of a list whose items hold role and text, or `fields` lists (role, paths to join)."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for extra in itertools.combinations(self.optional, n):
                yield fingerprint({*self.required, *extra})


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("messages", ("messages[].role:string", "messages[].content:string"), ("id:string", "id:number"), turns="messages"),
    Mapping("empty messages", ("messages[]:empty",), ("id:string", "id:number"), turns="messages"),
    Mapping(
        "from/value", ("conversations[].from:string", "conversations[].value:string"), ("id:string", "system:string"),
        turns="conversations", role="from", text="value", fields=(("system", ("system",)),),
    ),
    Mapping(
        "instruction", ("instruction:string", "output:string"), ("input:string", "system:string"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping(
        "prompt/completion", ("prompt:string", "completion:string"), ("system:string",),
        fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))),
    ),
    Mapping(
        "prompt/response", ("prompt:string", "response:string"), ("system:string",),
        fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ),
    Mapping(
        "prompt/messages", ("prompt[].role:string", "prompt[].content:string", "completion[].role:string", "completion[].content:string"),
        turns="prompt+completion",
    ),
    Mapping(
        "question/answer", ("question:string", "answer:string"), ("context:string",),
        fields=(("user", ("context", "question")), ("assistant", ("answer",))),
    ),
)


def escape_name(name: str) -> str:
    return re.sub(r"[\\.\[\]:\n]", lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], name)


def paths_of(value, prefix: str | None = None) -> set[str]:
    """The nested field paths of a JSON value with the kinds of its leaves."""
    if isinstance(value, dict):
        inside = {escape_name(k) if prefix is None else f"{prefix}.{escape_name(k)}": v for k, v in value.items()}
        return set().union(*(paths_of(v, p) for p, v in inside.items()))
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{prefix or ''}[]") for v in value)) if value else {f"{prefix or ''}[]:empty"}
    if value is None:
        return set()
    kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"
    return {f"{prefix or ''}:{kind}"}


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    turns = []
    for role, names in mapping.fields:
        parts = [record[n] for n in names if record.get(n)]
        if parts or (role != "system" and any(n in record for n in names)):
            turns.append((role, "\n\n".join(parts)))
    for name in mapping.turns.split("+") if mapping.turns else ():
        for item in filter(None, record.get(name) or ()):
            role = item.get(mapping.role) or ""
            turns.append((ROLES.get(role, role), item.get(mapping.text) or ""))
    return turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code point ranges of the assistant texts in it."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head = f"{START}{escape(role).replace('\n', '\\n')}\n"
        body = escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records (conv_id long, record JSON string) -> conv_id, fingerprint, layout, formatted, loss, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {f: m for m in mappings for f in m.fingerprints()}
        clean = lambda s: s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"conv_id": conv, "fingerprint": None, "layout": None, "formatted": None, "loss": [], "error": None}
                try:
                    record = json.loads(text) if text is not None else None
                    if not isinstance(record, dict):
                        raise ValueError("not a JSON object")
                    row["fingerprint"] = fingerprint(paths_of(record))
                    mapping = known.get(row["fingerprint"])
                    if mapping is None:
                        raise ValueError("unknown schema")
                    row["layout"] = mapping.name
                    turns = [(clean(r), clean(t)) for r, t in canonical(record, mapping)]
                    row["formatted"], loss = render(turns)
                    row["loss"] = [{"first": a, "end": b} for a, b in loss]
                except (ValueError, RecursionError) as e:
                    row["error"] = str(e)[:200]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema(
        [
            ("conv_id", pa.int64()), ("fingerprint", pa.string()), ("layout", pa.string()), ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("error", pa.string()),
        ]
    )
    return records.select("conv_id", "record").mapInArrow(
        run,
        "conv_id long, fingerprint string, layout string, formatted string, loss array<struct<first:long,end:long>>, error string",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted texts hold, read back from them and their loss masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"] or ""
                turns = read_back(text)
                loss = "".join(unescape(text[x["first"] : x["end"]]) for x in row["loss"])
                out.append(
                    {
                        "conv_id": row["conv_id"], "n_turns": len(turns),
                        "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                        "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema(
        [
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ]
    )
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def records_of_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, ...), a row each -> (conv_id, record) in the messages layout."""
    empty = F.lit("")
    item = F.struct(
        F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("content")
    )
    ordered = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return ordered.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))
