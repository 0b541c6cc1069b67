"""Chat formatting: records of any known layout become canonical turns, and turns become a training text with a loss mask.

A record is a JSON object. The set of its nested field paths (a.b, a[].b for lists) is hashed: the layout's fingerprint. It
selects a declarative mapping (MAPPINGS): first the one registered under that very hash; a record with further fields takes
the first mapping all of whose required paths it has, and the choice is remembered under its fingerprint.

The text of a conversation is, for each turn, `<turn>role\\ntext</turn>\\n`. Inside texts, a backslash is doubled and the
marks are broken by a single one (`<\\turn>`, `<\\/turn>`); in roles a newline is `\\n` too. So the marks only occur where turns begin
and end, and unescaping gives back every text. The loss mask covers assistant texts, without marks.

A null or invalid record, one that is nested too deeply to read, or one of an unknown layout, has no turns. Null roles and
texts are empty; roles that no mapping renames are kept as they are. Lone surrogates, which no text can hold, become U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import cuts, mapped, sliced, table

OPEN, CLOSE = "<turn>", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,end:bigint>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: each: a list of turns (path to the list, then the field of the role and of the text), or fields that are turns by themselves, in order;
#: several fields of one turn are joined by an empty line. alternate: a list of plain texts, user first.
MAPPINGS = (
    {"name": "mixed-messages", "list": "messages", "role": "role", "text": "content", "part": "text", "plain": True, "optional": ("messages[].content[].type",)},
    {"name": "messages", "list": "messages", "role": "role", "text": "content"},
    {"name": "message-parts", "list": "messages", "role": "role", "text": "content", "part": "text", "optional": ("messages[].content[].type",)},
    {"name": "from-value", "list": "conversations", "role": "from", "text": "value", "optional": ("system",), "before": (("system", ("system",)),), "roles": _ROLES},
    {"name": "instruction", "fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), "optional": ("system", "input")},
    {"name": "prompt-response", "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), "optional": ("system",)},
    {"name": "prompt-completion", "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "preference", "fields": (("user", ("prompt",)), ("assistant", ("chosen",))), "optional": ("rejected",)},
    {"name": "question-answer", "fields": (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), "optional": ("context",)},
    {"name": "dialog", "alternate": "dialog"},
)


_LONE = re.compile("[\ud800-\udfff]")


def _name(key: str) -> str:
    """A key as a part of a path: what a path is made of is escaped."""
    return re.sub(r"([\\.\[])", r"\\\1", _LONE.sub("\ufffd", key)).replace("\n", "\\n")


def paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{_name(k)}" if at else _name(k)) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(of: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(of)).encode(), digest_size=16).hexdigest()


def required(mapping: dict) -> set[str]:
    if "list" in mapping:
        texts = [f"{mapping['text']}[].{mapping['part']}"] if "part" in mapping else [mapping["text"]]
        texts += [mapping["text"]] if mapping.get("plain") else []
        return {f"{mapping['list']}[].{x}" for x in (mapping["role"], *texts)}
    if "alternate" in mapping:
        return {f"{mapping['alternate']}[]"}
    return {f for _, fields in mapping["fields"] for f in fields} - set(mapping.get("optional", ()))


@functools.cache
def registered() -> dict[str, dict]:
    """Fingerprint -> mapping, for the required paths with each choice of optional ones."""
    out: dict[str, dict] = {}
    for mapping in MAPPINGS:
        more = mapping.get("optional", ())
        for n in range(len(more) + 1):
            for some in itertools.combinations(more, n):
                out.setdefault(fingerprint(required(mapping) | set(some)), mapping)
    return out


def mapping_for(of: set[str], seen: dict[str, dict | None]) -> tuple[str, dict | None]:
    key = fingerprint(of)
    if key not in seen:
        if len(seen) > 100_000:
            seen.clear()
        seen[key] = registered().get(key) or next((m for m in MAPPINGS if required(m) <= of), None)
    return key, seen[key]


def _text(value) -> str:
    return "" if value is None else _LONE.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def turns_by(mapping: dict, record: dict) -> list[dict]:
    def fields(wanted) -> list[dict]:
        out = []
        for role, names in wanted:
            parts = [_text(record[n]) for n in names if record.get(n) not in (None, "")]
            if parts or any(n in record for n in names) and role != "system":
                out.append({"role": role, "text": "\n\n".join(parts)})
        return out

    if "fields" in mapping:
        return fields(mapping["fields"])
    if "alternate" in mapping:
        return [{"role": ("user", "assistant")[i % 2], "text": _text(x)} for i, x in enumerate(record[mapping["alternate"]])]
    out = fields(mapping.get("before", ()))
    for turn in record[mapping["list"]]:
        turn = turn if isinstance(turn, dict) else {}
        role, text = _text(turn.get(mapping["role"])), turn.get(mapping["text"])
        if "part" in mapping and isinstance(text, list):
            text = "".join(_text(p.get(mapping["part"])) for p in text if isinstance(p, dict))
        out.append({"role": mapping.get("roles", {}).get(role, role), "text": _text(text)})
    return out


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn>", "<\\turn>").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", None: ""}.get(m[1], m[1]), role)


def formatted(turns: list[dict]) -> tuple[str, list[dict]]:
    """The text of turns, and the spans (code points, end exclusive) of what is learnt."""
    out, spans, at = [], [], 0
    for turn in turns:
        head, body = f"{OPEN}{escape_role(turn['role'] or '')}\n", escape(turn["text"] or "")
        if turn["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parsed(text: str) -> list[dict]:
    out = []
    for turn in text.split(CLOSE)[:-1]:
        role, _, body = turn[len(OPEN) :].partition("\n")
        out.append({"role": unescape_role(role), "text": unescape(body)})
    return out


def _mapped(df: DataFrame, at: str, added: str, kinds: list[pa.DataType], one) -> DataFrame:
    """df with one(row's values of column `at` and those after the colon) added."""
    added = added.split(", ")
    names = [x.split(" ", 1)[0] for x in added]
    df = df.drop(*names)
    where = df.columns.index(at)

    def run(batches):
        seen: dict = {}
        for batch, texts in sliced(batches, where):
            rows = [one(x, seen, batch, i) for i, x in enumerate(texts.to_pylist())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *columns], [*batch.schema.names, *names])

    return mapped(df, run, added)


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """records with fingerprint, layout (null if unknown) and turns added."""

    def one(text, seen, _batch, _i):
        try:
            value = json.loads(text)
            of = paths(value) if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            of = None
        if of is None:
            return None, None, []
        key, mapping = mapping_for(of, seen)
        try:
            return key, mapping and mapping["name"], turns_by(mapping, value) if mapping else []
        except (TypeError, KeyError, RecursionError):  # a list that holds other things beside turns
            return key, None, []

    return _mapped(records, record, f"fingerprint string, layout string, turns {TURNS}", [pa.string(), pa.string(), _TURNS], one)


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with formatted and loss_spans added; null turns are none."""
    df = df.drop("formatted", "loss_spans")
    where = df.columns.index(turns)

    def run(batches):
        for batch in batches:
            column = batch.column(where)
            sizes = pc.fill_null(pc.binary_length(column.values.field(1)), 0).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for lo, hi in cuts(before[column.offsets.to_numpy()]):
                part = batch.slice(lo, hi - lo)
                rows = [formatted(x or []) for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], _SPANS)], [*part.schema.names, "formatted", "loss_spans"])

    return mapped(df, run, ["formatted string", f"loss_spans {SPANS}"])


def read_back(df: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """df with read_turns and read_loss (all text under the mask, unescaped) added, both from the formatted text alone."""
    at = [c for c in df.columns if c not in ("read_turns", "read_loss")].index(spans)

    def one(text, _seen, batch, i):
        return parsed(text), "".join(unescape(text[s["start"] : s["end"]]) for s in batch.column(at)[i].as_py() or ())

    return _mapped(df, formatted, f"read_turns {TURNS}, read_loss string", [_TURNS, pa.string()], one)


def _turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) by turn, then role, then text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("content")).alias("row"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))


def _messages():
    return F.to_json(F.struct(F.transform("turns", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages")))


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as (conv_id, record) in one layout; a null conv_id is one conversation, as GROUP BY has it."""
    return _turns_of(conversations).select("conv_id", _messages().alias("record"))


def records_in_layouts(conversations: DataFrame) -> DataFrame:
    """As records_of, but each record takes the plainest layout that keeps its roles: a question and its answer as prompt and response, also behind a
    system text; in every other conversation, turns under other names; user and assistant in turns as a dialog; else messages."""
    roles, said = F.transform("turns", lambda r: r["role"]), F.transform("turns", lambda r: r["content"])
    are = lambda *names: roles == F.array(*(F.lit(n) for n in names))
    in_turns = F.forall(F.transform("turns", lambda r, i: r["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    plain = F.forall(roles, lambda r: ~r.isin(*_ROLES))
    other = F.transform("turns", lambda r: F.struct(F.when(r["role"] == "user", "human").when(r["role"] == "assistant", "gpt").otherwise(r["role"]).alias("from"), r["content"].alias("value")))
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(said[0].alias("prompt"), F.get(said, 1).alias("response"))))
        .when(are("system", "user", "assistant") & (said[0] != ""), F.to_json(F.struct(said[0].alias("system"), F.get(said, 1).alias("prompt"), F.get(said, 2).alias("response"))))
        .when(plain & (F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0), F.to_json(F.struct(other.alias("conversations"))))
        .when(in_turns, F.to_json(F.struct(said.alias("dialog"))))
        .otherwise(_messages())
    )
    return _turns_of(conversations).select("conv_id", record.alias("record"))


#: Fixed value: a text that looks like marks and escapes.
PROBE = r"\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = read_back(format_turns(canonical_turns(records_in_layouts(rows.unionByName(probe))).drop("record")).drop("turns"))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("read_loss").cast("long").alias("loss_chars"), F.sha2(F.encode("read_loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), chr(10), '\n'))
    + length(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
