"""Secret scans: fixed shapes, and random strings that a tokenizer's vocabulary encodes badly.

Kinds, in this order: assign (a named value), access (key ids), hex (long hexadecimal runs), random (the method's). A
random span is a run of RUN_CHARS+ characters [A-Za-z0-9+/_-] with fewer than max_ratio characters a token under a tiktoken
vocabulary: text that looks like language takes few tokens, random text takes many. Not counted are known digests (hex of a
digest's length, base64 behind the digest's name), UUIDs, numbers, identifiers (words joined by _ - / or camel case, whose letters alone, lowered, reach max_ratio
word by word), and runs inside a span of another kind.

Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import mapped, sliced, table

KINDS = ("assign", "access", "hex", "random")
# The shapes of named values, key ids and hexadecimal runs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, ACCESS_CHARS = re.compile(r"AKIA[A-Z0-9]{16,}"), 20
HEX, HEX_CHARS = re.compile(r"[0-9a-f]{24,}"), 24
ASSIGN_CHARS = 6
RUN_CHARS, MAX_RATIO = 20, 2.1
#: Every access and hex match lies in such a run, as RUN_CHARS is no more than their least lengths.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A digest's name and its base64 without padding, as in integrity="sha256-..." and SHA256:...; the latter's name stands before the run.
NAMED = re.compile(r"(?:md5-[A-Za-z0-9+/_-]{22}|sha1-[A-Za-z0-9+/_-]{27}|sha224-[A-Za-z0-9+/_-]{38}|sha256-[A-Za-z0-9+/_-]{43}|sha384-[A-Za-z0-9+/_-]{64}|sha512-[A-Za-z0-9+/_-]{86})", re.I)
NAME_BEFORE = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)):$", re.I)
DIGEST_64 = {22, 27, 38, 43, 64, 86}
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(r"[_/-]*(?:[A-Z]?[a-z]+|[A-Z]{1,12}|[0-9]{1,4})(?:[_/-]+(?:[A-Z]?[a-z]+|[A-Z]{1,12}|[0-9]{1,4}))*[_/-]*|[A-Za-z]?[a-z]+(?:[A-Z][a-z]{2,})+[0-9]{0,4}")

PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_identifier(run: str, count, max_ratio: float = MAX_RATIO) -> bool:
    """An identifier's shape, of words and not of random letters; groups of digits alone are numbers."""
    parts = PART.findall(run) if IDENTIFIER.fullmatch(run) else None
    return parts is not None and sum(map(len, parts)) >= max_ratio * sum(count(x.lower()) for x in parts)


def is_known(run: str, before: str = "") -> bool:
    """A digest, UUID or number; before: the characters before the run."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGEST_CHARS or UUID.fullmatch(run) or run.strip("_/+-").isdigit():
        return True
    return bool(NAMED.fullmatch(run) or len(run) in DIGEST_64 and NAME_BEFORE.search(before))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): leftmost non-overlapping matches of each kind, those too short left out."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    for run in RUN.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], count, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """count(run) gives the tokens of a run. Runs and taken spans are walked side by side, in order."""
    out, spans, at, reach = [], sorted(taken), 0, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][2])
            at += 1
        if reach > a or is_known(m[0], text[max(0, a - 8) : a]):
            continue
        if (b - a) < max_ratio * count(m[0]) and not is_identifier(m[0], count, max_ratio):
            out.append((a, 3, b))
    return out


_ENCODINGS: dict[int, object] = {}


def _counter(data: bytes, pattern: str):
    import tiktoken

    key = hash((data, pattern))
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = _ENCODINGS[key]
    return lambda run: len(own.encode_ordinary(run))


def scan(docs: DataFrame, vocab, text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with found: array<struct<kind, start, end>>, by start, then kind, in place of any column of that name. vocab: see bpe.vocabulary."""
    docs = docs.drop("found")
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        count = _counter(*vocab.value)
        for batch, texts in sliced(batches, at):
            out = []
            for x in texts.to_pylist():
                spans = base_spans(x)
                spans += random_spans(x, spans, count, max_ratio)
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(out, kind)], [*batch.schema.names, "found"])

    return mapped(docs, run, ["found array<struct<kind:string,start:long,end:long>>"])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from riskspark.llm.bpe import vocabulary

    vocab = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab).drop("text")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("random"))
