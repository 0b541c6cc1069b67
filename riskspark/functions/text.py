"""Columns over source lines and paths. Word edges are those of Unicode letters, digits and _."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies of line measurements.
TODO = ("TODO", "FIXME", "HACK", "XXX", "BUG", "WORKAROUND", "TEMP", "KLUDGE", "REFACTOR")
BRANCH = ("if", "elif", "elsif", "switch", "case", "when", "match", "guard", "unless")  # "else if" is one, by its "if"
LOOP = ("for", "while", "foreach", "repeat", "loop", "do")
TRY = ("try", "begin", "rescue", "defer")
CATCH = ("catch", "except", "rescue", "recover")
RISKY = (
    "open", "read", "write", "request", "requests", "urlopen", "fetch", "axios", "http", "socket", "connect", "execute", "executemany", "query", "cursor", "commit", "rollback", "session", "transaction",
    "subprocess", "popen", "system", "exec", "eval", "spawn", "fork", "loads", "parse", "decode", "encode", "int", "float", "atoi", "parseint", "parsefloat", "remove", "unlink", "rmtree", "delete", "drop",
    "truncate", "send", "recv", "publish", "consume", "acquire", "lock", "getenv", "config",
)
RISKY_DOTTED = r"(?i)(^|[^\p{L}\p{N}_])(json\.loads?|os\.environ)([^\p{L}\p{N}_]|$)"
ALLOWED_NUMBERS = ("0", "1", "2", "-1", "10", "24", "60", "100", "1000", "1024", "0.0", "1.0")
COMMENT = r"^\s*(#|//|/\*|\*|--|<!--|%)"
DUP_COMMENT = r"^(#|//|\*|/\*|--|%)"
NON_WORD, NON_NUMBER = r"[^\p{L}\p{N}_]+", r"[^\p{L}\p{N}_.]+"
STRING = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
NUMBER = r"(?<![\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?(?![\p{L}\p{N}_])"


def lines(text: Column) -> Column:
    """A text's lines; a newline at the end begins no further line."""
    parts = F.split(text, "\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def exploded(sources: DataFrame) -> DataFrame:
    """(path, line, raw), lines from 1."""
    return sources.select("path", F.posexplode(lines(F.col("text"))).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def count_words(text: Column, vocabulary, lower: bool = False) -> Column:
    words = F.split(F.lower(text) if lower else text, NON_WORD)
    return F.size(F.filter(words, lambda w: w.isin(*vocabulary))).cast("long")


def is_risky(text: Column) -> Column:
    return (count_words(text, RISKY, lower=True) > 0) | text.rlike(RISKY_DOTTED)


def magic_numbers(text: Column) -> Column:
    return F.size(F.filter(F.split(text, NON_NUMBER), lambda w: w.rlike(r"^[0-9]+(\.[0-9]+)?$") & ~w.isin(*ALLOWED_NUMBERS))).cast("long")


def normalised(raw: Column) -> Column:
    """A line without what copies differ in: strings, numbers, spacing; comments are empty."""
    s = F.trim(raw)
    out = reduce(lambda c, p: F.regexp_replace(c, *map(F.lit, p)), ((STRING, "'S'"), (NUMBER, "N"), (r"\s+", " ")), s)
    return F.when(s.rlike(DUP_COMMENT), "").otherwise(out)


def indent(raw: Column) -> Column:
    """Width of leading blanks, a tab as four."""
    return F.length(F.replace(F.regexp_extract(raw, r"^[ \t]*", 0), F.lit("\t"), F.lit("    "))).cast("long")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def test_stem(path: Column) -> Column:
    """What a test is of, by its name."""
    s = F.regexp_replace(F.lower(stem(path)), r"^test_*", "")
    return F.regexp_replace(s, r"[_.]*(_test|\.test|\.spec|_spec|spec)$", "")


def is_test(path: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(path), F.lit(m)) for m in markers))


def glob_pattern(globs) -> str:
    """One anchored pattern of shell globs; `*` also matches `/`, and `dir/*` holds for that directory at any depth."""
    import re

    def one(glob: str) -> str:
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
        return f"(?:.*/)?{body}" if glob.endswith("/*") else body

    return "^(?:" + "|".join(one(g) for g in globs) + ")$"


def normal_path(path: Column, root: str = "") -> Column:
    """Relative to root; a leading ./ goes."""
    rest = F.when(F.startswith(path, F.lit(f"{root}/")), F.substr(path, F.lit(len(root) + 2))).otherwise(path) if root else path
    return F.regexp_replace(rest, r"^(\./)+", "")
