"""Predicates on commit subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of defect repairs, prefixes of other commits, and reverts.
FIX = (
    r"(?i)\b(fix(e[sd])?|bugfix|hotfix|patch(ed|es)?|repair(ed)?|resolve[sd]?|bug|defect|issue|error|crash(es|ed)?|fail(ure|ing|ed)?|broken|break(s|age)?|regress(ion|ed)?|incorrect|invalid|wrong|mistake|typo|"
    r"workaround|revert(ed|s)?|rollback|npe|nullpointer|segfault|deadlock|race\s*condition|memory\s*leak|oops|whoops|mitigat(e|ion))\b"
)
NON_FIX = r"(?i)^\s*(feat|feature|docs?|style|refactor|perf|test|chore|build|ci|release)\b[:(]"
REVERT = r"(?i)^\s*(revert|rollback|back\s*out)\b"


def is_fix(subject: Column, extra: str | None = None) -> Column:
    """extra: a further pattern, in any case, which also counts behind a prefix of other commits."""
    own = ~subject.rlike(NON_FIX) & subject.rlike(FIX)
    return own | subject.rlike(f"(?i){extra}") if extra else own


def is_revert(subject: Column) -> Column:
    return subject.rlike(REVERT)
