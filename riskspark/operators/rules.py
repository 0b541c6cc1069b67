"""The scoring rules as one registry of SQL expressions, applied in one projection without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scoring
from riskspark.settings import Settings


@dataclass(frozen=True)
class Rule:
    id: str
    phase: str
    title: str
    when: str
    points: str
    severity: str | None = None  # else by points
    detail: str = "''"


def _over(weight: str, value: str, threshold: str, cap: float) -> str:
    return f"{{w_{weight}}} * ({scoring.scale(value, '{t_' + threshold + '}', cap)})"


def _says(text: str, *values: str) -> str:
    parts = text.split("{}")
    return "concat(" + ", ".join(f"'{p}'" + (f", cast({v} AS string)" if v else "") for p, v in zip(parts, (*values, ""), strict=True)) + ")"


PHASES = ("static", "history", "graph", "ml")
TRIVIAL = "(loc < 10 AND function_count = 0 AND class_count = 0)"
RULES = (
    Rule("long-function", "static", "Function too long", "max_function_length >= {t_long_function_lines}", _over("long_function", "max_function_length", "long_function_lines", 3.0), None, _says("the longest function has {} lines", "max_function_length")),
    Rule("deep-nesting", "static", "Nested too deeply", "(nested_loop_depth > {t_nested_loop_depth} OR max_nesting_depth > {t_max_nesting_depth} + 2)", _over("deep_nesting", "greatest(nested_loop_depth, max_nesting_depth - 2)", "nested_loop_depth", 2.5), None, _says("loops {} deep, blocks {} deep", "nested_loop_depth", "max_nesting_depth")),
    Rule("high-branching", "static", "Many branches", "branch_count > {t_branch_count}", _over("high_branching", "branch_count", "branch_count", 2.5), None, _says("{} branches", "branch_count")),
    Rule("high-complexity", "static", "Complex function", "max_function_complexity > {t_cyclomatic_complexity}", _over("high_complexity", "max_function_complexity", "cyclomatic_complexity", 3.0), None, _says("complexity {} in one function", "max_function_complexity")),
    Rule("no-error-handling", "static", "Risky calls without handling", "(risky_calls >= 3 AND try_blocks = 0)", "{w_no_error_handling} * (" + scoring.scale("risky_calls", "3", 2.0) + ")", None, _says("{} risky calls, none guarded", "risky_calls")),
    Rule("sparse-error-handling", "static", "Risky calls with little handling", "(NOT (risky_calls >= 3 AND try_blocks = 0) AND risky_calls >= 8 AND try_blocks < risky_calls / 6)", "{w_no_error_handling} * 0.5", None, _says("{} risky calls, {} guards", "risky_calls", "try_blocks")),
    Rule("swallowed-exception", "static", "Errors vanish", "bare_excepts + swallowed_exceptions > 0", "{w_bare_except} * least(cast(2.0 AS double), (bare_excepts + swallowed_exceptions) / 2 + 0.5)", None, _says("{} handlers catch all or do nothing", "bare_excepts + swallowed_exceptions")),
    Rule("global-state", "static", "State of the whole module", "global_variables > 0", "{w_global_variables} * (" + scoring.scale("global_variables", "2", 2.0) + ")", None, _says("{} globals that change", "global_variables")),
    Rule("duplicate-code", "static", "Repeated code", "(duplicate_ratio >= {t_duplicate_ratio} OR clones > 0)",
         "(CASE WHEN duplicate_ratio >= {t_duplicate_ratio} THEN " + _over("duplicate_code", "duplicate_ratio", "duplicate_ratio", 2.0) + " ELSE 0 END + CASE WHEN clones > 0 THEN 0.6 * {w_duplicate_code} ELSE 0 END)", None, _says("{} files hold the same blocks", "clones")),
    Rule("low-coverage", "static", "Hardly tested", "(coverage IS NOT NULL AND coverage < {t_low_coverage})", "{w_low_test_coverage} * least(cast(1.6 AS double), 0.4 + 1.2 * ({t_low_coverage} - coverage) / greatest(cast(0.01 AS double), {t_low_coverage}))", None, _says("tests cover a share of {}", "coverage")),
    Rule("no-test-file", "static", "No test by name", "(coverage IS NULL AND has_test = false AND NOT " + TRIVIAL + ")", "{w_low_test_coverage} * 0.55", None, _says("no test file is named after it")),
    Rule("god-file", "static", "File too large", "loc > {t_god_file_loc}", _over("god_file", "loc", "god_file_loc", 2.5), None, _says("{} lines of code", "loc")),
    Rule("long-parameter-list", "static", "Many parameters", "max_parameters > {t_max_parameters}", _over("long_parameter_list", "max_parameters", "max_parameters", 2.0), None, _says("a function takes {} parameters", "max_parameters")),
    Rule("mutable-default-arg", "static", "Shared default value", "mutable_default_args > 0", "{w_mutable_default_arg} * least(cast(2.0 AS double), cast(mutable_default_args AS double))", None, _says("{} defaults are shared by all calls", "mutable_default_args")),
    Rule("magic-numbers", "static", "Unnamed numbers", "magic_numbers > {t_magic_number_count}", _over("magic_numbers", "magic_numbers", "magic_number_count", 2.0), None, _says("{} unnamed numbers", "magic_numbers")),
    Rule("todo-debt", "static", "Work put off", "todo_comments >= {t_todo_count}", _over("todo_debt", "todo_comments", "todo_count", 2.0), None, _says("{} open remarks", "todo_comments")),
    Rule("undocumented-complexity", "static", "Complex and unexplained", "(loc > 150 AND comment_ratio < {t_low_comment_ratio} AND cyclomatic_complexity > 15)", "{w_low_comment_ratio}", "low", _says("a comment share of {}", "comment_ratio")),
    Rule("change-frequency", "history", "Changed often", "(commits > 0 AND commits >= {t_commit_count})", _over("change_frequency", "commits", "commit_count", 2.2), None, _says("{} commits", "commits")),
    Rule("bugfix-density", "history", "Fixed often", "(commits > 0 AND fixes >= 2 AND fix_ratio >= {t_bugfix_ratio})", _over("bugfix_density", "fix_ratio", "bugfix_ratio", 2.2), None, _says("{} of {} commits are fixes", "fixes", "commits")),
    Rule("revert-history", "history", "Taken back before", "(commits > 0 AND reverts >= {t_revert_count})", "{w_revert_history} * least(cast(2.0 AS double), cast(reverts AS double))", None, _says("{} reverts", "reverts")),
    Rule("fix-follow-rate", "history", "Edits need fixes", "(commits >= 5 AND fix_follow_rate >= {t_fix_follow_rate})", _over("fix_follow_rate", "fix_follow_rate", "fix_follow_rate", 2.0), None, _says("a fix soon follows a share of {} of edits", "fix_follow_rate")),
    Rule("recent-churn", "history", "Busy of late", "(commits > 0 AND recent_30d >= {t_recent_commits_30d})", _over("recent_churn", "recent_30d", "recent_commits_30d", 2.0), None, _says("{} commits in 30 days", "recent_30d")),
    Rule("many-authors", "history", "Many hands", "(commits > 0 AND authors >= {t_author_count})", _over("many_authors", "authors", "author_count", 2.0), None, _says("{} authors", "authors")),
    Rule("knowledge-silo", "history", "One person knows it", "(commits >= 10 AND authors < {t_author_count} AND ownership >= {t_ownership_ratio})", "{w_knowledge_silo}", "low", _says("one author made a share of {}", "ownership")),
    Rule("high-fan-in", "graph", "Much depends on it", "dependents >= {t_fan_in}", _over("high_fan_in", "dependents", "fan_in", 2.0), None, _says("{} files import it", "dependents")),
    Rule("high-centrality", "graph", "Between many files", "centrality >= 0.25", "{w_high_centrality} * least(cast(2.0 AS double), 3 * centrality)", None, _says("centrality {}", "centrality")),
    Rule("ml-prediction", "ml", "The model expects a fix", "ml_points > 1.0", "ml_points", "CASE WHEN ml_points >= 15 THEN 'high' ELSE 'medium' END", _says("{} points of lift", "ml_points")),
)

#: What the rules read, and its value where a side is missing. NULL means not measured.
DEFAULTS = {
    **dict.fromkeys(("loc", "function_count", "class_count", "max_function_length", "nested_loop_depth", "max_nesting_depth", "branch_count", "max_function_complexity", "cyclomatic_complexity", "risky_calls", "try_blocks", "bare_excepts", "swallowed_exceptions", "global_variables", "clones", "max_parameters", "mutable_default_args", "magic_numbers", "todo_comments"), "cast(0 AS bigint)"),
    **dict.fromkeys(("commits", "fixes", "reverts", "recent_30d", "authors", "dependents"), "cast(0 AS bigint)"), **dict.fromkeys(("duplicate_ratio", "comment_ratio", "fix_ratio", "fix_follow_rate", "centrality"), "cast(0.0 AS double)"),
    "ownership": "cast(1.0 AS double)", "coverage": "cast(NULL AS double)", "has_test": "cast(NULL AS boolean)", "ml_points": "cast(NULL AS double)",
}


def complete(wide: DataFrame) -> DataFrame:
    """wide with every column that the rules read."""
    keep = [c for c in wide.columns if c not in DEFAULTS]
    return wide.selectExpr(*keep, *(f"{d} AS {c}" if c not in wide.columns else f"{c}" if d.startswith("cast(NULL") else f"coalesce({c}, {d}) AS {c}" for c, d in DEFAULTS.items()))


def expressions(rule: Rule, settings: Settings, duckdb: bool = False) -> tuple[str, str, str, str]:
    """When, points, severity and detail, ready for an engine."""
    values = settings.literals()
    if duckdb:
        values = {k: v.replace("D", "::DOUBLE") for k, v in values.items()}
    when, points = rule.when.format(**values), rule.points.format(**values)
    severity = scoring.severity(f"({points})") if rule.severity is None else rule.severity if rule.severity.startswith("CASE") else f"'{rule.severity}'"
    return when, points, severity, rule.detail


def points(wide: DataFrame, settings: Settings | None = None, phases=PHASES, only: str | None = None, skipped: str = "false") -> DataFrame:
    """wide, completed, with the points of each rule as a column p_<rule>, null where it doesn't fire. skipped: a condition of files without static rules.

    One plain column for each rule, so that filters on scores stay small when the optimizer moves them below."""
    settings, each = settings or Settings(), []
    for rule in RULES:
        if rule.phase in phases and only in (None, rule.id):
            when, value, _, _ = expressions(rule, settings)
            guard = f"NOT ({skipped}) AND " if rule.phase == "static" and skipped != "false" else ""
            each.append(f"CASE WHEN {guard}{when} THEN cast({value} AS double) END AS {column(rule)}")
    return complete(wide).selectExpr("*", *each)


def column(rule: Rule) -> str:
    return f"p_{rule.id.replace('-', '_')}"


def hits(wide: DataFrame, settings: Settings | None = None, phases=PHASES, only: str | None = None, skipped: str = "false") -> DataFrame:
    """points(), with hits: an array of (rule_id, phase, points, severity, title, detail), most points first."""
    out, each = points(wide, settings, phases, only, skipped), []
    for rule in RULES:
        if (p := column(rule)) in out.columns:
            severity = scoring.severity(p) if rule.severity is None else rule.severity if rule.severity.startswith("CASE") else f"'{rule.severity}'"
            each.append(f"CASE WHEN {p} IS NOT NULL THEN named_struct('rule_id', '{rule.id}', 'phase', '{rule.phase}', 'points', {p}, 'severity', {severity}, 'title', '{rule.title}', 'detail', {rule.detail}) END")
    ordered = "array_sort(filter(array({}), h -> h IS NOT NULL), (x, y) -> CASE WHEN x.points > y.points THEN -1 WHEN x.points < y.points THEN 1 WHEN x.rule_id < y.rule_id THEN -1 WHEN x.rule_id > y.rule_id THEN 1 ELSE 0 END)"
    return out.withColumn("hits", F.expr(ordered.format(", ".join(each))))


def long_hits(scored: DataFrame) -> DataFrame:
    return scored.select("path", F.explode("hits").alias("h")).select("path", "h.rule_id", "h.phase", "h.points", "h.severity")


def scores(scored: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The output of points() or hits() with the points of each phase, raw, score and band."""
    t = (settings or Settings()).thresholds
    total = lambda phase: " + ".join(["cast(0 AS double)", *(f"coalesce({column(r)}, 0)" for r in RULES if r.phase == phase and column(r) in scored.columns)])
    out = scored.selectExpr("*", *(f"{total(p)} AS points_{p}" for p in PHASES)).withColumn("raw", F.expr(" + ".join(f"points_{p}" for p in PHASES)))
    return out.withColumn("score", F.expr(scoring.squash("raw"))).withColumn("band", F.expr(scoring.band("score", t["band_medium"], t["band_high"], t["band_critical"])))
