"""SQL functions of the session's catalogue: texts, keys, hashes, goals, and the scope of a request."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomspan.functions.text import GOAL_STOPWORDS

#: What a request is bound to, as session variables; an empty or unset one is no bound.
SCOPE = ("organization_id", "team_id", "project_id", "user_id", "actor_type", "team_role")

_GOALS = "array_except(array_distinct(filter(regexp_extract_all(lower(x), '([a-z0-9_./:+-]+)', 1), t -> length(t) >= 3)), array({words}))"

#: Name and parameters, what it returns, and its body.
FUNCTIONS = (
    ("canonical_text(x STRING)", "STRING", "trim(regexp_replace(lower(x), '[^a-z_]+', ' '))"),
    ("claim_text(x STRING)", "STRING", "array_join(slice(filter(regexp_extract_all(lower(x), '([a-z0-9_]+)', 1), t -> length(t) >= 3), 1, 10), '_')"),
    ("claim_key(kind STRING, subject STRING, x STRING)", "STRING", "concat_ws(':', kind, subject, claim_text(x))"),
    ("stable_id(x STRING)", "STRING", "left(sha2(x, 256), 32)"),
    ("error_signature(x STRING)", "STRING", "left(trim(regexp_replace(regexp_replace(lower(x), '[0-9a-f]{7,}', ''), '\\\\s+', ' ')), 160)"),
    ("goals_in(x STRING)", "TABLE(position INT, goal STRING)", f"SELECT pos, col FROM posexplode({_GOALS.format(words=', '.join(repr(w) for w in GOAL_STOPWORDS))})"),
    *[(f"app_current_{name}()", "STRING", f"nullif(app_{name}, '')") for name in SCOPE],
    (
        "app_is_scoped_to_row(row_organization STRING, row_team STRING, row_project STRING)",
        "BOOLEAN",
        "app_current_organization_id() = row_organization AND app_current_team_id() = row_team AND (app_current_project_id() IS NULL OR row_project IS NULL OR app_current_project_id() = row_project)",
    ),
    ("app_is_team_admin()", "BOOLEAN", "app_current_team_role() IN ('owner', 'admin')"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, and the variables of the scope where there are none yet; their names.

    They are SQL, so the planner inlines them: a scope predicate over columns of a
    table is pushed down like any other. ``goals_in`` is a table function, for
    FROM and LATERAL. Null texts give nulls, and no goals.
    """
    for name in SCOPE:
        spark.sql(f"DECLARE OR REPLACE VARIABLE app_{name} STRING DEFAULT NULL")
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in FUNCTIONS]


def bind(spark: SparkSession, **scope: str | None) -> None:
    """Bind the session to a scope: the given variables are set, the others unset. Queries analysed before keep theirs."""
    for name in scope:
        if name not in SCOPE:
            raise ValueError(f"no {name} in a scope")
    for name in SCOPE:
        value = scope.get(name)
        spark.sql(f"SET VARIABLE app_{name} = :value", args={"value": value}) if value is not None else spark.sql(f"SET VARIABLE app_{name} = NULL")
