"""Tenant scope: rows of an organisation and team, of one project or of all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScopeError(PermissionError):
    """A request names a project outside its scope."""


@dataclass(frozen=True)
class Scope:
    organization_id: str
    team_id: str
    project_id: str | None = None

    def override(self, project_id: str | None) -> Scope:
        """The same scope for a named project; a scope bound to a project admits no other."""
        if project_id is None or project_id == self.project_id:
            return self
        if self.project_id is not None:
            raise ScopeError(f"project {project_id} is outside the scope")
        return Scope(self.organization_id, self.team_id, project_id)


def scoped(df: DataFrame, scope: Scope) -> DataFrame:
    """Rows in scope; a scope without a project admits all of the team's. Plain equality, so it reaches the scan."""
    out = df.where((F.col("organization_id") == scope.organization_id) & (F.col("team_id") == scope.team_id))
    return out if scope.project_id is None else out.where(F.col("project_id") == scope.project_id)


def with_global_fallback(own: DataFrame, other: DataFrame) -> DataFrame:
    """``own``, or ``other`` where it has no rows: one plan, no action on the driver."""
    return own.unionByName(other.where(~own.exists()))
