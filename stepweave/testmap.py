"""A test map: one DataFrame for each table of the schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import TABLES


@dataclass
class TestMap:
    __test__ = False

    meta: DataFrame
    projects: DataFrame
    classes: DataFrame
    methods: DataFrame
    step_definitions: DataFrame
    features: DataFrame
    scenarios: DataFrame
    scenario_steps: DataFrame
    endpoints: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    #: Folders of stored search indexes by name; a map without them is searched by scan.
    indexes: dict[str, str] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    def edge(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("edge_kind").isin(*kinds))

    def node_projects(self) -> DataFrame:
        """(kind, id, project_id) of every node that belongs to a project; endpoints belong to none."""
        parts = [
            self.projects.select(F.lit("project").alias("kind"), "id", F.col("id").alias("project_id")),
            self.classes.select(F.lit("class").alias("kind"), "id", "project_id"),
            self.methods.select(F.lit("method").alias("kind"), "id", "project_id"),
            self.step_definitions.select(F.lit("step_definition").alias("kind"), "id", "project_id"),
            self.scenario_steps.select(F.lit("scenario_step").alias("kind"), "id", "project_id"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
