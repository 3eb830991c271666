"""The eleven tables of a test map: schemas, vocabularies, and tolerant alignment of older maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 5

_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def _table(spec: str) -> T.StructType:
    """`name:kind` words; kinds l, i, s, b; a question mark makes the column nullable."""
    kinds = {"l": _L, "i": _I, "s": _S, "b": _B}
    out = T.StructType()
    for word in spec.split():
        name, _, kind = word.partition(":")
        out.add(name, kinds[kind[0]], kind.endswith("?"))
    return out


TABLES: dict[str, T.StructType] = {
    "meta": _table("key:s value:s?"),
    "projects": _table("id:l name:s path:s target_framework:s? kind:s"),
    "classes": _table("id:l project_id:l name:s namespace:s base_type:s? kind:s file_path:s line_start:i line_end:i"),
    "methods": _table("id:l class_id:l project_id:l name:s signature:s visibility:s kind:s file_path:s line_start:i line_end:i"),
    "step_definitions": _table("id:l method_id:l class_id:l project_id:l keyword:s expression:s expression_kind:s parameters:s? file_path:s line_start:i"),
    "features": _table("id:l project_id:l name:s description:s? tags:s? file_path:s"),
    "scenarios": _table("id:l feature_id:l project_id:l name:s kind:s tags:s? example_row_count:i file_path:s line_start:i"),
    "scenario_steps": _table("id:l scenario_id:l project_id:l keyword:s text:s ordinal:i has_docstring:b has_table:b file_path:s line_start:i"),
    "endpoints": _table("id:l verb:s route:s path:s? target_api:s?"),
    "edges": _table("from_kind:s from_id:l to_kind:s to_id:l? edge_kind:s confidence:s?"),
    "diagnostics": _table("severity:s code:s message:s location:s?"),
}

#: Tables without which a folder is no map; the others may be missing in maps of older versions.
CORE = ("meta", "projects", "classes", "methods", "edges", "diagnostics")

# The vocabularies of the map's columns.
CLASS_KINDS = ("step_class", "page_object", "api_client", "test_class", "hook_class", "helper", "other")
METHOD_KINDS = ("step_definition", "hook", "test_method", "page_object_method", "api_method", "helper_method", "other")
PROJECT_KINDS = ("bdd_tests", "unit_tests", "shared_library", "other")
EXPRESSION_KINDS = ("regex", "cucumber_expression")
EDGE_KINDS = ("binds_to", "unbound", "inherits", "uses_type", "holds", "references", "calls_endpoint")
COLLABORATORS = ("page_object", "api_client")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def aligned(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order: missing nullable ones null, extra ones dropped, types cast."""
    cols = []
    for field in TABLES[table]:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.nullable:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"table {table} lacks column {field.name}")
    return df.select(*cols)
