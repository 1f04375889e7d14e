"""Agent catalog: listing, and the tools named in each agent's JSON spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPEC = T.StructType(
    [
        T.StructField(
            "tool_resources",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("semantic_model_file", T.StringType())]),
            ),
        )
    ]
)


def agent_catalog(agents: DataFrame) -> DataFrame:
    return agents.select(
        F.col("name").alias("agent_name"),
        F.col("database_name").alias("db_name"),
        F.col("schema_name").alias("sch_name"),
    )


def agent_tool_models(agents: DataFrame, drop_null_files: bool = False) -> DataFrame:
    """One row per (agent, tool); broken or missing specs give no rows.

    ``drop_null_files`` leaves out tools that name no semantic model file.
    """
    tools = agents.select(
        F.col("name").alias("agent_name"),
        F.explode(F.from_json("agent_spec", _SPEC)["tool_resources"]).alias("tool_name", "tool"),
    ).select("agent_name", "tool_name", F.col("tool.semantic_model_file").alias("semantic_model_file"))
    if drop_null_files:
        tools = tools.filter(F.col("semantic_model_file") != "")
    return tools
