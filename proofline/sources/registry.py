"""Registries of tasks and candidates, from YAML or JSON, as small tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(text: str) -> tuple[dict, str]:
    """A registry and the hash of its text. YAML needs its library; JSON does not."""
    try:
        import yaml
    except ImportError:
        return json.loads(text), hashlib.sha256(text.encode()).hexdigest()
    return yaml.safe_load(text), hashlib.sha256(text.encode()).hexdigest()


def kind(value: object) -> str:
    return "bool" if isinstance(value, bool) else "float" if isinstance(value, float) else "int"


def tables(spark: SparkSession, registry: dict) -> tuple[DataFrame, DataFrame]:
    """(gates, results) as the selection operators take them: keys in the order written, with their kind."""
    gates = [(task, key, i, kind(v), float(v)) for task, spec in registry.get("tasks", {}).items() for i, (key, v) in enumerate(spec.get("gate", {}).items())]
    results = [(task, model, key, float(v)) for model, spec in registry.get("models", {}).items() for task, found in (spec.get("results") or {}).items() for key, v in found.items() if isinstance(v, int | float)]
    return spark.createDataFrame(gates, "task string, key string, ord int, kind string, want double"), spark.createDataFrame(results, "task string, model string, key string, have double")


#: What ``tables`` takes of a registry's text; values stay as written.
WRITTEN = "tasks map<string, struct<gate: map<string, string>>>, models map<string, struct<results: map<string, map<string, string>>>>"


def tables_of(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``tables`` of many registries, a JSON text in each row: the same columns after the registry's key. A number in quotes counts as a number."""
    found = texts.select(key, F.from_json("text", WRITTEN).alias("r"))
    value = F.col("value")
    number = F.when(value.isin("true", "false"), (value == "true").cast("double")).otherwise(value.try_cast("double"))
    kind_of = F.when(value.isin("true", "false"), "bool").when(value.rlike(r"^-?\d+$"), "int").otherwise("float")
    gates = found.select(key, F.explode("r.tasks").alias("task", "spec")).select(key, "task", F.posexplode("spec.gate").alias("ord", "key", "value"))
    models = found.select(key, F.explode("r.models").alias("model", "spec")).select(key, "model", F.explode("spec.results").alias("task", "found"))
    results = models.select(key, "task", "model", F.explode("found").alias("key", "value"))
    return gates.select(key, "task", "key", "ord", kind_of.alias("kind"), number.alias("want")), results.select(key, "task", "model", "key", number.alias("have")).filter("have is not null")
