"""Function registry: SQL names of the engine's functions, and calls that give records instead of exceptions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, StringType

from corpusengine.functions.similarity import porter
from corpusengine.operators.text_chunks import register_chunks


class Entry(NamedTuple):
    name: str
    description: str
    call: Callable[..., Any]
    parameters: tuple[str, ...]


class Registry:
    def __init__(self):
        self.entries: dict[str, Entry] = {}

    def add(self, name: str, description: str, call: Callable[..., Any], *parameters: str) -> None:
        self.entries[name] = Entry(name, description, call, parameters)

    def list(self) -> list[tuple[str, str, tuple[str, ...]]]:
        return [(e.name, e.description, e.parameters) for e in self.entries.values()]

    def execute(self, name: str, **arguments: Any) -> dict[str, Any]:
        """``{"result": ...}`` or ``{"error": ...}``; never an exception."""
        if name not in self.entries:
            return {"error": f"unknown function {name}"}
        try:
            return {"result": self.entries[name].call(**arguments)}
        except Exception as e:  # noqa: BLE001  the failure is the answer
            return {"error": repr(e)}


def _ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a or "", b or "").ratio()


def register(spark: SparkSession) -> Registry:
    """SQL functions ``porter_stem``, ``sequence_ratio`` and the table function ``chunks``."""
    found = Registry()
    found.add("porter_stem", "stem of a lower-case word", porter, "word")
    found.add("sequence_ratio", "Ratcliff/Obershelp similarity of two texts", _ratio, "a", "b")
    spark.udf.register("porter_stem", lambda w: None if w is None else porter(w), StringType())
    spark.udf.register("sequence_ratio", _ratio, DoubleType())
    register_chunks(spark)
    return found
