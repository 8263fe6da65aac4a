"""The eight questions that a client asks about a call graph, each answered with a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph


class CallGraph:
    """Functions of a binary's listing, as `operators.graph.analyse` gives them, with the types marked so far."""

    def __init__(self, parsed: DataFrame, arg_types: DataFrame | None = None):
        spark = parsed.sparkSession
        self.parsed = parsed
        self.functions = parsed.select("name", "listing")
        self.edges = graph.call_edges(parsed)
        self.passed = graph.passes(parsed)
        self.types_ = arg_types if arg_types is not None else spark.createDataFrame([], "func string, arg int, type string")

    def get_function(self, name: str) -> DataFrame:
        """(name, listing, callees, callers, types)."""
        row = self.functions.where(F.col("name") == name)
        typed = self.types().withColumnRenamed("func", "name")
        return row.join(graph.callees(self.functions, self.edges), "name", "left").join(self.get_callers(name).withColumnRenamed("callee", "name"), "name", "left").join(typed, "name", "left")

    def get_callers(self, name: str) -> DataFrame:
        return graph.callers(self.edges, name)

    def get_callees(self, name: str) -> DataFrame:
        return self.graph().where(F.col("name") == name)

    def cluster(self, pattern: str) -> DataFrame:
        return graph.cluster(self.functions, pattern).orderBy("name")

    def wave(self, func: str, arg: int, type_: str, depth: int = graph.WAVE_DEPTH) -> DataFrame:
        """Marks a type and gives what it reached; `types` has it from then on."""
        reached = graph.wave(self.functions, self.passed, func, arg, depth)
        self.types_ = graph.mark(self.types_, reached, type_)
        return reached.orderBy("depth", "path").select("func", "arg", "depth")

    def types(self) -> DataFrame:
        return graph.type_map(self.types_).orderBy("func")

    def diff(self, other: CallGraph) -> DataFrame:
        return graph.version_diff(self.functions, other.functions).orderBy("name")

    def graph(self) -> DataFrame:
        return graph.callees(self.functions, self.edges).orderBy("name")
