"""Pipelines as named nodes: built fluently or from a description, checked, bound to DataFrames, shown as a graph."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowframe.plans.parser import PipelineError, parse
from flowframe.plans.registry import REGISTRY


@dataclass
class Node:
    name: str
    kind: str
    make: Callable
    properties: dict = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    takes: str = "buffer"
    gives: str = "buffer"


class Pipeline:
    """A graph of elements. Nothing runs before a sink is asked for; the DataFrames' own lineage is the plan."""

    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {}
        self._last: str | None = None

    @classmethod
    def parse(cls, description: str) -> Pipeline:
        """A linear pipeline of registered elements."""
        out = cls()
        for step in parse(description):
            out.add(step.name, **step.properties)
        return out

    def add(self, element: str, name: str | None = None, after: str | list[str] | None = None, **properties) -> Pipeline:
        """Add a registered element, linked to the one added before unless ``after`` names others."""
        if element not in REGISTRY:
            raise PipelineError(f"no such element: {element}")
        e = REGISTRY[element]
        return self._node(Node(name or self._fresh(element), e.kind, e.make, properties, takes=e.takes, gives=e.gives), after)

    def source(self, make: Callable[[SparkSession], DataFrame], name: str = "source") -> Pipeline:
        return self._node(Node(self._fresh(name) if name in self.nodes else name, "source", make), None)

    def then(self, f: Callable[..., DataFrame], name: str = "transform", after: str | list[str] | None = None) -> Pipeline:
        """Any function from DataFrames to a DataFrame; several inputs come in the order of ``after``."""
        return self._node(Node(self._fresh(name), "transform", f), after)

    def sink(self, f: Callable[[DataFrame], object] = lambda df: df, name: str = "sink", after: str | None = None) -> Pipeline:
        return self._node(Node(self._fresh(name) if name in self.nodes else name, "sink", f, gives="rows"), after)

    __rshift__ = then

    def _fresh(self, base: str) -> str:
        return next(x for i in range(len(self.nodes) + 1) if (x := f"{base}_{i}") not in self.nodes)

    def _node(self, node: Node, after) -> Pipeline:
        if node.name in self.nodes:
            raise PipelineError(f"two nodes named {node.name}")
        self.nodes[node.name] = node
        if node.kind != "source":
            inputs = [after] if isinstance(after, str) else after if after is not None else [self._last] if self._last else []
            for x in inputs:
                self.link(x, node.name)
        self._last = node.name
        return self

    def link(self, start: str, end: str) -> Pipeline:
        """Link two nodes; a link that would close a circle, or join unlike formats, is refused."""
        for x in (start, end):
            if x not in self.nodes:
                raise PipelineError(f"no node named {x}")
        if start == end or end in self._before(start):
            raise PipelineError(f"{start} to {end} closes a circle")
        if self.nodes[start].kind == "sink":
            raise PipelineError(f"{start} is a sink")
        if self.nodes[end].takes not in ("any", self.nodes[start].gives):
            raise PipelineError(f"{end} takes {self.nodes[end].takes}, {start} gives {self.nodes[start].gives}")
        self.nodes[end].inputs.append(start)
        return self

    def _before(self, name: str) -> set[str]:
        seen: set[str] = set()
        todo = [name]
        while todo:
            for x in self.nodes[todo.pop()].inputs:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def validate(self) -> None:
        if not self.nodes:
            raise PipelineError("no elements")
        kinds = [n.kind for n in self.nodes.values()]
        if "source" not in kinds or "sink" not in kinds:
            raise PipelineError("a pipeline has a source and a sink")
        for n in self.nodes.values():
            if n.kind != "source" and not n.inputs:
                raise PipelineError(f"{n.name} has no input")

    def build(self, spark: SparkSession) -> dict:
        """What each sink gives: a DataFrame, or what its action returned."""
        self.validate()
        made: dict = {}

        def of(name: str):
            if name not in made:
                n = self.nodes[name]
                inputs = [of(x) for x in n.inputs]
                made[name] = n.make(spark, **n.properties) if n.kind == "source" else n.make(*inputs, **n.properties)
            return made[name]

        return {n.name: of(n.name) for n in self.nodes.values() if n.kind == "sink"}

    def run(self, spark: SparkSession):
        """As :meth:`build`; of one sink, what it gives."""
        out = self.build(spark)
        return next(iter(out.values())) if len(out) == 1 else out

    def describe(self) -> str:
        return "\n".join(f"{n.name} ({n.kind})" + (f" <- {', '.join(n.inputs)}" if n.inputs else "") for n in self.nodes.values())

    def dot(self) -> str:
        lines = [f'  "{n.name}" [shape={"box" if n.kind == "transform" else "ellipse"}];' for n in self.nodes.values()]
        lines += [f'  "{x}" -> "{n.name}";' for n in self.nodes.values() for x in n.inputs]
        return "\n".join(["digraph pipeline {", *lines, "}"])

    def json(self) -> str:
        return json.dumps({"nodes": [{"name": n.name, "kind": n.kind, "properties": n.properties} for n in self.nodes.values()], "links": [[x, n.name] for n in self.nodes.values() for x in n.inputs]})
