"""A small graph builder: operators as nodes, checked before any job starts, then compiled to one lazy DataFrame per output.

Checks: unknown or doubly driven ports, element types, rates, cycles, nodes without a source. Coercion: a mono edge into a
stereo port is copied, a stereo edge into a mono port averaged, other layouts by a registered matrix. Latency: branches
that meet in a zip are delayed to the longest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.tables import MIX
from rillflow.operators import history
from rillflow.operators.loops import Step


class FlowError(Exception):
    pass


class UnknownPort(FlowError):
    pass


class PortTaken(FlowError):
    pass


class TypeMismatch(FlowError):
    pass


class MixedRates(FlowError):
    pass


class LayoutMismatch(FlowError):
    pass


class Cycle(FlowError):
    pass


class Unrooted(FlowError):
    pass




@dataclass(frozen=True)
class Port:
    """element: sample, frame, spectrum, power or control; rate: outputs per source sample as (p, q)."""

    element: str = "sample"
    layout: str = "mono"


@dataclass
class Node:
    name: str
    build: Callable[..., DataFrame]
    inputs: dict[str, Port]
    output: Port
    rate: tuple[int, int] = (1, 1)
    latency: int = 0
    zip: bool = False
    #: How the node runs sample by sample, for nodes on a feedback loop.
    step: Step | None = None
    edges: dict[str, str] = field(default_factory=dict)
    back: dict[str, str] = field(default_factory=dict)


class Flow:
    def __init__(self):
        self.nodes: dict[str, Node] = {}

    def add(self, name: str, build: Callable[..., DataFrame], inputs: dict[str, Port] | None = None, output: Port = Port(), **kw) -> str:
        if name in self.nodes:
            raise FlowError(f"{name} is there already")
        self.nodes[name] = Node(name, build, inputs or {}, output, **kw)
        return name

    def connect(self, source: str, target: str, port: str = "x") -> None:
        if source not in self.nodes or target not in self.nodes or port not in self.nodes[target].inputs:
            raise UnknownPort(f"{source} -> {target}.{port}")
        node = self.nodes[target]
        if port in node.edges:
            raise PortTaken(f"{target}.{port} is driven by {node.edges[port]}")
        a, b = self.nodes[source].output, node.inputs[port]
        if a.element != b.element:
            raise TypeMismatch(f"{source} gives {a.element}, {target}.{port} takes {b.element}")
        if a.layout != b.layout and (a.layout, b.layout) not in MIX:
            raise LayoutMismatch(f"{a.layout} -> {b.layout}")
        node.edges[port] = source

    def connect_feedback(self, source: str, target: str, port: str) -> None:
        """An edge that carries the source's last sample, so it may close a cycle."""
        self.connect(source, target, port)
        node = self.nodes[target]
        node.back[port] = node.edges.pop(port)

    def loops(self) -> list[set[str]]:
        """The sets of nodes that lie on a cycle through a feedback edge, overlapping ones as one."""
        below: dict[str, set[str]] = {name: set() for name in self.nodes}
        for name in self.order():
            for source in self.nodes[name].edges.values():
                below[name] |= {source} | below[source]
        found: list[set[str]] = []
        for name, node in self.nodes.items():
            for source in node.back.values():
                own = {source, name} | {k for k in self.nodes if name in below[k] and (k in below[source] or k == source)}
                for other in [f for f in found if f & own]:
                    own |= other
                    found.remove(other)
                found.append(own)
        return found

    def looped(self, loop: set[str], built: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """A loop as one recurrence over what enters it: one output per node."""
        from rillflow.operators.loops import Body
        from rillflow.operators.recurrent import run
        from rillflow.operators.spatial import concat

        inside = [n for n in self.order() if n in loop]
        if bare := [n for n in inside if self.nodes[n].step is None]:
            raise Cycle(f"{bare[0]} lies on a feedback loop and has no step")
        outer = list(dict.fromkeys(s for n in inside for s in self.nodes[n].edges.values() if s not in loop))
        body = Body(*outer)
        for n in inside:
            body.add(n, self.nodes[n].step, list(self.nodes[n].edges.values()), list(self.nodes[n].back.values()))
        entering = concat({s: built[s].select("signal_id", "n", built[s].columns[-1]) for s in outer}, ("signal_id", "n"))
        y = run(entering, body.kernel(*inside), tuple(outer), tuple(inside))
        return {n: y.select("signal_id", "n", F.col(n).alias("x")) for n in inside}

    def order(self) -> list[str]:
        done, out = {}, []

        def visit(name: str) -> None:
            if done.get(name) == 1:
                raise Cycle(f"{name} feeds itself; make the cycle one stateful operator")
            if name in done:
                return
            done[name] = 1
            for source in self.nodes[name].edges.values():
                visit(source)
            done[name] = 2
            out.append(name)

        for name in self.nodes:
            visit(name)
        return out

    def validate(self) -> dict[str, tuple[int, tuple[int, int]]]:
        """(latency, rate) at each node's output; raises what is wrong."""
        found: dict[str, tuple[int, tuple[int, int]]] = {}
        for name in self.order():
            node = self.nodes[name]
            if missing := [p for p in node.inputs if p not in node.edges and p not in node.back]:
                raise Unrooted(f"{name}.{missing[0]} has no source")
            above = [found[s] for s in node.edges.values()]
            if len({r for _, r in above}) > 1:
                raise MixedRates(f"inputs of {name} come at {sorted({r for _, r in above})}")
            p, q = above[0][1] if above else (1, 1)
            found[name] = (max((lat for lat, _ in above), default=0) + node.latency, (p * node.rate[0], q * node.rate[1]))
        return found

    def part(self, output: str) -> DataFrame:
        """What feeds an output, on its own."""
        sub, todo = Flow(), [output]
        while todo:
            name = todo.pop()
            if name not in sub.nodes:
                sub.nodes[name] = self.nodes[name]
                todo += [*self.nodes[name].edges.values(), *self.nodes[name].back.values()]
        return sub.compile(output)

    def coerced(self, df: DataFrame, a: Port, b: Port) -> DataFrame:
        if a.layout == b.layout:
            return df
        from rillflow.operators.spatial import mix_matrix

        names = lambda k: ["x"] if k == "mono" else [f"ch{i}" for i in range(len(MIX[(a.layout, b.layout)] if k == b.layout else MIX[(a.layout, b.layout)][0]))]
        out = mix_matrix(MIX[(a.layout, b.layout)], [df[c] for c in names(a.layout)])
        return df.select("signal_id", "n", *[c.alias(k) for c, k in zip(out, names(b.layout), strict=True)])

    def compile(self, output: str) -> DataFrame:
        timing = self.validate()
        built: dict[str, DataFrame] = {}
        loops = self.loops()
        for name in self.order():
            node = self.nodes[name]
            if name in built:
                continue
            if loop := next((f for f in loops if name in f), None):
                for other in loop:  # what enters the loop comes first
                    for source in self.nodes[other].edges.values():
                        if source not in loop and source not in built:
                            built[source] = Flow.part(self, source)
                built |= self.looped(loop, built)
                continue
            most = max((timing[s][0] for s in node.edges.values()), default=0)
            args = {}
            for port, source in node.edges.items():
                df = self.coerced(built[source], self.nodes[source].output, node.inputs[port])
                late = most - timing[source][0]
                if node.zip and late and node.inputs[port].element == "sample":
                    df = history.delay(df, late, out="x")
                args[port] = df
            built[name] = node.build(**args)
        return built[output]
