"""Graphs that run sample by sample as one recurrence: a body with feedback edges, each of which carries the last sample."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

from rillflow.operators.recurrent import Kernel


class DelayFreeLoop(Exception):
    pass


@dataclass(frozen=True)
class Step:
    """A node's state and its function (state, *inputs) -> (state, output) of one sample; delay is how late its output is."""

    make: Callable[[], Any]
    run: Callable[..., tuple]
    delay: int = 0


def plain(fn: Callable) -> Step:
    """A node without state."""
    return Step(lambda: None, lambda state, *v: (state, fn(*v)))


def delayed(length: int, zero: Any = 0.0) -> Step:
    def run(line, v):
        line = deque(line)
        line.append(v)
        return line, line.popleft()

    return Step(lambda: deque([zero] * length), run, length)


class Body:
    """Nodes in the order they were added; an input is a node, an outer input's name, or feedback(node): that node's last output."""

    def __init__(self, *inputs: str):
        self.inputs = inputs
        self.nodes: dict[str, tuple[Step, list[str], list[str]]] = {}
        self.zero: dict[str, Any] = {}

    def add(self, name: str, step: Step, inputs: list[str], feedback: list[str] | None = None, zero: Any = 0.0) -> None:
        """feedback: nodes, also later ones, whose last output follows the inputs; zero: this node's output before the first sample."""
        if missing := [k for k in inputs if k not in self.nodes and k not in self.inputs]:
            raise KeyError(f"{name} reads {missing[0]}, which isn't there yet: only feedback may point forward")
        self.nodes[name] = (step, inputs, feedback or [])
        self.zero[name] = zero

    def check(self) -> None:
        """Every cycle must hold a node with a delay."""

        def reaches(a: str, b: str, seen: set[str]) -> bool:
            if a == b:
                return True
            seen.add(a)
            return any(k in self.nodes and k not in seen and not self.nodes[k][0].delay and reaches(k, b, seen) for k in [*self.nodes[a][1], *self.nodes[a][2]])

        for name, (step, _, back) in self.nodes.items():
            for source in back:
                if not step.delay and not self.nodes[source][0].delay and reaches(source, name, set()):
                    raise DelayFreeLoop(f"the loop from {name} through {source} has no delay")

    def kernel(self, *outputs: str) -> Kernel:
        """The body as a recurrence over the outer inputs."""
        self.check()
        order = list(self.nodes)

        def kernel(state, *arrays):
            held, last = state or ({k: self.nodes[k][0].make() for k in order}, dict(self.zero))
            held, last = dict(held), dict(last)
            out = [[] for _ in outputs]
            for sample in zip(*(a.tolist() for a in arrays), strict=True):
                now = dict(zip(self.inputs, sample, strict=True))
                for k in order:
                    step, inputs, back = self.nodes[k]
                    held[k], now[k] = step.run(held[k], *[now[i] for i in inputs], *[last[i] for i in back])
                last = {k: now[k] for k in order}
                for o, k in zip(out, outputs, strict=True):
                    o.append(now[k])
            return (held, last), *(np.array(o) for o in out)

        return kernel


def network(size: int, delay: int, matrix: list[list[float]]) -> Body:
    """A feedback delay network: the input enters the first of size lines, whose outputs come back through a matrix."""
    m = np.asarray(matrix)
    body = Body("x")
    body.add("mix", plain(lambda x, back: m @ back + np.eye(size)[0] * x), ["x"], ["lines"])
    body.add("lines", delayed(delay, np.zeros(size)), ["mix"], zero=np.zeros(size))
    for k in range(size):
        body.add(f"y{k}", plain(lambda v, k=k: float(v[k])), ["lines"])
    return body
