"""Fetch requests: what to read, and in which shape."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from orrery.functions.library import VOLATILE
from orrery.model import Model, ModelError
from orrery.operators.expressions import Block, Call, Path, Subquery, Value, expression, nodes, predicate, substituted

RESULTS = ("objects", "ids", "dictionaries", "count")


@dataclass(frozen=True)
class Named:
    """A computed column of a result: an expression (text or tree), and a Spark type to cast to."""

    name: str
    expression: object
    kind: str | None = None


@dataclass(frozen=True)
class Request:
    """predicate and having are texts or trees; sort lists "path" or "-path"; properties and group_by
    list paths and Named columns; shape is a nested dict of names for nested results."""

    entity: str
    predicate: object = None
    args: tuple = ()
    sort: tuple = ()
    limit: int = 0
    offset: int = 0
    properties: tuple = ()
    group_by: tuple = ()
    having: object = None
    distinct: bool = False
    result: str = "dictionaries"
    heirs: bool = True
    values: bool = True
    shape: dict | None = field(default=None, hash=False)

    def tree(self):
        return None if self.predicate is None else predicate(self.predicate, *self.args)

    def checked(self) -> Request:
        if self.result not in RESULTS:
            raise ModelError(f"unknown result {self.result!r}")
        if self.group_by and self.result != "dictionaries":
            raise ModelError("grouping needs dictionaries as result")
        if self.having is not None and not self.group_by:
            raise ModelError("having needs grouping")
        if self.limit < 0 or self.offset < 0:
            raise ModelError("limit and offset cannot be negative")
        return self

    def key(self, generation: int = 0) -> str:
        """Equal for requests with equal results on one generation of a store."""
        return hashlib.sha256(f"{generation}|{self!r}".encode()).hexdigest()

    def cacheable(self) -> bool:
        """No volatile function in any part; no block, collection operator, subquery or path over two relationships in the predicate."""
        computed = [expression(p.expression) for p in (*self.properties, *self.group_by) if isinstance(p, Named)]
        if self.having is not None:
            computed.append(predicate(self.having))
        if any(isinstance(n, Block) or isinstance(n, Call) and n.name in VOLATILE for tree in computed for n in nodes(tree)):
            return False
        tree = self.tree()
        for n in nodes(tree) if tree is not None else ():
            if isinstance(n, (Subquery, Block)) or isinstance(n, Call) and n.name in VOLATILE:
                return False
            if isinstance(n, Value) and isinstance(n.value, (Request, DataFrame)):
                return False
            if isinstance(n, Path) and (len(n.parts) > 2 or any(p.startswith("@") for p in n.parts)):
                return False
        return True


def from_template(model: Model, name: str, variables: dict) -> Request:
    """A copy of the model's named request with its $VARIABLES filled in."""
    if name not in model.templates:
        raise ModelError(f"no template {name!r}")
    found = model.templates[name]
    return replace(found, predicate=substituted(found.tree(), variables), args=())
