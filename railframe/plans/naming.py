"""Types that are named after where they stand, in classes that serve as namespaces."""

from __future__ import annotations

from .nodes import Type


def renamed(value: object, name: str) -> object:
    """A type under the name; a class of types as a namespace of its own under it. Anything else as it is."""
    if isinstance(value, Type):
        return value.named(name)
    if isinstance(value, Naming) or (isinstance(value, type) and type(value) is type and any(isinstance(v, (Type, Naming)) for v in vars(value).values())):
        parts = {k: v for c in reversed(value.__mro__[:-1]) for k, v in vars(c).items() if not k.startswith("__")}
        return Naming(value.__name__, (Namespace,), parts | {"__qualname__": name, "__module__": value.__module__, "__doc__": value.__doc__})
    return value


class Naming(type):
    def __init__(cls, name: str, bases: tuple, body: dict, **kw):
        super().__init__(name, bases, body, **kw)
        inherited = {k: v for b in reversed(cls.__mro__[1:]) if isinstance(b, Naming) for k, v in vars(b).items()}
        for k, v in (inherited | body).items():
            if not k.startswith("__"):
                setattr(cls, k, v)

    def __setattr__(cls, key: str, value: object) -> None:
        super().__setattr__(key, renamed(value, f"{cls.__qualname__.rpartition('<locals>.')[2]}.{key}"))


class Namespace(metaclass=Naming):
    """A class whose types are named by their attributes: in messages, in definitions of JSON Schema, in diagrams.

        class Shop(Namespace):
            Price = t.Float[t.between(0)]            # Shop.Price
            Tree = t.defer(lambda: Shop.Node)        # a cycle by its name
            class Orders:
                Id = t.Integer                       # Shop.Orders.Id

    What is assigned later is named too. A class that inherits from a namespace has its types under its own name. A type
    that is used elsewhere keeps its own: an attribute is a named copy."""
