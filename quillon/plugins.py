"""Extension points: what a plugin of each kind has to offer, a registry, and a check that it does."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

#: Each kind's call: its name and how many arguments it takes.
KINDS = {
    "source": ("read", 2), "sink": ("write", 2), "detector": ("detect", 1), "fitter": ("fit", 1), "strategy": ("column", 3), "distribution": ("draw", 3), "calendar": ("factor", 1), "domain": ("tables", 0),
    "mutator": ("damage", 1), "emitter": ("send", 1), "stream_source": ("stream", 1), "transform": ("apply", 1), "report": ("render", 1), "behavior": ("simulate", 2), "command": ("run", 1), "gate": ("findings", 1),
}
_FOUND: dict[tuple[str, str], object] = {}


def register(kind: str, name: str, plugin: object) -> None:
    problems = conform(kind, plugin)
    if problems:
        raise TypeError("; ".join(problems))
    _FOUND[kind, name] = plugin


def conform(kind: str, plugin: object) -> list[str]:
    """What a plugin lacks to be one of its kind."""
    if kind not in KINDS:
        return [f"no such kind: {kind}"]
    call, n = KINDS[kind]
    f = getattr(plugin, call, None)
    if not callable(f):
        return [f"{kind} plugins need a method {call}"]
    code = getattr(f, "__code__", None)
    given = code.co_argcount - hasattr(f, "__self__") if code else n
    return [] if given == n or (code and code.co_flags & 4) else [f"{call} takes {given} arguments, not {n}"]


def get(kind: str, name: str) -> object:
    """A registered plugin, or one that an installed package offers under quillon.<kind>; loaded when first asked for."""
    if (kind, name) not in _FOUND:
        for point in entry_points(group=f"quillon.{kind}"):
            if point.name == name:
                register(kind, name, point.load()())
    return _FOUND[kind, name]


def contained(f: Callable, *args) -> tuple[object, Exception | None]:
    """A plugin's call; its failure is handed back rather than raised."""
    try:
        return f(*args), None
    except Exception as error:  # a plugin may fail in any way
        return None, error
