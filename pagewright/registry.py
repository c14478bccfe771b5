"""What users add: rules, and readers of further formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame

from pagewright.operators.cv_rules import CV_RULES
from pagewright.operators.source_rules import SOURCE_RULES
from pagewright.operators.structure_rules import STRUCTURE_RULES

Rule = Callable[..., Column]
#: Built-in rules by family, in the order in which they run.
FAMILIES: dict[str, dict[str, Rule]] = {"structure": STRUCTURE_RULES, "source": SOURCE_RULES, "cv": CV_RULES}
_ADDED: dict[str, dict[str, Rule]] = {family: {} for family in FAMILIES}
#: The group of entry points whose objects are called without arguments to register what they have.
ENTRY_POINTS = "pagewright.plugins"


class RegistryError(ValueError):
    """What cannot be registered."""


def register_rule(rule: str, family: str, make: Rule) -> None:
    """Add a rule: ``make`` gives the array of its issues, of (blocks), (lines, code) or (cv, config) by family.

    The same rule again changes nothing; another one of its name is an error.
    """
    if family not in FAMILIES:
        raise RegistryError(f"unknown family {family!r}; known are {sorted(FAMILIES)}")
    if not rule or not callable(make):
        raise RegistryError("a rule needs a name and a function that gives its issues")
    held = all_rules(family).get(rule)
    if held is not None and held is not make or any(rule in all_rules(f) for f in FAMILIES if f != family):
        raise RegistryError(f"rule {rule!r} exists already")
    if held is None:
        _ADDED[family][rule] = make


def unregister_rule(rule: str) -> bool:
    """Remove an added rule; whether there was one."""
    return any([held.pop(rule, None) is not None for held in _ADDED.values()])


def registered_rules(family: str) -> list[str]:
    """Names of the added rules of a family."""
    return list(_ADDED[family])


def all_rules(family: str) -> dict[str, Rule]:
    """Built-in rules and then added ones."""
    return FAMILIES[family] | _ADDED[family]


@dataclass(frozen=True)
class Adapter:
    """A format: ``read`` makes (path, source, blocks, error) of files (path, content)."""

    name: str
    extensions: tuple[str, ...]
    read: Callable[[DataFrame], DataFrame]
    has_source: bool = False


_ADAPTERS: list[Adapter] = []


def register_adapter(adapter: Adapter, replace: bool = False) -> None:
    """Add a format; its extensions come before those of built-in ones."""
    if not adapter.extensions or not callable(adapter.read):
        raise RegistryError("an adapter needs extensions and a reader")
    for extension in adapter.extensions:
        if not extension.startswith(".") or extension != extension.lower():
            raise RegistryError(f"extension {extension!r} must start with a dot and be in lower case")
    held = [a for a in _ADAPTERS if a.name == adapter.name or set(a.extensions) & set(adapter.extensions)]
    if held and not replace:
        raise RegistryError(f"adapter {held[0].name!r} has that name or extension already")
    for other in held:
        _ADAPTERS.remove(other)
    _ADAPTERS.insert(0, adapter)


def unregister_adapter(name: str) -> bool:
    held = [a for a in _ADAPTERS if a.name == name]
    for adapter in held:
        _ADAPTERS.remove(adapter)
    return bool(held)


def registered_adapters() -> list[Adapter]:
    return list(_ADAPTERS)


_LOADED: dict[str, str | None] = {}


def load_plugins(reload: bool = False) -> list[str]:
    """Call each entry point once; names of those that worked. One that fails stops no other."""
    if reload:
        _LOADED.clear()
    for point in entry_points(group=ENTRY_POINTS):
        if point.name not in _LOADED:
            try:
                point.load()()
                _LOADED[point.name] = None
            except Exception as error:  # noqa: BLE001 - kept for plugin_errors
                _LOADED[point.name] = f"{point.name}: {type(error).__name__}: {error}"
    return [name for name, error in _LOADED.items() if error is None]


def plugin_errors() -> list[str]:
    return [error for error in _LOADED.values() if error]
