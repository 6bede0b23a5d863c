"""Languages: an immutable catalogue of pattern lists with inheritance and subtag fallback.

A :class:`Registry` is a value.  ``register`` and ``unregister`` return another one, so
that what a query captured when it was built cannot drift.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from . import patterns


@dataclass(frozen=True)
class Lists:
    block: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()


@dataclass(frozen=True)
class Language:
    lists: Lists
    parent: str | None = None


def normal_code(code: str) -> str:
    return str(code).strip().lower()


def _checked(code: str, kind: str, stems: Sequence[str]) -> tuple[str, ...]:
    if isinstance(stems, str) or not isinstance(stems, Sequence):
        raise TypeError(f"language {code!r}: {kind} must be a sequence of strings")
    for i, stem in enumerate(stems):
        if not isinstance(stem, str) or stem == "":
            raise TypeError(f"language {code!r}: {kind}[{i}] must be a string that isn't empty")
        for source, what in ((stem, "is no valid pattern"), (patterns.expand(stem), "is no valid pattern once its letters are expanded")):
            try:
                patterns.check(f"^(?:{source})$" if kind == "allow" else source)
            except patterns.PatternError as why:
                raise patterns.PatternError(f"language {code!r}: {kind}[{i}] {stem!r} {what}: {why}") from None
    return tuple(stems)


@dataclass(frozen=True)
class Registry:
    """Languages in the order of their registration."""

    languages: tuple[tuple[str, Language], ...] = ()

    @staticmethod
    def builtin() -> Registry:
        return Registry(tuple((code, Language(Lists(x["block"], x["allow"]))) for code, x in patterns.builtin_lists().items()))

    def _map(self) -> dict[str, Language]:
        return dict(self.languages)

    def codes(self) -> list[str]:
        return [code for code, _ in self.languages]

    def register(self, code: str, block: Sequence[str] = (), allow: Sequence[str] = (), extends: str | None = None) -> Registry:
        key, known = normal_code(code), self._map()
        if key == "":
            raise TypeError("a language code must not be empty")
        parent = None
        if extends is not None:
            parent = normal_code(extends)
            if parent not in known:
                raise LookupError(f"language {key!r} extends {parent!r}, which isn't registered; known: {', '.join(known) or '(none)'}")
            at: str | None = parent
            while at is not None:
                if at == key:
                    raise LookupError(f"language {key!r} would extend itself by way of {parent!r}: a cycle")
                at = known[at].parent if at in known else None
        known[key] = Language(Lists(_checked(key, "block", block), _checked(key, "allow", allow)), parent)
        return Registry(tuple(known.items()))

    def unregister(self, code: str) -> Registry:
        key = normal_code(code)
        heirs = [c for c, x in self.languages if x.parent == key]
        if heirs:
            raise LookupError(f"language {key!r} is still extended by {', '.join(heirs)}")
        return Registry(tuple((c, x) for c, x in self.languages if c != key))

    def resolve(self, code: str) -> str | None:
        """The registered code: subtags are dropped from the right until one is known."""
        key, known = normal_code(code), self._map()
        while key:
            if key in known:
                return key
            key = key.rpartition("-")[0]
        return None

    def __contains__(self, code: str) -> bool:
        return self.resolve(code) is not None

    def lists(self, code: str) -> Lists | None:
        """A language's lists, its ancestors' first."""
        key = self.resolve(code)
        if key is None:
            return None
        known, chain = self._map(), []
        while key is not None:
            chain.append(known[key])
            key = known[key].parent
        chain.reverse()
        return Lists(tuple(s for x in chain for s in x.lists.block), tuple(s for x in chain for s in x.lists.allow))


DEFAULT = Registry.builtin()


@dataclass(frozen=True)
class FilterOptions:
    """What to look for.  ``languages`` is a tuple of codes or ``"*"`` for all registered."""

    languages: tuple[str, ...] | str = ("en",)
    custom_list: tuple[str, ...] = ()
    allow_list: tuple[str, ...] = ()
    cross_check: bool = True
    aggressive: bool = True
    registry: Registry = DEFAULT

    def resolved(self) -> Lists:
        """The lists in force.  A custom list replaces what is blocked; the allowlist stays."""
        known = self.__dict__.get("_lists")  # looked up for every text
        if known is None:
            known = self._resolved()
            object.__setattr__(self, "_lists", known)
        return known

    def _resolved(self) -> Lists:
        codes = self.registry.codes() if self.languages == "*" else [self.languages] if isinstance(self.languages, str) else self.languages
        block: list[str] = []
        allow: list[str] = []
        for code in codes:
            found = self.registry.lists(code)
            if found is None:
                raise LookupError(f"unknown language {code!r}; registered: {', '.join(self.registry.codes()) or '(none)'}")
            block += found.block
            allow += found.allow
        return Lists(tuple(self.custom_list or block), (*allow, *self.allow_list) if self.cross_check else ())
