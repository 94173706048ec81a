"""Formula strings: ``y ~ x i.c a&b a##b (endog ~ instr), fe(f g) cluster(f g)``.

Terms are separated by blanks; there is no ``+`` and no intercept.  ``i.v`` is
categorical with base level 1, ``i.B.v`` with base level B > 0.  ``&`` and ``#``
interact, ``&&`` and ``##`` also add every lower-order term.  One token is split
by one delimiter only, the first of ``&&``, ``&``, ``##``, ``#`` that it has.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace

log = logging.getLogger("lattica")

_PIECES = re.compile(r"\(|\)|[^\s()]+")


@dataclass(frozen=True)
class Factor:
    name: str
    categorical: bool = False
    base: int = 1

    def same(self, other: Factor) -> bool:
        """Equal for the purpose of repeated terms: the base doesn't count."""
        return self.categorical == other.categorical and self.name.lower() == other.name.lower()


@dataclass(frozen=True)
class Formula:
    y: str
    terms: tuple[Factor, ...] = ()
    interactions: tuple[tuple[Factor, ...], ...] = ()
    endogenous: tuple[Factor, ...] = ()
    instruments: tuple[Factor, ...] = ()
    fe: tuple[str, ...] | None = None
    cluster: tuple[str, ...] | None = None
    text: str = field(default="", compare=False)


def parse_factor(token: str) -> Factor:
    if not token.startswith("i."):
        return Factor(token)
    rest = token[2:]
    base, dot, name = rest.partition(".")
    if dot and re.fullmatch(r"\+?\d+", base) and int(base) > 0:
        return Factor(name, True, int(base))
    return Factor(rest, True)


def _expand(token: str) -> list[tuple[Factor, ...]]:
    """The terms that a token stands for, each as the tuple of its factors."""
    for mark, crossed in (("&&", True), ("&", False), ("##", True), ("#", False)):
        if mark in token:
            parts = [parse_factor(p) for p in token.split(mark) if p]
            if not crossed:
                return [tuple(parts)]
            chosen = range(1, 1 << len(parts))
            return [tuple(p for j, p in enumerate(parts) if mask >> j & 1) for mask in chosen]
    return [(parse_factor(token),)]


def _merge(factors: list[Factor], new: Factor) -> None:
    """Add to the list of an instrument block: a repeated name is one variable, categorical if it ever was."""
    for i, known in enumerate(factors):
        if known.name.lower() == new.name.lower():
            factors[i] = replace(known, categorical=known.categorical or new.categorical)
            return
    factors.append(new)


def _option(tail: str, word: str) -> str | None:
    """What the parentheses after ``word`` hold, up to the one that closes them."""
    at = tail.lower().find(word + "(")
    if at < 0:
        return None
    depth, start = 0, at + len(word)
    for i in range(start, len(tail)):
        depth += (tail[i] == "(") - (tail[i] == ")")
        if not depth:
            return tail[start + 1 : i]
    return tail[start + 1 :]


def names(text: str) -> tuple[str, ...]:
    return tuple(text.replace(",", " ").split())


def parse(text: str) -> Formula:
    """Parse a formula.  Raises ``ValueError`` without ``~``; odd instrument blocks are left out with a warning."""
    main, _, tail = text.strip().partition(",")
    y, tilde, right = main.partition("~")
    if not tilde:
        raise ValueError(f"formula without '~': {text!r}")
    terms: list[Factor] = []
    crossed: list[tuple[Factor, ...]] = []
    endogenous: list[Factor] = []
    instruments: list[Factor] = []
    pieces = iter(_PIECES.findall(right))
    for piece in pieces:
        if piece == "(":
            depth, block = 1, []
            for inner in pieces:
                depth += (inner == "(") - (inner == ")")
                if not depth:
                    break
                block.append(inner)
            if depth:
                log.warning("unmatched parenthesis in the formula: the rest is left out")
                break
            left, split, others = " ".join(block).partition("~")
            if not split:
                log.warning("instrument block without '~' is left out")
                continue
            for token in left.split():
                _merge(endogenous, parse_factor(token))
            for token in others.split():
                _merge(instruments, parse_factor(token))
        elif piece != ")":
            for factors in _expand(piece):
                if not factors or not all(f.name for f in factors):
                    continue
                if len(factors) == 1:
                    if not any(factors[0].same(t) for t in terms):
                        terms.append(factors[0])
                elif not any(len(c) == len(factors) and all(a.same(b) for a, b in zip(c, factors)) for c in crossed):
                    crossed.append(factors)
    fe, cluster = _option(tail, "fe"), _option(tail, "cluster")
    vce = _option(tail, "vce")
    if vce is not None and vce.strip().lower().startswith("cluster"):
        cluster = vce.strip()[len("cluster") :]
    listed = lambda x: None if x is None else names(x)
    return Formula(y.strip(), tuple(terms), tuple(crossed), tuple(endogenous), tuple(instruments), listed(fe), listed(cluster), text.strip())
