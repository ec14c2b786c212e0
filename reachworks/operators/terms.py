"""Model terms: interactions with their margins, and the design columns they stand for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

Term = tuple[str, ...]


def terms_of(terms: str | Sequence[str]) -> list[Term]:
    """Terms written as ``a``, ``a:b`` and so on, in a list or added up in one string; main effects come first."""
    parts = terms.split("+") if isinstance(terms, str) else terms
    each = [tuple(dict.fromkeys(v.strip() for v in part.split(":"))) for part in parts]
    once = {frozenset(t): t for t in reversed(each)}
    return sorted((t for t in dict.fromkeys(each) if once[frozenset(t)] == t), key=len)


def up_to(variables: Sequence[str], order: int) -> list[str]:
    """The variables and all their products of up to ``order``."""
    return [":".join(some) for n in range(1, order + 1) for some in combinations(variables, n)]


def label(term: Term) -> str:
    return ":".join(term)


def margins_kept(terms: Sequence[Term]) -> bool:
    """Whether every interaction stands beside all terms it contains."""
    have = {frozenset(t) for t in terms}
    return all(frozenset(some) in have for t in terms for n in range(1, len(t)) for some in combinations(t, n))


def sub_models(terms: Sequence[Term], fixed: Sequence[Term] = ()) -> list[tuple[Term, ...]]:
    """All subsets that hold the fixed terms and the margins of their interactions."""
    always = {frozenset(t) for t in fixed}
    free = [t for t in terms if frozenset(t) not in always]
    picked = (set(some) for n in range(len(free) + 1) for some in combinations(free, n))
    each = (tuple(t for t in terms if frozenset(t) in always or t in some) for some in picked)
    return [m for m in each if margins_kept(m)]


@dataclass(frozen=True)
class Design:
    """Terms of a model and the levels of the factors among their variables; the first level is the base."""

    terms: tuple[Term, ...]
    levels: Mapping[str, tuple] = field(default_factory=dict)

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for t in self.terms for v in t))

    def _parts(self, variable: str) -> list[tuple[str, Column]]:
        if variable not in self.levels:
            return [(variable, F.col(variable).cast("double"))]
        known = F.col(variable).isin(list(self.levels[variable]))
        # A level that was not fitted is unknown, not the base.
        return [(f"{variable}{lv}", F.when(known, (F.col(variable) == F.lit(lv)).cast("double"))) for lv in self.levels[variable][1:]]

    def columns(self) -> list[tuple[str, Term, Column]]:
        """(name, term, column) of everything but the intercept; NULL where a variable is missing or a level unknown."""
        out = []
        for term in self.terms:
            for parts in product(*map(self._parts, term)):
                out.append((":".join(n for n, _ in parts), term, reduce(lambda a, b: a * b, (c for _, c in parts))))
        return out

    def names(self) -> list[str]:
        return ["(Intercept)", *[n for n, _, _ in self.columns()]]

    def row(self) -> Column:
        """The model row, intercept first; NULL as a whole where any of it is unknown, single-level factors included."""
        one = F.when(reduce(lambda a, b: a & b, [self.known(v) for v in self.variables], F.lit(True)), F.lit(1.0))
        return F.when(one.isNotNull(), F.array(F.lit(1.0), *[c for _, _, c in self.columns()]))

    def known(self, variable: str) -> Column:
        return F.coalesce(F.col(variable).isin(list(self.levels[variable])), F.lit(False)) if variable in self.levels else F.col(variable).isNotNull()


def design(train: DataFrame, terms: str | Sequence[str] | Sequence[Term]) -> Design:
    """The design of a model on these rows; text and flags are factors with their levels in order."""
    parsed = [t for t in terms] if not isinstance(terms, str) and all(isinstance(t, tuple) for t in terms) else terms_of(terms)
    names = dict.fromkeys(v for t in parsed for v in t)
    kinds = {c: train.schema[c].dataType for c in names}
    factors = [c for c in names if isinstance(kinds[c], (StringType, BooleanType))]
    found = train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in factors]).first() if factors else {}
    return Design(tuple(parsed), {c: tuple(found[c]) for c in factors})
