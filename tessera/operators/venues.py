"""Classification of venues by a table of names: aliases, academic and practitioner lists, scopes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import venue


@dataclass(frozen=True)
class Venues:
    """Names as written; they are normalised where they are used. Lists of rules are small driver-side data."""

    academic: tuple[str, ...] = ()
    practitioner: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    ambiguous: tuple[str, ...] = ()
    working_paper: tuple[str, ...] = ()
    scopes: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _names(names) -> Column:
    return F.array(*(venue(F.lit(n)) for n in names)) if names else F.array().cast("array<string>")


def resolved(name: Column, cfg: Venues) -> Column:
    """The normalised name, or that of what it is an alias of. Aliases are constant-folded by the optimizer."""
    n = venue(name)
    out = n
    for alias, target in reversed(cfg.aliases.items()):
        out = F.when(n == venue(F.lit(alias)), venue(F.lit(target))).otherwise(out)
    return out


def _working_paper(n: Column, cfg: Venues) -> Column:
    out = F.lit(False)
    for p in cfg.working_paper:
        out = out | n.contains(venue(F.lit(p)))
    return out


def reason(n: Column, cfg: Venues) -> Column:
    """The branch that a resolved name takes."""
    branch = F.when(n.isNull(), F.lit(None).cast("string")).when(F.array_contains(_names(cfg.ambiguous), n), "ambiguous").when(F.array_contains(_names(cfg.academic), n), "academic")
    return branch.when(F.array_contains(_names(cfg.practitioner), n), "practitioner").when(_working_paper(n, cfg), "working_paper").otherwise("unknown")


def is_academic(n: Column, cfg: Venues) -> Column:
    r = reason(n, cfg)
    return F.when(r == "academic", True).when(r == "practitioner", False)


def scope(n: Column, cfg: Venues) -> Column:
    """An explicit scope (the first that lists the name), else one by the academic or practitioner list."""
    branches = [(F.array_contains(_names(v), n), k) for k, v in cfg.scopes.items()]
    branches += [(F.array_contains(_names(cfg.academic), n), "finance_adjacent"), (F.array_contains(_names(cfg.practitioner), n), "finance_practitioner")]
    out = F.when(n.isNull(), F.lit(None).cast("string"))
    for condition, label in branches:
        out = out.when(condition, label)
    return out


def classify(df: DataFrame, cfg: Venues, column: str = "recovered_journal") -> DataFrame:
    """df with venue_norm, is_academic_code, venue_scope and venue_reason. Distinct names are few next to rows, but no
    shuffle is spent on them: all is one projection."""
    out = df.withColumn("venue_norm", resolved(F.col(column), cfg))
    n = F.col("venue_norm")
    return out.withColumns({"is_academic_code": is_academic(n, cfg), "venue_scope": scope(n, cfg), "venue_reason": reason(n, cfg)})


# Edits: each returns a new configuration.


def add(cfg: Venues, section: str, name: str) -> Venues:
    """Adds a name to a section; fails if a section has it already."""
    for other in ("academic", "practitioner", "ambiguous"):
        if name.strip().lower() in (x.strip().lower() for x in getattr(cfg, other)):
            raise ValueError(f"{name!r} is in {other}")
    return replace(cfg, **{section: (*getattr(cfg, section), name)})


def remove(cfg: Venues, section: str, name: str) -> Venues:
    return replace(cfg, **{section: tuple(x for x in getattr(cfg, section) if x != name)})


def alias(cfg: Venues, name: str, target: str) -> Venues:
    return replace(cfg, aliases=cfg.aliases | {name: target})


def unalias(cfg: Venues, name: str) -> Venues:
    return replace(cfg, aliases={k: v for k, v in cfg.aliases.items() if k != name})


def set_scope(cfg: Venues, name: str, label: str) -> Venues:
    """A name has one scope at most."""
    cleared = {k: tuple(x for x in v if x != name) for k, v in cfg.scopes.items()}
    return replace(cfg, scopes=cleared | {label: (*cleared.get(label, ()), name)})


def unset_scope(cfg: Venues, name: str) -> Venues:
    return replace(cfg, scopes={k: tuple(x for x in v if x != name) for k, v in cfg.scopes.items()})
