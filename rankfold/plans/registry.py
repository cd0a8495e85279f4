"""The two registry runs: validation of known slugs and discovery of new ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rankfold import fixed_values as fv
from rankfold.operators import registry as rg
from rankfold.operators import reports
from rankfold.session import cut_lineage
from rankfold.sources.sinks import write_registry


@dataclass
class Validation:
    outcome: DataFrame
    counts: DataFrame
    needs_update: DataFrame
    registry: DataFrame
    unconfirmed: DataFrame


def validate(registry: DataFrame, probes: DataFrame, save: bool = True) -> Validation:
    outcome = rg.validate_registry(registry, probes)
    if save:
        outcome = cut_lineage(outcome)
    return Validation(
        outcome=outcome, counts=reports.status_counts(outcome), needs_update=rg.any_failure(outcome),
        registry=rg.reconciled(outcome), unconfirmed=rg.unconfirmed(outcome),
    )


def write_validation(result: Validation, folder: str) -> tuple[str, str]:
    """Full snapshots of the next registry and of the slugs to check by hand."""
    return (
        write_registry(result.registry, f"{folder}/registry"),
        write_registry(result.unconfirmed, f"{folder}/unconfirmed"),
    )


@dataclass
class Discovery:
    confirmed: DataFrame
    not_found: DataFrame
    errors: DataFrame
    totals: DataFrame
    by_category: DataFrame
    uncategorised: DataFrame
    lines: DataFrame
    registry: DataFrame


def discover(candidates: DataFrame, probes: DataFrame, categories: DataFrame | None = None,
             ats: str = fv.BOARD_A, save: bool = True) -> Discovery:
    """One pass over the probes: their tries are saved, then folded to winners and errors."""
    keep = cut_lineage if save else (lambda df: df)
    tried = keep(rg.attempts(candidates, probes, ats))
    winners = keep(rg.settled(tried))
    found = rg.found_boards(winners)
    missing = rg.not_found(found)
    errors = rg.errors_before(tried, winners)
    listed = categories if categories is not None else rg.default_categories(candidates)
    return Discovery(
        confirmed=rg.confirmed(found), not_found=missing, errors=errors,
        totals=rg.discovery_totals(found, errors),
        by_category=rg.category_report(missing, listed),
        uncategorised=rg.uncategorised(missing, listed),
        lines=rg.registry_lines(found),
        registry=rg.discovered_registry(found, ats),
    )


def write_discovery(result: Discovery, folder: str) -> str:
    """The confirmed companies as the board kind's new registry, in company order."""
    return write_registry(result.registry, f"{folder}/registry")
