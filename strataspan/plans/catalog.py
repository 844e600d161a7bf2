"""All queries of the core library, with SQL where SQL can express them."""

from __future__ import annotations

from strataspan.operators import controls, curves, density, files, manifests, orthography, outputs, partitions, protocols, randomized, reports, runs, schedule, scripts, spectrum, texts, vocabularies  # noqa: F401  they register their queries
from strataspan.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
