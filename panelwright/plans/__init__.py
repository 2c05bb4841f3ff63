"""Registered queries: every operator on the driver tables, with its SQL twin where SQL can say it."""

from importlib import import_module

from panelwright.plans.registry import ORACLE, QUERIES

for _family in ("sources", "checks", "scalar", "temporal", "baselines", "joins", "metrics", "resampling", "attribution", "agreement", "modelling"):
    import_module(f"panelwright.plans.{_family}_queries")

__all__ = ["ORACLE", "QUERIES"]
