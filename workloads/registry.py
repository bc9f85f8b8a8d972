"""All registered workloads, merged."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

_MODULES = [
    "workloads.datatests_wl",
    "workloads.profile_wl",
    "workloads.generation_wl",
    "workloads.render_wl",
    "workloads.twin_wl",
    "workloads.plans_wl",
    "workloads.discover_wl",
    "workloads.xops_wl",
    "workloads.mended_wl",
    "workloads.distribution_wl",
    "workloads.coverage_wl",
]


def _mods():
    return [importlib.import_module(m) for m in _MODULES]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle():
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["twin_report"](spark, sf_dir)
