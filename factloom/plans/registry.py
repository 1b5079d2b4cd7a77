"""All registered queries with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["finding_queries", "text_queries", "case_queries", "stream_queries", "dataset_queries"]


def _collect():
    queries, oracles = {}, {}

    def add(name, fn, sql=None):
        assert name not in queries, name
        queries[name] = fn
        if sql is not None:
            oracles[name] = sql

    for module in MODULES:
        importlib.import_module(f"factloom.plans.{module}").register(add)
    return queries, {k: v() if callable(v) else v for k, v in oracles.items()}


def queries():
    from factloom.session import WIDE_PLANS, prepare

    def wrap(fn):
        def run(spark, sf_dir):
            for key, value in WIDE_PLANS.items():
                spark.conf.set(key, value)
            return fn(prepare(spark), sf_dir)

        return run

    return {k: wrap(fn) for k, fn in _collect()[0].items()}


def oracle_sql():
    return _collect()[1]
