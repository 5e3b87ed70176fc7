"""The daily regime run from a series to routing table and metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import mixture, regimes
from tidemark.sources import io

#: Fixed values of the default run; a file of settings overrides them.
DEFAULTS = {
    "csv": None, "n": 3000, "seed": 0, "train_frac": 0.7, "out_dir": None, "expert_alpha": 10.0,
    "label": {"horizon": 30, "k": 0.4, "vol_window": 30},
    "router": {"hidden": 4, "epochs": 150, "l2": 0.03, "temperature": 1.0, "top_k": 0},
}


def merged(below: dict, above: dict) -> dict:
    """The values of ``above`` over those of ``below``, in nested groups too."""
    return below | {k: merged(below[k], v) if isinstance(v, dict) and isinstance(below.get(k), dict) else v for k, v in above.items()}


def settings(text: str | None = None, **overrides) -> dict:
    """The defaults, a JSON or YAML text over them, and named values over both; groups are merged value by value."""
    told = {}
    if text:
        try:
            told = json.loads(text)
        except ValueError:
            import yaml

            told = yaml.safe_load(text) or {}
    return merged(merged(DEFAULTS, told), overrides)


def run(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(routing of the test days, one row of metrics); written as CSV and JSON where ``out_dir`` is named."""
    days = io.read_daily_csv(spark, config["csv"]) if config.get("csv") else io.synthetic_regimes(spark, config["n"], config["seed"])
    table = regimes.features(days)
    columns = [c for c in table.columns if c not in ("date", "close")]
    label, router = config["label"], config["router"]
    joined = table.join(regimes.labels(days, **label).select("date", "regime"), "date").join(regimes.next_return(days).select("date", "next_ret"), "date")
    gate = {"hidden": router["hidden"], "rounds": router["epochs"], "decay": router["l2"], "temperature": router["temperature"], "top_k": router["top_k"]}
    routing = mixture.routed(joined, columns, config["train_frac"], label["horizon"], config["expert_alpha"], **gate)
    metrics = mixture.routing_metrics(routing)
    if config.get("out_dir"):
        io.write_small(routing.orderBy("date"), f"{config['out_dir']}/routing_test")
        io.write_small(metrics, f"{config['out_dir']}/metrics", "json")
    return routing, metrics
