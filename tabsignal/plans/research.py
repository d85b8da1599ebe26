"""Whole runs, parameter grids and their command line."""

from __future__ import annotations

import argparse
import itertools
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_params, make_config
from ..functions.scalar import quoted
from ..operators.target import as_timestamp
from ..operators.types import numeric_columns
from ..session import session
from ..sources.steplog import PipelineLogger
from ..sources.tables import load_table, save_params_to_yaml, save_table, file_exists, under, write_text
from . import stages

DONE = "_DONE"


def validate_datasets(df: DataFrame, prices: DataFrame | None, params, strict: bool = True) -> list[str]:
    """What is wrong with the input tables; strict raises it as ValueError."""
    get = params.get if hasattr(params, "get") else lambda k: getattr(params, k)
    problems = []
    ids, date, price = get("id_cols"), get("date_col"), get("price_col")
    for name, table, wanted in (("features", df, [*ids, date, *get("drop_cols")]), ("prices", prices, [*ids, date, price])):
        if table is None:
            continue
        lost = [c for c in wanted if c not in table.columns]
        problems += [f"{name}: no column {c!r}" for c in lost]
        if date in table.columns:
            bad = table.agg(F.count_if(as_timestamp(table, date).isNull())).first()[0]
            if bad:
                problems.append(f"{name}: {bad} dates are missing or cannot be read")
    if prices is not None and price in prices.columns and price not in numeric_columns(prices):
        problems.append("prices: the price is not a number")
    if not [c for c in df.columns if c not in {*ids, date, *get("drop_cols")}]:
        problems.append("features: no feature column")
    if strict and problems:
        raise ValueError("; ".join(problems))
    return problems


def research_pipeline(
    spark: SparkSession,
    to_train_test: bool = True,
    to_wfa: bool = True,
    to_bootstrap: bool = True,
    to_null_fdr: bool = True,
    default_params=None,
    custom_params=None,
    feature_path: str = "data/fundamentals_sample.parquet",
    hloc_path: str = "data/hloc_sample.parquet",
    res_save_path: str = "data/results",
    res_filetype: str = "csv",
) -> dict[str, DataFrame]:
    """Read both tables, run the validations asked for, and save each result with the settings and a log.

    Tables kept between stages stay until ``stages.release()``; the results
    given back still read them.
    """
    if not (to_train_test or to_wfa or to_bootstrap or to_null_fdr):
        raise ValueError("at least one validation is needed")
    params = load_params(default_params, custom_params)
    cfg = make_config(default_params, custom_params)
    features, prices = load_table(spark, feature_path), load_table(spark, hloc_path)
    validate_datasets(features, prices, cfg)
    folder = under(res_save_path, cfg.run_name)
    logger = PipelineLogger(folder, f"{cfg.run_name}_log", cfg.log_markdown, cfg.log_json, cfg.log_max_rows)
    save_params_to_yaml(dict(params), under(folder, "merged_config.yaml"))
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> None:
        out[name] = df
        flat = df.select(*[F.to_json(quoted(c)).alias(c) if t.startswith(("array", "struct", "map")) and res_filetype == "csv" else quoted(c) for c, t in df.dtypes])
        save_table(flat, under(folder, name), res_filetype, single=True)

    if to_train_test:
        combined, log = stages.train_test_pipeline(features, prices, cfg, logger)
        keep("train_test_results", combined)
        keep("train_test_log", log)
    if to_wfa:
        combined, log = stages.wfa_pipeline(features, prices, cfg, logger)
        keep("wfa_results", combined)
        keep("wfa_log", log)
    if to_bootstrap or to_null_fdr:
        ready = stages.prepared(features, prices, cfg, logger)
        mined = stages.held(stages.mining_pipeline(ready, cfg, logger)[0])
        keep("mining_results", mined)
        if to_bootstrap:
            summary, log = stages.bootstrap_pipeline(ready, mined, cfg, logger)
            keep("bootstrap_results", summary)
            keep("bootstrap_log", log)
        if to_null_fdr:
            null_df, log = stages.null_pipeline(ready, mined, cfg, logger)
            keep("null_df", null_df)
            keep("null_log", log)
            result, log = stages.fdr_pipeline(mined, null_df, cfg, logger)
            keep("fdr_res", result)
            keep("fdr_log", log)
    write_text(under(folder, DONE), "")
    return out


#: What a grid runs for each combination.
RUN = research_pipeline


def generate_param_grid(param_space: dict) -> list[dict]:
    """All combinations, keys in order of name."""
    keys = sorted(param_space)
    return [dict(zip(keys, values)) for values in itertools.product(*[param_space[k] if isinstance(param_space[k], list) else [param_space[k]] for k in keys])]


def resolve_path(path: str, base: str | None = None) -> str:
    """A relative path from ``base`` (the working folder by default)."""
    return path if "://" in path or Path(path).is_absolute() else str(Path(base or ".").resolve() / path)


def run_grid_config(spark: SparkSession, i: int, params: dict, grid: dict) -> str | None:
    """One combination as run ``{base}_{i + 1}``; one that is finished is skipped."""
    name = f"{grid.get('base_name', 'run')}_{i + 1}"
    folder = str(grid.get("res_save_path", "data/results"))
    if file_exists(under(folder, name, DONE)):
        return None
    RUN(
        spark,
        *[grid.get(k, True) for k in ("to_train_test", "to_wfa", "to_bootstrap", "to_null_fdr")],
        default_params=grid.get("default_params"),
        custom_params={**(grid.get("custom_params") or {}), **params, "run_name": name},
        feature_path=grid["feature_path"],
        hloc_path=grid["hloc_path"],
        res_save_path=folder,
        res_filetype=grid.get("res_filetype", "csv"),
    )
    return name


def grid_research_pipeline(spark: SparkSession, grid_path: str, exit_on_error: bool = True) -> list[str]:
    """All combinations of a grid file, ``n_jobs`` at a time over one session; gives the runs made."""
    import yaml

    path = Path(grid_path)
    if not path.is_file():
        raise FileNotFoundError(grid_path)
    grid = yaml.safe_load(path.read_text()) or {}
    missing = [k for k in ("param_space", "feature_path", "hloc_path") if k not in grid]
    if missing:
        raise ValueError(f"the grid lacks {missing}")
    for k in ("feature_path", "hloc_path", "res_save_path"):
        if k in grid:
            grid[k] = resolve_path(grid[k], str(path.parent))
    combinations = generate_param_grid(grid["param_space"])
    made, errors = [], []

    def one(job):
        try:
            return run_grid_config(spark, *job, grid)
        except Exception as e:
            if exit_on_error:
                raise
            errors.append(e)
            return None

    with ThreadPoolExecutor(max_workers=max(1, int(grid.get("n_jobs", 1)))) as pool:
        made = [x for x in pool.map(one, enumerate(combinations)) if x]
    return made


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run a grid of configurations.")
    parser.add_argument("grid_path")
    parser.add_argument("--no-exit-on-error", action="store_true")
    args = parser.parse_args(argv)
    try:
        print("\n".join(grid_research_pipeline(session(), args.grid_path, not args.no_exit_on_error)))
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
