"""Stages of a run under one configuration: each takes a table and settings and gives tables and logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..config import Config
from ..functions.scalar import quoted
from ..operators import features, miners, missing, prune, scale, splits, synth, target, types, validate
from ..sources.shared import drop_saved, saved
from ..sources.steplog import PipelineLogger


def with_overrides(cfg: Config, overrides: dict) -> Config:
    """The configuration with some settings replaced; an unknown one raises ValueError."""
    unknown = [k for k in overrides if not hasattr(cfg, k)]
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return replace(cfg, **overrides) if overrides else cfg


#: Tables kept between stages, for :func:`release`.
HELD: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder: the decisions of later steps (types, columns, edges) read it again and again.

    Plans stay short, and a lost executor costs no earlier work.
    """
    HELD.append(saved(df, "held"))
    return HELD[-1]


def release() -> None:
    """Delete all kept tables."""
    while HELD:
        drop_saved(HELD.pop())


def _note(logger: PipelineLogger | None, step: str, info: dict, tables=None) -> None:
    if logger:
        logger.log_step(step, info, tables)


#: Parts of a split that are worked on at the same time, at most; small steps of one then run beside large ones of another.
AT_ONCE = 4


class _Notes(list):
    """Log entries of a part, kept until the parts before it have written theirs."""

    def log_step(self, *entry) -> None:
        self.append(entry)


def _each(work: Callable, parts: Sequence, logger: PipelineLogger | None) -> list:
    """``work(part, logger)`` of every part, some at once; results and log entries in the order of the parts."""
    notes = [_Notes() if logger else None for _ in parts]
    with ThreadPoolExecutor(max_workers=max(1, min(AT_ONCE, len(parts)))) as pool:
        out = list(pool.map(inheritable_thread_target(parts[0].sparkSession)(work), parts, notes))
    for entry in (e for n in notes if n for e in n):
        logger.log_step(*entry)
    return out


def clean_pipeline(df: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, dict]:
    """Types, missing values, outliers and redundancy, scaling."""
    cfg = with_overrides(cfg, overrides)
    ids = [c for c in cfg.id_cols if c in df.columns]
    other = [c for c in (*cfg.drop_cols, cfg.date_col) if c in df.columns]
    logs: dict = {}
    out, logs["types"] = types.apply_column_type_cleaning(held(df))
    out = held(out)
    out, more = missing.handle_missing_data(out, cfg.missingness_row_thresh, cfg.missingness_col_thresh, cfg.to_drop_high_missingness, cfg.to_impute_numeric, cfg.to_impute_categorical, cfg.to_mask_high_impute, ids, cfg.impute_strategy, cfg.max_imputed, other)
    out = held(out)
    logs |= more
    out, more = prune.handle_outliers_and_redundancy(out, cfg.to_winsorize, cfg.to_drop_var, cfg.to_drop_corr, cfg.winsor_cols, cfg.winsor_grouping, ids, cfg.date_col, cfg.winsor_dt_units, cfg.winsor_lower_quantile, cfg.winsor_upper_quantile, cfg.variance_threshold, cfg.correlation_threshold, cfg.drop_cols)
    logs |= more
    wanted = cfg.scale_cols if cfg.scale_cols == "all" else [c for c in cfg.scale_cols if c in out.columns]
    if types.numeric_columns(out, [*ids, *other]):
        out, logs["scaling"] = scale.normalize_features(out, cfg.scaling_method, wanted, cfg.scale_grouping, ids, cfg.date_col, cfg.scale_dt_units, tuple(cfg.robust_scale_quantile_range), cfg.quantile_rank_mode, cfg.vector_scale_norm_type, cfg.drop_cols)
    out = held(out)
    _note(logger, "clean", {"columns": out.columns}, {"types": logs["types"]})
    return out, logs


def engineer_pipeline(df: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> DataFrame:
    """Ratios, lags, dates; then bins and one-hot columns."""
    cfg = with_overrides(cfg, overrides)
    drop = [c for c in cfg.drop_cols if c in df.columns]
    out = features.engineer_features(df, cfg.date_col, cfg.id_cols, cfg.engineer_cols, cfg.to_engineer_dates, cfg.to_engineer_ratios, cfg.to_engineer_lags, cfg.lag_mode, cfg.n_dt_list, cfg.flat_threshold, drop)
    out = held(out)
    bins = cfg.bin_cols if cfg.bin_cols == "all" else [c for c in cfg.bin_cols if c in out.columns]
    out = features.encode_data(out, cfg.date_col, cfg.id_cols, drop, bins, cfg.bin_quantiles, cfg.bin_quantile_labels, cfg.bin_grouping, cfg.bin_dt_units, cfg.to_sweep, cfg.to_drop_no_data, cfg.min_bin_obs, cfg.min_bin_fraction, cfg.lag_num_missing)
    out = held(out)
    _note(logger, "engineer", {"n_columns": len(out.columns)})
    return out


def forward_returns(hloc: DataFrame | None, cfg: Config) -> DataFrame:
    """The prices' returns as :func:`target_pipeline` joins them: ids, _returns_date, target."""
    if hloc is None:
        raise ValueError("a table of prices is needed")
    returns = target.compute_forward_return(hloc, cfg.target_periods, cfg.id_cols, cfg.date_col, cfg.target_col, cfg.price_col, cfg.return_mode, cfg.vol_window, cfg.smoothing_method, keep_all=True)
    return returns.select(*[quoted(c) for c in cfg.id_cols], quoted(cfg.date_col).alias("_returns_date"), quoted(cfg.target_col))


def target_pipeline(df: DataFrame, cfg: Config, hloc: DataFrame | None = None, logger: PipelineLogger | None = None, returns: DataFrame | None = None, **overrides) -> tuple[DataFrame, dict]:
    """Forward return (``returns``, if it is known), as-of join, rows with any null dropped, target binned.

    A row takes the next price's return, also if that has none and drops it.
    """
    cfg = with_overrides(cfg, overrides)
    out, logs = df, {}
    if cfg.to_calculate_target:
        returns = forward_returns(hloc, cfg) if returns is None else returns
        merged = target.merge_features_with_returns(df, returns, id_cols=cfg.id_cols, feature_date_col=cfg.date_col, returns_date_col="_returns_date")
        logs = target.summarize_merge(merged, cfg.id_cols, "_returns_date", cfg.date_col, cfg.target_col)
        out = held(merged.drop("_returns_date").na.drop())
    out = target.bin_target_column(out, cfg.target_bins, cfg.target_labels, cfg.target_binning_method, cfg.target_col, cfg.id_cols, cfg.date_col, cfg.target_grouping, cfg.target_n_dt, cfg.target_nan_placeholder)
    _note(logger, "target", {"method": cfg.target_binning_method}, logs)
    return out, logs


def data_prep_pipeline(df: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, dict]:
    """Mining input, with synthetic and augmented rows as asked."""
    cfg = with_overrides(cfg, overrides)
    ready, log = miners.prepare_dataframe_for_mining(df, cfg.date_col, [c for c in cfg.id_cols], cfg.drop_cols, cfg.target_col, cfg.to_sample, cfg.sample_size, cfg.drop_duplicates)
    logs = {"prepare": log}
    made = synth.generate_combined_synthetic_data(ready, cfg.target_col, cfg.to_sdv, cfg.to_synthcity, cfg.sdv_model, cfg.sdv_rows, cfg.sc_model, cfg.sc_rows) if cfg.to_sdv or cfg.to_synthcity else None
    augment = lambda t: synth.augment_dataset(t, cfg.target_col, cfg.to_aug_imbalance, cfg.to_aug_flip_feats, cfg.to_aug_flip_targets, cfg.flip_feats_frac, cfg.flip_targs_frac)
    real = augment(ready) if cfg.corrupt_data and cfg.corrupt_target in ("real", "both") else None
    fake = augment(made) if made is not None and cfg.corrupt_data and cfg.corrupt_target in ("synthetic", "both") else None
    out = synth.coalesce_data(ready, made, real, fake)
    _note(logger, "data_prep", {"n_columns": len(out.columns)}, logs)
    return out, logs


def mining_pipeline(df: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    """Rule statistics of the configured miners, and rules by miner."""
    cfg = with_overrides(cfg, overrides)
    params = {k: v for k, v in vars(cfg).items() if k.startswith(("apriori_", "rulefit_", "subgroup_", "cart_"))}
    stats, counts = miners.mine_stats(df, cfg.target_col, cfg.miners, cfg, **params)
    _note(logger, "mining", {"miners": cfg.miners}, {"rules": stats, "by_miner": counts})
    return stats, counts


def prepared(df: DataFrame, hloc: DataFrame | None, cfg: Config, logger: PipelineLogger | None = None, returns: DataFrame | None = None) -> DataFrame:
    """Clean, engineer, target and prepare, in that order."""
    out, _ = clean_pipeline(df, cfg, logger)
    out = engineer_pipeline(out, cfg, logger)
    out, _ = target_pipeline(out, cfg, hloc, logger, returns)
    return held(data_prep_pipeline(out, cfg, logger)[0])


def split_datasets(df: DataFrame, hloc: DataFrame | None, cfg: Config, date_col: str, logger: PipelineLogger | None = None, n_splits=None, ranges=None, method: str = "fractional", window_frac=None, step_frac=None, fractions=None, overlap: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """Split by time, prepare each part on its own, keep the columns that all have; the prices' returns serve all parts."""
    typed = types.parse_datetime_column(df, date_col)
    if method == "temporal":
        parts, log = splits.generate_time_splits(typed, date_col, n_splits, ranges)
    elif method == "fractional":
        parts, log = splits.generate_fraction_splits(typed, date_col, n_splits, window_frac, step_frac, fractions, overlap)
    else:
        raise ValueError(f"unknown split method {method!r}")
    returns = held(forward_returns(hloc, cfg)) if cfg.to_calculate_target else None
    ready = _each(lambda p, notes: prepared(p, hloc, cfg, notes, returns), parts, logger)
    common = sorted(set.intersection(*[set(r.columns) for r in ready]))
    return [r.select(*[quoted(c) for c in common]) for r in ready], log


def split_mining_pipeline(parts: list[DataFrame], cfg: Config, re_mine: bool, target_col: str, logger: PipelineLogger | None = None) -> list[DataFrame]:
    """Mine the first part; mine the others too, or test the first's rules on them."""
    if len(parts) < 2:
        raise ValueError("at least two splits are needed")
    mine = lambda p, notes: held(mining_pipeline(p, cfg, notes)[0])
    if re_mine:
        return _each(mine, parts, logger)
    first = mine(parts[0], logger)
    return [first, *_each(lambda p, _: held(validate.test_mined_rules(first, p, cfg, target_col)), parts[1:], None)]


def _validated(df, hloc, cfg, target_col, date_col, n_splits, ranges, method, window_frac, step_frac, fractions, overlap, re_mine, logger):
    explicit = fractions if method == "fractional" and not window_frac else None
    parts, log = split_datasets(df, hloc, cfg, date_col, logger, n_splits, ranges if method == "temporal" else None, method, window_frac, step_frac, explicit, overlap)
    combined = held(validate.combine_split_results(split_mining_pipeline(parts, cfg, re_mine, target_col, logger)))
    return combined, validate.create_validation_log_df(combined, [f"split_{i}" for i in range(len(parts))]), log


def validate_train_test(df: DataFrame, hloc: DataFrame | None, cfg: Config, logger: PipelineLogger | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules of the first split on the others: combined statistics, validation log, split log."""
    fractions = cfg.train_test_fractions or None
    return _validated(df, hloc, cfg, cfg.target_col, cfg.date_col, cfg.train_test_splits, cfg.train_test_ranges, cfg.train_test_split_method, None if fractions else cfg.train_test_window_frac, cfg.train_test_step_frac, fractions, cfg.train_test_overlap, cfg.train_test_re_mine, logger)


def validate_wfa(df: DataFrame, hloc: DataFrame | None, cfg: Config, logger: PipelineLogger | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same over walk-forward windows."""
    fractions = None if cfg.wfa_window_frac else cfg.wfa_fractions
    return _validated(df, hloc, cfg, cfg.target_col, cfg.date_col, cfg.wfa_splits, cfg.wfa_ranges, cfg.wfa_split_method, cfg.wfa_window_frac, cfg.wfa_step_frac, fractions, cfg.wfa_overlap, cfg.wfa_re_mine, logger)


def train_test_pipeline(df: DataFrame, hloc: DataFrame | None, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    combined, log, cut = validate_train_test(df, hloc, with_overrides(cfg, overrides), logger)
    _note(logger, "train_test", {}, {"log": log, "splits": cut})
    return combined, log


def wfa_pipeline(df: DataFrame, hloc: DataFrame | None, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    combined, log, cut = validate_wfa(df, hloc, with_overrides(cfg, overrides), logger)
    _note(logger, "walk_forward", {}, {"log": log, "splits": cut})
    return combined, log


def bootstrap_pipeline(df: DataFrame, mining_res: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    cfg = with_overrides(cfg, overrides)
    summary, log = validate.validate_bootstrap(df, mining_res, cfg, cfg.target_col, cfg.n_bootstrap, 42, cfg.resample_method, cfg.block_size, cfg.date_col, cfg.id_cols)
    summary = held(summary)
    _note(logger, "bootstrap", {"n": cfg.n_bootstrap}, {"log": log})
    return summary, log


def null_pipeline(df: DataFrame, mining_res: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    cfg = with_overrides(cfg, overrides)
    null_df, log = validate.validate_null(df, mining_res, cfg.target_col, cfg.n_null, cfg.early_stop_metric, cfg.es_m_permutations, cfg.rel_error_threshold, save=held)
    null_df = held(null_df)
    _note(logger, "null", {"n": cfg.n_null}, {"log": log})
    return null_df, log


def fdr_pipeline(mining_res: DataFrame, null_df: DataFrame, cfg: Config, logger: PipelineLogger | None = None, **overrides) -> tuple[DataFrame, DataFrame]:
    cfg = with_overrides(cfg, overrides)
    out = held(validate.validate_multiple_tests(mining_res, null_df, cfg.early_stop_metric, cfg.fdr_mode, cfg.correction_alpha, cfg.correction_metric))
    log = validate.summarize_fdr_results(out, "pval", f"{cfg.correction_metric}_significant", cfg.correction_alpha)
    _note(logger, "fdr", {"method": cfg.correction_metric}, {"log": log})
    return out, log
