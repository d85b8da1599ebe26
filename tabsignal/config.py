"""Settings: defaults, layers, checks."""

from __future__ import annotations

import math
import os
from collections import ChainMap
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

GROUPING_CHOICES = ("none", "ids", "datetime", "datetime+ids")
SPLIT_METHODS = ("temporal", "fractional")
INF = math.inf


def _one_of(*choices, default):
    return field(default=default, metadata={"choices": choices})


def _list(*values, of=None):
    return field(default_factory=lambda: list(values), metadata={"of": of})


@dataclass
class Config:
    """Every setting with its default."""

    # names and defaults are fixed values: they must equal those of users' files
    run_name: str = "my_first_test"
    id_cols: list = _list("ticker", of=str)
    date_col: str = "date"
    log_markdown: bool = True
    log_json: bool = True
    log_max_rows: int = 20
    drop_cols: list = _list(of=str)
    # missing values
    to_drop_high_missingness: bool = True
    missingness_row_thresh: float = 0.9
    missingness_col_thresh: float = 0.9
    to_impute_numeric: bool = True
    impute_strategy: str = _one_of("mean", "median", default="median")
    to_impute_categorical: bool = True
    to_mask_high_impute: bool = True
    max_imputed: float = 0.5
    # outliers and scaling
    to_winsorize: bool = False
    winsor_cols: object = field(default="all", metadata={"columns": True})
    winsor_grouping: str = _one_of(*GROUPING_CHOICES, default="datetime")
    winsor_dt_units: int = 60
    winsor_lower_quantile: float = 0.01
    winsor_upper_quantile: float = 0.99
    scaling_method: str = _one_of("zscore", "robust", "quantile_rank", "unit_vector", default="zscore")
    scale_cols: object = field(default="all", metadata={"columns": True})
    scale_grouping: str = _one_of(*GROUPING_CHOICES, default="none")
    scale_dt_units: int = 20
    robust_scale_quantile_range: list = _list(25, 75)
    quantile_rank_mode: str = _one_of("quantile_normal", "quantile_uniform", "rank", default="quantile_normal")
    vector_scale_norm_type: str = _one_of("l1", "l2", "max", default="l2")
    to_drop_var: bool = True
    variance_threshold: float = 1e-5
    to_drop_corr: bool = True
    correlation_threshold: float = 0.9
    # features
    engineer_cols: str = _one_of("base", "all", default="base")
    to_engineer_ratios: bool = True
    to_engineer_dates: bool = False
    to_engineer_lags: bool = True
    lag_mode: str = _one_of("raw_only", "combined_only", "encoded_and_combined", "raw_and_combined", default="encoded_and_combined")
    n_dt_list: list = _list(4, 2, 1, of=int)
    flat_threshold: list = _list(-0.01, 0.01)
    lag_num_missing: int = 0
    bin_cols: object = field(default="all", metadata={"columns": True})
    bin_quantiles: list = _list(0, 0.25, 0.5, 0.75, 1.0)
    bin_quantile_labels: object = field(default_factory=list, metadata={"labels": "bin_quantiles"})
    bin_grouping: str = _one_of(*GROUPING_CHOICES, default="none")
    bin_dt_units: int = 4
    to_sweep: bool = True
    to_drop_no_data: bool = True
    min_bin_obs: int = 10
    min_bin_fraction: float = 0.01
    # target
    to_calculate_target: bool = True
    target_periods: int = 20
    price_col: str = "adj_close"
    return_mode: str = _one_of("pct_change", "log_return", "vol_adjusted", "smoothed", default="pct_change")
    vol_window: int = 20
    smoothing_method: str = _one_of("median", "mean", "max", "min", default="median")
    target_col: str = "forward_return"
    target_binning_method: str = _one_of("binary", "custom", "quantile", default="custom")
    target_bins: list = _list(-INF, -0.05, 0.05, INF)
    target_labels: list = _list("down", "sideways", "up", of=str)
    target_grouping: str = _one_of(*GROUPING_CHOICES, default="datetime")
    target_n_dt: int = 20
    target_nan_placeholder: str = "no_data"
    # filters of statistics
    stat_min_support: float = 0.01
    stat_min_observations: int = 20
    stat_bounds_lift: list = _list(0.9, 1.1)
    stat_min_antecedent_support: float = -1
    stat_min_consequent_support: float = -1
    stat_min_confidence: float = -1
    stat_min_representativity: float = -1
    stat_min_leverage: float = -1
    stat_min_conviction: float = -1
    stat_min_zhangs_metric: float = -1
    stat_min_jaccard: float = -1
    stat_min_certainty: float = -1
    stat_min_kulczynski: float = -1
    # mining input, synthetic and augmented rows
    to_sample: bool = True
    sample_size: int = 100_000
    drop_duplicates: bool = False
    synth_silence: bool = True
    corrupt_data: bool = False
    corrupt_target: str = _one_of("none", "real", "synthetic", "both", default="none")
    to_sdv: bool = False
    sdv_rows: int = 500
    sdv_model: str = _one_of("gaussian_copula", "ctgan", "tvae", default="gaussian_copula")
    sdv_verbose: bool = False
    to_synthcity: bool = False
    sc_rows: int = 500
    sc_model: str = _one_of("adsgan", "ctgan", "pategan", "rtvae", "tvae", default="ctgan")
    sc_n_iter: int = 10
    sc_batch_size: int = 128
    sc_lr: float = 0.0001
    sc_device: str = _one_of("cpu", "cuda", default="cpu")
    to_aug_imbalance: bool = False
    to_aug_flip_feats: bool = False
    to_aug_flip_targets: bool = False
    flip_feats_frac: float = 0.1
    flip_targs_frac: float = 0.1
    # miners
    miners: list = _list("univar", "rulefit", "subgroup", of=str)
    apriori_min_support: float = 0.01
    apriori_metric: str = "lift"
    apriori_min_metric: float = 0.0
    rulefit_tree_size: int = 3
    rulefit_min_depth: int = 2
    subgroup_top_n: int = 50
    subgroup_depth: int = 3
    subgroup_beam_width: int = 50
    cart_max_depth: int = 5
    cart_criterion: str = _one_of("gini", "entropy", default="gini")
    cart_random_state: int = 42
    cart_min_samples_split: int = 2
    cart_min_samples_leaf: int = 1
    # validation
    perform_train_test: bool = True
    train_test_split_method: str = _one_of(*SPLIT_METHODS, default="fractional")
    train_test_splits: int = 2
    train_test_ranges: list = _list(["2010-01-01", "2015-01-01"], ["2015-01-01", "2020-01-01"])
    train_test_window_frac: float = 0.6
    train_test_step_frac: float = 0.0
    train_test_fractions: list = _list(0.6, 0.4)
    train_test_overlap: bool = False
    train_test_re_mine: bool = False
    perform_wfa: bool = True
    wfa_split_method: str = _one_of(*SPLIT_METHODS, default="temporal")
    wfa_splits: int = 4
    wfa_ranges: list = _list(["2010-01-01", "2017-01-01"], ["2011-01-01", "2018-01-01"], ["2012-01-01", "2019-01-01"], ["2013-01-01", "2020-01-01"])
    wfa_window_frac: float = 0.4
    wfa_step_frac: float = 0.2
    wfa_fractions: list = _list(0.25, 0.25, 0.25, 0.25)
    wfa_overlap: bool = True
    wfa_re_mine: bool = True
    perform_bootstrap: bool = True
    n_bootstrap: int = 1000
    bootstrap_verbose: bool = True
    resample_method: str = _one_of("traditional", "block", "block_ids", default="traditional")
    block_size: int = 4
    perform_null_fdr: bool = True
    shuffle_mode: str = _one_of("target", "rows", "columns", default="target")
    n_null: int = 1000
    null_verbose: bool = True
    early_stop_metric: str = "lift"
    es_m_permutations: int = 50
    rel_error_threshold: float = 0.01
    correction_metric: str = _one_of("fdr_bh", "fdr_by", default="fdr_bh")
    correction_alpha: float = 0.05
    fdr_mode: str = _one_of("greater", "less", "two-sided", default="two-sided")


def gather_known_keys() -> set[str]:
    return {f.name for f in fields(Config)}


def is_integer(params: Mapping, key: str) -> bool:
    return isinstance(params.get(key), int) and not isinstance(params.get(key), bool)


def is_float(params: Mapping, key: str) -> bool:
    return isinstance(params.get(key), (int, float)) and not isinstance(params.get(key), bool)


def is_string(params: Mapping, key: str) -> bool:
    return isinstance(params.get(key), str)


def is_bool(params: Mapping, key: str) -> bool:
    return isinstance(params.get(key), bool)


def is_list(params: Mapping, key: str) -> bool:
    return isinstance(params.get(key), (list, tuple))


def is_in_choices(choices: Sequence, params: Mapping, key: str) -> bool:
    return params.get(key) in choices


def is_all_or_list_of_strings(params: Mapping, key: str) -> bool:
    v = params.get(key)
    return v == "all" or (isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v) and len(set(v)) == len(v))


def is_valid_quantile_bins(bins) -> bool:
    """Numbers that rise from 0 to 1."""
    return _rising(bins) and bins[0] == 0 and bins[-1] == 1


def is_valid_custom_bins(bins) -> bool:
    return _rising(bins)


def _rising(bins) -> bool:
    if not isinstance(bins, (list, tuple)) or len(bins) < 2:
        return False
    if not all(isinstance(b, (int, float)) and not isinstance(b, bool) for b in bins):
        return False
    return all(a < b for a, b in zip(bins, bins[1:]))


def is_valid_bin_labels(labels, bins) -> bool:
    """None, empty, or a text for each bin."""
    if labels is None or labels == []:
        return True
    return isinstance(labels, (list, tuple)) and all(isinstance(x, str) for x in labels) and isinstance(bins, (list, tuple)) and len(labels) == len(bins) - 1


def _errors_of(f, params: Mapping) -> list[str]:
    """What is wrong with one setting."""
    name, value = f.name, params[f.name]
    choices, kind = f.metadata.get("choices"), f.type
    if f.metadata.get("columns"):
        return [] if is_all_or_list_of_strings(params, name) else [f"{name}: 'all' or a list of texts is needed"]
    if f.metadata.get("labels"):
        return [] if is_valid_bin_labels(value, params.get(f.metadata["labels"])) else [f"{name}: a text for each bin is needed"]
    checks = {"int": is_integer, "float": is_float, "str": is_string, "bool": is_bool, "list": is_list}
    if kind in checks and not checks[kind](params, name):
        return [f"{name}: {kind} is needed, not {value!r}"]
    if choices and not is_in_choices(choices, params, name):
        return [f"{name}: one of {list(choices)} is needed, not {value!r}"]
    of = f.metadata.get("of")
    if of and not all(isinstance(x, of) and not isinstance(x, bool) for x in value):
        return [f"{name}: a list of {of.__name__} is needed"]
    return []


def config_validator(params: Mapping, strict: bool = True) -> None:
    """Collect everything wrong with the settings given and raise one ValueError; strict also rejects unknown keys."""
    known = {f.name: f for f in fields(Config)}
    errors = [f"{k}: unknown setting" for k in params if k not in known] if strict else []
    for k in params:
        if k in known:
            errors += _errors_of(known[k], params)
    if "bin_quantiles" in params and is_list(params, "bin_quantiles") and not is_valid_quantile_bins(params["bin_quantiles"]):
        errors.append("bin_quantiles: numbers rising from 0 to 1 are needed")
    if {"target_bins", "target_binning_method", "target_labels"} <= set(params) and is_list(params, "target_bins"):
        bins, method = params["target_bins"], params["target_binning_method"]
        if method == "quantile" and not is_valid_quantile_bins(bins):
            errors.append("target_bins: numbers rising from 0 to 1 are needed")
        if method == "custom" and not is_valid_custom_bins(bins):
            errors.append("target_bins: rising numbers are needed")
        if method == "binary" and (len(bins) != 1 or len(params["target_labels"]) != 2):
            errors.append("target_bins: binary needs one border and two labels")
        if method != "binary" and not is_valid_bin_labels(params["target_labels"], bins):
            errors.append("target_labels: a text for each bin is needed")
    if errors:
        raise ValueError("invalid settings:\n" + "\n".join(errors))


def _layer(source) -> dict:
    if source is None:
        return {}
    if isinstance(source, Mapping):
        return dict(source)
    if not isinstance(source, (str, os.PathLike)):
        raise TypeError("settings come from a dict or a .yaml path")
    path = Path(source)
    if path.suffix.lower() not in (".yaml", ".yml"):
        raise ValueError(f"not a yaml file: {path}")
    if not path.is_file():
        return {}
    import yaml

    return yaml.safe_load(path.read_text()) or {}


def load_params(default_params=None, custom_params=None, strict: bool = True) -> ChainMap:
    """Custom settings over default ones over the built-in ones, checked; a missing file is an empty layer."""
    built_in = {f.name: getattr(Config(), f.name) for f in fields(Config)}
    layers = ChainMap(_layer(custom_params), _layer(default_params), built_in)
    config_validator(dict(layers), strict)
    return layers


def make_config(default_params=None, custom_params=None) -> Config:
    merged = load_params(default_params, custom_params)
    return Config(**{f.name: merged[f.name] for f in fields(Config)})


def pretty_print_params(params: ChainMap, show_layers: bool = False) -> str:
    """Settings as text, with the layer each comes from if asked."""
    lines = []
    for k in sorted(params):
        layer = next((i for i, m in enumerate(params.maps) if k in m), 0) if isinstance(params, ChainMap) else 0
        lines.append(f"{k}: {params[k]!r}" + (f"  [layer {layer}]" if show_layers else ""))
    return "\n".join(lines)
