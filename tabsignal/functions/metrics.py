"""Rule metrics over the 2x2 table of a condition and a class.

a: both; b: condition without the class; c: class without the condition;
d: neither; target_total: a + c; total: all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: keeps denominators from 0.
EPSILON = 1e-12

Metric = Callable[[dict[str, Column]], Column]


def get_stat_registry() -> dict[str, Metric]:
    """The thirteen metrics by name."""
    share = lambda x, m: x / m["total"]
    support = lambda m: share(m["a"], m)
    with_condition = lambda m: share(m["a"] + m["b"], m)
    with_class = lambda m: share(m["a"] + m["c"], m)
    confidence = lambda m: m["a"] / (m["a"] + m["b"] + EPSILON)
    leverage = lambda m: support(m) - with_condition(m) * with_class(m)
    return {
        "support": support,
        "antecedent_support": with_condition,
        "consequent_support": with_class,
        "confidence": confidence,
        "lift": lambda m: confidence(m) / (with_class(m) + EPSILON),
        "leverage": leverage,
        "conviction": lambda m: (1 - with_class(m) + EPSILON) / (1 - confidence(m) + EPSILON),
        "zhangs_metric": lambda m: leverage(m) / F.greatest(support(m) * share(m["b"] + m["d"], m), with_class(m) * share(m["b"], m), F.lit(EPSILON)),
        "jaccard": lambda m: support(m) / (with_condition(m) + with_class(m) - support(m) + EPSILON),
        "representativity": lambda m: m["a"] / (m["target_total"] + EPSILON),
        "certainty": lambda m: confidence(m) - m["c"] / (m["c"] + m["d"] + EPSILON),
        "kulczynski": lambda m: 0.5 * (confidence(m) + support(m) / (with_class(m) + EPSILON)),
        "observations": lambda m: m["a"],
    }


def composite_score(m: dict[str, Column]) -> Column:
    """lift * confidence * sqrt(support), over columns of those names."""
    return m["lift"] * m["confidence"] * F.sqrt(m["support"])


def extend_stat_registry(custom_stats: dict[str, Metric] | None = None, exclude_stats: Sequence[str] | None = None, allow_override: bool = False) -> dict[str, Metric]:
    """The registry with metrics added and left out; a new one must give a Column."""
    registry = get_stat_registry()
    for name in exclude_stats or ():
        if name not in registry:
            raise ValueError(f"unknown metric {name!r}")
        del registry[name]
    probe = {k: F.lit(1.0) for k in ("a", "b", "c", "d", "target_total", "total")}
    for name, make in (custom_stats or {}).items():
        if name in registry and not allow_override:
            raise ValueError(f"metric {name!r} is there already")
        if not callable(make):
            raise TypeError(f"metric {name!r} is not callable")
        try:
            made = make(probe)
        except Exception as e:
            raise ValueError(f"metric {name!r} failed: {e}") from e
        if not isinstance(made, Column):
            raise TypeError(f"metric {name!r} must give a Column")
        registry[name] = make
    return registry
