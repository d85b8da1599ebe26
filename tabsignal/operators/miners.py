"""Rule miners: frequent item sets, trees, rule ensembles, beam search, covering, and a classifier system.

Tables come one-hot encoded: every column but the target is 0 or 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import quoted
from ..sources.shared import drop_saved, saved
from .grouping import global_row_number
from .synth import keyed
from .rules import Rule, condition, normalize_and_dedup_rules, normalize_rule, parse_apriori_rules, rule_stats, rules_table
from .stats import CHUNK, build_filter_config, apply_statistic_filters, generate_statistics

MINERS = ("univar", "apriori", "rulefit", "subgroup", "elcs", "cn2", "cart")
#: Different rows that the classifier system learns from, at most; beyond that a sample, drawn by a hash of the row.
ELCS_ROWS = 20_000
#: Rows whose hash is looked at for a sample, as a multiple of its size; where a class then lacks rows, all of it are.
LOWEST = 1.5
#: Classes of a target, at most.
CLASSES = 1000
#: Rules after which the covering miner writes down what is left.
KEPT = 4


def _features(df: DataFrame, target_col: str) -> list[str]:
    if target_col not in df.columns:
        raise ValueError(f"no target column {target_col!r}")
    return [c for c in df.columns if c != target_col]


def _classes(df: DataFrame, target_col: str) -> list[str]:
    """The classes in order; more than CLASSES raise ValueError."""
    found = sorted(r[0] for r in df.select(quoted(target_col).cast("string")).na.drop().distinct().limit(CLASSES + 1).collect())
    if len(found) > CLASSES:
        raise ValueError(f"the target {target_col!r} has more than {CLASSES} classes")
    return found


def _counted(df: DataFrame, target_col: str) -> DataFrame:
    """The different rows and how often each occurs (_n): miners of 0 and 1 count those."""
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))


def prepare_dataframe_for_mining(df: DataFrame, date_col: str, id_cols: Sequence[str], drop_cols: Sequence[str], target_col: str = "forward_return", to_sample: bool = True, sample_size: int = 100_000, drop_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features as 0 and 1 and the target; duplicates dropped and classes sampled in proportion, as asked.

    Of each class as many rows are taken as its share of the sample, rounded,
    those that come first by a hash of the row and its number among equal rows;
    rows with a null target are not sampled.  Only rows whose hash is low enough
    to be among the first are put in order, and all of a class that has too few
    of those.  The log has rows before and after and the classes.
    """
    gone = {date_col, *id_cols, *drop_cols} - {target_col}
    features = [c for c in df.columns if c not in gone | {target_col}]
    out = df.select(*[quoted(c).cast("tinyint").alias(c) for c in features], quoted(target_col))
    if drop_duplicates:
        out = out.dropDuplicates()
    before = out.count()
    if to_sample and before > sample_size:
        drawn = keyed(out).filter(quoted(target_col).isNotNull()).withColumn("_draw", F.xxhash64("_key", F.lit(42)))
        wanted = F.round(F.col("_k") * F.lit(sample_size / before)).alias("_wanted")
        sizes = saved(out.filter(quoted(target_col).isNotNull()).groupBy(quoted(target_col).alias("_class")).agg(F.count(F.lit(1)).alias("_k")).select("_class", wanted), "classes")
        if sizes.count() > CLASSES:
            raise ValueError(f"the target {target_col!r} has more than {CLASSES} classes")
        low = int(min(1.0, LOWEST * sample_size / before) * 2**64) - 2**63 - 1  # hashes go from -2**63 on
        few = saved(drawn.filter(F.col("_draw") <= F.lit(low)), "drawn")
        found = few.groupBy(quoted(target_col).alias("_c")).agg(F.count(F.lit(1)).alias("_found"))
        lacks = sizes.join(F.broadcast(found), F.col("_class").eqNullSafe(F.col("_c")), "left").filter(F.coalesce("_found", F.lit(0)) < F.col("_wanted"))
        late = [r[0] for r in lacks.select("_class").collect()]
        if late:
            few = few.unionByName(drawn.filter((F.col("_draw") > F.lit(low)) & quoted(target_col).isin(late)))
        numbered = global_row_number(few, [target_col, "_draw"], "_row")
        firsts = numbered.groupBy(quoted(target_col).alias("_c")).agg(F.min("_row").alias("_first"))
        bounds = firsts.join(F.broadcast(sizes), F.col("_class").eqNullSafe(F.col("_c"))).drop("_c")
        out = numbered.join(F.broadcast(bounds), quoted(target_col) == F.col("_class")).filter(F.col("_row") - F.col("_first") < F.col("_wanted")).select(*[quoted(c) for c in out.columns])
    log = out.agg(F.lit(before).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), F.count_distinct(quoted(target_col)).alias("n_classes")).withColumn("n_features", F.lit(len(features)))
    return out, log


def _frequent_sets(baskets: DataFrame, least: int) -> DataFrame:
    """items, freq of the item sets in at least so many rows, from baskets (items, n).

    Items are ranked, the most frequent first; a task takes the sets whose last
    item is one item, from the different beginnings of the baskets up to it.
    """
    least = max(1, least)
    single = baskets.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
    names = [r["item"] for r in sorted(single, key=lambda r: (-r["n"], r["item"]))]
    if not names:
        return baskets.sparkSession.createDataFrame([], "items array<string>, freq long")
    known = F.array(*[F.lit(x) for x in names])
    ranked = baskets.select(F.array_sort(F.filter(F.transform("items", lambda x: F.array_position(known, x).cast("int")), lambda k: k > 0)).alias("r"), "n").filter(F.size("r") > 0)
    heads = ranked.select(F.explode(F.transform("r", lambda x, i: F.struct(x.alias("last"), F.slice("r", 1, i).alias("head")))).alias("e"), "n").groupBy("e.last", "e.head").agg(F.sum("n").alias("n"))

    def project(rows: list[tuple[tuple, int]], suffix: tuple, out: list[tuple[tuple, int]]) -> None:
        """FP-growth by projection: the frequent items before the suffix, each with what it makes frequent in turn."""
        counts: dict[int, int] = {}
        for items, n in rows:
            for x in items:
                counts[x] = counts.get(x, 0) + n
        for x, k in counts.items():
            if k < least:
                continue
            out.append(((x, *suffix), k))
            before: dict[tuple, int] = {}
            for items, n in rows:
                if x in items and items[0] != x:
                    head = tuple(y for y in items[: items.index(x)] if counts[y] >= least)
                    before[head] = before.get(head, 0) + n
            project([(h, n) for h, n in before.items() if h], (x, *suffix), out)

    def grow(key, f):
        import pandas as pd

        last, out = int(key[0]), []
        out.append(((last,), int(f["n"].sum())))
        project([(tuple(int(x) for x in h), int(n)) for h, n in zip(f["head"], f["n"]) if len(h)], (last,), out)
        return pd.DataFrame({"r": [list(x) for x, _ in out], "freq": [n for _, n in out]})

    found = heads.groupBy("last").applyInPandas(grow, "r array<int>, freq long")
    return found.select(F.transform("r", lambda k: F.element_at(known, k)).alias("items"), "freq")


def perform_apriori(df: DataFrame, target_col: str = "forward_return", min_support: float = 0.01, metric: str = "lift", min_threshold: float = 0.0, sort_rules: bool = False, max_len: int | None = None) -> DataFrame:
    """antecedents array, consequents, support, confidence, lift, leverage, conviction of rules with two conditions or more.

    Item sets come from FP-growth over true features and the row's class, run
    on the different baskets with their numbers.  ``max_len`` bounds the conditions of a rule.
    """
    features = _features(df, target_col)
    each = [F.when(quoted(c).cast("int") == 1, F.lit(c)) for c in features]
    target = F.concat(F.lit("target="), F.coalesce(quoted(target_col).cast("string"), F.lit("null")))
    baskets = df.select(F.array_compact(F.array(*each, target)).alias("items"))
    baskets = saved(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("n")), "baskets")
    n = baskets.agg(F.sum("n")).first()[0] or 0
    sets = _frequent_sets(baskets, math.ceil(min_support * n))
    is_target = lambda x: x.startswith("target=")
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_target(x))).alias("antecedents"), F.filter("items", is_target).alias("t"), F.col("freq").cast("double").alias("freq"))
    whole = split.filter((F.size("t") == 1) & (F.size("antecedents") >= 2))
    if max_len:
        whole = whole.filter(F.size("antecedents") <= max_len)
    alone = split.filter(F.size("t") == 0).select(F.col("antecedents").alias("_a"), F.col("freq").alias("n_a"))
    classes = split.filter((F.size("t") == 1) & (F.size("antecedents") == 0)).select(F.col("t")[0].alias("_t"), F.col("freq").alias("n_c"))
    rules = whole.join(alone, whole["antecedents"] == alone["_a"]).join(F.broadcast(classes), whole["t"][0] == classes["_t"])
    s, a, c = F.col("freq") / n, F.col("n_a") / n, F.col("n_c") / n
    confidence = F.col("freq") / F.col("n_a")
    out = rules.select("antecedents", F.substring(F.col("t")[0], 8, 1 << 20).alias("consequents"), s.alias("support"), confidence.alias("confidence"), (confidence / c).alias("lift"), (s - a * c).alias("leverage"), F.when(confidence < 1, (1 - c) / F.nullif(1 - confidence, F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("conviction"))
    out = out.filter(F.col(metric) >= min_threshold)
    return out.orderBy(F.col(metric).desc(), "antecedents", "consequents") if sort_rules else out


def _vectors(counted: DataFrame, features: Sequence[str], label) -> DataFrame:
    """Different rows with their number as weight: trees keep those in memory, not each row."""
    flat = counted.select(*[quoted(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)], label.cast("double").alias("label"), F.col("_n").cast("double").alias("weight"))
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features").transform(flat).select("features", "label", "weight")


def _paths(node, features: Sequence[str], inner: bool) -> list[Rule]:
    """Conditions from the root to each leaf, or to each node; x <= 0.5 means 0, x > 0.5 means 1."""
    out: list[Rule] = []

    def walk(at, path: Rule) -> None:
        leaf = at.numDescendants() == 0
        if path and (leaf or inner):
            out.append(list(path))
        if not leaf:
            f = features[at.split().featureIndex()]
            walk(at.leftChild(), [*path, (f, 0)])
            walk(at.rightChild(), [*path, (f, 1)])

    walk(node, [])
    return out


def perform_cart(df: DataFrame, target_col: str, max_depth: int = 5, criterion: str = "gini", random_state: int = 42, min_samples_split: int = 2, min_samples_leaf: int = 1) -> list[Rule]:
    """Root-to-leaf paths of a decision tree."""
    features = _features(df, target_col)
    classes = _classes(df, target_col)
    if not features or len(classes) < 2:
        return []
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), quoted(target_col).cast("string")) - 1
    rows = saved(_counted(df.filter(quoted(target_col).isNotNull()), target_col), "different-rows")
    least = max(min_samples_leaf, min_samples_split // 2)
    share = (least - 0.5) / rows.agg(F.sum("_n")).first()[0] if least > 1 else 0.0  # of the rows, half a row below the least
    if share >= 0.5:
        return []
    tree = DecisionTreeClassifier(maxDepth=max_depth, impurity=criterion, seed=random_state, minWeightFractionPerNode=share, weightCol="weight").fit(_vectors(rows, features, label))
    drop_saved(rows)
    return sorted({tuple(normalize_rule(p)) for p in _paths(tree._call_java("rootNode"), features, False)})


def perform_rulefit(df: DataFrame, target_col: str = "forward_return", tree_size: int = 3, min_rule_depth: int = 2, trees: int = 10) -> list[Rule]:
    """Tree rules of a boosted ensemble for each class against the rest; nulls raise ValueError."""
    features = _features(df, target_col)
    nulls = df.agg(*[F.count_if(quoted(c).isNull()) for c in df.columns]).first()
    if any(nulls):
        raise ValueError("the table has nulls")
    found: set = set()
    depth = max(1, math.ceil(math.log2(max(2, tree_size + 1))))
    rows = saved(_counted(df, target_col), "different-rows")
    for c in _classes(rows, target_col):
        data = _vectors(rows, features, (quoted(target_col).cast("string") == c).cast("double"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=42, weightCol="weight").fit(data)
        for tree in model._call_java("trees"):
            found |= {tuple(normalize_rule(p)) for p in _paths(tree.rootNode(), features, True)}
    drop_saved(rows)
    return sorted(r for r in found if len(r) >= min_rule_depth and len({f for f, _ in r}) == len(r))


def _counts(df: DataFrame, rules: Sequence[Rule], positive) -> list[tuple[int, int]]:
    """(rows that meet a rule, those of them that are positive), many rules in one aggregate."""
    out: list[tuple[int, int]] = []
    for at in range(0, len(rules), CHUNK):
        part = [condition(df, list(r)) for r in rules[at : at + CHUNK]]
        row = df.agg(*[x for c in part for x in (F.count_if(c), F.count_if(c & positive))]).first()
        out += [(row[2 * i], row[2 * i + 1]) for i in range(len(part))]
    return out


def wracc(n_s: int, p_s: int, n: int, p: int) -> float:
    """Weighted relative accuracy."""
    return (n_s / n) * (p_s / n_s - p / n) if n_s and n else 0.0


def perform_subgroup_discovery(df: DataFrame, target_col: str, top_n: int = 50, depth: int = 3, beam_width: int = 50, qf: Callable[[int, int, int, int], float] | None = None) -> list[tuple[Rule, str, float]]:
    """(rule, class, quality) by beam search on true features for each class, rules of two conditions or more, best first.

    A level's candidates are counted together; only the beam stays on the driver.
    """
    features, quality = _features(df, target_col), qf or wracc
    out: list[tuple[Rule, str, float]] = []
    total = df.count()
    for c in _classes(df, target_col):
        positive = F.coalesce(quoted(target_col).cast("string") == c, F.lit(False))
        p = df.filter(positive).count()
        beam: list[tuple] = [()]
        found: dict[tuple, float] = {}
        for _ in range(depth):
            level = sorted({tuple(sorted({*r, (f, 1)})) for r in beam for f in features if (f, 1) not in r})
            if not level:
                break
            scored = sorted(((quality(n, k, total, p), r) for r, (n, k) in zip(level, _counts(df, level, positive)) if n), key=lambda x: (-x[0], x[1]))
            beam = [r for _, r in scored[:beam_width]]
            found |= {r: q for q, r in scored[:beam_width]}
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top_n]
        out += [(list(r), c, q) for r, q in best if len(r) > 1]
    return out


def perform_cn2(df: DataFrame, target_col: str, max_rules: int = 20, depth: int = 3, beam_width: int = 5, min_covered: int = 5) -> list[tuple[Rule, str]]:
    """An ordered rule list: the best rule by Laplace accuracy, then again on what it does not cover.

    Counts run over the different rows; what is left is written to the shared
    folder every KEPT rules.
    """
    features, classes = _features(df, target_col), _classes(df, target_col)
    out: list[tuple[Rule, str]] = []
    left = saved(_counted(df.filter(quoted(target_col).isNotNull()), target_col), "uncovered")
    for _ in range(max_rules):
        beam, best = [()], None
        for _ in range(depth):
            level = sorted({tuple(sorted({*r, (f, v)})) for r in beam for f in features for v in (0, 1) if all(f != g for g, _ in r)})
            if not level:
                break
            scored = []
            for at in range(0, len(level), CHUNK):
                part = level[at : at + CHUNK]
                rows = left.groupBy(quoted(target_col).cast("string").alias("t")).agg(*[F.sum(F.when(condition(left, list(r)), F.col("_n")).otherwise(0)).alias(f"_{i}") for i, r in enumerate(part)]).collect()
                for i, r in enumerate(part):
                    counts = {x["t"]: x[f"_{i}"] for x in rows}
                    n = sum(counts.values())
                    if n >= min_covered:
                        c, k = max(sorted(counts.items()), key=lambda x: x[1])
                        scored.append(((k + 1) / (n + len(classes)), n, r, c))
            scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
            beam = [x[2] for x in scored[:beam_width]]
            if scored and (best is None or scored[0][0] > best[0]):
                best = scored[0]
        if best is None:
            break
        out.append((list(best[2]), best[3]))
        left = left.filter(~condition(left, list(best[2])))
        if len(out) % KEPT == 0:
            left = saved(left, "uncovered")
        if (left.agg(F.sum("_n")).first()[0] or 0) < min_covered:
            break
    return out


def validate_binary_table(df: DataFrame, target_col: str) -> DataFrame:
    """The table, if its features are 0 and 1 and its target is there and not null."""
    features = _features(df, target_col)
    row = df.agg(*[F.count_if(~F.coalesce(quoted(c).cast("int").isin(0, 1), F.lit(False))) for c in features], F.count_if(quoted(target_col).isNull())).first()
    bad = [c for c, n in zip([*features, target_col], row) if n]
    if bad:
        raise ValueError(f"not binary or null: {bad}")
    return df


def perform_elcs(df: DataFrame, target_col: str, rows: int = ELCS_ROWS, population: int = 200, rounds: int = 15, seed: int = 42) -> list[tuple[Rule, str]]:
    """A learning classifier system for each class: an evolving population of rules.

    Fitness counts the different rows, each as often as it occurs; if there are
    more than ``rows`` of them, those drawn by a hash.  Each class is evolved in
    a task of its own.
    """
    features, classes = _features(df, target_col), _classes(df, target_col)
    if not features or not classes:
        return []
    counted = saved(_counted(df, target_col), "different-rows")
    n = counted.count()
    draw = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = counted.filter(draw < min(1.0, rows / max(1, n))).select(F.array(*[quoted(c).cast("int") for c in features]).alias("x"), quoted(target_col).cast("string").alias("y"), F.col("_n").alias("n"))
    tasks = sample.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))

    def evolve(key, f):
        import pandas as pd

        f = f.sort_values(["y", "n"], kind="stable")
        order = sorted(range(len(f)), key=lambda i: (tuple(f["x"].iloc[i]), str(f["y"].iloc[i])))  # not that of arrival
        f = f.iloc[order]
        found = _evolve(np.array(f["x"].tolist(), float) > 0.5, (f["y"] == key[0]).to_numpy(), f["n"].to_numpy(float), key[0], population, rounds, seed)
        rules = pd.Series([[j * 2 + v for j, v in r] for r in found], dtype=object)  # may be empty
        return pd.DataFrame({"cls": pd.Series([key[0]] * len(found), dtype=object), "rule": rules})

    got = tasks.groupBy("cls").applyInPandas(evolve, "cls string, rule array<int>").collect()
    return sorted(([(features[k // 2], k % 2) for k in r["rule"]], r["cls"]) for r in got) if got else []


def _evolve(x: np.ndarray, good: np.ndarray, weight: np.ndarray, name: str, population: int, rounds: int, seed: int) -> list[tuple]:
    """Rules as (column, value) pairs; genes are -1 for any, 0 and 1."""
    r, width, total = np.random.default_rng([seed, *name.encode()]), x.shape[1], weight.sum()
    if not good.any():
        return []

    def fitness(genes: np.ndarray) -> float:
        if (genes < 0).all():  # says nothing
            return 0.0
        hit = np.ones(len(x), bool)
        for j in np.flatnonzero(genes >= 0):
            hit &= x[:, j] == (genes[j] == 1)
        k = weight[hit].sum()
        return float((weight[hit & good].sum() / k if k else 0) ** 2 * np.sqrt(k / total))

    pool = np.full((population, width), -1)
    for g in pool:  # each begins as a general form of a positive row
        row = x[r.choice(np.flatnonzero(good), p=weight[good] / weight[good].sum())]
        j = r.choice(width, min(width, int(r.integers(1, 4))), replace=False)
        g[j] = row[j]
    score = np.array([fitness(g) for g in pool])
    for _ in range(rounds):
        parents = pool[r.choice(len(pool), (population, 2), p=(score + 1e-9) / (score + 1e-9).sum())]
        young = np.where(r.random((population, width)) < 0.5, parents[:, 0], parents[:, 1])
        young = np.where(r.random(young.shape) < 1 / width, r.integers(-1, 2, young.shape), young)
        both, both_score = np.concatenate([pool, young]), np.concatenate([score, [fitness(g) for g in young]])
        first = np.sort(np.unique(both, axis=0, return_index=True)[1])  # each form once, so the pool stays diverse
        best = first[np.argsort(-both_score[first], kind="stable")][:population]
        pool, score = both[best], both_score[best]
    return sorted(r for r in {tuple((int(j), int(g[j])) for j in np.flatnonzero(g >= 0)) for g in pool[:50]} if r)


def mine_apriori(df: DataFrame, target_col: str, apriori_min_support: float = 0.01, apriori_metric: str = "lift", apriori_min_metric: float = 0.0) -> list[Rule]:
    found = perform_apriori(df, target_col, apriori_min_support, apriori_metric, apriori_min_metric).select("antecedents").distinct().collect()
    return parse_apriori_rules(r[0] for r in found)


def mine_rulefit(df: DataFrame, target_col: str, rulefit_tree_size: int = 3, rulefit_min_depth: int = 2) -> list[Rule]:
    return [list(r) for r in perform_rulefit(df, target_col, rulefit_tree_size, rulefit_min_depth)]


def mine_subgroup(df: DataFrame, target_col: str, subgroup_top_n: int = 50, subgroup_depth: int = 3, subgroup_beam_width: int = 50) -> list[Rule]:
    return [r for r, _, _ in perform_subgroup_discovery(df, target_col, subgroup_top_n, subgroup_depth, subgroup_beam_width)]


def mine_elcs(df: DataFrame, target_col: str) -> list[Rule]:
    return [r for r, _ in perform_elcs(df, target_col)]


def mine_cn2(df: DataFrame, target_col: str) -> list[Rule]:
    return [r for r, _ in perform_cn2(validate_binary_table(df, target_col), target_col)]


def mine_cart(df: DataFrame, target_col: str, cart_max_depth: int = 5, cart_criterion: str = "gini", cart_random_state: int = 42, cart_min_samples_split: int = 2, cart_min_samples_leaf: int = 1) -> list[Rule]:
    return [list(r) for r in perform_cart(df, target_col, cart_max_depth, cart_criterion, cart_random_state, cart_min_samples_split, cart_min_samples_leaf)]


def mine_univar(df: DataFrame, cfg) -> tuple[DataFrame, DataFrame]:
    """Statistics of every single feature."""
    stats, summary = generate_statistics(df, cfg)
    return stats.withColumn("rule_depth", F.lit(1)), summary


def mine_multivar(df: DataFrame, cfg, rule_sources: Sequence[tuple[Rule, str]], target_col: str) -> tuple[DataFrame, DataFrame]:
    """Statistics of mined rules, each once, and rules by miner."""
    unique, counts = normalize_and_dedup_rules(rules_table(df.sparkSession, rule_sources))
    rules = sorted({tuple(normalize_rule(r)) for r, _ in rule_sources})
    stats, _ = apply_statistic_filters(rule_stats(df, [list(r) for r in rules], target_col), build_filter_config(cfg))
    return stats, counts


def mine_stats(df: DataFrame, target_col: str, miners: Sequence[str], cfg, **params) -> tuple[DataFrame, DataFrame]:
    """Statistics of the rules of the listed miners in one table, and rules by miner."""
    unknown = [m for m in miners if m not in MINERS]
    if unknown:
        raise ValueError(f"unknown miners: {unknown}")
    own = {
        "apriori": (mine_apriori, ("apriori_min_support", "apriori_metric", "apriori_min_metric")),
        "rulefit": (mine_rulefit, ("rulefit_tree_size", "rulefit_min_depth")),
        "subgroup": (mine_subgroup, ("subgroup_top_n", "subgroup_depth", "subgroup_beam_width")),
        "cart": (mine_cart, ("cart_max_depth", "cart_criterion", "cart_random_state", "cart_min_samples_split", "cart_min_samples_leaf")),
        "elcs": (mine_elcs, ()),
        "cn2": (mine_cn2, ()),
    }
    sources: list[tuple[Rule, str]] = []
    for m in miners:
        if m != "univar":
            f, names = own[m]
            sources += [(r, m) for r in f(df, target_col, **{k: params[k] for k in names if k in params})]
    stats = counts = None
    if "univar" in miners:
        stats, _ = mine_univar(df, cfg)
        counts = df.sparkSession.createDataFrame([("univar", len(_features(df, target_col)))], "source string, n_rules long")
    if sources:
        multi, by_miner = mine_multivar(df, cfg, sources, target_col)
        stats = multi if stats is None else stats.unionByName(multi, allowMissingColumns=True)
        counts = by_miner if counts is None else counts.unionByName(by_miner)
    if stats is None:
        stats = rule_stats(df, [], target_col).withColumn("selected", F.lit(False))
        counts = df.sparkSession.createDataFrame([], "source string, n_rules long")
    return stats, counts
