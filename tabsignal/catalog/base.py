"""Registry of queries and what they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **names: str) -> DataFrame:
    """Doubles rounded (without a negative zero), and columns renamed."""
    out = []
    for c, t in df.dtypes:
        x = F.round(quoted(c), digits) + F.lit(0.0) if t in ("double", "float") else quoted(c)
        out.append(x.alias(names.get(c, c)))
    return df.select(*out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel: id user_id, date ts; x is value with some nulls, kind is event_type with some nulls."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        "value",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"),
    )


#: The same in SQL.
EVENTS = """panel AS (SELECT event_id, user_id, ts, event_type, value,
    CASE WHEN event_id % 7 <> 0 THEN value END AS x, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events)"""


def rules_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as binary features and the status as class."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_quantity") > 25).cast("int").alias("big"),
        (F.col("l_discount") >= 0.05).cast("int").alias("discounted"),
        (F.col("l_returnflag") == "A").cast("int").alias("returned"),
        (F.col("l_extendedprice") > 50000).cast("int").alias("dear"),
        F.col("l_linestatus").alias("status"),
    )


RULES = """input AS (SELECT CAST(l_quantity > 25 AS INT) AS big, CAST(l_discount >= 0.05 AS INT) AS discounted,
    CAST(l_returnflag = 'A' AS INT) AS returned, CAST(l_extendedprice > 50000 AS INT) AS dear, l_linestatus AS status FROM lineitem)"""
FEATURES: Sequence[str] = ("big", "discounted", "returned", "dear")

_CELLS = "CAST(a AS DOUBLE) AS a, CAST(na - a AS DOUBLE) AS b, CAST(nc - a AS DOUBLE) AS c, CAST(n - na - nc + a AS DOUBLE) AS d, CAST(nc AS DOUBLE) AS nc, CAST(n AS DOUBLE) AS n"


def metrics_sql(counts: str, keep: str = "antecedents, consequents") -> str:
    """The thirteen metrics from a relation of antecedents, consequents, a, na, nc, n."""
    e = "1e-12"
    conf, supp, aa, cc = f"(a / (a + b + {e}))", "(a / n)", "((a + b) / n)", "((a + c) / n)"
    lev = f"({supp} - {aa} * {cc})"
    parts = {
        "support": supp,
        "antecedent_support": aa,
        "consequent_support": cc,
        "confidence": conf,
        "lift": f"({conf} / ({cc} + {e}))",
        "leverage": lev,
        "conviction": f"((1 - {cc} + {e}) / (1 - {conf} + {e}))",
        "zhangs_metric": f"({lev} / greatest({supp} * ((b + d) / n), {cc} * (b / n), {e}))",
        "jaccard": f"({supp} / ({aa} + {cc} - {supp} + {e}))",
        "representativity": f"(a / (nc + {e}))",
        "certainty": f"({conf} - c / (c + d + {e}))",
        "kulczynski": f"(0.5 * ({conf} + {supp} / ({cc} + {e})))",
        "observations": "a",
    }
    return f"SELECT {keep}, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in parts.items()) + f" FROM (SELECT {keep}, {_CELLS} FROM {counts})"
