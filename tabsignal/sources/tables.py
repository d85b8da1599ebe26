"""Tables and settings in files."""

from __future__ import annotations

import re
import shutil
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Samples(NamedTuple):
    """The two tables that come with an installation's data folder."""

    prices: DataFrame
    fundamentals: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def under(folder: str, *names: str) -> str:
    """A path below a folder, which may be on any file system."""
    return "/".join([str(folder).rstrip("/"), *names])


def _remote(path: str):
    """The file system and path object of a path with a scheme, by the active session."""
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_exists(path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    system, p = _remote(path)
    return system.exists(p)


def write_text(path: str, text: str) -> None:
    """A small text file, over what is there; folders are made."""
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    system, p = _remote(path)
    stream = system.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A .csv or .parquet file or folder, by its suffix in any case.

    A missing path raises FileNotFoundError, another suffix ValueError.
    """
    path = str(path)
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix not in (".csv", ".parquet"):
        raise ValueError(f"only .csv and .parquet are read, not {suffix!r}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path) if suffix == ".parquet" else spark.read.csv(path, header=True, inferSchema=True)


def save_table(df: DataFrame, path: str, filetype: str = "parquet", single: bool = False) -> str:
    """Write as csv or parquet under a path with that suffix; gives the path.

    ``single`` makes one file, for small results.
    """
    if filetype not in ("csv", "parquet"):
        raise ValueError(f"only csv and parquet are written, not {filetype!r}")
    target = str(Path(path).with_suffix("." + filetype)) if "://" not in str(path) else re.sub(r"\.[^./]*$", "", str(path)) + "." + filetype
    writer = (df.coalesce(1) if single else df).write.mode("overwrite")
    writer.parquet(target) if filetype == "parquet" else writer.option("header", True).csv(target)
    return target


def copy_yaml_to_output(source_path: str, output_dir: str) -> str:
    """Copy a .yaml file into a folder, made if need be."""
    source = Path(source_path)
    if source.suffix.lower() not in (".yaml", ".yml"):
        raise ValueError(f"not a yaml file: {source}")
    if not source.is_file():
        raise FileNotFoundError(str(source))
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    return str(shutil.copy2(source, Path(output_dir) / source.name))


def save_params_to_yaml(params: dict, path: str) -> None:
    import yaml

    write_text(str(path), yaml.safe_dump(dict(params), sort_keys=False))


def load_samples(spark: SparkSession, folder: str) -> Samples:
    """The prices and fundamentals samples of a data folder."""
    return Samples(load_table(spark, f"{folder}/hloc_sample.parquet"), load_table(spark, f"{folder}/fundamentals_sample.parquet"))
