"""A run's settings: defaults, over them a YAML-like file, over that command-line flags; and dictionary files."""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """What a run may be told. Zero records means all of them."""

    model: str = "offline"
    batch_size: int = 25
    max_records: int = 0
    overwrite: bool = False
    sleep_seconds: float = 0.0
    competitor_words_file: str = ""
    token_separators_file: str = ""

    def updated(self, values: dict[str, str]) -> Settings:
        """With values given as text; names that are none of the settings' are left alone."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        known = {k: v for k, v in values.items() if k in kinds}
        return replace(self, **{k: (v.strip().lower() in ("1", "true", "yes", "on") if kinds[k] is bool else kinds[k](v)) for k, v in known.items()})


def parsed(lines: Iterable[str]) -> dict[str, str]:
    """`name: value` lines, nested ones under their own name; quotes around a value and comments after it go."""
    out = {}
    for line in lines:
        name, colon, value = line.split(" #")[0].partition(":")
        if colon and not name.lstrip().startswith("#") and value.strip():
            out[name.strip().replace("-", "_")] = value.strip().strip("\"'")
    return out


def lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file by any path that Spark reads, in order."""
    text = spark.read.text(path, wholetext=True).first()
    return (text.value if text else "").splitlines()


def words(spark: SparkSession, path: str, default: Iterable[str]) -> tuple[str, ...]:
    """The words of a dictionary file, one a line, in order and once each, blank lines and comments aside; `default` without a file."""
    if not path:
        return tuple(default)
    found = (x.strip() for x in lines(spark, path))
    return tuple(dict.fromkeys(x for x in found if x and not x.startswith("#")))


def settings(spark: SparkSession | None = None, path: str = "", arguments: Iterable[str] | None = None) -> Settings:
    """Defaults, then the file, then flags such as --batch-size 50 or --overwrite."""
    found = Settings().updated(parsed(lines(spark, path))) if path and spark is not None else Settings()
    parser = argparse.ArgumentParser()
    for f in fields(Settings):
        flag = "--" + f.name.replace("_", "-")
        parser.add_argument(flag, **({"action": "store_const", "const": "true"} if isinstance(getattr(found, f.name), bool) else {}))
    given = vars(parser.parse_args([] if arguments is None else list(arguments)))
    return found.updated({k: v for k, v in given.items() if v is not None})
