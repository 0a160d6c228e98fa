"""python -m plumbline OUTPUT INPUT... [key=value ...]: every field of ProfileConfig can be set."""

from __future__ import annotations

import ast
import dataclasses
import sys

from pyspark.sql import SparkSession

from plumbline.config import ProfileConfig
from plumbline.plans.run import run


def parse(args: list[str]) -> tuple[list[str], dict]:
    """Paths, and settings by field name; values are Python literals or else text."""
    known = {f.name for f in dataclasses.fields(ProfileConfig)} | {"format"}
    paths, settings = [], {}
    for arg in args:
        name, sign, value = arg.partition("=")
        if not sign or name not in known:
            paths.append(arg)
            continue
        try:
            settings[name] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            settings[name] = value
    return paths, settings


def main() -> None:
    (output, *inputs), settings = parse(sys.argv[1:])
    fmt = settings.pop("format", "csv")
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    print(run(spark, inputs, output, ProfileConfig(**settings), fmt))


if __name__ == "__main__":
    main()
