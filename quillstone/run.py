"""Jobs by name from a configuration: ``python -m quillstone.run JOB [--config FILE] [key=value ...]``.

A configuration is JSON, or YAML where that module is there; keys may be nested and are read by dotted paths.  Values on the
command line win over the file's, the file's over the defaults.  Unknown keys and wrong types are refused before anything runs.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.ipc import matches_prefixes
from quillstone.operators import judge, records, relate, stats, validate
from quillstone.session import session
from quillstone.sinks import write_csv, write_routed
from quillstone.sinks.shards import close_shards, pack, write_shards
from quillstone.sources.jsonl import read_shards


@dataclass(frozen=True)
class Config:
    """What a job can be told; the defaults are those of the source this follows."""

    input: str = ""
    output: str = ""
    shard_size: int = 1000
    limit: int = -1
    force: bool = False
    include_open: bool = False
    ipc_prefixes: tuple[str, ...] = ()
    sample_size: int = 50
    seed: int = 42
    pass_score_min: int = 4
    truncate_chars: int = 12_000
    requests_per_minute: int = 500
    headroom: float = 0.9

    def __post_init__(self) -> None:
        for name in ("shard_size", "sample_size", "truncate_chars", "requests_per_minute"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 1 <= self.pass_score_min <= 5:
            raise ValueError("pass_score_min must be from 1 to 5")
        if not 0 < self.headroom <= 1:
            raise ValueError("headroom must be above 0 and at most 1")


def flat(tree: dict, path: str = "") -> dict[str, object]:
    """Values of a nested configuration by their last key; the same key twice is refused."""
    out: dict[str, object] = {}
    for k, v in tree.items():
        for name, value in (flat(v, f"{path}{k}.") if isinstance(v, dict) else {k: v}).items():
            if name in out:
                raise ValueError(f"{path}{k}: {name} is given twice")
            out[name] = value
    return out


def typed(name: str, value: object) -> object:
    """A value as its field wants it: texts of the command line are read, other types must fit."""
    default = next((f.default for f in fields(Config) if f.name == name), None)
    if default is None:
        raise ValueError(f"unknown key {name}")
    if isinstance(default, tuple):
        return tuple(value.split(",") if isinstance(value, str) else value)
    if isinstance(value, str) and not isinstance(default, str):
        value = json.loads(value.lower() if isinstance(default, bool) else value)
    if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if type(value) is not type(default):
        raise ValueError(f"{name} must be {type(default).__name__}, not {value!r}")
    return value


def load(path: str | None, given: Sequence[str] = ()) -> Config:
    """The configuration of a file and of ``key=value`` texts."""
    tree: dict = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            tree = yaml.safe_load(text) or {}
        else:
            tree = json.loads(text)
        if not isinstance(tree, dict):
            raise ValueError(f"{path} holds no mapping")
    values = {k: typed(k, v) for k, v in flat(tree).items()}
    for pair in given:
        k, eq, v = pair.partition("=")
        if not eq:
            raise ValueError(f"{pair} is no key=value")
        values[k.rpartition(".")[2]] = typed(k.rpartition(".")[2], v)
    return Config(**values)


JOBS: dict[str, Callable[[SparkSession, Config], object]] = {}


def job(f: Callable[[SparkSession, Config], object]) -> Callable[[SparkSession, Config], object]:
    JOBS[f.__name__.replace("_", "-")] = f
    return f


def _clean_input(spark: SparkSession, c: Config) -> DataFrame:
    """Clean records of a folder of shards, those of the wanted codes only, at most ``limit`` of them in order."""
    raw = read_shards(spark, c.input, include_open=c.include_open).select("phase", "shard", "line", F.to_json("v").alias("j"))
    shape = "application_number string, fetched_at string, ip_right_status_code string, invention_title string, primary_ipc string, ipcr_classification array<string>, patent_application_type string, filed_date string, priority_date string, expiry_date string, applicant array<string>, inventors array<string>, published_documents array<struct<document_type_code string, file_name string, abstract string, claims array<string>, claims_parse_ok boolean>>"
    rows = raw.select("phase", "shard", "line", F.from_json("j", shape).alias("r")).select("phase", "shard", "line", "r.*")
    kept = rows.filter(matches_prefixes(F.col("ipcr_classification"), c.ipc_prefixes)) if c.ipc_prefixes else rows
    return relate.first_rows(kept, ["phase", "shard", "line"], c.limit if c.limit >= 0 else None)


@job
def clean(spark: SparkSession, c: Config) -> object:
    """Raw shards to clean ones."""
    raw = read_shards(spark, c.input, include_open=c.include_open)
    lines = raw.select("phase", "shard", "line", F.try_variant_get("v", "$.application_number", "string").alias("application_number"), F.try_variant_get("v", "$.fetched_at", "string").alias("fetched_at"), F.to_json(F.try_variant_get("v", "$.response", "variant")).alias("response"))
    rows = records.clean_records(relate.first_rows(lines, ["phase", "shard", "line"], c.limit if c.limit >= 0 else None))
    return write_shards(rows.filter("application_number <> ''"), c.output, ["shard", "line"], c.shard_size, "force" if c.force else "refuse")


@job
def summary(spark: SparkSession, c: Config) -> DataFrame:
    """Counters of the clean records, printed as a table."""
    report = stats.coverage(_clean_input(spark, c))
    report.show(truncate=False, vertical=True)
    return report


@job
def export(spark: SparkSession, c: Config) -> None:
    """Abstracts, first claims and claims as gzipped CSV."""
    for name, df in records.text_exports(_clean_input(spark, c)).items():
        write_csv(df, f"{c.output.rstrip('/')}/{name}", gzip=True)


@job
def label_report(spark: SparkSession, c: Config) -> DataFrame:
    """Codes by frequency, as one CSV, and the summary of their tail."""
    counts = stats.label_counts(_clean_input(spark, c), F.col("ipcr_classification"))
    write_csv(counts.orderBy(F.desc("n"), "code"), f"{c.output.rstrip('/')}/label_counts", one_file=True)
    return stats.tail_summary(counts)


@job
def pack_legacy(spark: SparkSession, c: Config) -> list[str]:
    """A folder of single JSON files as shards."""
    return pack(spark, c.input, c.output, c.shard_size, c.force)


@job
def close(spark: SparkSession, c: Config) -> list[str]:
    """Open shards of the input folder gzipped."""
    return close_shards(spark, c.input)


@job
def validate_instructions(spark: SparkSession, c: Config) -> DataFrame:
    """Instruction records of a parquet folder, validated and routed by outcome; the report by task."""
    done = validate.validate(spark.read.parquet(c.input))
    write_routed(done, c.output, F.col("validation.passed"), c.shard_size)
    return validate.report(done)


@job
def judge_payloads(spark: SparkSession, c: Config) -> None:
    """What a judge is to see of a sample of applications, one JSON text a line."""
    rows = spark.read.parquet(c.input)
    drawn = relate.hash_sample(rows, "application_number", c.sample_size, c.seed)
    rows.join(relate.small(drawn), "application_number").select(judge.payload(c.truncate_chars).alias("value")).write.mode("overwrite" if c.force else "errorifexists").text(c.output)


def main(argv: Sequence[str] | None = None) -> object:
    p = argparse.ArgumentParser(prog="quillstone.run", description=__doc__)
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--config")
    p.add_argument("settings", nargs="*", metavar="key=value")
    a = p.parse_args(argv)
    config = load(a.config, a.settings)
    spark = SparkSession.getActiveSession() or session(app=f"quillstone {a.job}")
    print(json.dumps({"job": a.job, **{f.name: getattr(config, f.name) for f in fields(Config)}}))  # holds no secrets
    return JOBS[a.job](spark, config)


if __name__ == "__main__":
    main()
