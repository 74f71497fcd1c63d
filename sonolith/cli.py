"""The command line: python -m sonolith.cli preprocess | update | info | add_embedding."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dataset
from .operators import config, registry
from .sources import files


def _switch(parser: argparse.ArgumentParser, name: str, default: bool, text: str) -> None:
    parser.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default, help=text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sonolith")
    commands = out.add_subparsers(dest="command", required=True)
    many = {"action": "append", "default": []}
    p = commands.add_parser("preprocess", help="build a dataset")
    p.add_argument("--path", action="append", required=True, help="folders of source files")
    p.add_argument("--out", help="the dataset's folder (default: beside the first path)")
    p.add_argument("--config", default="default", help="a preset, or a configuration file")
    p.add_argument("--config_path", **many, help="folders to look for configuration files in")
    p.add_argument("--scope", **many, help="a scope of the configuration, later ones win")
    p.add_argument("--sample_rate", type=int, help="44100 unless the configuration says otherwise")
    p.add_argument("--channels", type=int, help="1 unless the configuration says otherwise")
    p.add_argument("--chunk_length", type=int, help="samples a chunk; the hop is half of it")
    p.add_argument("--max_db_size", type=float, help="has no effect: tables grow as they need")
    p.add_argument("--log", help="a file for the number of chunks of each source file")
    _switch(p, "force", False, "replace an existing dataset")
    _switch(p, "waveform", True, "store waveforms")
    _switch(p, "compact", False, "few files, in key order")
    u = commands.add_parser("update", help="append files, fill in features")
    u.add_argument("--path", required=True)
    u.add_argument("--data", **many, help="folders of files to append")
    for c in (p, u):
        for name in ("feature", "filter", "exclude", "meta_regexp", "override"):
            c.add_argument(f"--{name}", **many)
    i = commands.add_parser("info", help="what a dataset holds")
    i.add_argument("--path", required=True)
    _switch(i, "files", False, "list files")
    _switch(i, "check_metadata", False, "what each row lacks")
    i.add_argument("--idx", type=int, **many)
    i.add_argument("--key", **many)
    e = commands.add_parser("add_embedding", help="add a module's output and its views")
    e.add_argument("--path", required=True)
    e.add_argument("--module", required=True, help="a JSON file: weights, stride and (optional) bias")
    e.add_argument("--method", default="forward", help="has no effect: a layer has one method")
    e.add_argument("--name")
    e.add_argument("--transform", **many, help="for a further view, by name")
    e.add_argument("--model_sr", type=int)
    for c in (u, e):
        _switch(c, "overwrite", False, "compute features anew")
    for c in (p, e):
        c.add_argument("--device", help="has no effect: Spark places tasks")
    for c in (p, u, e):
        _switch(c, "check", False, "print the plan first")
    return out


def _features(names: list[str], sr: int) -> list:
    return [registry.feature(n, sr=sr) for n in names]


def _resolved(args) -> dict:
    """The configuration with what the command line says on top."""
    said = [f"audio.waveform={json.dumps(args.waveform)}"]
    said += [f"audio.{k}={v}" for k, v in (("sr", args.sample_rate), ("channels", args.channels)) if v is not None]
    if args.chunk_length:
        said += [f"windows.chunk={args.chunk_length}", f"windows.hop={args.chunk_length // 2}"]
    lists = {"include": args.filter, "exclude": args.exclude, "patterns": args.meta_regexp}
    said += [f"files.{k}={json.dumps(v)}" for k, v in lists.items() if v]
    plain = [o if "." in o.partition("=")[0] else f"windows.{o}" for o in args.override]
    out = config.merge({"audio": {"sr": 44100, "channels": 1}}, config.resolve(args.config, args.config_path, args.scope, [*said, *plain]))
    known = out.get("features", [])
    return out | {"features": known + [f for f in args.feature if f not in known]}


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> dataset.Dataset:
    if args.command == "preprocess":
        target = args.out or args.path[0].rstrip("/") + "_dataset"
        if args.check:
            print(f"{files.scan(spark, args.path, args.filter, args.exclude, content=False).count()} files to {target}", file=out)
        made = dataset.preprocess(spark, args.path, target, **config.arguments(_resolved(args)), force=args.force)
        if args.compact:
            made = dataset.compact(spark, target)
        if args.log:
            with open(args.log, "w", encoding="utf-8") as log:
                for r in dataset.info(made)["files"].orderBy("file_path").toLocalIterator():
                    log.write(f"{r.file_path}\t{r.n_chunks}\n")
    elif args.command == "update":
        stored = dataset.Dataset(spark, args.path)
        if args.check:
            print(f"{len(stored)} rows stored; files from {', '.join(args.data) or 'nowhere'}, features {', '.join(args.feature) or 'none'}", file=out)
        made = dataset.update(spark, args.path, args.data, _features(args.feature, stored.metadata["sr"] or 44100), overwrite=args.overwrite, include=args.filter or None, exclude=args.exclude or None, patterns=args.meta_regexp)
    elif args.command == "add_embedding":
        spec = config.read(args.module)
        name = args.name or args.module.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        options = {"name": name, "weights": spec["weights"], "stride": spec["stride"], "bias": spec.get("bias"), "model_sr": args.model_sr, "transforms": args.transform}
        made_of = registry.feature("module", sr=dataset.Dataset(spark, args.path).metadata["sr"] or 44100, **options)
        if args.check:
            print(f"{name}: {1 + len(args.transform)} views", file=out)
        made = dataset.update(spark, args.path, features=[made_of], overwrite=args.overwrite)
    else:
        made = dataset.Dataset(spark, args.path)
        print(json.dumps(made.metadata, indent=1), file=out)
        if args.files:
            for r in dataset.info(made)["files"].orderBy("file_path").toLocalIterator():
                print(f"{r.file_path}\t{r.n_chunks}", file=out)
        if args.check_metadata:
            for r in dataset.info(made, made.features)["missing"].orderBy("frag_key").toLocalIterator():
                print(f"{r.frag_key}\t{r.feature}", file=out)
        for rows in [*(made.at(k) for k in args.idx), *(made.get(k) for k in args.key)]:
            for r in rows.drop("waveform").withColumn("all", F.to_json(F.struct("*"))).select("all").toLocalIterator():
                print(r[0], file=out)
    return made


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sonolith").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
