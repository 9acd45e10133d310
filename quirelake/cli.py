"""Command line: thin commands over the configuration and the operators."""

from __future__ import annotations

import argparse
import os
import sys

from quirelake.sources import config as settings
from quirelake.sources.files import nearest_upwards

_NAMES = {"placeholder-env": "latex_placeholder_envs", "math-env": "latex_math_envs", "placeholder-cmd": "latex_placeholder_commands"}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quirelake")
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    p = add("init")
    p.add_argument("name")
    add("info")
    p = add("status")
    p.add_argument("data", nargs="?", help="a directory of tables; without it, the project here")
    p.add_argument("--files", action="store_true")
    add("list")
    p = add("sync")
    p.add_argument("--to")
    p = add("translate")
    p.add_argument("paths", nargs="*")
    p.add_argument("--to")
    p.add_argument("--all", action="store_true")
    p.add_argument("--vocabulary")
    p.add_argument("--use-reasoning-model", action="store_true")
    p = add("lang")
    p.add_argument("action", choices=["add", "remove", "list"])
    p.add_argument("name", nargs="?")
    p.add_argument("--suffix")
    p.add_argument("--short")
    p = add("source")
    p.add_argument("action", choices=["add", "info"])
    p.add_argument("path", nargs="?")
    p.add_argument("--lang")
    p = add("target")
    p.add_argument("action", choices=["add", "remove", "list"])
    p.add_argument("lang", nargs="?")
    p.add_argument("--path")
    p = add("file")
    p.add_argument("action", choices=["add", "remove"])
    p.add_argument("paths", nargs="+")
    p = add("llm")
    p.add_argument("action", choices=["set", "set-reasoning", "set-xml-retries", "list", "env-file", "unset-env-file"])
    p.add_argument("values", nargs="*")
    p = add("vocab")
    p.add_argument("action", choices=["set", "unset"])
    p.add_argument("path", nargs="?")
    p = add("typst")
    p.add_argument("action", choices=["set-func-args", "unset-func-args"])
    p.add_argument("function")
    p.add_argument("names", nargs="*")
    p = add("latex")
    p.add_argument("setting", choices=[*_NAMES, "cmd-args", "cmd-spec"])
    p.add_argument("action", choices=["add", "remove", "set", "unset"])
    p.add_argument("name")
    p.add_argument("numbers", nargs="*", type=int)
    p.add_argument("--optional", nargs="*", type=int, default=[])
    p = add("query")
    p.add_argument("name")
    p.add_argument("data")
    p = add("cache")
    p.add_argument("action", choices=["clear", "sync", "correct"])
    p.add_argument("memory", nargs="?", help="a memory; without it, that of the project here")
    p.add_argument("--checksum")
    p.add_argument("--to")
    p.add_argument("--missing-chunks", action="store_true")
    p.add_argument("--all", action="store_true")
    p.add_argument("--lang")
    p.add_argument("--file")
    p.add_argument("--keyword")
    p = add("migrate")
    p.add_argument("json")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args)
    except settings.ConfigError as error:
        print(error, file=sys.stderr)
        return 1


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def _run(args: argparse.Namespace) -> int:
    if args.command == "init":
        if os.path.exists(settings.FILE_NAME):
            raise settings.ConfigError("there is a project here")
        settings.save(settings.ProjectConfig(args.name), settings.FILE_NAME)
        return 0
    if args.command == "migrate":
        done = settings.migrate_json(args.json, settings.FILE_NAME)
        print("migrated" if done else "nothing to migrate")
        return 0
    if args.command == "query" or (args.command == "status" and args.data):
        from quirelake.plans import registry

        name = args.name if args.command == "query" else "status_grouping_sets" if args.files else "status_by_lang"
        found = registry.queries()[name](_session(), args.data)
        print("\t".join(found.columns))
        # languages by name, files by path
        for row in found.orderBy(*(c for c in ("lang", "rel_path") if c in found.columns) or found.columns[:1]).toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
        return 0
    if args.command == "cache" and args.action == "clear" and args.memory:
        return _clear(args, None)
    path = nearest_upwards(".", settings.FILE_NAME)
    if path is None:
        raise settings.ConfigError("no project here")
    if args.command in ("translate", "sync", "cache", "status"):
        from quirelake.project import Project

        return _on_project(Project(_session(), os.path.dirname(path)), args)
    config = settings.load(path)
    if args.command == "info":
        print(settings.to_toml({"name": config.name, "targets": [d.language for d in config.lang_dirs], "files": config.translatable_files, "model": config.llm_model}))
        return 0
    if args.command == "list":
        print("\n".join(config.translatable_files))
        return 0
    _change(config, args)
    settings.save(config, path)
    return 0


def _on_project(project, args: argparse.Namespace) -> int:
    if args.command == "translate":
        return _translate(project, args)
    if args.command == "sync":
        print(f"{project.sync(args.to)} files copied")
    elif args.command == "status":
        rows = project.status().collect()  # a row a file and language
        shown = {}
        for row in rows:
            key = (row["lang"], row["rel_path"]) if args.files else (row["lang"],)
            shown[key] = [a + b for a, b in zip(shown.get(key, (0, 0, 0)), (row["total"], row["translated"], row["needs_review"]))]
        for key, (total, translated, review) in sorted(shown.items()):
            print("\t".join([*key, f"{translated}/{total} translated", f"{review} to review"]))
    elif args.action == "sync":
        print(f"version {project.cache_sync(args.to)}")
    elif args.action == "correct":
        print(f"{sum(project.correct(d.language) for d in project.targets(args.to))} chunks recorded")
    else:
        return _clear(args, project)
    return 0


def _translate(project, args: argparse.Namespace) -> int:
    """Either --all or paths; without --to every target."""
    from quirelake.operators.translate import RunAborted

    if args.all == bool(args.paths):
        raise settings.ConfigError("give either --all or paths")
    vocabulary = None
    if args.vocabulary:
        with open(args.vocabulary, encoding="utf-8") as file:
            vocabulary = file.read()

    def told(row: dict) -> None:
        lines = [f"{row['rel_path']} -> {row['tgt_lang']}", f"  from the memory: {row['from_cache']}", f"  translated: {row['translated']}"]
        lines += [f"  by the reasoning model: {row['passed_to_reasoning']}"] * bool(row["passed_to_reasoning"]) + [f"  failed: {row['failed']}"] * bool(row["failed"])
        print("\n".join(lines))

    try:
        project.translate(args.to, args.paths or None, args.use_reasoning_model, vocabulary, told)
    except RunAborted as error:
        print(f"given up: {error}", file=sys.stderr)
        return 1
    return 0


def _clear(args: argparse.Namespace, project) -> int:
    """What has lost its text, everything in a scope (--lang, --file and --keyword need --all), or a checksum."""
    if [args.missing_chunks, args.all, args.checksum is not None].count(True) != 1:
        raise settings.ConfigError("give one of --missing-chunks, --all and --checksum")
    if not args.all and (args.file or args.keyword is not None):
        raise settings.ConfigError("--file and --keyword go with --all")
    if args.missing_chunks and args.lang:
        raise settings.ConfigError("--lang goes with --all and --checksum")
    from hashlib import sha256

    from quirelake.engine import Engine

    engine = project.engine if project else Engine(_session(), args.memory)
    if args.missing_chunks:
        engine.clear_missing()
    elif args.checksum is not None:
        engine.clear_checksum(args.checksum, args.lang)
    else:
        path = (project.cache_path(args.file) if project else settings.normal(args.file)) if args.file else None
        engine.clear(args.lang, sha256(path.encode()).hexdigest() if path else None, args.keyword)
    print(f"version {engine.version()}")
    return 0


def _change(config: settings.ProjectConfig, args: argparse.Namespace) -> None:
    action = getattr(args, "action", None)
    if args.command == "lang":
        if action == "add":
            config.add_language(args.name, args.suffix or "", args.short)
        elif action == "remove":
            config.remove_language(args.name)
        else:
            used = {d.language for d in config.lang_dirs}
            print("\n".join(sorted(name for name in (*settings.SUFFIXES, *config.custom_languages) if name not in used)))
    elif args.command == "source":
        if action == "add":
            config.set_source(args.path, args.lang)
        elif config.src_dir:
            print(f"{config.src_dir.language}: {config.src_dir.path}")
    elif args.command == "target":
        if action == "add":
            config.add_target(args.lang, args.path)
        elif action == "remove":
            config.remove_target(args.lang)
        else:
            print("\n".join(f"{d.language}: {d.path}" for d in config.lang_dirs))
    elif args.command == "file":
        for path in args.paths:
            (config.add_file if action == "add" else config.remove_file)(path)
    elif args.command == "llm":
        if action == "set":
            config.llm_service, config.llm_model = args.values
        elif action == "set-reasoning":
            config.reasoning_service, config.reasoning_model = args.values
        elif action == "set-xml-retries":
            config.xml_retries_before_reasoning = int(args.values[0])
        elif action == "list":
            print("\n".join(f"{name}: {service} {model}" for name, (service, model) in zip(("main", "reasoning"), filter(None, config.routed()))))
        else:
            config.env_file = args.values[0] if action == "env-file" else None
    elif args.command == "vocab":
        config.vocab_file = args.path if action == "set" else None
    elif args.command == "typst":
        if action == "set-func-args":
            config.set_typst_args(args.function, args.names)
        else:
            config.typst.pop(args.function, None)
    elif args.command == "latex" and args.setting == "cmd-args":
        if action == "set":
            if not args.numbers and not args.optional:
                raise settings.ConfigError("give the numbers of arguments")
            config.set_command_args(args.name, args.numbers, args.optional)
        else:
            config.latex_command_args.pop(args.name.lstrip("\\"), None)
    elif args.command == "latex" and args.setting == "cmd-spec":
        name = args.name.strip().lstrip("\\")
        if action == "set":
            config.latex_command_specs[name] = {"mandatory": args.numbers[0] if args.numbers else 0, "optional": args.optional[0] if args.optional else 0}
        else:
            config.latex_command_specs.pop(name, None)
    elif args.command == "latex":
        (config.add_name if action in ("add", "set") else config.remove_name)(_NAMES[args.setting], args.name)


if __name__ == "__main__":
    sys.exit(main())
