"""Command line: `python -m vaultspark OPERATION VAULT ...`; `serve VAULT` over HTTP or standard input; `prime` describes it all."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import api
from .server import PORT, converse, serve
from .sources.vault import Vault


def parser() -> argparse.ArgumentParser:
    """One command an operation: what it needs by place, what it may be given as options."""
    top = argparse.ArgumentParser(prog="vaultspark", description="Analytics and search over a folder of notes.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in api.OPERATIONS:
        own = commands.add_parser(name)
        own.add_argument("vault")
        for field in api.fields(name):
            if field.kind is bool:
                own.add_argument(f"--{field.option}", dest=field.name, action=argparse.BooleanOptionalAction, default=argparse.SUPPRESS)
                continue
            kind = (lambda v: v.split(",")) if field.kind is list else field.kind
            if field.required and field.kind is not list:
                own.add_argument(field.name, type=kind)
            else:
                own.add_argument(f"--{field.option}", dest=field.name, type=kind, required=field.required, default=argparse.SUPPRESS)
    server = commands.add_parser("serve")
    server.add_argument("vault")
    server.add_argument("--port", type=int, default=PORT)
    server.add_argument("--stdio", action="store_true", help="answer JSON-RPC on standard input instead")
    commands.add_parser("prime", help="print instructions for a language model that uses this tool")
    return top


def prime() -> str:
    """Every command with its options, and what holds for all."""
    lines = ["# vaultspark", "", "Analytics and search over a folder of Markdown notes. Run `python -m vaultspark COMMAND VAULT ...`.", ""]
    for name, call in api.OPERATIONS.items():
        lines += [f"## {name}", ""]
        if call.__doc__:
            lines += [call.__doc__.strip(), ""]
        for f in api.fields(name):
            kind = "comma-separated list" if f.kind is list else f.kind.__name__
            lines.append(f"- `{f.name if f.required and f.kind is not list else '--' + f.option}` ({kind}{', required' if f.required else ''})")
        lines.append("")
    lines += ["## Notes", "", "- Answers are JSON, but for the tree of `list-files`.", "- Paths are relative to the vault and never leave it.", "- `exclude_paths` and `exclude_headings` in the vault's `.vaultspark.toml` leave files and sections out.", "- Dates are written YYYY-MM-DD.", "- `serve VAULT` answers over HTTP, `serve VAULT --stdio` as a tool server.", ""]
    return "\n".join(lines)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the answer: the tree of `list-files` as text, any other as JSON."""
    asked = vars(parser().parse_args(argv))
    command = asked.pop("command")
    if command == "prime":
        print(prime())
        return 0
    where = asked.pop("vault")
    vault = Vault(spark or SparkSession.builder.appName("vaultspark").getOrCreate(), where)
    if command == "serve":
        if asked["stdio"]:
            converse(vault, sys.stdin, sys.stdout)
        else:
            serve(vault, asked["port"]).serve_forever()
        return 0
    try:
        answer = api.execute(vault, command, asked)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.loads(answer)["visual_tree"] if command == "list-files" else answer)
    return 0


if __name__ == "__main__":
    sys.exit(main())
