"""Command line: onboard, verify, forecast, forecast-direct, verify-results, download."""

from __future__ import annotations

import argparse
import json
import sys

from .session import build
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgrid", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **flags: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(f"--{n}", required=True)
        for n in flags:
            c.add_argument(f"--{n}")
        return c

    command("onboard", "config", "meters", "metadata", "output", weather="", sources="")
    command("verify", "bundle")
    command("forecast", "bundle", "config", "output")
    command("forecast-direct", "bundle", "config", "output")
    command("verify-results", "results", bundle="")
    command("download", "manifest", "target")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "download":
        from urllib.request import urlopen

        found = readers.download(readers.read_json(args.manifest)["files"], args.target, urlopen)
        print(json.dumps(found, indent=2))
        return 0
    from .plans import forecasting, onboarding

    spark = build()
    if args.command == "onboard":
        sources = readers.read_json(args.sources) if args.sources else None
        print(json.dumps(onboarding.run(spark, readers.read_json(args.config), args.meters, args.metadata, args.output, args.weather, sources)["gate"], default=str))
        return 0
    if args.command in ("forecast", "forecast-direct"):
        forecasting.run(spark, args.bundle, args.config, args.output, direct=args.command == "forecast-direct")
        return 0
    bad = onboarding.verify_bundle(spark, args.bundle) if args.command == "verify" else forecasting.verify_results(spark, args.results, args.bundle)
    print("\n".join(bad) or "verified")
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
