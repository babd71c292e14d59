"""Commands: fetch-archives, list-archives, run, classify, export."""

from __future__ import annotations

import argparse
import logging
import os
import signal
import subprocess
import sys
import tempfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from chronofold import schemas as S
from chronofold.operators import discovery
from chronofold.plans import classify as classification
from chronofold.plans import collect as collection
from chronofold.plans import pick
from chronofold.session import session
from chronofold.sources import registry
from chronofold.sources.store import Store
from chronofold.sources.transport import HttpTransport, Transport


#: Names the registry's source where no --source is given.
SOURCE = "CHRONOFOLD_REGISTRY_SOURCE"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofold", description="The history of web addresses from many witnesses.")
    p.add_argument("--output", default="output", help="folder of all results")
    p.add_argument("--registry", default="registry", help="folder of the archives' descriptors")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("fetch-archives", help="import the registry of archives")
    c.add_argument("--source", default=os.environ.get(SOURCE), help=f"a folder of descriptors, or the address of a git repository of them; {SOURCE} by default")
    sub.add_parser("list-archives", help="show the registry")
    c = sub.add_parser("run", help="pick URLs and query every witness")
    c.add_argument("--input", action="append", default=[], help="a list, a folder of lists, or a domain; may be repeated")
    c.add_argument("--scope", help="root, hosts, deep or all, comma-separated")
    c.add_argument("--witnesses", help="names or archive ids, comma-separated")
    c.add_argument("--limit", type=int)
    c.add_argument("--workers", type=int, help="tasks that fetch at once")
    c.add_argument("--shard", help="i/n, auto or auto/n")
    c.add_argument("--min-witnesses", type=int, help="witnesses that settle a disappearance early")
    c.add_argument("--changes", action="store_true", help="full histories; no early stop unless --min-witnesses is given")
    c.add_argument("--retry", action="store_true", help="query again what failed for good")
    c = sub.add_parser("classify", help="states, risks and changes, and the summary")
    c.add_argument("--corroboration-threshold", type=int, default=S.THRESHOLD)
    c.add_argument("--no-summarize", action="store_true")
    c = sub.add_parser("export", help="each table as one file")
    c.add_argument("--out", required=True)
    return p


def _witness_names(text: str | None) -> set[str] | None:
    if not text:
        return None
    return {n if n == S.LIVE or n.startswith("archive:") else f"archive:{n}" for n in (t.strip() for t in text.split(",")) if n}


def run(args: argparse.Namespace, store: Store, transport: Transport) -> dict[str, int]:
    shard, shards = collection.parse_shard(args.shard, dict(os.environ))
    history = "full" if args.changes else "lifespan"
    collection.claim_history(store, history)
    scope = discovery.parse_scope(args.scope) if args.scope else None
    names = _witness_names(args.witnesses)
    known = [w for w in registry.witnesses(args.registry, shards=shards) if names is None or w.name in names]
    if not known:
        raise ValueError(f"no witness is named {args.witnesses}")
    archives = [w.archive for w in known if w.archive] or registry.compile_all(args.registry)
    now = datetime.now(timezone.utc)
    collection.build_once(store, lambda: pick.prepare(store, args.input, now, scope, archives, transport))
    for gap in pick.incomplete(store).collect():
        print(f"incomplete: {gap.listing} on {gap.domain}: {gap.gap}", file=sys.stderr)
    stop = args.min_witnesses is not None or not args.changes
    options = collection.Options(
        history=history, stop_early=stop, threshold=args.min_witnesses or S.THRESHOLD, shard=shard, shards=shards, limit=args.limit, retry_failed=args.retry, tasks=args.workers or 8
    )
    return collection.collect(store, known, transport, options)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, transport: Transport | None = None) -> int:
    args = parser().parse_args(argv)
    Path(args.output).mkdir(parents=True, exist_ok=True) if "://" not in args.output else None
    handlers: list[logging.Handler] = [logging.FileHandler(f"{args.output}/run.log")] if "://" not in args.output else []
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, handlers=handlers + [logging.StreamHandler()] * args.verbose, force=True)
    if spark is None:  # a terminated run ends like an interrupted one: after its round's marks or before them
        signal.signal(signal.SIGTERM, signal.default_int_handler)
    try:
        if args.command == "fetch-archives":
            if not args.source:
                raise ValueError(f"give --source, or set {SOURCE}")
            with tempfile.TemporaryDirectory() as folder:
                source = args.source
                if not Path(source).is_dir():
                    subprocess.run(["git", "clone", "--depth", "1", source, folder], check=True)
                    source = folder
                print(plural(registry.import_from(source, args.registry), "archive"))
            return 0
        if args.command == "list-archives":
            for a in registry.compile_all(args.registry):
                kinds = ", ".join(k for k, on in (("index", a.usable_cdx), ("timemap", a.usable_timemap)) if on) or "offline"
                print(f"{a.id:20} {a.name} ({kinds})")
            return 0
        store = Store(spark or session(), args.output)
        if args.command == "run":
            print(", ".join(f"{k.replace('_', ' ')} {n:,}" for k, n in run(args, store, transport or HttpTransport()).items()))
        elif args.command == "classify":
            years = registry.established_years(args.registry)
            full = collection.held_history(store) == "full"
            print(plural(classification.classify(store, years, args.corroboration_threshold, full), "URL"), "classified")
            if not args.no_summarize:
                print(plural(classification.summarize(store, years), "row"), "in the summary")
        else:
            for table, n in store.export(args.out).items():
                print(f"{table}: {plural(n, 'row')}")
    except KeyboardInterrupt:
        return 130
    except (ValueError, subprocess.CalledProcessError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
