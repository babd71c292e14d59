"""Collection: every (URL, witness) pair is queried, in rounds that can stop and go on.

A round takes the pairs that are due, leaves out URLs that need no more witnesses, fetches the
rest in tasks, and stores raw answers, observations, captures, and at last the checkpoint
marks; a round that dies before its marks is simply done again.

Tasks only fetch. A task has a client for each witness, with its own share of the witness's
rate and a guard of its own, and hands on texts; Spark parses them. Where an archive can list whole
hosts, a host with ``BATCH`` pending URLs or more is fetched once, and URLs meet its captures
in a join on the match key.

Early stop is computed from stored observations, so it survives a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from time import sleep

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.functions import statuses
from chronofold.functions import urls as U
from chronofold.operators import checkpoints as C
from chronofold.operators import dedupe, parsers
from chronofold.operators.limits import FAILURES, HARD, LIVE_FAILURES, SOFT, Guard, Terms
from chronofold.sources import files, raw
from chronofold.sources.clients import ArchiveClient, LiveClient
from chronofold.sources.registry import Witness
from chronofold.sources.store import Store
from chronofold.sources.transport import FetchError, Transport

#: Pending URLs of a host that are worth one listing; hosts without a second key after which a listing is not trusted; seconds to wait for witnesses that are out of reach.
BATCH, VERIFY_HOSTS, GRACE = 3, 8, 300.0
_FETCHED = (
    "url_id string, witness string, host string, outcome string, error_class string, penalised boolean, kinds array<string>, texts array<string>, http_status int, redirect_target string, "
    "mime_type string, content_length bigint, content_digest string, query_time timestamp, done_time timestamp"
)


@dataclass
class Options:
    history: str = "full"
    stop_early: bool = True
    threshold: int = S.THRESHOLD
    shard: int = 0
    shards: int = 1
    limit: int | None = None
    retry_failed: bool = False
    tasks: int = 8
    most_rounds: int = 1000
    now: Callable[[], datetime] = field(default=lambda: datetime.now(timezone.utc))
    pause: Callable[[float], None] = sleep


class Unit:
    """One witness within a task."""

    def __init__(self, witness: Witness, transport: Transport, history: str, tasks: int):
        self.guard = Guard(Terms(witness.requests_per_second / tasks, LIVE_FAILURES if witness.archive is None else FAILURES))
        if witness.archive is None:
            self.client = LiveClient(transport, witness.timeout_seconds)
        else:
            self.client = ArchiveClient(witness.archive, transport, witness.timeout_seconds, history, self.guard.wait)

    def ready(self) -> bool:
        return self.guard.lets_through(self.client.healthy)

    def run(self, call: Callable[[], object], waits: bool = True) -> tuple[object, FetchError | None]:
        """The call's result or error; the guard learns from it."""
        if waits:
            self.guard.wait()
        try:
            result = call()
        except FetchError as e:
            if e.penalise:
                strain = (HARD if e.error_class in self.client.hard else SOFT) if e.error_class in self.client.slow_down else 1.0
                self.guard.learn(e.error_class in self.client.trip, strain)
            return None, e
        except Exception as e:  # an answer that breaks a client is the answer's fault
            return None, FetchError("malformed_response", f"{type(e).__name__}: {e}", penalise=False)
        self.guard.learn()
        return result, None


def _fetcher(witnesses: dict[str, Witness], transport: Transport, history: str, tasks: int):
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units: dict[str, Unit] = {}
        names = [c.split()[0] for c in _FETCHED.split(", ")]
        for batch in batches:
            out = []
            for uid, witness, host, url in zip(batch["url_id"], batch["witness"], batch["host"], batch["original_url"], strict=True):
                unit = units.get(witness) or units.setdefault(witness, Unit(witnesses[witness], transport, history, tasks))
                row = dict.fromkeys(names) | {"url_id": uid, "witness": witness, "host": host, "query_time": pd.Timestamp.now("UTC"), "kinds": [], "texts": []}
                listing = uid is None
                if not unit.ready():
                    out.append(row | {"outcome": "circuit_open"})
                    continue
                result, error = unit.run((lambda: unit.client.host_pages(host)) if listing else (lambda: unit.client.query(url)), waits=not listing)  # noqa: B023
                row["done_time"] = pd.Timestamp.now("UTC")
                if error is not None:
                    row |= {"outcome": "error", "error_class": error.error_class, "penalised": error.penalise}
                elif listing:
                    row |= {"outcome": "too_big"} if result is None else {"outcome": "success", "kinds": ["cdx"] * len(result), "texts": result}
                elif isinstance(result, dict):
                    row |= {"outcome": "success", **result}
                else:
                    row |= {"outcome": "success", "kinds": [k for k, _ in result], "texts": [t for _, t in result]}
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return fetch


def fetched(pairs: DataFrame, witnesses: dict[str, Witness], transport: Transport, options: Options) -> DataFrame:
    """(url_id, witness, host, original_url) to answers. A host's URLs are spread over tasks unless it is listed."""
    salt = F.when(F.col("url_id").isNotNull(), F.pmod(F.xxhash64("url_id"), F.lit(options.tasks))).otherwise(F.lit(0))
    dealt = pairs.repartition(options.tasks, "witness", "host", salt).sortWithinPartitions("witness", "host", "url_id")
    return dealt.mapInPandas(_fetcher(witnesses, transport, options.history, options.tasks), _FETCHED)


_OBSERVED = ("url_id", "observer", "observation_time", "query_time", "status", "http_status", "error_class", "redirect_target", "mime_type", "content_length", "content_digest", "response_digest", "confidence")


def _observed(df: DataFrame, **columns) -> DataFrame:
    values = {
        "observer": F.col("witness"), "observation_time": F.col("query_time"), "http_status": F.lit(0), "redirect_target": F.lit(""), "mime_type": F.lit(""), "content_length": F.lit(0),
        "content_digest": F.lit(""), "response_digest": F.lit(""), "confidence": F.lit(1.0),
    } | columns
    return df.select(*(values.get(c, F.col(c)).alias(c) for c in _OBSERVED))


def live_observations(answers: DataFrame) -> DataFrame:
    status = statuses.live_status(F.col("http_status"))
    kept = {c: F.col(c) for c in ("http_status", "redirect_target", "mime_type", "content_length", "content_digest")}
    return _observed(answers, status=status, error_class=statuses.live_error(status), observation_time=F.col("done_time"), response_digest=F.col("content_digest"), **kept)


def parsed(answers: DataFrame) -> DataFrame:
    """Archives' answers with ``captures``, ``any_text`` and ``malformed``."""
    each = F.transform(F.arrays_zip("kinds", "texts"), lambda x: F.struct(x["kinds"].alias("kind"), x["texts"].alias("text")))
    some = F.filter(each, lambda x: (F.trim(x["text"]) != "") & ~((x["kind"] == "cdx") & F.coalesce(parsers.is_empty(x["text"]), F.lit(False))))
    read = lambda x: F.when(x["kind"] == "captures", parsers.from_text(x["text"])).when(x["kind"] == "cdx", parsers.index(x["text"])).otherwise(parsers.timemap(x["text"]))
    lists = F.transform("some", lambda x: F.struct(read(x).alias("c"), x["kind"].alias("kind"), x["text"].alias("text")))
    bad = F.exists("lists", lambda x: (x["kind"] != "captures") & parsers.is_malformed(x["kind"], x["text"], x["c"]))
    return (
        answers.withColumn("some", some)
        .withColumn("lists", lists)
        .withColumns({"any_text": F.size("some") > 0, "malformed": bad, "captures": F.flatten(F.transform("lists", lambda x: x["c"]))})
        .drop("some", "lists")
    )


def captures_of(answers: DataFrame, now: datetime, history: str) -> DataFrame:
    """Captures up to now; in lifespan mode each once."""
    flat = answers.select("url_id", F.col("witness").alias("archive"), F.posexplode("captures").alias("at", "c")).select("url_id", "archive", "at", "c.*").where(F.col("capture_time") <= F.lit(now))
    if history == "lifespan":
        flat = dedupe.first_wins(flat, ["url_id", "archive", *dedupe.CAPTURE_KEY], [F.col("at")])
    return flat.drop("at")


def from_hosts(pairs: DataFrame, listings: DataFrame, now: datetime, history: str) -> DataFrame:
    """Pairs joined with their hosts' listings by match key: answers as if each had been asked alone."""
    rows = listings.select("witness", "host", F.explode("captures").alias("c")).select("witness", "host", "c.*").where(F.col("capture_time") <= F.lit(now))
    rows = rows.withColumn("match", U.match_key(F.col("memento_url")))
    own = [F.col(c) for c in S.CAPTURE.names]
    rows = dedupe.last_wins(rows, ["witness", "host", "match", *dedupe.CAPTURE_KEY], [F.struct(*own)])
    if history == "lifespan":
        rows = dedupe.trim_lifespan(rows, ["witness", "host", "match"], [F.col("capture_time"), F.struct(*own)])
    mine = pairs.join(listings.select("witness", "host").distinct(), ["witness", "host"], "left_semi").withColumn("match", U.match_key(F.col("original_url")))
    return mine.join(rows, ["witness", "host", "match"], "left")


def due(store: Store, urls: DataFrame, names: DataFrame, options: Options) -> DataFrame:
    """Pairs without a final mark whose retry is not still waiting. The wait is drawn from the pair and the attempt."""
    log = store.read("checkpoints")
    view = C.view(log)
    last = log.groupBy(*C.KEYS).agg(F.max("updated_at").alias("last"))
    waits = view.where(F.col("state") == S.RETRY).join(last, C.KEYS)
    draw = F.pmod(F.xxhash64("url_id", "witness", "attempts"), F.lit(1 << 20)) / (1 << 20)
    until = F.unix_micros("last") + (draw * statuses.longest_delay(F.col("last_error_class"), F.col("attempts")) * 1e6).cast("bigint")
    waiting = waits.select(*C.KEYS, "attempts", F.timestamp_micros(until).alias("not_before"))
    return C.pending(urls, names, view).join(waiting, C.KEYS, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def collect(store: Store, witnesses: list[Witness], transport: Transport, options: Options | None = None) -> dict[str, int]:
    """Rounds until nothing is pending, or only witnesses out of reach are left. Returns counters."""
    o = options or Options()
    spark = store.spark
    by_name = {w.name: w for w in witnesses}
    names = spark.createDataFrame([(n,) for n in by_name], "witness string")
    listable = [w.name for w in witnesses if w.archive is not None and w.archive.usable_cdx]
    urls, _ = store.load_urls(o.limit, o.shard, o.shards)
    urls = urls.withColumn("host", U.host_key(F.col("original_url")))
    counts = dict.fromkeys(("queried", "success", "retried", "permanent_failure", "skipped_circuit_open", "skipped_early_stop", "batched"), 0)
    untrusted: dict[str, int] = {}
    single_hosts = f"{store.out}/single-hosts"  # hosts to be asked URL by URL; there may be many
    idle = 0.0

    last_seq = store.read("checkpoints").agg(F.max("seq")).first()[0] or 0

    def sequence() -> int:
        """Grows from mark to mark, even if the clock doesn't."""
        nonlocal last_seq
        last_seq = max(last_seq + 1, int(o.now().timestamp() * 1e6))
        return last_seq

    def mark(rows: DataFrame) -> None:
        store.append("checkpoints", C.mark(rows.withColumn("seq", F.lit(sequence()).cast("bigint")).withColumn("updated_at", F.lit(o.now()))))

    none = F.lit(None).cast("string")
    if o.retry_failed:
        failed = C.retry_failures(C.view(store.read("checkpoints")), list(by_name), sequence())
        store.append("checkpoints", failed)

    for number in range(o.most_rounds):
        pairs = due(store, urls, names, o)
        if o.stop_early:
            pairs, skipped = C.split_early(pairs, C.resolved(store.read("observations"), o.threshold))
            n = skipped.count()
            if n:
                counts["skipped_early_stop"] += n
                mark(skipped.select("url_id", "witness", F.lit(S.SKIPPED).alias("state"), none.alias("error_class")))
                pairs = due(store, urls, names, o)
        # One witness at a time sees all URLs first, so that what it finds can spare the others.
        left = [r[0] for r in pairs.groupBy("witness").count().collect()]
        if not left:
            break
        order = [n for n in by_name if n in left]
        turn = order[number % len(order)] if o.stop_early else None
        now = o.now()
        ready = pairs.where((F.col("not_before").isNull() | (F.col("not_before") <= F.lit(now))) & (F.lit(True) if turn is None else F.col("witness") == turn))
        staged = f"{store.out}/rounds/{number:06d}"
        files.remove(spark, staged)

        # Hosts worth a listing: one row for each goes to the fetcher in place of its URLs.
        trusted = [w for w in listable if untrusted.get(w, 0) < VERIFY_HOSTS]
        per_host = ready.where(F.col("witness").isin(*trusted) & (F.col("host") != "")).groupBy("witness", "host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BATCH) if trusted else None
        if per_host is not None and files.exists(spark, single_hosts):
            per_host = per_host.join(spark.read.schema("witness string, host string").parquet(single_hosts), ["witness", "host"], "left_anti")
        listings = None
        if per_host is not None and not per_host.isEmpty():
            ask = per_host.select(none.alias("url_id"), "witness", "host", none.alias("original_url"))
            parsed(fetched(ask, by_name, transport, o)).write.mode("overwrite").parquet(f"{staged}/hosts")
            listings = spark.read.parquet(f"{staged}/hosts")
            # A listing of fewer than two keys doesn't prove that the archive lists hosts at all.
            keys = listings.where("outcome = 'success'").select("witness", "host", F.explode_outer(F.transform("captures", lambda c: U.match_key(c["memento_url"]))).alias("k")).groupBy("witness", "host").agg(F.count_distinct("k").alias("k"))
            verified = {r[0] for r in keys.where("k >= 2").select("witness").distinct().collect()} | {w for w, n in untrusted.items() if n < 0}
            for w, n in keys.where("k < 2").groupBy("witness").count().collect():
                if w not in verified:
                    untrusted[w] = untrusted.get(w, 0) + n
            untrusted |= dict.fromkeys(verified, -1)
            good = keys.where((F.col("k") >= 2) | F.col("witness").isin(*verified)).select("witness", "host")
            listings.where("outcome in ('too_big', 'error')").select("witness", "host").write.mode("append").parquet(single_hosts)
            listings = listings.join(good, ["witness", "host"], "left_semi")
            alone = ready.join(good, ["witness", "host"], "left_anti")
        else:
            alone = ready

        fetched(alone.select("url_id", "witness", "host", "original_url"), by_name, transport, o).write.mode("overwrite").parquet(f"{staged}/answers")
        answers = parsed(spark.read.parquet(f"{staged}/answers"))
        is_live = F.col("witness") == S.LIVE
        fine = F.col("outcome") == "success"
        bad = ~is_live & fine & F.col("malformed")
        failed = answers.where((F.col("outcome") == "error") | bad).withColumn("error_class", F.coalesce("error_class", F.lit("malformed_response")))
        failed = failed.join(ready.select(*C.KEYS, "attempts"), C.KEYS)
        again = statuses.should_retry(F.col("error_class"), F.col("attempts") + 1)
        given_up = failed.where(~again)
        good_answers = answers.where(fine & ~bad)
        no_text = good_answers.where(~is_live & ~F.col("any_text"))

        payload = F.when(is_live, F.to_json(F.struct("http_status", "redirect_target", "mime_type", "content_length"))).otherwise(F.to_json("texts"))
        raw.append(good_answers.select("url_id", "witness", F.col("done_time").alias("stored_at"), payload.alias("payload")), store.out)
        store.append("observations", live_observations(good_answers.where(is_live)))
        nothing = {"status": F.lit(S.NO_EVIDENCE), "error_class": F.lit("not_found")}
        store.append("observations", _observed(no_text, **nothing))
        store.append("observations", _observed(given_up, status=statuses.failure_status(F.col("witness"), F.col("error_class")), confidence=F.lit(0.0)))
        store.append("captures", captures_of(good_answers.where(~is_live), now, o.history))
        marks = [
            good_answers.select("url_id", "witness", F.lit(S.SUCCESS).alias("state"), none.alias("error_class")),
            failed.where(again).select("url_id", "witness", F.lit(S.RETRY).alias("state"), "error_class"),
            given_up.select("url_id", "witness", F.lit(S.FAILED).alias("state"), "error_class"),
        ]
        batched = 0
        if listings is not None:
            joined = from_hosts(ready.select("url_id", "witness", "host", "original_url"), listings, now, o.history)
            joined.write.mode("overwrite").parquet(f"{staged}/batched")
            joined = spark.read.parquet(f"{staged}/batched")
            store.append("captures", joined.where(F.col("capture_time").isNotNull()).withColumn("archive", F.col("witness")))
            empty = joined.where(F.col("capture_time").isNull()).withColumn("query_time", F.lit(now))
            store.append("observations", _observed(empty, **nothing))
            answered = joined.select("url_id", "witness").distinct()
            batched = answered.count()
            marks.append(answered.select("url_id", "witness", F.lit(S.SUCCESS).alias("state"), none.alias("error_class")))
        for m in marks:
            mark(m)

        tally = {r[0]: r[1] for r in answers.groupBy("outcome").count().collect()}
        n_again, n_failed = failed.where(again).count(), given_up.count()
        n_good = good_answers.count()
        counts["queried"] += n_good + n_again + n_failed
        counts["success"] += n_good + batched
        counts["batched"] += batched
        counts["retried"] += n_again
        counts["permanent_failure"] += n_failed
        counts["skipped_circuit_open"] += tally.get("circuit_open", 0)
        files.remove(spark, staged)
        if n_good + batched + n_failed + n_again:
            idle = 0.0
        elif turn is None or number % len(order) == len(order) - 1:
            # Nothing moved: retries are waiting, or witnesses are out of reach. Wait, for so long at most.
            if idle >= GRACE:
                break
            idle += 5.0
            o.pause(5.0)
    return counts


def claim_history(store: Store, mode: str) -> None:
    """A folder is collected in one mode for good; one that holds data and no claim is full."""
    path = f"{store.out}/history.json"
    held = json.loads(files.read_text(store.spark, path))["history"] if files.exists(store.spark, path) else "full" if store.has_rows("captures") else None
    if held is None:
        files.write_text(store.spark, path, json.dumps({"history": mode}))
    elif held != mode:
        raise ValueError(f"{store.out} holds {held} histories, not {mode}; use another folder")


def held_history(store: Store) -> str:
    path = f"{store.out}/history.json"
    return json.loads(files.read_text(store.spark, path))["history"] if files.exists(store.spark, path) else "full"


def build_once(store: Store, build: Callable[[], object], stale: float = 3600.0, pause: Callable[[float], None] = sleep, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> bool:
    """Run ``build`` unless another run has done it or is doing it; a lock older than ``stale`` is taken over."""
    lock, ready = f"{store.out}/urls.lock", f"{store.out}/urls.ready"
    while not files.exists(store.spark, ready):
        if files.write_text(store.spark, lock, now().isoformat(), overwrite=False):
            try:
                build()
                files.write_text(store.spark, ready, now().isoformat())
            finally:
                files.remove(store.spark, lock)
            return True
        try:
            age = (now() - datetime.fromisoformat(files.read_text(store.spark, lock))).total_seconds()
        except Exception:  # the lock's owner has just finished
            age = 0.0
        if age > stale:
            files.remove(store.spark, lock)
        else:
            pause(5.0)
    return False


def parse_shard(text: str | None, env: dict[str, str]) -> tuple[int, int]:
    """(index, shards) of "i/n", of "auto" or "auto/n" in an array job of a scheduler, or (0, 1)."""
    if not text:
        return 0, 1
    if text.split("/")[0] != "auto":
        try:
            i, n = map(int, text.split("/"))
        except ValueError:
            raise ValueError(f"shard: {text!r} is not i/n, auto or auto/n") from None
    else:
        i, n = _array_job(env)
        if "/" in text:
            n = int(text.split("/")[1])
        if n is None:
            raise ValueError("shard: this scheduler doesn't tell the number of jobs; give auto/n")
    if not 0 <= i < n:
        raise ValueError(f"shard: {i} is not in 0 to {n - 1}")
    return i, n


def _array_job(env: dict[str, str]) -> tuple[int, int | None]:
    number = lambda k, d=None: int(env[k]) if env.get(k) else d
    if env.get("SLURM_ARRAY_TASK_ID") and env.get("SLURM_ARRAY_TASK_COUNT"):
        i = number("SLURM_ARRAY_TASK_ID")
        return (i - number("SLURM_ARRAY_TASK_MIN", i)) // (number("SLURM_ARRAY_TASK_STEP", 1) or 1), number("SLURM_ARRAY_TASK_COUNT")
    if env.get("SGE_TASK_ID", "undefined") != "undefined":
        i, first, step = number("SGE_TASK_ID"), number("SGE_TASK_FIRST", 1), number("SGE_TASK_STEPSIZE", 1) or 1
        return (i - first) // step, (number("SGE_TASK_LAST", i) - first) // step + 1
    for k in ("PBS_ARRAY_INDEX", "PBS_ARRAYID"):
        if k in env:
            return number(k), None
    if "LSB_JOBINDEX" in env:
        return number("LSB_JOBINDEX") - 1, number("LSB_JOBINDEX_END")
    raise ValueError("shard: no array job of a known scheduler")
