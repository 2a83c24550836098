"""Ordered provider fallback."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import THINK, strip_think
from ..sources.scratch import kept
from .context import count_words

_BLOCKS = re.compile(THINK.removeprefix("(?s)"), re.S)

#: Gives a provider's answer to a prompt; raises what the provider raises.
Provider = Callable[[str], str]


class ProviderUnavailable(Exception):
    """No credentials: the chain goes on."""


@dataclass
class Breaker:
    """Keeps a worker from asking a provider that keeps failing: after ``failures`` in a row it rests ``rest`` seconds, then one prompt tries it."""

    failures: int = 5
    rest: float = 30.0
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        self.row: dict[str, int] = {}
        self.until: dict[str, float] = {}

    def allows(self, name: str) -> bool:
        return self.row.get(name, 0) < self.failures or self.clock() >= self.until[name]

    def told(self, name: str, good: bool) -> None:
        self.row[name] = 0 if good else self.row.get(name, 0) + 1
        if self.row[name] >= self.failures:
            self.until[name] = self.clock() + self.rest


_ANSWER = "answer string, provider string, failures array<struct<provider:string,reason:string>>"
_SCHEMA = "answer string, provider string, tier string, tokens_in long, failures array<struct<provider:string,reason:string>>"
#: Prompts whose answers are written to the ledger together, so the most that a task asks again.
BATCH = 16


def _ask_chain(prompt: str, chain: list[str], clients: dict[str, Provider], breaker: Breaker, models: dict[str, str] | None = None) -> dict:
    """The first answer that isn't blank, judged without its reasoning blocks; why the providers before it gave none.

    ``models``: of a provider the model to ask, whose client is called ``provider/model``.
    """
    failures, out = [], {"answer": None, "provider": None}
    for name in chain:
        model = (models or {}).get(name)
        client = clients.get(f"{name}/{model}" if model else name)
        if client is None:
            failures.append((name, "no_credentials"))
            continue
        if not breaker.allows(name):
            failures.append((name, "circuit_open"))
            continue
        try:
            text = _BLOCKS.sub("", client(prompt)).strip()
            breaker.told(name, bool(text))
            if text:
                out = {"answer": text, "provider": name}
                break
            failures.append((name, "MalformedResponseError"))
        except ProviderUnavailable:
            failures.append((name, "no_credentials"))
        except Exception as e:  # any provider error moves the chain on
            breaker.told(name, False)
            failures.append((name, type(e).__name__))
    return out | {"failures": [{"provider": p, "reason": r} for p, r in failures]}


def _models(settings: Settings, tier: str | None) -> dict[str, str]:
    return {p: m for t, p, m in settings.tier_models if t == tier}


def ask_providers(prompts: DataFrame, providers: Callable[[], dict[str, Provider]], settings: Settings = Settings(), count: Callable[[str], int] = count_words,
                  ledger: str | None = None, batch: int = BATCH, breaker: Callable[[], Breaker] = Breaker) -> DataFrame:
    """``prompts`` (query_id, tier, prompt) -> (query_id, answer, provider, tier, tokens_in, failures) by each row's chain.

    ``providers`` builds the clients, once per task: by provider, and by ``provider/model`` for
    the models that ``settings`` gives a tier. A blank answer counts as a failure, judged
    without its reasoning blocks. Where all fail, answer and provider are null. With a ``ledger``,
    a folder that all executors reach, answers are kept there by prompt and provider: see ``_recorded``.
    """
    kind = prompts.schema["query_id"].dataType.simpleString()
    rows = prompts.select("query_id", "tier", "prompt")
    if ledger is not None:
        return _recorded(rows, providers, settings, count, ledger, batch, breaker)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients, guard = providers(), breaker()
        for pdf in frames:
            out = [_ask_chain(prompt, settings.chain(tier), clients, guard, _models(settings, tier)) for tier, prompt in zip(pdf["tier"], pdf["prompt"])]
            yield pd.DataFrame({"query_id": pdf["query_id"], **{c: [x[c] for x in out] for c in ("answer", "provider")}, "tier": pdf["tier"], "tokens_in": [count(p) for p in pdf["prompt"]], "failures": [x["failures"] for x in out]})

    return rows.mapInPandas(run, f"query_id {kind}, {_SCHEMA}")


_ENTRY = f"key string, tier string, {_ANSWER}"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(key, tier, answer, provider, failures) of the answers that a ledger has; key: SHA-256 of the prompt."""
    try:
        return spark.read.schema(_ENTRY).json(f"{ledger}/answers").where("provider is not null")
    except AnalysisException:  # nobody has been asked yet
        return spark.createDataFrame([], _ENTRY)


def _recorded(rows: DataFrame, providers: Callable, settings: Settings, count: Callable[[str], int], ledger: str, batch: int, breaker: Callable[[], Breaker]) -> DataFrame:
    """As ``ask_providers``, so that no answer is asked for twice: not by a task that runs again, a stream that starts again, or a second job.

    Each different prompt of a tier is asked once. What the ledger has, by a provider that is still
    in the tier's chain, is taken from it. The rest is dealt by prompt and sorted, so that a task
    that runs again forms the same batches; a batch's answers are one file, named by its prompts
    and this run and put there whole, and a task asks no batch whose file is there. So a lost task
    repeats one batch at most. A prompt that every provider failed is asked anew by the next run.
    """
    spark = rows.sparkSession
    keyed = kept(rows.withColumn("key", F.sha2(F.coalesce("prompt", F.lit("")), 256)), "prompts")
    tiers = [r["tier"] for r in keyed.select("tier").distinct().collect()]  # of three kinds
    chains, models = {t: settings.chain(t) for t in tiers}, {t: _models(settings, t) for t in tiers}
    in_chain = reduce(lambda a, b: a | b, (F.col("tier").eqNullSafe(t) & F.col("provider").isin(c) for t, c in chains.items()), F.lit(False))
    known = read_ledger(spark, ledger).where(in_chain).groupBy("key", "tier").agg(F.min(F.struct("answer", "provider", "failures")).alias("a")).select("key", "tier", "a.*")
    known = kept(known.join(keyed.select(F.col("key").alias("k"), F.col("tier").alias("t")).distinct(), (F.col("key") == F.col("k")) & F.col("tier").eqNullSafe(F.col("t")), "left_semi"), "known-answers")
    todo = keyed.select("key", "tier", F.coalesce("prompt", F.lit("")).alias("prompt")).distinct().join(known.select(F.col("key").alias("k"), F.col("tier").alias("t")), (F.col("key") == F.col("k")) & F.col("tier").eqNullSafe(F.col("t")), "left_anti")
    dealt = todo.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "tier")

    this_run = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients, guard, place = providers(), breaker(), _Folder(f"{ledger}/answers")
        for r in _in_batches(frames, batch):
            name = hashlib.sha256("\n".join([this_run, *(f"{k} {t}" for k, t, _ in r)]).encode()).hexdigest() + ".json"
            out = place.read(name)
            if out is None:
                out = [{"key": key, "tier": tier} | _ask_chain(prompt, chains[tier], clients, guard, models[tier]) for key, tier, prompt in r]
                place.write(name, out)
            yield pd.DataFrame({"key": [k for k, *_ in r], "tier": [t for _, t, _ in r], **{c: [x[c] for x in out] for c in ("answer", "provider", "failures")}})

    asked = kept(dealt.mapInPandas(run, _ENTRY), "asked")  # once, whatever uses the result
    every = known.unionByName(asked).withColumnsRenamed({"key": "k", "tier": "t"})
    counted = F.pandas_udf(lambda texts: texts.map(lambda t: count(t) if t else 0).astype("int64"), "long")
    joined = keyed.join(every, (F.col("key") == F.col("k")) & F.col("tier").eqNullSafe(F.col("t")))
    return joined.select("query_id", "answer", "provider", "tier", counted(F.col("prompt")).alias("tokens_in"), "failures")


def _in_batches(frames: Iterator[pd.DataFrame], batch: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for pdf in frames:
        for row in zip(pdf["key"], pdf["tier"], pdf["prompt"]):
            held.append(row)
            if len(held) == batch:
                yield held
                held = []
    if held:
        yield held


class _Folder:
    """Files of JSON lines that appear whole."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.root, recursive=True)

    def read(self, name: str) -> list[dict] | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as lines:
                return [json.loads(x) for x in lines.read().decode().splitlines()]
        except FileNotFoundError:
            return None

    def write(self, name: str, rows: list[dict]) -> None:
        draft = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft, compression=None) as out:
            out.write("".join(json.dumps(x) + "\n" for x in rows).encode())
        self.fs.move(draft, f"{self.root}/{name}")


def resolve(outcomes: DataFrame, chain: list[str]) -> DataFrame:
    """The same decision over recorded ``outcomes`` (query_id, provider, answer, error), as an aggregation.

    ``error`` null and an answer that isn't blank is success; a provider without a row has no
    credentials. Returns query_id, provider, answer, n_failures, error.
    """
    place = F.array_position(F.array(*(F.lit(p) for p in chain)), F.col("provider"))
    good = F.col("error").isNull() & (F.length(strip_think(F.coalesce("answer", F.lit("")))) > 0)
    rows = outcomes.select("query_id", "provider", place.cast("int").alias("place"), strip_think(F.col("answer")).alias("answer"), good.alias("good")).where("place > 0")
    best = rows.groupBy("query_id").agg(F.min(F.when(F.col("good"), F.struct("place", "provider", "answer"))).alias("won"))
    failed = F.coalesce(F.col("won.place") - 1, F.lit(len(chain)))
    return best.select("query_id", F.col("won.provider").alias("provider"), F.col("won.answer").alias("answer"), failed.cast("int").alias("n_failures"), F.when(F.col("won").isNull(), "all providers failed").alias("error"))
