"""Asking that can be repeated: what the ledger spares, and the circuit breaker."""

import collections
import os

import pytest

from corpusloom.config import Settings
from corpusloom.operators import answering


def counting(folder, fail_after=None, broken=()):
    """Providers whose calls are lines of files; with ``fail_after`` the process dies at that call, unless it has died before."""

    def build():
        def client(name):
            def call(prompt):
                with open(f"{folder}/calls", "a") as f:
                    f.write(f"{name} {prompt}\n")
                made = sum(1 for _ in open(f"{folder}/calls"))
                if fail_after is not None and made > fail_after and not os.path.exists(f"{folder}/died"):
                    open(f"{folder}/died", "w").close()
                    os._exit(1)
                if name in broken:
                    raise TimeoutError
                return "" if prompt == "blank" else f"<think>x</think> {name}: {prompt}"

            return call

        return {n: client(n) for n in ("openai", "groq")}

    return build


def calls(folder):
    return collections.Counter(line.strip() for line in open(f"{folder}/calls")) if os.path.exists(f"{folder}/calls") else collections.Counter()


def prompts(spark, n=40):
    rows = [(i, "normal", f"p{i % 30}") for i in range(n)] + [(900, "simple", "p0"), (901, "normal", None), (None, "normal", "blank")]
    return spark.createDataFrame(rows, "query_id long, tier string, prompt string")


def test_a_task_that_dies_asks_nobody_twice(spark, tmp_path):
    """Half of the prompts are answered when a worker dies. A local session allows its task no second try, so the job runs again."""
    ledger, log = str(tmp_path / "ledger"), str(tmp_path)
    df = prompts(spark)
    ask = lambda: answering.ask_providers(df, counting(log, fail_after=16), Settings(), ledger=ledger, batch=1).collect()
    with pytest.raises(Exception):
        ask()
    tries = 1
    while True:
        try:
            got = ask()
            break
        except Exception:  # the tasks of the first job may take their time to die
            tries += 1
            assert tries < 5
    assert len(got) == 43 and all(r.answer == f"openai: {r.prompt}" for r in df.join(spark.createDataFrame(got), "query_id").collect() if r.prompt not in (None, "blank"))
    made = calls(log)
    # prompts that were answered before are asked once, whatever task or job came to them; blank answers are no answers
    again = {p: n for p, n in made.items() if n > 1 and not p.endswith("blank") and p not in ("openai p0", "openai", "groq")}
    assert sum(again.values()) - len(again) <= 8 * tries  # one batch of each of the tasks that ran when the process died
    before = sum(made.values())
    assert sorted(map(str, ask())) == sorted(map(str, got))
    assert {p for p in calls(log) - made} <= {"openai blank", "groq blank"} and sum(calls(log).values()) - before <= 2
    times = collections.Counter((r.key, r.tier) for r in answering.read_ledger(spark, ledger).collect())
    assert set(times.values()) == {1} and len(times) == 32


def test_a_batch_that_is_there_is_not_asked(spark, tmp_path):
    ledger, log = str(tmp_path / "ledger"), str(tmp_path)
    df = spark.createDataFrame([(i, "normal", f"p{i}") for i in range(20)], "query_id long, tier string, prompt string")
    first = answering.ask_providers(df, counting(log), Settings(), ledger=ledger, batch=4).collect()
    assert calls(log) == {f"openai p{i}": 1 for i in range(20)}
    more = df.union(spark.createDataFrame([(50, "normal", "new"), (51, "normal", "p3")], df.schema))
    again = answering.ask_providers(more, counting(log), Settings(), ledger=ledger, batch=4).collect()
    assert sum(calls(log).values()) == 21 and {r.query_id: r.answer for r in again} == {r.query_id: r.answer for r in first} | {50: "openai: new", 51: "openai: p3"}
    # a chain without the provider that answered asks anew
    other = answering.ask_providers(df.limit(3), counting(log), Settings(fallback_chain=("groq",)), ledger=ledger).collect()
    assert all(r.provider == "groq" for r in other)


def test_circuit_breaker(spark, tmp_path):
    now = [0.0]
    b = answering.Breaker(failures=2, rest=10, clock=lambda: now[0])
    clients = counting(str(tmp_path), broken=("openai",))()
    reasons = [answering._ask_chain(f"p{i}", ["openai", "groq"], clients, b)["failures"][0]["reason"] for i in range(4)]
    assert reasons == ["TimeoutError", "TimeoutError", "circuit_open", "circuit_open"] and calls(tmp_path)["openai p2"] == 0
    now[0] = 11.0
    assert answering._ask_chain("late", ["openai", "groq"], clients, b)["failures"][0]["reason"] == "TimeoutError" and not b.allows("openai")
    now[0] = 30.0
    b.told("openai", True)
    assert b.allows("openai")


def test_a_tier_asks_its_model(spark):
    settings = Settings(tier_models=(("simple", "groq", "small"), ("complex", "openai", "large")))
    assert settings.chain("simple")[0] == "groq" and settings.chain("normal")[0] == "openai" and settings.tier_model("simple", "groq") == "small" and settings.tier_model("normal", "groq") is None
    for bad in ((("none", "groq", "m"),), (("simple", "groq", " "),)):
        with pytest.raises(ValueError):
            Settings(tier_models=bad)
    clients = lambda: {"groq": lambda p: "plain", "groq/small": lambda p: "small", "openai": lambda p: "own"}
    df = spark.createDataFrame([(1, "simple", "p"), (2, "normal", "p"), (3, "complex", "p")], "query_id long, tier string, prompt string")
    got = {r.query_id: (r.answer, r.provider, [f.reason for f in r.failures]) for r in answering.ask_providers(df, clients, settings).collect()}
    assert got == {1: ("small", "groq", []), 2: ("own", "openai", []), 3: ("plain", "groq", ["no_credentials"])}
