"""Rule tables against the same rules as expressions."""

import random

import pytest
from pyspark.sql import functions as F

from rankfold import config as cf
from rankfold import schema as sc
from rankfold.config import Rule, SearchConfig, default_rules
from rankfold.operators import rule_tables as rt, rules as rl
from rankfold.operators.matching import SHIPPED

COLUMNS = "i int, company string, role string, location string, description string"


def random_rules(rng, n):
    kinds = (cf.DISQUALIFY, cf.CAP, cf.POINTS, cf.POINTS, cf.FLAG)
    word = lambda: "".join(rng.choice("ab c.é") for _ in range(rng.randrange(2, 5))).strip() or "b"
    matches = ("substring", "word", "exact", "required", "absent", "regex")
    found = []
    for i in range(n):
        match = rng.choice(matches if i < 25 else matches[:4])
        found.append(Rule(
            f"r{i}", rng.choice(kinds), rng.choice(("title", "description", "both", "location", "company")), match,
            tuple(sorted({f"[{rng.choice('abc')}]{{2}}" if match == "regex" else word() for _ in range(rng.randrange(1, 4))})), rng.randrange(-20, 60),
            f"flag {i}", unless=tuple(word() for _ in range(rng.randrange(0, 3))) if rng.random() < 0.4 else (),
            unless_pattern="c$" if i == 7 else ""))
    return tuple(found)


def random_rows(spark, rng, n):
    text = lambda k: None if rng.random() < 0.05 else "".join(rng.choice("aAb c.\né") for _ in range(rng.randrange(0, k)))
    rows = [(i, text(5), text(12), text(6), text(60)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:20], COLUMNS)


@pytest.mark.parametrize("most", [SHIPPED, 0])   # by automaton, by join
def test_hits_are_those_of_the_expressions(spark, most):
    rng = random.Random(11)
    rules = random_rules(rng, 80)
    config = SearchConfig(required_cues=("a",), optional_cues=("bb",), rules=())
    rows = rl.with_rule_text(random_rows(spark, rng, 150), config)
    got = rt.with_rule_hits(rows, rt.rule_table(rows, rules), config, most)
    want = rows.select("i", F.array_compact(F.array(*[F.when(rl.rule_hit(r, config), F.lit(r.rule_id)) for r in rules])).alias("ids"))
    assert sorted((r["i"], [h["rule_id"] for h in r[rt.HITS]]) for r in got.select("i", rt.HITS).collect()) == sorted(
        (r["i"], r["ids"]) for r in want.collect())


@pytest.mark.parametrize("most", [SHIPPED, 0])
def test_scores_are_those_of_the_settings(spark, monkeypatch, most):
    monkeypatch.setattr(rt, "with_rule_hits", lambda *args, own=rt.with_rule_hits: own(*args, most=most))
    rng = random.Random(3)
    rules = random_rules(rng, 60)
    config = SearchConfig(required_cues=("a",), optional_cues=("bb",), rules=rules)
    rows = random_rows(spark, rng, 120)
    want = rl.score_by_rules(rows, config)
    got = rl.score_by_rules(rows, config.with_(rules=()), rule_table=rt.rule_table(rows, rules))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_ten_thousand_rules(spark):
    names = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij" for d in "klmnopqrst"]
    rules = tuple(Rule(n, cf.POINTS, "description", "word" if i % 2 else "substring", (n,), i % 7 + 1, unless=(f"no{n}",)) for i, n in enumerate(names))
    texts = [(i, "c", "r", "l", f"X{names[i * 10]} {names[i * 10 + 1]}! " + (f"no{names[i * 10 + 1]}" if i % 3 == 0 else "")) for i in range(1000)]
    rows = rl.with_rule_text(spark.createDataFrame(texts, COLUMNS))
    table = rt.rule_table(rows, rules)
    for most in (SHIPPED, 0):
        hits = rt.with_rule_hits(rows, table, most=most)
        got = {r["i"]: r["p"] for r in hits.select("i", rt.folded(F.col(rt.HITS))["points"].alias("p")).collect()}
        # the first name stands behind a letter: only rules for substrings (even numbers) see it
        assert got == {i: (i * 10) % 7 + 1 + (0 if i % 3 == 0 else (i * 10 + 1) % 7 + 1) for i in range(1000)}


def test_default_rules_as_a_table(spark):
    rows = spark.createDataFrame([(0, "Acme", "Sr. Engineer", "Berlin, Germany", "C#, Azure Functions. Angular is required."),
                                  (1, "Acme", "Engineer", "Paris, TX", "remote .NET role, $90,000"), (2, None, None, "Remote", None)], COLUMNS)
    want = rl.score_by_rules(rows).collect()
    got = rl.score_by_rules(rows, SearchConfig(rules=()), rule_table=rt.rule_table(rows, default_rules())).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_empty_table_and_loaded_rules(spark):
    rows = spark.createDataFrame([(0, "a", "b", "c", "d")], COLUMNS)
    none = spark.createDataFrame([], sc.RULES_SCHEMA)
    assert rl.score_by_rules(rows, SearchConfig(rules=()), rule_table=none).head()["score"] == rl.score_by_rules(
        rows, SearchConfig(rules=())).head()["score"]
    rule = Rule("a", cf.POINTS, "title", "word", ("k1", "k2"), 3, "f", ("u",), "x$")
    assert rl.load_rules(rt.rule_table(rows, (rule,))) == (rule,)
