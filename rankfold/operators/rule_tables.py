"""Rule tables of any length: an inverted index of their words meets every text once.

Rules that are recognised by words (substring, word, exact, required, and the words
of ``unless``) become entries (field, word, rule).  The words are looked for in the
texts, the entries tell whose words they are, and the hits of a row are folded in
rule order; no rule becomes part of the plan.  An index of a checked size is sent to
the tasks, where an automaton reads each text once and nothing is shuffled; a larger
one is joined.

A required word is one in a sentence with a cue and without an optional cue: such
sentences of a text make a field of their own.  Rules that no word announces (regex,
absent, ``unless_pattern``) are expressions; their number is checked.

Words are compared with lower-cased texts; empty words are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import config as cf
from rankfold.config import SearchConfig
from rankfold.functions import text as tx
from rankfold.functions.patterns import EXACT, SUBSTRING, WORD, RuleWords
from rankfold.operators import rules as rl
from rankfold.operators.matching import SHIPPED, keyword_pairs
from rankfold.session import cut_lineage

#: Column of a row's hits: an array of _HIT in rule order.
HITS = "_hits"
#: Keyword rows of rules that become expressions, at most.
EXPRESSIONS = 1000
#: Hits that leave a Python worker at once, about.
AT_ONCE = 50_000
_HIT = "struct<rule_order:int,rule_id:string,kind:string,value:int,flag:string>"
_RULE = ("rule_order", "rule_id", "kind", "value", "flag")
_SENTENCES = "!"   # marks the field of a scope's demanding sentences


def _complete(table: DataFrame) -> DataFrame:
    """The table with all columns and without nulls where they mean nothing."""
    optional = {"unless": "array<string>", "unless_pattern": "string"}
    whole = table.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in table.columns})
    return whole.select(
        F.col("rule_order").cast("int").alias("rule_order"), "rule_id", "kind", "scope", "match", "keyword",
        F.coalesce("value", F.lit(0)).cast("int").alias("value"), F.coalesce("flag", F.lit("")).alias("flag"),
        F.coalesce("unless", F.array().cast("array<string>")).alias("unless"), F.coalesce("unless_pattern", F.lit("")).alias("unless_pattern"))


def _by_words(table: DataFrame) -> Column:
    """Whether a rule is recognised by words."""
    return F.col("match").isin(SUBSTRING, WORD, EXACT, "required") & (F.col("unless_pattern") == "")


def entries(table: DataFrame) -> DataFrame:
    """(field, word, mode, cancels, rule columns) of the rules recognised by words."""
    rules = _complete(table).filter(_by_words(table))
    required = F.col("match") == "required"
    own = rules.select(
        F.when(required, F.concat("scope", F.lit(_SENTENCES))).otherwise(F.col("scope")).alias("field"), F.col("keyword").alias("word"),
        F.when(required, SUBSTRING).otherwise(F.col("match")).alias("mode"), F.lit(False).alias("cancels"), *_RULE)
    against = rules.select(F.col("scope").alias("field"), F.explode("unless").alias("word"), F.lit(SUBSTRING).alias("mode"),
                           F.lit(True).alias("cancels"), *_RULE)
    return own.unionByName(against).filter("word <> ''").distinct()


def field_text(field: str, config: SearchConfig) -> Column:
    """Text of a field of rows that have the columns of ``with_rule_text``."""
    column = F.col(rl.SCOPE[field.removesuffix(_SENTENCES)])
    if not field.endswith(_SENTENCES):
        return column
    return F.concat_ws("\n", F.filter(
        F.split(column, rl.SENTENCE_END),
        lambda s: tx.contains_any(s, config.required_cues) & ~tx.contains_any(s, config.optional_cues)))


def _shipped_hits(index: list, fields: list[str], texts: list[Column]) -> Column:
    """Hits of a row by an index in the tasks."""
    rules = sorted({tuple(e[c] for c in _RULE) for e in index})
    number = {rule: i for i, rule in enumerate(rules)}
    words = RuleWords([(e["field"], e["word"], e["mode"], e["cancels"], number[tuple(e[c] for c in _RULE)]) for e in index], fields)
    columns = [pa.array(c, t) for c, t in zip(zip(*rules), (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()))]
    most = AT_ONCE

    def find(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        # hits are numbers until they leave; a batch of texts leaves in parts of a bounded number of hits
        table = pa.StructArray.from_arrays(columns, list(_RULE))

        def part(ends: list[int], hits: list[int]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(hits, pa.int32())))

        for batch in batches:
            ends, hits = [0], []
            for row in zip(*(batch if isinstance(batch, tuple) else (batch,))):
                hits += words.rules_of([text.as_py() for text in row])
                ends.append(len(hits))
                if len(hits) >= most:
                    yield part(ends, hits)
                    ends, hits = [0], []
            if len(ends) > 1:
                yield part(ends, hits)

    return F.arrow_udf(find, f"array<{_HIT}>").asNondeterministic()(*texts)


def _joined_hits(rows: DataFrame, index: DataFrame, fields: list[str], texts: list[Column]) -> DataFrame:
    """``rows`` with their hits by a join: rows are known by two hashes of all their fields, texts by two of theirs."""
    keys = {"_k1": F.xxhash64(*texts), "_k2": F.hash(*texts)}
    rows = rows.withColumns(keys)
    each = rows.select("_k1", "_k2", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), t.alias("text")) for f, t in zip(fields, texts)])).alias("f"))
    each = each.select("_k1", "_k2", "f.field", "f.text", F.xxhash64("f.text").alias("_t1"), F.hash("f.text").alias("_t2"))
    whole = cut_lineage(each.select("_t1", "_t2", "text").dropDuplicates(["_t1", "_t2"]))
    found = keyword_pairs(whole, ["_t1", "_t2"], "text", cut_lineage(index.select("word").distinct()), "word")
    met = each.select("_k1", "_k2", "field", "_t1", "_t2").distinct().join(found, ["_t1", "_t2"]).join(index, ["field", "word"])
    sure = met.filter(F.col("mode") == SUBSTRING)
    apart = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.col("word"), F.lit(r"\E($|[^a-z0-9])"))
    tested = met.filter(F.col("mode") != SUBSTRING).join(whole, ["_t1", "_t2"]).filter(
        F.when(F.col("mode") == EXACT, F.col("text") == F.col("word")).otherwise(F.rlike("text", apart))).drop("text")
    by_rule = sure.unionByName(tested).groupBy("_k1", "_k2", *_RULE).agg(
        F.bool_or(~F.col("cancels")).alias("_own"), F.bool_or("cancels").alias("_against"))
    folded_hits = by_rule.filter("_own AND NOT _against").groupBy("_k1", "_k2").agg(
        F.sort_array(F.collect_list(F.struct(*_RULE))).cast(f"array<{_HIT}>").alias(HITS))
    return rows.join(folded_hits, ["_k1", "_k2"], "left").drop("_k1", "_k2")


def with_rule_hits(rows: DataFrame, table: DataFrame, config: SearchConfig = SearchConfig(), most: int = SHIPPED) -> DataFrame:
    """Rows (with the columns of ``with_rule_text``) and the rules of a table that they hit, in rule order."""
    whole = cut_lineage(_complete(table))
    index = cut_lineage(entries(whole))
    sizes = index.groupBy("field").agg(F.sum(F.char_length("word")).alias("n")).collect()   # a row per scope at most
    fields = sorted(r["field"] for r in sizes)
    texts = [field_text(f, config) for f in fields]
    if not fields:
        rows = rows.withColumn(HITS, F.array().cast(f"array<{_HIT}>"))
    elif sum(r["n"] for r in sizes) <= most:
        rows = rows.withColumn(HITS, _shipped_hits(index.collect(), fields, texts))
    else:
        rows = _joined_hits(rows, index, fields, texts)
    others = whole.filter(~_by_words(whole))
    orders = {r["rule_id"]: r["rule_order"] for r in others.select("rule_id", "rule_order").distinct().limit(EXPRESSIONS).collect()}
    written = [F.when(rl.rule_hit(r, config), F.struct(
        F.lit(orders[r.rule_id]).alias("rule_order"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"),
        F.lit(r.value).alias("value"), F.lit(r.flag).alias("flag"))) for r in rl.load_rules(others, EXPRESSIONS)]
    found = F.coalesce(HITS, F.array().cast(f"array<{_HIT}>"))
    if written:
        found = F.array_sort(F.concat(found, F.array_compact(F.array(*written)).cast(f"array<{_HIT}>")))
    return rows.withColumn(HITS, found)


def folded(hits: Column) -> dict[str, Column]:
    """out and out_flag of the first disqualifier, note, points, lowest cap and flag of the first cap of a row's hits."""
    def of(kind: str) -> Column:
        return F.filter(hits, lambda h: h["kind"] == kind)

    first = lambda kind: F.get(of(kind), F.lit(0))
    return {
        "out": first(cf.DISQUALIFY)["rule_id"], "out_flag": first(cf.DISQUALIFY)["flag"], "note": first(cf.FLAG)["flag"],
        "points": F.aggregate(of(cf.POINTS), F.lit(0), lambda total, h: total + h["value"]),
        "cap": F.array_min(F.transform(of(cf.CAP), lambda h: h["value"])), "cap_flag": first(cf.CAP)["flag"],
    }


def rule_table(df: DataFrame, rules: tuple[cf.Rule, ...]) -> DataFrame:
    """Rules as a table."""
    from rankfold.schema import RULES_SCHEMA

    rows = [(r.rule_id, order, r.kind, r.scope, r.match, word, r.value, r.flag, list(r.unless), r.unless_pattern)
            for order, r in enumerate(rules) for word in r.keywords]
    return df.sparkSession.createDataFrame(rows, RULES_SCHEMA)
