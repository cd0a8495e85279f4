"""The normal run: landed sources to one ranked table.

The order of the stages is part of the result: title gate (boards only), union,
keep-first, today filter, priority cap, exclusions, score, gate, rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.config import SearchConfig
from rankfold.functions.dates import posted_today
from rankfold.functions.replies import fill_profile, scoring_prompt, with_reply
from rankfold.functions.text import has_signal
from rankfold.operators import exclusions, matching, ranking, reports
from rankfold.operators.rules import score_by_rules
from rankfold.schema import ORDER_COLUMNS
from rankfold.session import cut_lineage
from rankfold.sources import boards, lists
from rankfold.sources.landed import default_sources
from rankfold.sources.sinks import output_rows

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Inputs:
    """Landed tables of a run; absent ones contribute nothing, absent ``sources`` mean the configured ones."""

    sources: DataFrame | None = None
    raw_docs: DataFrame | None = None
    board_a: DataFrame | None = None
    board_b: DataFrame | None = None
    board_c: DataFrame | None = None
    host_probes: DataFrame | None = None
    pages: DataFrame | None = None
    company_rules: DataFrame | None = None
    company_attrs: DataFrame | None = None
    rule_table: DataFrame | None = None


@dataclass
class Stages:
    """What a run leaves behind.  Frames stay lazy unless the run saved them.

    Rows are scored, and descriptions looked up for that, when ``capped``, ``scored`` or what
    follows from them is first asked for: a run of which only counts are wanted scores nothing.
    """

    postings: DataFrame      # union of all sources
    unique: DataFrame        # keep-first by link
    recent: DataFrame        # after the optional today filter, with has_signal
    config: SearchConfig
    fill: Callable[[], DataFrame]
    score: Callable[[DataFrame], DataFrame]

    @cached_property
    def capped(self) -> DataFrame:
        """The rows to process, descriptions filled."""
        return self.fill()

    @cached_property
    def scored(self) -> DataFrame:
        """Every capped row with score, verdict, flag, reason."""
        return self.score(self.capped)

    @property
    def results(self) -> DataFrame:
        """Rows through the gate, in rank order."""
        return gated(self.scored, self.config).orderBy(*rank_order())

    @property
    def source_counts(self) -> DataFrame:
        """Rows found per source, before keep-first."""
        return reports.stage_counts(self.postings, "source")

    @property
    def run_counts(self) -> DataFrame:
        """One row: found, unique, recent, with signal, to process."""
        return run_counts(self.postings, self.unique, self.recent, self.config)

    @property
    def histogram(self) -> DataFrame:
        return reports.score_histogram(self.scored)


# Lists come in their configured ranks; boards follow all lists.
BOARD_A_RANK, BOARD_B_RANK, BOARD_C_RANK = 1_000_000, 1_000_001, 1_000_002


def all_postings(inputs: Inputs, config: SearchConfig = SearchConfig(), late: bool = False) -> DataFrame:
    """Union of every given source, its fixed order kept in the order columns.

    ``late`` leaves markup unparsed in columns of its own (see ``boards.described``).
    """
    parts: list[DataFrame] = []
    if inputs.raw_docs is not None:
        sources = inputs.sources if inputs.sources is not None else default_sources(inputs.raw_docs.sparkSession)
        parts.append(lists.list_postings(inputs.raw_docs, sources, config.keep_empty_cells))
    if inputs.board_a is not None:
        parts.append(boards.board_a_postings(inputs.board_a, BOARD_A_RANK, config, late))
    if inputs.board_b is not None:
        parts.append(boards.board_b_postings(inputs.board_b, BOARD_B_RANK, config, late))
    if inputs.board_c is not None and inputs.host_probes is not None:
        parts.append(boards.board_c_postings(inputs.board_c, inputs.host_probes, BOARD_C_RANK, config))
    if not parts:
        raise ValueError("no source given")
    if late:
        parts = [p if boards.MARKUP in p.columns else boards.with_markup(p) for p in parts]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def choose_rows(postings: DataFrame, as_of: datetime, config: SearchConfig = SearchConfig(),
                save: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unique, recent, capped): keep-first, today filter, priority cap.

    ``save`` is applied where several later steps read the same rows: to the
    unique rows and to the (then small) capped ones.  Markup that postings bring
    along is parsed for the rows that stay.
    """
    unique = ranking.keep_first(postings, "url", ORDER_COLUMNS, config.empty_url)
    if boards.MARKUP in unique.columns:
        unique = boards.described(unique, config)
    signal = has_signal(F.col("role"), F.col("description"), config.signal_words)
    unique = save(unique.withColumn("has_signal", signal))
    recent = unique.filter(posted_today(F.col("posted"), as_of)) if config.today_only else unique
    capped = ranking.cap_by_priority(recent, F.col("has_signal"), config.max_jobs)
    if config.max_jobs is not None:
        capped = save(capped)
    return unique, recent, capped


def score_rows(capped: DataFrame, as_of: datetime, config: SearchConfig, scorer: Scorer,
               save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Every row with its outcome: excluded rows get their record, the rest is scored.

    The scorer only sees rows that need scoring.  Both halves come from the
    saved rows, so pages are looked up and parsed once.
    """
    marked = save(exclusions.with_exclusion(capped, as_of, config))
    scored = scorer(marked.filter("exclusion IS NULL").drop("exclusion"))
    target = F.when(matching.target_flag(F.col("company"), config.target_companies), fv.TARGET_MARK).otherwise("")
    return scored.withColumn("target", target).unionByName(
        exclusions.excluded_rows(marked).withColumn("target", F.lit(""))
    )


def run_counts(postings: DataFrame, unique: DataFrame, recent: DataFrame, config: SearchConfig) -> DataFrame:
    """One row: n_found, n_unique, n_recent (after the today filter), n_signal of these, n_to_process."""
    found = reports.total_counts(postings).withColumnRenamed("n_rows", "n_found")
    kept = reports.total_counts(unique).withColumnRenamed("n_rows", "n_unique")
    last = reports.total_counts(recent, n_signal=F.col("has_signal")).withColumnRenamed("n_rows", "n_recent")
    limit = F.col("n_recent") if config.max_jobs is None else F.least("n_recent", F.lit(config.max_jobs).cast("bigint"))
    frames = [df.withColumn("_one", F.lit(1)) for df in (found, kept, last)]   # one row each
    joined = frames[0].join(frames[1], "_one").join(frames[2], "_one").drop("_one")
    return joined.withColumn("n_to_process", limit)


def gated(scored: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    return scored.filter(exclusions.passes_gate(F.col("score"), F.col("verdict"), config.min_score))


def rank_order() -> list:
    """Score descending, ties in processing order."""
    return [F.desc("score"), F.col("priority"), *[F.col(c) for c in ORDER_COLUMNS]]


def run_search(inputs: Inputs, as_of: datetime, config: SearchConfig = SearchConfig(),
               scorer: Scorer | None = None, save_stages: bool = True) -> Stages:
    """A whole run.

    ``save_stages`` writes the postings as the sources give them, the unique, capped, filled and
    scored rows to the shared folder: each is read by several steps, and lost executors then
    never repeat the parsing.
    """
    save = cut_lineage if save_stages else (lambda df: df)
    scorer = scorer or partial(score_by_rules, config=config, company_rules=inputs.company_rules,
                               company_attrs=inputs.company_attrs, rule_table=inputs.rule_table)
    postings = save(all_postings(inputs, config, late=True))
    unique, recent, capped = choose_rows(postings, as_of, config, save)

    def fill() -> DataFrame:
        return capped if inputs.pages is None else matching.fill_descriptions(capped, inputs.pages, config)

    return Stages(
        postings=postings, unique=unique, recent=recent, config=config, fill=fill,
        score=lambda rows: save(score_rows(rows, as_of, config, scorer, save)),
    )


def output_table(stages: Stages) -> DataFrame:
    return output_rows(stages.results)


def reply_scorer(replies: DataFrame) -> Scorer:
    """A scorer from landed model replies (url, reply); rows without one are errors."""
    def score(rows: DataFrame) -> DataFrame:
        # one reply per link, saved: with an exchange on either side a hot link can be split.
        # Rows without a link have no reply and pass the join by.
        one_each = cut_lineage(replies.filter(F.col("url") != "").groupBy("url").agg(F.min("reply").alias("reply")))
        linked = F.coalesce(F.col("url"), F.lit("")) != ""
        answered = rows.filter(linked).join(one_each, "url", "left").select(*rows.columns, "reply")
        others = rows.filter(~linked).withColumn("reply", F.lit(None).cast("string"))
        joined = with_reply(answered.unionByName(others), F.col("reply"), "_r")
        return joined.select(*rows.columns, "_r.score", "_r.verdict", "_r.flag", "_r.reason")

    return score


def model_prompt(rows: DataFrame, rubric: str = "", profile: str = "") -> Column:
    """What a model is asked about a row: the rubric with the profile filled in, then the posting."""
    posting = scoring_prompt(F.col("role"), F.col("company"), F.col("location"), F.col("description"))
    return F.concat(fill_profile(F.lit(rubric + "\n\n"), profile), posting) if rubric else posting


def model_scorer(answer: Callable[[pd.Series], pd.Series], rubric: str = "", profile: str = "",
                 partitions: int | None = None) -> Scorer:
    """A scorer that asks a caller's model: ``answer`` maps prompts to reply texts.

    It runs inside tasks on Arrow batches, once per row that needs scoring; what
    it raises fails the task, what it returns is parsed like any reply.
    ``partitions`` spreads the rows before they are asked about.
    """
    ask = F.pandas_udf(answer, "string").asNondeterministic()

    def score(rows: DataFrame) -> DataFrame:
        spread = rows if partitions is None else rows.repartition(partitions)
        asked = spread.withColumn("_reply", ask(model_prompt(spread, rubric, profile)))
        joined = with_reply(asked, F.col("_reply"), "_r")
        return joined.select(*rows.columns, "_r.score", "_r.verdict", "_r.flag", "_r.reason")

    return score


def prompts(rows: DataFrame, rubric: str = "", profile: str = "") -> DataFrame:
    """url, prompt: what to send to a model for the rows that need scoring."""
    return rows.select("url", model_prompt(rows, rubric, profile).alias("prompt"))
