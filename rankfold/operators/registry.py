"""Board registry: which identifiers work, what to keep, what to check by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions.json import with_json
from rankfold.functions.slugs import slugs_to_try
from rankfold.functions.text import title_case
from rankfold.operators.matching import residual
from rankfold.operators.ranking import first_success
from rankfold.schema import CATEGORIES_SCHEMA, compute_once, each_item, local_table
from rankfold.session import cut_lineage
from rankfold.sources.boards import board_a_count, board_b_count


def probe_jobs(probes: DataFrame) -> DataFrame:
    """ats, slug, http_status, error, jobs: postings each probe found, null when it does not work.

    Only HTTP 200 with a payload of the board's shape works; zero postings is
    still working.
    """
    jobs = F.when(
        F.col("http_status") == 200,
        F.when(F.col("ats") == fv.BOARD_B, board_b_count(F.col("_json"))).otherwise(
            board_a_count(F.col("_json"), F.col("payload"))
        ),
    )
    parsed = with_json(probes, F.when(F.col("http_status") == 200, F.col("payload")))
    return parsed.select("ats", "slug", "http_status", "error", jobs.alias("jobs"))


def probe_counts(probes: DataFrame) -> DataFrame:
    """ats, slug, jobs: one row per slug, repeated probes folded before any join."""
    return probe_jobs(probes).groupBy("ats", "slug").agg(F.max("jobs").alias("jobs"))


def validate_registry(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """ats, slug, board, position, status, fixed, jobs for every registered slug.

    The slug itself is tried first, then its variants in order.  Tenants of the
    board kind that cannot be probed over HTTP are 'skipped'.
    """
    skipped = registry.filter(F.col("ats") == fv.BOARD_C).select(
        "ats", "slug", "board", "position", F.lit("skipped").alias("status"),
        F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("int").alias("jobs"),
    )
    tries = each_item(
        registry.filter(F.col("ats") != fv.BOARD_C), ("ats", "slug", "board", "position"),
        slugs_to_try(F.col("slug"), F.col("ats")), "pos", "variant",
    )
    working = probe_counts(probes).filter("jobs IS NOT NULL").withColumnRenamed("slug", "variant")
    probed = tries.join(working, ["ats", "variant"], "left")
    best = first_success(probed, ("ats", "slug", "board", "position"), "pos",
                         F.col("jobs").isNotNull(), ("variant", "jobs"))
    status = F.when(F.col("pos") == 0, "ok").when(F.col("pos") > 0, "fixed").otherwise("failed")
    outcome = best.select(
        "ats", "slug", "board", "position", status.alias("status"),
        F.when(F.col("pos") > 0, F.col("variant")).alias("fixed"), "jobs",
    )
    return outcome.unionByName(skipped)


def check_link(ats: Column, slug: Column) -> Column:
    """Page where a person can check a slug; null for other board kinds."""
    chain = F
    for kind, link in fv.CHECK_LINKS.items():
        chain = chain.when(ats == kind, F.format_string(link, slug))
    return chain.otherwise(F.lit(None).cast("string"))


def any_failure(outcome: DataFrame) -> DataFrame:
    """One row: does the registry need rewriting?"""
    needs = F.coalesce(F.bool_or(F.col("status").isin("fixed", "failed")), F.lit(False))
    return outcome.agg(needs.alias("needs_update"))


def reconciled(outcome: DataFrame) -> DataFrame:
    """The registry to use next: fixed slugs replaced (old one in ``was``), failed ones left out."""
    return outcome.filter(F.col("status") != "failed").select(
        "ats", F.coalesce("fixed", "slug").alias("slug"), "board", "position",
        F.when(F.col("fixed").isNotNull(), F.col("slug")).alias("was"), "jobs",
    )


def unconfirmed(outcome: DataFrame) -> DataFrame:
    """Failed slugs with a name, a page to check and a report line."""
    link = check_link(F.col("ats"), F.col("slug"))
    return outcome.filter(F.col("status") == "failed").select(
        title_case(F.col("slug")).alias("name"), "ats", "slug", "position", link.alias("check_url"),
        F.concat("slug", F.lit(": check "), link).alias("line"),
    )


# ---- discovery -----------------------------------------------------------------

def attempts(candidates: DataFrame, probes: DataFrame, ats: str = fv.BOARD_A) -> DataFrame:
    """company, company_pos, pos, slug, jobs, http_status, problem: every try of every company with its answer.

    The one pass over probes that a discovery needs: winners, errors and totals are
    folds of it.  A try without an answer, and a company without candidates, have a
    row as well.
    """
    tries = candidates.select("company", "company_pos", F.posexplode_outer("slugs").alias("pos", "slug"))
    unreadable = F.when((F.col("http_status") == 200) & F.col("jobs").isNull(), "unreadable answer")
    answers = compute_once(probe_jobs(probes.filter(F.col("ats") == ats)), problem=F.coalesce("error", unreadable))
    return tries.join(answers.select("slug", "jobs", "http_status", "problem"), "slug", "left").select(
        "company", "company_pos", "pos", "slug", "jobs", "http_status", "problem")


def settled(tried: DataFrame) -> DataFrame:
    """company, company_pos, pos, slug, jobs: the first working try of every company, else nulls."""
    worked = F.col("jobs").isNotNull()
    best = F.min(F.when(worked, F.struct("pos", (-F.col("jobs")).alias("minus"), "slug"))).alias("_best")
    return tried.groupBy("company", "company_pos").agg(best).select(
        "company", "company_pos", F.col("_best.pos").alias("pos"), F.col("_best.slug").alias("slug"),
        (-F.col("_best.minus")).alias("jobs"))


def found_boards(winners: DataFrame) -> DataFrame:
    """company, company_pos, slug, jobs, url of settled companies."""
    url = F.when(F.col("slug").isNotNull(), F.format_string(fv.BOARD_LISTING_LINK, F.col("slug")))
    return winners.select("company", "company_pos", "slug", "jobs", url.alias("url"))


def errors_before(tried: DataFrame, winners: DataFrame) -> DataFrame:
    """company, company_pos, pos, slug, kind, message of tries that failed before their company was settled.

    An unreadable answer counts as an error.  Answers other than 200 and 404 are
    reported too, as kind 'status'.
    """
    bad = tried.filter(F.col("problem").isNotNull() | ~F.col("http_status").isin(200, 404))
    won = winners.select("company_pos", F.col("pos").alias("_won"))
    reported = bad.join(won, "company_pos").filter(F.col("_won").isNull() | (F.col("pos") < F.col("_won")))
    raised = F.col("problem").isNotNull()
    return reported.select(
        "company", "company_pos", "pos", "slug", F.when(raised, "error").otherwise("status").alias("kind"),
        F.when(raised, error_text(F.col("company"), F.col("slug"), F.col("problem"))).otherwise(
            F.format_string("%s (%s): HTTP %d", "company", "slug", "http_status")).alias("message"))


def discover(candidates: DataFrame, probes: DataFrame, ats: str = fv.BOARD_A) -> DataFrame:
    """company, company_pos, slug, jobs, url: the first working candidate, else nulls."""
    return found_boards(settled(attempts(candidates, probes, ats)))


def confirmed(found: DataFrame) -> DataFrame:
    return found.filter("slug IS NOT NULL").select("company", "company_pos", "slug", "jobs", "url")


def not_found(found: DataFrame) -> DataFrame:
    return found.filter("slug IS NULL").select("company", "company_pos")


def registry_lines(found: DataFrame) -> DataFrame:
    """Registry entries of confirmed companies, to be written in company order."""
    line = F.format_string('"%s",  # %s (%d jobs)', "slug", "company", "jobs")
    return confirmed(found).select("company_pos", "slug", "company", "jobs", line.alias("line"))


def discovered_registry(found: DataFrame, ats: str = fv.BOARD_A) -> DataFrame:
    """Confirmed companies as registry rows, their company and postings beside them."""
    return confirmed(found).select(
        F.lit(ats).alias("ats"), "slug", F.lit("").alias("board"), F.col("company_pos").alias("position"), "company", "jobs")


def error_text(company: Column, slug: Column, error: Column) -> Column:
    """Report text of a failed probe, the message whole but for timeouts."""
    lowered = F.lower(error)
    timed_out = lowered.contains("timeout") | lowered.contains("timed out")
    shown = F.when(timed_out, "timeout").otherwise(error)
    return F.concat(company, F.lit(" ("), slug, F.lit("): "), shown)


def probe_errors(candidates: DataFrame, probes: DataFrame, found: DataFrame | None = None, ats: str = fv.BOARD_A) -> DataFrame:
    """company, slug, kind, message of probes that failed before a company was settled (``errors_before``).

    The tries are saved: probes are read and parsed once for the winners and the errors.
    """
    tried = cut_lineage(attempts(candidates, probes, ats))
    return errors_before(tried, settled(tried))


def default_categories(df: DataFrame) -> DataFrame:
    rows = [(name, rank, company) for rank, (name, companies) in enumerate(fv.BOARD_CATEGORIES.items())
            for company in companies]
    return local_table(df.sparkSession, rows, CATEGORIES_SCHEMA)


def category_report(missing: DataFrame, categories: DataFrame) -> DataFrame:
    """Companies without a board, under every category that lists them."""
    listed = categories.select("category", "category_rank", "company").distinct()
    return missing.join(listed, "company").select("category", "category_rank", "company_pos", "company")


def uncategorised(missing: DataFrame, categories: DataFrame) -> DataFrame:
    renamed = categories.select(F.col("company").alias("_listed"))
    return residual(missing, "company", renamed, "_listed").select("company_pos", "company")


def discovery_totals(found: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: n_confirmed, n_not_found, n_errors."""
    zero = F.lit(0).cast("bigint")
    companies = found.agg(
        F.count_if(F.col("slug").isNotNull()).alias("n_confirmed"),
        F.count_if(F.col("slug").isNull()).alias("n_not_found"),
    ).withColumn("n_errors", zero)
    raised = errors.agg(F.count_if(F.col("kind") == "error").alias("n_errors")).select(
        zero.alias("n_confirmed"), zero.alias("n_not_found"), "n_errors")
    names = ("n_confirmed", "n_not_found", "n_errors")
    return companies.unionByName(raised).agg(*[F.sum(n).alias(n) for n in names])
