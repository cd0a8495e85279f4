"""Registry operators; probes and candidates are made from suppliers, parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions.slugs import slug_variants as variants
from rankfold.operators import registry as rg, reports
from rankfold.plans.registry import Validation, discover, validate, write_validation
from rankfold.plans.table_queries.common import spread_table, table
from rankfold.session import scratch_path


def _key(column: str):
    return F.col(column).cast("string")


SUFFIX = {"SMALL": "software", "LARGE": "inc", "PROMO": "hq", "ECONOMY": "systems", "MEDIUM": "technologies"}


def slug_variants(spark, sf):
    chain = F
    for kind, suffix in SUFFIX.items():
        chain = chain.when(F.col("p_type") == kind, suffix)
    slug = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), chain.otherwise(""))
    part = table(spark, sf, "part").select("p_partkey", slug.alias("slug"))
    kinds = (fv.BOARD_A, fv.BOARD_B, fv.BOARD_C)
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("ats"), variants(F.col("slug"), k, {"red-bolt": "rb", "hot-rodinc": "hr"}).alias("tries"))
        for k in kinds
    ])).alias("v")
    return part.select("p_partkey", "slug", each).select(
        "p_partkey", "slug", "v.ats", F.posexplode("v.tries").alias("pos", "variant"))


def _registry(spark, sf):
    """Suppliers as slugs of the three board kinds (by nation)."""
    nation = F.col("s_nationkey")
    ats = F.when(nation < 10, fv.BOARD_A).when(nation < 20, fv.BOARD_B).otherwise(fv.BOARD_C)
    return table(spark, sf, "supplier").select(
        ats.alias("ats"), F.concat(F.lit("sup-"), _key("s_suppkey")).alias("slug"),
        F.lit("main").alias("board"), F.col("s_suppkey").alias("position"),
    )


def _probes(spark, sf):
    """Balance decides which spelling answers: the slug, the slug without hyphen, or none."""
    money = F.col("s_acctbal")
    spelling = F.when(money > 6000, F.concat(F.lit("sup-"), _key("s_suppkey"))).otherwise(
        F.concat(F.lit("sup"), _key("s_suppkey")))
    is_a = F.col("s_nationkey") < 10
    lines = table(spark, sf, "supplier").filter("s_nationkey < 20")
    return lines.select(
        F.when(is_a, fv.BOARD_A).otherwise(fv.BOARD_B).alias("ats"), spelling.alias("slug"),
        F.when(money < 1000, 404).otherwise(200).alias("http_status"),
        F.when(is_a & (money > 9000), F.lit("{}")).when(is_a, F.lit('{"jobs": [{}, {"a": 1}]}'))
        .when(money > 9000, F.lit('{"data": [{}]}')).otherwise(F.lit("[{}, {}, {}]")).alias("payload"),
        F.lit(None).cast("string").alias("error"),
    )


def registry_validation(spark, sf):
    return rg.validate_registry(_registry(spark, sf), _probes(spark, sf)).select(
        "ats", "slug", "position", "status", F.coalesce("fixed", F.lit("")).alias("fixed"),
        F.coalesce("jobs", F.lit(-1)).alias("jobs"))


def status_pivot(spark, sf):
    """Order statuses as outcomes, priorities as board kinds."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "fixed").otherwise("failed")
    return reports.status_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ats"), status.alias("status")))


def validation_counts(spark, sf):
    return reports.status_counts(rg.validate_registry(_registry(spark, sf), _probes(spark, sf)))


def registry_needs_update(spark, sf):
    return rg.any_failure(rg.validate_registry(_registry(spark, sf), _probes(spark, sf)))


def probe_counts(spark, sf):
    return rg.probe_counts(_probes(spark, sf)).select("ats", "slug", F.coalesce("jobs", F.lit(-1)).alias("jobs"))


def registry_output(spark, sf):
    """Both snapshots written and read back: the next registry, and what to check by hand."""
    result: Validation = validate(_registry(spark, sf), _probes(spark, sf))
    kept, failed = write_validation(result, scratch_path(spark, "registry"))
    registry = spark.read.parquet(kept).select(
        "position", "ats", "slug", F.coalesce("was", F.lit("")).alias("was"), F.lit("").alias("name"), F.lit("").alias("line"))
    checks = spark.read.parquet(failed).select("position", "ats", "slug", F.lit("").alias("was"), "name", "line")
    return registry.unionByName(checks)


# ---- discovery: orders as companies, their line items as probes ------------------

SLOTS = 7   # line numbers of an order


def _candidates(spark, sf):
    slugs = F.array(*[F.concat(F.lit("o"), _key("o_orderkey"), F.lit(f"-{i + 1}")) for i in range(SLOTS)])
    return spread_table(spark, sf, "orders", "o_orderkey").select(
        F.concat(F.lit("order "), _key("o_orderkey")).alias("company"), F.col("o_orderkey").alias("company_pos"),
        slugs.alias("slugs"))


def _line_probes(spark, sf):
    flag, big = F.col("l_returnflag"), F.col("l_quantity") > 25
    slug = F.concat(F.lit("o"), _key("l_orderkey"), F.lit("-"), _key("l_linenumber"))
    error = F.when((flag == "N") & big, F.concat(F.lit("connection to the board was reset by peer while reading part "), _key("l_partkey")))
    error = error.when((flag == "N") & (F.col("l_discount") > 0.05), "Read Timeout")
    lines = spread_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    return lines.select(
        F.lit(fv.BOARD_A).alias("ats"), slug.alias("slug"),
        F.when((flag == "R") & big, 200).when(flag == "A", 404).when(flag == "R", 429).otherwise(500).alias("http_status"),
        F.lit('{"jobs": [{}]}').alias("payload"), error.alias("error"))


def discovery(spark, sf):
    found = rg.discover(_candidates(spark, sf), _line_probes(spark, sf))
    return found.select("company", "company_pos", F.coalesce("slug", F.lit("")).alias("slug"),
                        F.coalesce("jobs", F.lit(-1)).alias("jobs"), F.coalesce("url", F.lit("")).alias("url"))


def registry_lines(spark, sf):
    return rg.registry_lines(rg.discover(_candidates(spark, sf), _line_probes(spark, sf))).select("company_pos", "line")


def probe_errors(spark, sf):
    return rg.probe_errors(_candidates(spark, sf), _line_probes(spark, sf)).select("company_pos", "pos", "kind", "message")


def discovery_totals(spark, sf):
    return discover(_candidates(spark, sf), _line_probes(spark, sf)).totals


QUERIES = {
    "slug_variants": slug_variants,
    "registry_validation": registry_validation,
    "status_pivot": status_pivot,
    "validation_counts": validation_counts,
    "registry_needs_update": registry_needs_update,
    "probe_counts": probe_counts,
    "registry_output": registry_output,
    "discovery": discovery,
    "registry_lines": registry_lines,
    "probe_errors": probe_errors,
    "discovery_totals": discovery_totals,
}


def _strip(suffixes) -> str:
    return ", ".join(
        f"CASE WHEN ends_with(slug, '{s}') AND length(slug) > {len(s)} THEN left(slug, length(slug) - {len(s)}) END"
        for s in suffixes)


def _add(suffixes) -> str:
    return ", ".join(f"slug || '{s}'" for s in suffixes)


_SHORT = "CASE slug WHEN 'red-bolt' THEN 'rb' WHEN 'hot-rodinc' THEN 'hr' END"
_OUTCOME = """
    SELECT CASE WHEN s_nationkey < 10 THEN 'greenhouse' WHEN s_nationkey < 20 THEN 'lever' ELSE 'workday' END AS ats,
           'sup-' || s_suppkey AS slug, s_suppkey AS position,
           CASE WHEN s_nationkey >= 20 THEN 'skipped'
                WHEN s_acctbal < 1000 OR (s_nationkey >= 10 AND s_acctbal > 9000) THEN 'failed'
                WHEN s_acctbal > 6000 THEN 'ok' ELSE 'fixed' END AS status,
           CASE WHEN s_nationkey < 10 AND s_acctbal > 9000 THEN 0 WHEN s_nationkey < 10 THEN 2 ELSE 3 END AS n
    FROM supplier"""
_FOUND = """
    SELECT o_orderkey AS company_pos, min(l_linenumber) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) AS line
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
_ERRORS = f"""
    SELECT company_pos, CAST(l_linenumber - 1 AS INTEGER) AS pos,
           l_returnflag = 'N' AND (l_quantity > 25 OR l_discount > 0.05) AS raised, l_quantity > 25 AS big, l_orderkey,
           l_linenumber, l_partkey, l_returnflag
    FROM ({_FOUND}) JOIN lineitem ON l_orderkey = company_pos
    WHERE (line IS NULL OR l_linenumber < line) AND l_returnflag <> 'A'"""

ORACLES = {
    "slug_variants": f"""
        WITH slugs AS (
            SELECT p_partkey, replace(p_name, ' ', '-') || CASE p_type
                {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIX.items())} ELSE '' END AS slug FROM part),
        tries AS (
            SELECT p_partkey, slug, 'greenhouse' AS ats, [regexp_replace(slug, '[^a-z0-9]', '', 'g'),
                {_add(('inc', 'technologies', 'systems', 'software', 'labs', 'health'))}, {_SHORT}] AS l FROM slugs
            UNION ALL SELECT p_partkey, slug, 'lever', [replace(slug, '-', ''),
                {_add(('inc', 'hq', 'careers', 'software'))}, {_strip(('software', 'inc', 'hq'))}, {_SHORT}] FROM slugs
            UNION ALL SELECT p_partkey, slug, 'workday', [{_add(('inc', 'corp', 'llc'))},
                {_strip(('inc', 'corp', 'systems', 'technologies'))}, slug || 'careers', {_SHORT}] FROM slugs),
        each_ AS (SELECT p_partkey, slug, ats, unnest(l) AS variant, generate_subscripts(l, 1) AS n FROM tries),
        firsts AS (SELECT p_partkey, slug, ats, variant, min(n) AS n FROM each_
                   WHERE variant IS NOT NULL AND variant <> slug GROUP BY ALL)
        SELECT p_partkey, slug, ats, variant,
               CAST(row_number() OVER (PARTITION BY p_partkey, ats ORDER BY n) - 1 AS INTEGER) AS pos FROM firsts""",
    "registry_validation": f"""
        SELECT ats, slug, position, status, CASE status WHEN 'fixed' THEN replace(slug, '-', '') ELSE '' END AS fixed,
               CASE WHEN status IN ('ok', 'fixed') THEN n ELSE -1 END AS jobs FROM ({_OUTCOME})""",
    "status_pivot": """
        SELECT o_orderpriority AS ats, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ok,
               count(*) FILTER (WHERE o_orderstatus = 'O') AS n_fixed, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_failed,
               CAST(0 AS BIGINT) AS n_skipped FROM orders GROUP BY ALL""",
    "validation_counts": f"""
        WITH o AS ({_OUTCOME})
        SELECT ats, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'fixed') AS n_fixed,
               count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'skipped') AS n_skipped
        FROM o GROUP BY ats""",
    "registry_needs_update": f"SELECT bool_or(status IN ('fixed', 'failed')) AS needs_update FROM ({_OUTCOME})",
    "probe_counts": """
        SELECT CASE WHEN s_nationkey < 10 THEN 'greenhouse' ELSE 'lever' END AS ats,
               CASE WHEN s_acctbal > 6000 THEN 'sup-' ELSE 'sup' END || s_suppkey AS slug,
               CASE WHEN s_acctbal < 1000 THEN -1 WHEN s_nationkey < 10 AND s_acctbal > 9000 THEN 0
                    WHEN s_nationkey < 10 THEN 2 WHEN s_acctbal > 9000 THEN -1 ELSE 3 END AS jobs
        FROM supplier WHERE s_nationkey < 20""",
    "registry_output": f"""
        SELECT position, ats, CASE status WHEN 'fixed' THEN replace(slug, '-', '') ELSE slug END AS slug,
               CASE status WHEN 'fixed' THEN slug ELSE '' END AS was, '' AS name, '' AS line
        FROM ({_OUTCOME}) WHERE status <> 'failed'
        UNION ALL
        SELECT position, ats, slug, '', 'S' || substr(slug, 2), slug || ': check ' ||
               CASE ats WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' ELSE 'https://jobs.lever.co/' END || slug
        FROM ({_OUTCOME}) WHERE status = 'failed'""",
    "discovery": f"""
        SELECT 'order ' || company_pos AS company, company_pos, coalesce('o' || company_pos || '-' || line, '') AS slug,
               CASE WHEN line IS NULL THEN -1 ELSE 1 END AS jobs,
               coalesce('https://boards-api.greenhouse.io/v1/boards/o' || company_pos || '-' || line || '/jobs', '') AS url
        FROM ({_FOUND})""",
    "registry_lines": f"""
        SELECT company_pos, '"o' || company_pos || '-' || line || '",  # order ' || company_pos || ' (1 jobs)' AS line
        FROM ({_FOUND}) WHERE line IS NOT NULL""",
    "probe_errors": f"""
        SELECT company_pos, pos, CASE WHEN raised THEN 'error' ELSE 'status' END AS kind,
               'order ' || company_pos || ' (o' || company_pos || '-' || l_linenumber || '): ' ||
               CASE WHEN raised AND big THEN 'connection to the board was reset by peer while reading part ' || l_partkey
                    WHEN raised THEN 'timeout' WHEN l_returnflag = 'R' THEN 'HTTP 429' ELSE 'HTTP 500' END AS message
        FROM ({_ERRORS})""",
    "discovery_totals": f"""
        SELECT (SELECT count(line) FROM ({_FOUND})) AS n_confirmed,
               (SELECT count(*) FILTER (WHERE line IS NULL) FROM ({_FOUND})) AS n_not_found,
               (SELECT count(*) FILTER (WHERE raised) FROM ({_ERRORS})) AS n_errors""",
}
