"""Run settings: word lists, limits and scoring rules, all caller-replaceable."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from rankfold import fixed_values as fv

# Places outside the US besides the ones the rubric names: countries, and cities that
# job listings give without their country.  Names that are also US states are left out.
COUNTRIES = (
    "afghanistan", "albania", "algeria", "argentina", "armenia", "austria", "azerbaijan", "bahrain", "bangladesh", "belarus",
    "belgium", "bolivia", "bosnia", "botswana", "brazil", "bulgaria", "cambodia", "cameroon", "chile", "china", "colombia",
    "costa rica", "croatia", "cuba", "cyprus", "czechia", "czech republic", "denmark", "dominican republic", "ecuador", "egypt",
    "el salvador", "england", "estonia", "ethiopia", "finland", "france", "germany", "ghana", "greece", "guatemala", "honduras",
    "hong kong", "hungary", "iceland", "indonesia", "iran", "iraq", "ireland", "israel", "italy", "jamaica", "japan", "jordan",
    "kazakhstan", "kenya", "korea", "kosovo", "kuwait", "latvia", "lithuania", "luxembourg", "malaysia", "malta", "mauritius",
    "mexico", "moldova", "mongolia", "montenegro", "morocco", "myanmar", "nepal", "netherlands", "new zealand", "nicaragua",
    "nigeria", "north macedonia", "northern ireland", "norway", "oman", "pakistan", "panama", "paraguay", "peru", "philippines",
    "poland", "portugal", "qatar", "romania", "russia", "rwanda", "saudi arabia", "scotland", "senegal", "serbia", "singapore",
    "slovakia", "slovenia", "south africa", "spain", "sri lanka", "sweden", "switzerland", "taiwan", "tanzania", "thailand",
    "tunisia", "turkey", "uganda", "ukraine", "united arab emirates", "uae", "united kingdom", "uruguay", "uzbekistan",
    "venezuela", "vietnam", "wales", "zambia", "zimbabwe", "emea", "apac", "latam",
)
CITIES = (
    "amsterdam", "athens", "auckland", "bangkok", "barcelona", "beijing", "bengaluru", "berlin", "bogota", "brisbane", "brussels",
    "bucharest", "budapest", "buenos aires", "cairo", "cape town", "chennai", "copenhagen", "delhi", "dubai", "dublin", "edinburgh",
    "frankfurt", "geneva", "gurgaon", "hamburg", "helsinki", "hyderabad", "istanbul", "jakarta", "johannesburg", "karachi", "krakow",
    "kyiv", "lagos", "lahore", "lisbon", "luxembourg", "madrid", "manila", "melbourne", "milan", "montreal", "moscow", "mumbai",
    "munich", "nairobi", "osaka", "oslo", "ottawa", "paris", "prague", "pune", "rome", "sao paulo", "seoul", "shanghai", "stockholm",
    "sydney", "tel aviv", "tokyo", "vancouver", "vienna", "warsaw", "zurich",
)
US_STATE_CODES = tuple(
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd "
    "tn tx ut vt va wa wv wi wy dc".split()
)
#: A location that names the US, or ends in the code of one of its states, as in "Paris, TX".
US_LOCATION = (
    r"(^|[^a-z])(usa?|u\.s\.a?\.?|united states|"
    rf"new mexico)($|[^a-z])|, *({'|'.join(US_STATE_CODES)})( [0-9]{{5}})?$"
)

DISQUALIFY, CAP, POINTS, FLAG = "disqualify", "cap", "points", "flag"


@dataclass(frozen=True)
class Rule:
    """One data-driven scoring rule.

    ``scope`` is title, description, both, location or company.  ``match`` is
    substring, word, exact, regex, required (a sentence holds the keyword and a
    "required" cue but no "nice to have" cue) or absent (none of the keywords).
    ``value`` is the cap of a cap rule or the signed points of a points rule; a
    word of ``unless`` in the same text cancels the rule, and so does a match of
    the regular expression ``unless_pattern``.
    """

    rule_id: str
    kind: str
    scope: str
    match: str
    keywords: tuple[str, ...]
    value: int = 0
    flag: str = ""
    unless: tuple[str, ...] = ()
    unless_pattern: str = ""


@dataclass(frozen=True)
class CompanyRule:
    """A cap on a company's postings, optionally only for some titles."""

    company: str
    title_contains: str | None
    cap: int
    flag: str


def default_rules() -> tuple[Rule, ...]:
    """The rubric in rule form.

    Phrases and penalties are fixed by the rubric.  It gives no points for the
    positive signals and no numbers for the plausibility screens, so those
    values are defaults of this library.
    """
    return (
        Rule("clearance", DISQUALIFY, "both", "word", fv.CLEARANCE_PHRASES, flag="clearance required"),
        Rule("foreign_location", DISQUALIFY, "location", "word", fv.FOREIGN_PLACES + COUNTRIES + CITIES, flag="non-US location",
             unless_pattern=US_LOCATION),
        Rule("wrong_role", DISQUALIFY, "title", "substring", fv.WRONG_ROLE_PHRASES, flag="wrong role type"),
        Rule("placement", DISQUALIFY, "description", "substring", fv.PLACEMENT_PHRASES, flag="contract or placement"),
        Rule("no_sponsorship", DISQUALIFY, "both", "substring", fv.NO_SPONSORSHIP_PHRASES, flag="no sponsorship"),
        Rule("seniority", DISQUALIFY, "title", "word", fv.SENIOR_TITLE_WORDS, flag="seniority mismatch"),
        Rule("remote_only", FLAG, "location", "exact", ("remote",), flag=fv.REMOTE_ONLY_FLAG),
        Rule("primary_stack", POINTS, "both", "substring", ("c#", ".net", "dotnet"), 25),
        Rule("azure", POINTS, "description", "substring",
             ("app service", "azure functions", "service bus", "key vault", "application insights",
              "azure sql", "azure devops"), 10),
        Rule("aws", POINTS, "description", "substring", ("iot core", "lambda"), 5),
        Rule("architecture", POINTS, "description", "substring",
             ("microservices", "rest api", "distributed systems"), 8),
        Rule("domain", POINTS, "description", "substring",
             ("healthcare", "fintech", "insurance", "enterprise software"), 8),
        Rule("remote_or_hybrid", POINTS, "description", "word", ("remote", "hybrid"), 5),
        Rule("level", POINTS, "both", "word",
             ("entry level", "entry-level", "junior", "associate", "mid-level", "0-5 years"), 10),
        Rule("libraries", POINTS, "description", "word",
             ("signalr", "redis", "entity framework", "linq"), 5),
        Rule("delivery", POINTS, "description", "word", ("ci/cd", "azure devops", "github actions"), 4),
        Rule("patterns", POINTS, "description", "word", ("cqrs", "repository pattern", "solid"), 4),
        Rule("ai_tooling", POINTS, "description", "substring",
             ("llm integration", "ai tooling", "data pipelines", "developer tooling"), 4),
        Rule("angular_core", POINTS, "description", "required", ("angular",), -15),
        Rule("infra_core", POINTS, "description", "required", ("terraform", "kubernetes"), -10),
        Rule("on_site_only", POINTS, "description", "word", ("on-site", "onsite"), -5,
             unless=("remote", "hybrid")),
        Rule("no_salary", POINTS, "description", "absent", ("$", "salary", "compensation range"), -3),
        Rule("five_years", POINTS, "description", "regex", (r"(^|[^0-9])([5-9]|[1-9][0-9])\+ ?years",), -5),
    )


def default_company_rules() -> tuple[CompanyRule, ...]:
    false_positives = tuple(
        CompanyRule(company, title, 0, "known false positive") for company, title in fv.FALSE_POSITIVES
    )
    contractors = tuple(CompanyRule(c, None, 50, fv.DEFENSE_FLAG) for c in fv.DEFENSE_CONTRACTORS)
    return false_positives + contractors


@dataclass(frozen=True)
class SearchConfig:
    """All settings of one run.

    The defaults process every row and whole descriptions; ``published_limits``
    adds the published limits of a run.
    """

    seniority_words: tuple[str, ...] = fv.SENIORITY_WORDS
    other_role_words: tuple[str, ...] = fv.OTHER_ROLE_WORDS
    wanted_role_words: tuple[str, ...] = fv.WANTED_ROLE_WORDS
    signal_words: tuple[str, ...] = fv.SIGNAL_WORDS
    target_companies: tuple[str, ...] = fv.TARGET_COMPANIES
    min_score: int = fv.MIN_SCORE
    max_jobs: int | None = None                 # None: rank everything
    stale_days: int = fv.STALE_DAYS
    description_chars: int | None = None        # None: whole texts
    thin_page_chars: int = fv.THIN_PAGE_CHARS
    shell_markers: tuple[str, ...] = fv.SHELL_MARKERS
    empty_url: str = "collapse"                 # or "keep_all"
    keep_empty_cells: bool = False
    today_only: bool = False

    rules: tuple[Rule, ...] = field(default_factory=default_rules)
    company_rules: tuple[CompanyRule, ...] = field(default_factory=default_company_rules)
    base_score: int = 30
    # plausibility screens and language balance (library defaults)
    salary_limit: int = 500_000
    screen_cap: int = 40
    technology_limit: int = 20
    technologies: tuple[str, ...] = (
        "java", "python", "golang", "rust", "ruby", "php", "scala", "kotlin", "swift", "perl",
        "javascript", "typescript", "react", "angular", "vue", "svelte", "node", "django",
        "flask", "spring", "rails", "laravel", "docker", "kubernetes", "terraform", "ansible",
        "jenkins", "kafka", "spark", "hadoop", "redis", "mongodb", "cassandra", "mysql",
        "postgresql", "oracle", "aws", "azure", "gcp", "salesforce", "sap", "tableau",
    )
    engineering_title_words: tuple[str, ...] = ("software engineer", "software developer")
    office_skill_words: tuple[str, ...] = ("customer service", "ms office")
    wanted_languages: tuple[str, ...] = ("c#", ".net")
    rival_languages: tuple[str, ...] = ("java", "python", "golang", "typescript")
    cosmetic_points: int = -20
    sponsor_points: int = 5
    small_company_points: int = -5
    required_cues: tuple[str, ...] = ("required", "must have", "core", "strong experience")
    optional_cues: tuple[str, ...] = ("nice to have", "a plus", "preferred", "bonus")

    def published_limits(self) -> "SearchConfig":
        """These settings with the published number of rows and length of descriptions."""
        return self.with_(max_jobs=fv.MAX_JOBS, description_chars=fv.DESCRIPTION_CHARS)

    def with_(self, **changes) -> "SearchConfig":
        return replace(self, **changes)
