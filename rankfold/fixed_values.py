"""Fixed values.

Everything below has to equal the published word lists, patterns, limits and
formats for results to agree, so it is stated as plain text and in its natural
order.  All of it can be replaced through ``SearchConfig``.
"""

# ---- fixed values: title words -------------------------------------------------

SENIORITY_WORDS = (
    "staff", "principal", "manager", "director", "lead",
    "head of", "vp ", "vice president", "distinguished", "fellow",
    "architect", "cto", "ceo", "ciso",
)

OTHER_ROLE_WORDS = (
    "account executive", "account manager", "sales", "recruiter", "recruiting",
    "finance", "legal", "marketing", "design", "customer success", "customer support",
    "operations", "analyst", "consultant", "business development", "partnership",
    "product manager", "program manager", "project manager", "hr ", "human resources",
)

WANTED_ROLE_WORDS = (
    "engineer", "developer", "software", "sde", "swe", "backend", "frontend",
    "full stack", "fullstack", "infrastructure", "security engineer",
    "machine learning", "data engineer", "devops", "cloud engineer",
    "systems", "compiler", "firmware", "embedded", "mobile", "android", "ios",
)

# ---- fixed values: stack signal and target companies ---------------------------

SIGNAL_WORDS = (
    "c#", ".net", "asp.net", "dotnet", "dot net", "blazor", "entity framework",
    "linq", "wpf", "xaml", "azure functions", "nuget",
)

TARGET_COMPANIES = (
    "microsoft", "truveta", "docusign", "geico", "milliman",
    "premera blue cross", "avanade", "wizards of the coast", "tcs",
    "infosys", "deloitte", "paccar", "charles schwab", "tesla",
    "inovalon", "jpmorgan chase", "gainwell technologies", "ibm",
    "honeywell", "covermymeds", "pointclickcare", "city national bank",
    "waystar", "ge healthcare", "cognizant", "accenture", "capgemini",
    "kpmg", "ey", "pwc", "hcltech",
)
TARGET_MARK = "🎯"

# ---- fixed values: links and cell text -----------------------------------------

APPLY_URL_WORDS = (
    "myworkday", "greenhouse", "lever", "ashby", "smartrecruiters",
    "icims", "jobvite", "workday", "taleo", "ultipro", "bamboohr",
    "amazon.jobs", "careers.", "jobs.", "job-boards", "apply",
    "simplify.jobs/p/",
)
AVOIDED_URL_WORDS = ("github.com", "simplify.jobs/c/")
LAST_RESORT_URL_WORDS = ("simplify.jobs",)

HREF_PATTERN = r"""(?U)href=["']?(https?://[^"'>\s]+)"""
MARKDOWN_LINK_PATTERN = r"\[[^\]]*\]\((https?://[^)]+)\)"

CELL_CLEANING = (
    (r"(?s)<a[^>]*>(.*?)</a>", "$1"),
    (r"</?(?:strong|em|b|i|div|td|tr|th|tbody|thead)[^>]*>", ""),
    (r"<[^>]+>", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r":[a-z_]+:", ""),
    (r"\*+([^*]+)\*+", "$1"),
)

TABLE_SEPARATOR_PATTERN = r"(?U)^\|[\s\-:|]+\|$"
TABLE_HEADER_CELLS = ("company", "name", "")

# ---- fixed values: web pages ---------------------------------------------------

HIDDEN_ELEMENTS = ("script", "style", "nav", "header", "footer", "aside")
SHELL_MARKERS = (
    "__NEXT_DATA__", "ng-version", "data-reactroot",
    '<div id="root">', '<div id="app">', "window.__INITIAL_STATE__",
    "__nuxt__", "data-v-app",
)
THIN_PAGE_CHARS = 200
DESCRIPTION_CHARS = 8000

# ---- fixed values: limits, labels and layouts ----------------------------------

MIN_SCORE = 51
MAX_JOBS = 200
STALE_DAYS = 30

SCORE_BUCKETS = (
    # bucket number, label, highest score in the bucket (None: no upper end)
    (0, "0 (error/excluded)", 0),
    (1, "1–30", 30),
    (2, "31–40", 40),
    (3, "41–50", 50),
    (4, "51–65", 65),
    (5, "66–79", 79),
    (6, "80+", None),
)

OUTPUT_COLUMNS = (
    "score", "verdict", "flag", "target", "company", "role", "location",
    "posted", "reason", "source", "url",
)

STALE_FLAG, STALE_REASON = "stale_posting", "Posting is older than 30 days"
OFF_STACK_FLAG, OFF_STACK_REASON = "wrong_stack", "No C#/.NET stack found in job description"
REPLY_ERROR_FLAG, REPLY_ERROR_REASON = "parse_error", "scoring error"
NO_DESCRIPTION_TEXT = "(no description available — score based on title only)"

BOARD_A, BOARD_B, BOARD_C = "greenhouse", "lever", "workday"

# list sources in their order of precedence: name, format
LIST_SOURCES = (
    ("speedyapply", "markdown-html"),
    ("SimplifyJobs", "html-table"),
    ("jobright-ai", "markdown-html"),
    ("cvrve", "markdown-html"),
)
# registered boards: kind, slug or tenant, board name
REGISTERED_BOARDS = (
    (BOARD_A, "inovalon", ""), (BOARD_A, "truveta", ""), (BOARD_A, "onespan", ""),
    (BOARD_B, "pointclickcare", ""),
    (BOARD_C, "waystar", "waystar"), (BOARD_C, "premera", "premera"),
    (BOARD_C, "guidewire", "external"), (BOARD_C, "quantiphi", "Careers_at_Quantiphi"),
)

CHECK_LINKS = {
    BOARD_A: "https://boards.greenhouse.io/%s",
    BOARD_B: "https://jobs.lever.co/%s",
}
BOARD_LISTING_LINK = "https://boards-api.greenhouse.io/v1/boards/%s/jobs"
BOARD_C_LINK = "https://%s.wd%d.myworkdayjobs.com/%s/job/%s"

# ---- fixed values: slug variants -----------------------------------------------

SLUG_SUFFIXES = {
    BOARD_A: ("inc", "technologies", "systems", "software", "labs", "health"),
    BOARD_B: ("inc", "hq", "careers", "software"),
    BOARD_C: ("inc", "corp", "llc"),
}
SLUG_STRIPPED_SUFFIXES = {
    BOARD_A: (),
    BOARD_B: ("software", "inc", "hq"),
    BOARD_C: ("inc", "corp", "systems", "technologies"),
}
SLUG_LATE_SUFFIXES = {BOARD_A: (), BOARD_B: (), BOARD_C: ("careers",)}
SLUG_SHORTHAND = {
    BOARD_A: {
        "modernizingmedicine": "modmed", "pointclickcare": "pcc",
        "guidewiresoftware": "guidewire", "duckcreektechnologies": "duckcreek",
        "appliedsystems": "ezlynx", "westmonroe": "westmonroepartners",
    },
    BOARD_B: {
        "guidewiresoftware": "guidewire", "duckcreektechnologies": "duckcreek",
        "publicissapient": "sapient", "netsmart": "netsmartechnologies",
    },
    BOARD_C: {
        "ltimindtree": "mindtree", "mrisoftware": "mri",
        "fisglobal": "fis", "bentleysystems": "bentley",
    },
}

# ---- fixed values: where companies without a confirmed board list their jobs ----

BOARD_CATEGORIES = {
    "WORKDAY": (
        "Epic Systems", "Medtronic", "GE HealthCare", "Philips", "ServiceNow",
        "Snowflake", "Splunk", "Datadog", "Autodesk", "Fiserv", "FIS Global",
        "Tyler Technologies", "Trimble", "Broadridge", "CrowdStrike", "Zscaler",
        "Palo Alto Networks", "Workday", "Infor", "Epicor",
    ),
    "LEVER": (
        "Harness", "Grafana Labs", "SentinelOne", "Sumo Logic",
        "Applied Systems (EZLynx)", "Waystar", "New Relic", "Sisense",
    ),
    "TALEO/ORACLE": (
        "Cerner (Oracle Health)", "Allscripts", "Infosys", "TCS", "Wipro",
        "HCL Technologies", "Cognizant", "Capgemini",
    ),
    "SMARTRECRUITERS": (
        "Nagarro", "LTIMindtree", "EPAM Systems", "Thoughtworks",
    ),
    "ICIMS": (
        "Yardi Systems", "RealPage", "MRI Software", "Jack Henry",
        "Vertafore", "Duck Creek", "SS&C Technologies",
    ),
}

# ---- fixed values: scoring rubric phrases --------------------------------------

CLEARANCE_PHRASES = (
    "top secret", "ts/sci", "secret clearance", "security clearance",
    "public trust", "itar", "dod", "us citizen required",
    "us citizenship required", "must be a us person", "cleared", "poly",
)
FOREIGN_PLACES = (
    "uk", "india", "canada", "europe", "australia", "london", "toronto", "bangalore",
)
WRONG_ROLE_PHRASES = (
    "firmware engineer", "embedded engineer", "fpga", "rtos", "avionics", "sdet",
    "qa engineer", "test automation engineer", "network engineer", "mainframe developer",
)
PLACEMENT_PHRASES = (
    "contract to hire", "w2 contract", "consulting engagement", "placed at client",
    "client site", "through our client", "on behalf of our client", "contingent",
    "6 month contract", "12 month contract",
)
NO_SPONSORSHIP_PHRASES = (
    "no sponsorship", "will not sponsor", "no visa sponsorship available",
    "must be authorized to work without sponsorship", "citizens only",
)
SENIOR_TITLE_WORDS = (
    "senior", "sr", "staff", "principal", "lead", "director", "vp", "head of",
    "architect", "distinguished", "fellow",
)
DEFENSE_CONTRACTORS = (
    "lockheed martin", "booz allen hamilton", "leidos", "raytheon", "rtx", "peraton",
    "l3harris", "saic", "general dynamics", "northrop grumman",
    "sierra nevada corporation", "boeing defense", "bae systems",
)
DEFENSE_FLAG = "likely clearance required, verify before applying"
REMOTE_ONLY_FLAG = "verify location"
# company, words in the title (None: any title)
FALSE_POSITIVES = (
    ("adtran", "software engineer"),
    ("peraton", None),
    ("dataannotation", None),
    ("fetchjobs.co", None),
    ("mon sinistre afrique", None),
    ("rotaract club", None),
    ("indtech calibration", None),
    ("hackerrank", "sdet"),
    ("boeing", "software engineer-simulation"),
)
