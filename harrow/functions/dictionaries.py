"""Fixed values that must equal the reference's for identical results.

Everything in this module is data, stated in the reference's natural order.
Operators turn these lists into column expressions or small literal tables.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's)
# ---------------------------------------------------------------------------

# Tracking query parameters dropped by URL canonicalization (case-insensitive
# name).  gh_jid is kept when the host contains "greenhouse".
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gh_src", "gh_jid", "lever-source", "lever-origin", "source", "src", "ref",
    "referrer", "recruiter", "trk", "fbclid", "gclid", "mc_cid", "mc_eid",
)

# Declared platforms: slug -> (display name, search domain), in declaration order.
PLATFORMS = (
    ("ashby", "Ashby", "jobs.ashbyhq.com"),
    ("greenhouse", "Greenhouse", "boards.greenhouse.io"),
    ("greenhouse_jb", "Greenhouse", "job-boards.greenhouse.io"),
    ("lever", "Lever", "jobs.lever.co"),
    ("workday", "Workday", "myworkdayjobs.com"),
    ("workday_alt", "Workday", "workdayjobs.com"),
    ("smartrecruiters", "SmartRecruiters", "jobs.smartrecruiters.com"),
    ("smartrecruiters_careers", "SmartRecruiters", "careers.smartrecruiters.com"),
    ("workable", "Workable", "apply.workable.com"),
    ("jobvite", "Jobvite", "jobs.jobvite.com"),
    ("bamboohr", "BambooHR", "jobs.bamboohr.com"),
    ("icims", "iCIMS", "jobs.icims.com"),
    ("careerspage", "Careers-Page", "careers-page.com"),
    ("recruitee", "Recruitee", "recruitee.com"),
    ("personio", "Personio", "jobs.personio.com"),
    ("rippling", "Rippling", "ats.rippling.com"),
    ("adp", "ADP", "careers.adp.com"),
    ("oracle", "Oracle Cloud", "oraclecloud.com"),
    ("successfactors", "SuccessFactors", "successfactors.com"),
)

# Posting platforms (URL -> slug), in resolution order, with their host domains.
POSTING_PLATFORMS = (
    ("ashby", ("jobs.ashbyhq.com",)),
    ("greenhouse", ("boards.greenhouse.io", "job-boards.greenhouse.io")),
    ("lever", ("jobs.lever.co",)),
    ("workday", ("myworkdayjobs.com", "workdayjobs.com")),
    ("smartrecruiters", ("jobs.smartrecruiters.com", "careers.smartrecruiters.com")),
    ("workable", ("apply.workable.com",)),
    ("jobvite", ("jobs.jobvite.com",)),
    ("bamboohr", ("jobs.bamboohr.com",)),
    ("icims", ("jobs.icims.com",)),
    ("careerspage", ("careers-page.com",)),
    ("recruitee", ("recruitee.com",)),
    ("personio", ("jobs.personio.com",)),
    ("rippling", ("ats.rippling.com",)),
    ("adp", ("careers.adp.com",)),
    ("oracle", ("oraclecloud.com",)),
    ("successfactors", ("successfactors.com",)),
)

# Title groups for query generation, in order, with their titles in order.
JOB_TITLE_GROUPS = (
    ("generic_swe", ("software engineer intern", "software engineering intern",
                     "software developer intern", "software development intern",
                     "SWE intern", "developer intern")),
    ("backend", ("backend engineer intern", "backend developer intern")),
    ("frontend", ("frontend engineer intern", "front end engineer intern")),
    ("fullstack", ("full stack engineer intern", "full-stack engineer intern")),
    ("mobile", ("mobile engineer intern", "iOS engineer intern", "Android engineer intern")),
    ("platform_infra", ("platform engineer intern", "infrastructure engineer intern",
                        "cloud engineer intern", "DevOps intern",
                        "site reliability engineer intern", "SRE intern")),
    ("data_ml", ("data engineer intern", "machine learning engineer intern",
                 "ML engineer intern", "AI engineer intern")),
    ("security", ("security engineer intern",)),
    ("embedded", ("embedded software intern", "firmware engineer intern",
                  "systems software intern")),
    ("other", ("game developer intern", "QA automation intern", "test engineer intern")),
)

# Title group -> category tag.
TITLE_GROUP_TO_CATEGORY = (
    ("generic_swe", "software"), ("backend", "backend"), ("frontend", "frontend"),
    ("fullstack", "fullstack"), ("mobile", "mobile"), ("platform_infra", "infrastructure"),
    ("data_ml", "machine_learning"), ("security", "security"), ("embedded", "embedded"),
    ("other", "software"),
)

# Title group -> relative query weight.
GROUP_WEIGHT = (
    ("generic_swe", 1.5), ("backend", 1.2), ("frontend", 1.1), ("fullstack", 1.1),
    ("mobile", 1.0), ("platform_infra", 1.0), ("data_ml", 1.1), ("security", 0.9),
    ("embedded", 0.8), ("other", 0.7),
)

# Query variants: (variant, priority factor).
QUERY_VARIANTS = (("title", 1.0), ("title_term", 0.8), ("title_location", 0.7))

DEFAULT_ACADEMIC_TERMS = (
    "Summer 2027", "Winter 2027", "Spring 2027", "Fall 2027", "2027 internship", "2027 co-op",
)

DEFAULT_LOCATIONS = (
    "Toronto", "Canada", "United States", "New York", "San Francisco", "Seattle",
    "Vancouver", "Waterloo", "Remote", "North America",
)

MAX_TITLES_PER_CLAUSE = 4
MAX_LOCATIONS_PER_CLAUSE = 5

# Terms recognised as the academic term of a posting, in checking order.
TERM_CANDIDATES = ("Summer 2027", "Winter 2027", "Fall 2027", "Spring 2027")
TERM_YEAR = "2027"

# Keyword sets for relevance scoring.
INTERNSHIP_INDICATORS = ("intern", "internship", "co-op", "coop", "co op", "student", "placement")

SOFTWARE_INDICATORS = (
    "software", "developer", "engineering", "engineer", "backend", "back end",
    "frontend", "front end", "full stack", "full-stack", "fullstack", "mobile",
    "ios", "android", "machine learning", "ml", "ai", "platform", "infrastructure",
    "security", "firmware", "embedded", "systems", "devops", "sre",
    "site reliability", "data engineer", "programming", "web developer", "qa automation",
)

NEGATIVE_KEYWORDS = (
    "senior software engineer", "staff software engineer", "principal engineer",
    "principal software engineer", "engineering manager", "internship program manager",
    "sales intern", "marketing intern", "recruiting intern", "hr intern", "finance intern",
    "mechanical engineering intern", "mechanical engineer intern", "civil engineering intern",
    "electrical engineering intern", "chemical engineering intern", "unpaid", "bootcamp",
    "course", "aggregator",
)

CATEGORY_KEYWORDS = (
    ("backend", ("backend", "back end", "back-end", "server")),
    ("frontend", ("frontend", "front end", "front-end", "ui engineer", "web developer")),
    ("fullstack", ("full stack", "full-stack", "fullstack")),
    ("mobile", ("mobile", "ios", "android")),
    ("machine_learning", ("machine learning", "ml engineer", " ai ", "deep learning")),
    ("infrastructure", ("infrastructure", "platform", "devops", "sre", "site reliability", "cloud")),
    ("security", ("security", "appsec", "infosec")),
    ("embedded", ("embedded", "firmware", "systems software")),
)
DEFAULT_CATEGORY = "software"

# Score weights in summation order; penalties.
SCORE_WEIGHTS = (
    ("internship", 0.25), ("software", 0.25), ("title", 0.15), ("term", 0.10),
    ("location", 0.08), ("ats", 0.07), ("freshness", 0.10),
)
NEGATIVE_PENALTY = 0.6
SEEN_PENALTY = 0.15
DEFAULT_MIN_SCORE = 0.55
NON_ATS_SLUGS = ("company", "generic")

# Freshness: (max age in days, factor); unknown date 0.5; older than all 0.1.
FRESHNESS_STEPS = ((3, 1.0), (7, 0.8), (14, 0.6), (30, 0.3))
FRESHNESS_UNKNOWN = 0.5
FRESHNESS_OLDEST = 0.1

# Legal suffix words removed from company names.
COMPANY_SUFFIX_PATTERN = (
    r"\b(inc|inc\.|llc|ltd|ltd\.|corp|corporation|co|gmbh|technologies|technology|labs|"
    r"software|systems|solutions|group|holdings)\b"
)
# Separators after which a title's trailing company part is dropped.
TITLE_SPLIT_PATTERN = r"\s+(?:-|–|—|\||at)\s+"
# Noise tokens removed from titles for equality matching.
TITLE_NOISE_PATTERN = (
    r"\b(intern|internship|co-?op|20\d\d|summer|winter|fall|spring|"
    r"remote|hybrid|onsite|full[- ]?time|part[- ]?time)\b"
)

# Phrases that mark a page as expired, checked in this order.
EXPIRED_PHRASES = (
    "job no longer available", "position filled", "position has been filled",
    "applications closed", "applications are closed", "job has expired",
    "this job is no longer accepting applications", "no longer accepting applications",
    "posting is closed", "this position is closed", "job not found",
)

# Dedup thresholds.
TITLE_SIMILARITY = 0.85
DESCRIPTION_SIMILARITY = 0.9

# Presentation.
COLOR_HIGH = 0x2ECC71
COLOR_NORMAL = 0x3498DB
COLOR_HIGH_MIN_SCORE = 0.75
SNIPPET_HIT = 400
SNIPPET_OG = 600

# Search budgets and batch sizes (defaults).
HOURLY_SEARCH_BUDGET = 100
DAILY_SEARCH_BUDGET = 1000
MAX_QUERIES_PER_SCAN = 40
RESULTS_PER_QUERY = 10
PENDING_LIMIT = 25
RECHECK_LIMIT = 50
DIGEST_LIMIT = 25
MIN_SCAN_INTERVAL_HOURS = 0.5

# Feedback effects.
IRRELEVANT_PENALTY = 0.2

# Search providers: name -> (items path, url field, title field, snippet field).
PROVIDER_LAYOUTS = (
    ("serper", "organic", "link", "title", "snippet"),
    ("bing", "webPages.value", "url", "name", "snippet"),
    ("brave", "web.results", "url", "title", "description"),
    ("google_pse", "items", "link", "title", "snippet"),
)

# IPv4 ranges that are not publicly routable (private, loopback, link-local,
# multicast, reserved, unspecified), and the two public exceptions.
NON_PUBLIC_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32", "224.0.0.0/4",
)
PUBLIC_IPV4_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")

# Guild settings defaults.
DEFAULT_SCAN_INTERVAL_HOURS = 6.0
DEFAULT_GUILD_MIN_SCORE = 0.55
