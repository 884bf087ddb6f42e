"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour
being reproduced (word lists, lookup tables, markers, defaults).  They are
written plainly, in their natural order, and are used as literal arrays by
the Column functions in :mod:`jobsift.functions`.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — whitespace classes per regex dialect
# ---------------------------------------------------------------------------
# Python ``\s`` (str patterns) written as a Java character class.
PY_WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# JavaScript ``\s`` written as a Java character class.
JS_WS = "[\\t-\\r\\x20\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
# The same two classes in DuckDB (RE2) syntax, for oracle SQL.
PY_WS_RE2 = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
JS_WS_RE2 = "[\\t-\\r\\x20\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"

# ---------------------------------------------------------------------------
# FIXED VALUES — bullet characters
# ---------------------------------------------------------------------------
# base cleaner: 15 symbols, then ⬩⬨⬦, ▪ + U+FE0F, ▫ + U+FE0F and the hyphen
BULLET_CHARS_BASE = "•·●◆◇▪▸▹►▻‣⁃⦿✦✧⬩⬨⬦▪️▫️-"
# listing engine: the first 15 only
BULLET_CHARS_ENGINE = "•·●◆◇▪▸▹►▻‣⁃⦿✦✧"
# browser extension: the first 15 plus ■ ✓ – —
BULLET_CHARS_EXT = "•·●◆◇▪▸▹►▻‣⁃⦿✦✧■✓–—"

# Stop-words dropped as lone bullets by the extension.
EXT_STOP_WORDS = ["and", "or", "the", "a", "an", "to", "for", "in", "of", "with", "by", "at", "is", "are", "was", "were"]

# ---------------------------------------------------------------------------
# FIXED VALUES — skills
# ---------------------------------------------------------------------------
SKILLS_REF = [
    "React", "Next.js", "TypeScript", "JavaScript", "Node.js", "Python", "FastAPI",
    "Django", "Flask", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Docker",
    "Kubernetes", "AWS", "GCP", "Azure", "GraphQL", "REST API", "Git",
    "PyTorch", "TensorFlow", "Java", "C++", "C#", "Go", "Rust", "TailwindCSS",
    "HTML", "CSS", "CI/CD", "Kafka", "Microservices", "System Design", "Swift", "iOS",
]
SKILLS_DEFAULT_EMPTY_TEXT = ["React", "TypeScript", "Node.js", "Python", "PostgreSQL"]
SKILLS_DEFAULT_NONE_FOUND = ["React", "TypeScript", "Node.js", "Python", "REST API"]
SKILLS_DEFAULT_ENGINE = ["React", "TypeScript", "Python"]

# ---------------------------------------------------------------------------
# FIXED VALUES — company detection
# ---------------------------------------------------------------------------
COMPANY_SUFFIXES = [
    "inc", "ltd", "limited", "pvt", "private", "corp", "corporation",
    "llc", "llp", "plc", "gmbh", "ag", "sa", "bv", "nv", "pty",
    "technologies", "tech", "solutions", "services", "consulting",
    "group", "holdings", "enterprises", "systems", "software",
    "digital", "global", "international", "industries", "labs",
    "ventures", "partners", "associates", "analytics", "data",
    "infotech",
]
NON_COMPANY_WORDS = [
    "home", "about", "contact", "search", "login", "sign", "register",
    "jobs", "careers", "apply", "submit", "next", "previous", "page",
    "loading", "error", "menu", "navigation", "footer", "header",
    "skip", "share", "save", "cancel", "delete", "edit", "filter",
    "sort", "view", "list", "grid", "back", "more", "less", "all",
    "reset", "send", "close", "open", "help", "faq",
]
# company names rejected by the generic post-processing step
GENERIC_REJECTED_COMPANIES = ["home", "about", "contact", "search"]
# first-row cell hints used when a table has no company column
TABLE_COMPANY_CELL_HINTS = ["inc.", "ltd", "technologies", "pvt."]
TABLE_HEADER_COMPANY = ["company", "organization", "firm", "employer", "name"]
TABLE_HEADER_ROLE = ["job", "title", "position", "role", "designation"]
TABLE_HEADER_DESC = ["description", "details", "info", "about"]
# suffix alternation used by the "X Inc/Ltd/..." text pattern
TEXT_PATTERN_LEGAL_FORMS = "Inc\\.?|Ltd\\.?|Limited|LLC|LLP|Pvt\\.?\\s*Ltd\\.?|Corp\\.?|GmbH|Technologies|Tech|Solutions"

# ---------------------------------------------------------------------------
# FIXED VALUES — places (listing-card location lookup, in priority order)
# ---------------------------------------------------------------------------
PLACES = [
    "Bengaluru", "Bangalore", "Mumbai", "Delhi", "Pune", "Hyderabad",
    "Chennai", "Kolkata", "Ahmedabad", "Gurugram", "Gurgaon", "Noida",
    "Remote", "Work From Home", "India",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — description trimming markers
# ---------------------------------------------------------------------------
START_MARKERS = [
    "Job description",
    "Job Description",
    "We are looking for",
    "You'll make an impact by",
    "Your key responsibilities",
    "What you'll do",
    "About the role",
    "About this role",
    "Job Description:",
    "Job description:",
]
END_MARKERS = [
    "\nRole:",
    "\nRole :",
    "\nIndustry Type:",
    "\nIndustry :",
    "\nCompany Info",
    "\nKey highlights",
    "\nCompany reviews",
    "\nAbout Company",
    "\nBeware of imposters",
    "\nroles you might be interested in",
    "\nSimilar Jobs",
    "\nSimilar jobs",
    "\nHome Jobs",
    "\nEmployee reviews",
    "\nSalary & Benefits",
    "\nPerks and Benefits",
    "\nCompany website",
    "\nFollow",
    "\nKickstart your",
    "\nReport this",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — default field values per extractor
# ---------------------------------------------------------------------------
NAUKRI_SINGLE_COMPANY = "Naukri Hiring Company"
NAUKRI_SINGLE_ROLE = "Software Developer"
NAUKRI_SINGLE_DESCRIPTION = "Naukri job description posting."
NAUKRI_SINGLE_LOCATION = "India / Remote"
NAUKRI_SINGLE_EXPERIENCE = "0-5 Yrs"
NAUKRI_CARD_COMPANY = "Naukri Organization"
NAUKRI_CARD_ROLE = "Software Role"
INDEED_SINGLE_COMPANY = "Indeed Featured Hiring Org"
INDEED_SINGLE_DESCRIPTION = "Job posting details scraped from Indeed."
INDEED_CARD_COMPANY = "Indeed Employer"
LINKEDIN_SINGLE_COMPANY = "LinkedIn Organization"
LINKEDIN_SINGLE_DESCRIPTION = "Job description details scraped from LinkedIn."
LINKEDIN_CARD_COMPANY = "LinkedIn Hiring Org"
DEFAULT_ROLE_ENGINEER = "Software Engineer"
GENERIC_DEFAULT_ROLE = "Listed Entry"
JSONLD_ORG_ROLE = "Company"
JSONLD_LIST_ROLE = "Listed Company"
JSON_SHEET_COMPANY = "Featured Organization"
JSON_SHEET_ROLE = "Software Engineer"
JSON_ENGINE_COMPANY = "Naukri"
JSON_ENGINE_ROLE = "Software Developer"
JSON_LOCATION = "Scraped Target Location"
JSON_URL = "#"
COMPANY_SENTINEL = "[COMPANY_NOT_FOUND]"
ROLE_SENTINEL = "[ROLE_NOT_FOUND]"
INDEED_BASE_URL = "https://www.indeed.com"
NAUKRI_BASE_URL = "https://www.naukri.com"
