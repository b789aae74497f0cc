"""Rule tables: plain data, compiled to Spark columns by the operator modules.

Everything in this module is a fixed value: the word lists, labels and limits
must equal the published ones for results to agree.
"""

# --- fixed values: closed enumerations ---------------------------------------

PROVIDERS = (
    "greenhouse", "lever", "ashby", "workday", "amazon", "google", "meta",
    "apple", "eightfold", "oracle", "smartrecruiters", "successfactors",
    "talentbrew", "usajobs", "avature", "mcloud", "verizon", "walmart",
)
FIRM_KINDS = (
    "technology", "finance", "consulting", "healthcare", "government",
    "startup", "industrial", "retail", "other",
)
LOCATION_TYPES = ("virtual", "in_person", "hybrid", "unknown")
SOURCE_SCOPES = (
    "company_page", "university_calendar", "handshake_public",
    "provider_api", "candidate",
)
SOURCE_STATUSES = (
    "productive", "empty", "blocked", "auth-required", "parser-needed",
    "inactive", "failed", "success",
)
PROGRAM_TYPES = ("internship", "new_grad", "experienced", "other")
REMOTE_TYPES = ("remote", "hybrid", "onsite", "unknown")
NORMALIZATION_STATUSES = ("COMPLETE", "NEEDS_REVIEW", "FAILED")
VISA_STATUSES = (
    "sponsors", "does_not_sponsor", "requires_authorization",
    "opt_cpt_allowed", "not_mentioned", "unclear",
)
ACADEMIC_LEVELS = (
    "freshman", "sophomore", "junior", "senior", "undergraduate",
    "masters", "phd", "new_grad",
)
APPLICATION_STATUSES = (
    "SAVED", "APPLIED", "PHONE_SCREEN", "TECHNICAL", "FINAL", "OFFER",
    "REJECTED",
)
APPLICATION_STATUS_LABELS = {
    "SAVED": "Saved",
    "APPLIED": "Applied",
    "PHONE_SCREEN": "Phone Screen",
    "TECHNICAL": "Technical",
    "FINAL": "Final Round",
    "OFFER": "Offer",
    "REJECTED": "Rejected",
}
RETRYABLE_ERRORS = (
    "ConnectionError", "ExtractionError", "RateLimitedError", "ReadTimeout",
    "Timeout",
)

# --- fixed values: description cleaning ---------------------------------------

BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "br", "div", "footer",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "p",
    "section", "tr",
)
BOILERPLATE_MARKERS = (
    "we are an equal opportunity employer",
    "equal employment opportunity",
    "EEO",
    "reasonable accommodation",
)

# --- fixed values: eligibility ------------------------------------------------

INTERN_WORDS = (
    "intern", "interns", "internship", "internships", "co-op", "co-ops",
    "coop", "coops",
)
NEW_GRAD_PHRASES = (
    "new grad", "new graduate", "entry level", "university grad",
    "graduate program",
)
ACADEMIC_LEVEL_TERMS = {
    "freshman": ("freshman", "first-year", "first year"),
    "sophomore": ("sophomore", "second-year", "second year"),
    "junior": ("junior", "third-year", "third year"),
    "senior": ("senior year", "college senior", "final year", "rising senior"),
    "undergraduate": ("undergrad", "undergraduate", "bachelor", "b.s.", "bs degree", "ba degree"),
    "masters": ("master's", "masters", "m.s.", "ms degree", "mba"),
    "phd": ("phd", "ph.d", "doctorate", "doctoral"),
    "new_grad": ("new grad", "new graduate", "recent graduate"),
}
DEGREE_TERMS = {
    "bachelors": ("bachelor", "b.s.", "bs degree", "ba degree", "undergrad", "undergraduate degree"),
    "masters": ("master's", "masters", "m.s.", "ms degree", "mba"),
    "phd": ("phd", "ph.d", "doctorate", "doctoral"),
}
FIRST_GRAD_YEAR, LAST_GRAD_YEAR = 2024, 2035
GRAD_YEAR_REACH, GRAD_RANGE_REACH = 80, 100
STUDENT_CONTEXT_TERMS = (
    "graduat", "class of", "degree", "student", "intern", "internship",
    "undergrad", "new grad", "university", "college", "summer", "fall",
    "winter", "spring",
)
VISA_TERMS = {
    "opt_cpt_allowed": (
        "opt/cpt", "opt and cpt", "cpt/opt", "curricular practical training",
        "optional practical training",
    ),
    "does_not_sponsor": (
        "does not sponsor", "do not sponsor", "cannot sponsor",
        "unable to sponsor", "will not sponsor", "not sponsor",
        "without sponsorship",
    ),
    "requires_authorization": (
        "must be authorized to work", "must be legally authorized to work",
        "authorized to work in the united states", "without restriction",
    ),
    "sponsors": (
        "visa sponsorship is available", "sponsorship is available",
        "we sponsor", "will sponsor", "h-1b sponsorship", "h1b sponsorship",
    ),
    "unclear": ("visa", "sponsorship", "work authorization"),
}
SKILL_ALIASES = {
    "aws": ("aws", "amazon web services"),
    "azure": ("azure",),
    "c++": ("c++",),
    "c#": ("c#",),
    "docker": ("docker",),
    "go": ("golang", "go"),
    "graphql": ("graphql",),
    "java": ("java",),
    "javascript": ("javascript", "node.js", "nodejs"),
    "kubernetes": ("kubernetes", "k8s"),
    "linux": ("linux",),
    "machine learning": ("machine learning", "ml engineer"),
    "postgresql": ("postgres", "postgresql"),
    "python": ("python",),
    "react": ("react", "react.js", "reactjs"),
    "redis": ("redis",),
    "ruby": ("ruby",),
    "rust": ("rust",),
    "sql": ("sql",),
    "swift": ("swift",),
    "typescript": ("typescript",),
}
NICE_TO_HAVE_MARKERS = (
    "nice to have", "preferred qualifications", "preferred skills", "bonus",
    "plus if",
)
CLEARANCE_TERMS = (
    "security clearance", "secret clearance", "top secret", "ts/sci",
    "polygraph",
)
REMOTE_TERMS = {
    "hybrid": ("hybrid",),
    "remote": ("remote", "work from home", "distributed team"),
    "onsite": ("onsite", "on-site", "in office", "office-based"),
}
SHORT_DESCRIPTION_CHARS = 120
BLOCKING_REASONS = (
    "missing_description", "short_description",
    "student_role_without_explicit_eligibility",
)

# --- fixed values: relevance --------------------------------------------------

STRONG_TITLE_TERMS = (
    "ai engineer", "android", "application developer", "application engineer",
    "applied scientist", "backend", "back end", "cloud engineer",
    "computer vision", "cybersecurity", "data engineer", "data scientist",
    "database administrator", "devops", "embedded software", "frontend",
    "front end developer", "front end engineer", "full stack", "fullstack",
    "ios engineer", "information technology specialist", "it engineer",
    "machine learning", "ml engineer", "mobile engineer", "platform engineer",
    "product security", "qa automation", "quant developer", "quant engineer",
    "quant research", "quant researcher", "quantitative analyst",
    "quantitative developer", "quantitative engineer", "quantitative research",
    "quantitative researcher", "quantitative trader", "robotics software",
    "security engineer", "site reliability", "software", "sre",
    "technical program manager", "web developer",
)
WEAK_TITLE_TERMS = (
    "analytics engineer", "business intelligence", "cloud", "cyber",
    "data analyst", "developer", "engineer", "information security",
    "network", "programmer", "qa engineer", "security analyst",
    "solutions architect", "systems administrator", "systems engineer",
    "technology analyst",
)
RELEVANT_DEPARTMENT_TERMS = (
    "ai", "cloud engineering", "computer science", "cybersecurity",
    "data platform", "data science", "developer platform",
    "information security", "information technology", "machine learning",
    "platform engineering", "product engineering", "quant research",
    "quantitative research", "security engineering", "software",
)
RELEVANT_SKILLS = (
    "aws", "azure", "c#", "c++", "docker", "graphql", "java", "javascript",
    "kubernetes", "linux", "machine learning", "postgresql", "python",
    "react", "redis", "ruby", "rust", "sql", "swift", "typescript",
)
NEGATIVE_TITLE_TERMS = (
    "account executive", "account manager", "accountant", "accounting",
    "assistant manager", "business development", "cashier", "cart attendant",
    "courier", "creative", "customer success", "customer service",
    "delivery driver", "department supervisor", "industry principal",
    "marketing", "merchandising", "freight handler", "handler",
    "material handler", "nurse", "order filler", "pharmacy technician",
    "production coordinator", "production worker", "quality inspector",
    "retail operations", "retail sales", "sales associate",
    "shift supervisor", "store associate", "store support", "truck driver",
    "warehouse worker",
)
TECHNICAL_NOUNS = (
    "administrator", "analyst", "architect", "developer", "devops",
    "engineer", "programmer", "scientist", "sdet", "sre",
)
RELEVANT_DESCRIPTION_TERMS = (
    " alpha research ", " computer science ", " software engineering ",
    " programming ", " build software ", " cloud ", " cyber security ",
    " cybersecurity ", " distributed systems ", " information technology ",
    " ict ", " market microstructure ", " network ", " oracle hcm ",
    " statistical modeling ", " software ",
)

# --- fixed values: queues -----------------------------------------------------

HIGH_PRIORITY_MARKERS = (
    "amazon", "anthropic", "apple", "deepmind", "cloudflare", "crowdstrike",
    "databricks", "datadog", "doordash", "google", "linkedin", "meta",
    "microsoft", "netflix", "nvidia", "openai", "palantir", "pinterest",
    "roblox", "salesforce", "stripe", "waymo",
)
SLOW_MARKERS = ("ashbyhq.com", "myworkdayjobs.com")
QUEUE_REASONS = {
    "high": "high-priority company",
    "slow": "slower or browser-heavy ATS",
    "standard": "default cadence",
}
REFRESH_LOCK_SECONDS = 30 * 60
STALE_HOURS_MANUAL, STALE_HOURS_SCHEDULED = 48, 2

# --- fixed values: source discovery -------------------------------------------

COMPANY_SUFFIXES = (
    "ai", "america", "bank", "capital", "co", "company", "corp",
    "corporation", "financial", "group", "holdings", "inc", "incorporated",
    "labs", "llc", "lp", "management", "partners", "software", "systems",
    "technologies", "technology",
)
KNOWN_TOKEN_ALIASES = {
    "Alphabet": ("google", "alphabet"),
    "Amazon": ("amazon", "amazonjobs"),
    "Anduril": ("andurilindustries", "anduril"),
    "Box": ("boxinc", "box"),
    "DoorDash": ("doordashusa", "doordash"),
    "HubSpot": ("hubspotjobs", "hubspot"),
    "TripActions": ("tripactions", "navan"),
    "Wiz": ("wizinc", "wiz"),
}
DISCOVERY_PROVIDER_ORDER = ("greenhouse", "lever", "ashby")
DISCOVERY_URL_PREFIX = {
    "greenhouse": "https://boards.greenhouse.io/",
    "lever": "https://jobs.lever.co/",
    "ashby": "https://jobs.ashbyhq.com/",
}

# --- fixed values: query surface ----------------------------------------------

COUNTRY_ALIASES = {
    "united states": ("United States", "USA", ", US", " US,"),
    "canada": ("Canada",),
    "india": ("India",),
    "united kingdom": ("United Kingdom", "UK", "England", "Scotland"),
    "ireland": ("Ireland",),
    "germany": ("Germany",),
    "france": ("France",),
    "netherlands": ("Netherlands",),
    "spain": ("Spain",),
    "singapore": ("Singapore",),
    "australia": ("Australia",),
    "japan": ("Japan",),
    "china": ("China",),
    "taiwan": ("Taiwan",),
    "south korea": ("South Korea", "Korea"),
    "israel": ("Israel",),
}

# --- fixed values: recruiting events ------------------------------------------

SCHEMA_EVENT_TYPES = ("Event", "BusinessEvent", "EducationEvent")
FIRM_ALIASES = {
    "Amazon": ("technology", ("amazon", "aws", "amazon web services", "amazon student programs")),
    "Meta": ("technology", ("meta", "facebook", "meta university", "meta careers")),
    "Apple": ("technology", ("apple", "careers at apple", "apple retail")),
    "Microsoft": ("technology", ("microsoft",)),
    "Google": ("technology", ("google", "google careers", "careers onair")),
    "NVIDIA": ("technology", ("nvidia",)),
    "Stripe": ("technology", ("stripe",)),
    "Databricks": ("technology", ("databricks",)),
    "Roblox": ("technology", ("roblox",)),
    "Uber": ("technology", ("uber",)),
    "Airbnb": ("technology", ("airbnb",)),
    "Netflix": ("technology", ("netflix",)),
    "Salesforce": ("technology", ("salesforce",)),
    "Adobe": ("technology", ("adobe",)),
    "IBM": ("technology", ("ibm",)),
    "Oracle": ("technology", ("oracle",)),
    "Bloomberg": ("finance", ("bloomberg",)),
    "Palantir": ("technology", ("palantir",)),
}
FIRM_OVERRIDE_SCOPES = ("university_calendar", "handshake_public", "candidate")
VIRTUAL_TERMS = ("virtual", "online", "webinar", "zoom", "teams meeting")
IN_PERSON_TERMS = ("in-person", "in person", "campus", "office", "career fair")
LOCATION_TEXT_TERMS = {
    "Virtual": ("virtual", "online", "webinar", "zoom"),
    "In person": ("onsite", "on-site", "in-person", "in person"),
}
EVENT_TYPE_TERMS = {
    "career_fair": ("career fair", "job fair"),
    "info_session": ("info session", "information session"),
    "webinar": ("webinar",),
    "workshop": ("workshop", "bootcamp"),
    "networking": ("networking", "meet and greet"),
    "conference": ("conference", "summit"),
}
AUDIENCE_TERMS = {
    "students": ("student", "students", "campus", "university"),
    "interns": ("intern", "internship"),
    "new_grads": ("new grad", "graduate", "early career"),
    "mba": ("mba",),
    "phd": ("phd", "ph.d"),
    "engineers": ("engineer", "technical", "software"),
}
EVENT_LANGUAGE_TERMS = (
    "event", "webinar", "career fair", "info session", "recruit", "workshop",
)
EVENT_TITLE_KEYS = ("name", "title", "headline", "summary", "eventName")
EVENT_START_KEYS = (
    "startDate", "start_date", "startsAt", "startTime", "startTimestamp",
    "start_timestamp", "date",
)
EVENT_END_KEYS = (
    "endDate", "end_date", "endsAt", "endTime", "endTimestamp",
    "end_timestamp",
)
EVENT_URL_KEYS = ("url", "eventUrl", "canonicalUrl", "link")
EVENT_REGISTRATION_KEYS = (
    "registrationUrl", "registration_url", "applyUrl", "rsvpUrl",
    "eventLandingURL",
)
EVENT_DESCRIPTION_KEYS = ("description", "body", "shortDescription", "details")
EVENT_TYPE_KEYS = ("eventType", "event_type", "category", "type")
EVENT_ID_KEYS = ("identifier", "id", "uid", "eventId")
EVENT_TIMEZONE_KEYS = ("timezone", "timeZone", "tz")
EVENT_LOCATION_KEYS = (
    "location", "eventLocation", "venue", "completeVenue", "address",
)
ADDRESS_KEYS = (
    "streetAddress", "addressLocality", "addressRegion", "postalCode",
    "addressCountry",
)
