"""Display-name tables.  All values in this module are fixed values."""

# --- fixed values: board token -> company name, per provider ------------------

GREENHOUSE_COMPANIES = {
    "arizeai": "Arize AI", "adyen": "Adyen", "algolia": "Algolia",
    "amplitude": "Amplitude", "alphasense": "AlphaSense", "appian": "Appian",
    "astranis": "Astranis", "aurorainnovation": "Aurora", "avetta": "Avetta",
    "blackduck": "Black Duck", "blend": "Blend", "bitwarden": "Bitwarden",
    "branch": "Branch", "bugcrowd": "Bugcrowd", "calm": "Calm",
    "canonical": "Canonical", "cerebrassystems": "Cerebras",
    "circleci": "CircleCI", "clickhouse": "ClickHouse",
    "collibra": "Collibra", "coherehealth": "Cohere Health",
    "contentful": "Contentful", "coreweave": "CoreWeave",
    "descript": "Descript", "digitalocean98": "DigitalOcean",
    "dremio": "Dremio", "dropbox": "Dropbox", "epirus": "Epirus",
    "epicgames": "Epic Games", "fiveringsllc": "Five Rings",
    "figureai": "Figure AI", "fireworksai": "Fireworks AI",
    "gemini": "Gemini", "grafanalabs": "Grafana Labs",
    "gofundme": "GoFundMe", "helsing": "Helsing", "iterable": "Iterable",
    "jfrog": "JFrog", "komodohealth": "Komodo Health", "lattice": "Lattice",
    "launchdarkly": "LaunchDarkly", "life360": "Life360", "make": "Make",
    "materialize": "Materialize", "mattermost": "Mattermost",
    "medium": "Medium", "mercury": "Mercury", "mixpanel": "Mixpanel",
    "monzo": "Monzo", "n26": "N26", "netlify": "Netlify",
    "nextiva": "Nextiva", "nextroll": "NextRoll", "nintendo": "Nintendo",
    "nubank": "Nubank", "onetrust": "OneTrust", "planetlabs": "Planet Labs",
    "planetscale": "PlanetScale", "riotgames": "Riot Games",
    "singlestore": "SingleStore", "runpod": "Runpod", "salsify": "Salsify",
    "securityscorecard": "SecurityScorecard",
    "sourcegraph91": "Sourcegraph", "starburst": "Starburst",
    "stackadapt": "StackAdapt", "squarespace": "Squarespace",
    "tanium": "Tanium", "tailscale": "Tailscale",
    "thetradedesk": "The Trade Desk", "togetherai": "Together AI",
    "twitch": "Twitch", "typeform": "Typeform", "udacity": "Udacity",
    "udemy": "Udemy", "unity3d": "Unity", "upstart": "Upstart",
    "veracode": "Veracode", "vast": "Vast", "wing": "Wing",
    "yugabyte": "Yugabyte", "xai": "xAI", "zocdoc": "Zocdoc",
    "zuora": "Zuora", "2k": "2K",
}
LEVER_COMPANIES = {
    "houzz": "Houzz", "shieldai": "Shield AI", "sonatype": "Sonatype",
    "veeva": "Veeva Systems", "zilliz": "Zilliz", "zoox": "Zoox",
}
ASHBY_COMPANIES = {
    "airbyte": "Airbyte", "alchemy": "Alchemy", "anyscale": "Anyscale",
    "astronomer": "Astronomer", "airgarage": "AirGarage",
    "baseten": "Baseten", "browserbase": "Browserbase",
    "cartesia": "Cartesia", "chalk": "Chalk", "clickup": "ClickUp",
    "commonroom": "Common Room", "confluent": "Confluent",
    "cognition": "Cognition", "crusoe": "Crusoe", "cursor": "Cursor",
    "decagon": "Decagon", "deel": "Deel", "deepgram": "Deepgram",
    "dottxt": "dotTXT", "drata": "Drata", "dust": "Dust", "e2b": "E2B",
    "elevenlabs": "ElevenLabs", "factory": "Factory", "fathom": "Fathom",
    "firecrawl": "Firecrawl", "gamma": "Gamma", "granola": "Granola",
    "gumloop": "Gumloop", "harvey": "Harvey", "helpscout": "Help Scout",
    "ideogram": "Ideogram", "elliptic": "Elliptic",
    "infisical": "Infisical", "krea": "Krea", "langchain": "LangChain",
    "lambda": "Lambda", "linear": "Linear", "livekit": "LiveKit",
    "mem0": "Mem0", "mercor": "Mercor", "mistral": "Mistral AI",
    "modal": "Modal", "motherduck": "MotherDuck", "openai": "OpenAI",
    "opensea": "OpenSea", "orb": "Orb", "1password": "1Password",
    "parallel": "Parallel", "patreon": "Patreon",
    "perplexity": "Perplexity",
    "physicalintelligence": "Physical Intelligence", "pika": "Pika",
    "pinecone": "Pinecone", "plaid": "Plaid", "poolside": "poolside",
    "posthog": "PostHog", "prefect": "Prefect", "quora": "Quora",
    "railway": "Railway", "ramp": "Ramp", "readme": "ReadMe",
    "render": "Render", "replit": "Replit", "runway": "Runway",
    "saronic": "Saronic", "semgrep": "Semgrep", "sentry": "Sentry",
    "sierra": "Sierra", "skydio": "Skydio", "slope": "Slope",
    "statsig": "Statsig", "strava": "Strava", "substack": "Substack",
    "supabase": "Supabase", "suno": "Suno", "tavus": "Tavus",
    "unstructured": "Unstructured", "vapi": "Vapi", "warp": "Warp",
    "weaviate": "Weaviate", "writer": "Writer", "zapier": "Zapier",
    "zip": "Zip",
}
WORKDAY_COMPANIES = {
    "amd": "AMD", "arm": "Arm Holdings", "att": "AT&T",
    "autodesk": "Autodesk", "bah": "Booz Allen Hamilton",
    "blueorigin": "Blue Origin", "boeing": "Boeing",
    "cadence": "Cadence Design Systems",
    "capitalone": "Capital One Financial", "cisco": "Cisco Systems",
    "cvshealth": "CVS Health", "dukeenergy": "Duke Energy",
    "elevancehealth": "Elevance Health", "fedex": "FedEx",
    "fanniemae": "Fannie Mae", "freddiemac": "Freddie Mac",
    "geaerospace": "GE Aerospace", "gevernova": "GE Vernova",
    "generac": "Generac", "gdit": "General Dynamics Information Technology",
    "generalmotors": "General Motors", "ghr": "Bank of America",
    "globalhr": "RTX Corporation", "humana": "Humana", "intuit": "Intuit",
    "jci": "Johnson Controls", "jll": "Jones Lang LaSalle",
    "kla": "KLA Corporation", "leidos": "Leidos", "lowes": "Lowe's",
    "ngc": "Northrop Grumman", "pae": "Amentum",
    "paloaltonetworks": "Palo Alto Networks", "qualcomm": "Qualcomm",
    "motorolasolutions": "Motorola Solutions", "ms": "Morgan Stanley",
    "philips": "Philips", "pru": "Prudential Financial",
    "rockwellautomation": "Rockwell Automation", "target": "Target",
    "thermofisher": "Thermo Fisher Scientific", "ti": "Texas Instruments",
    "tysonfoods": "Tyson Foods", "uhg": "UnitedHealth Group",
    "usbank": "US Bancorp", "visa": "Visa", "vmware": "VMware",
    "wf": "Wells Fargo", "zoom": "Zoom Video Communications",
}
USAJOBS_COMPANIES = {"nasa": "NASA"}

# --- fixed values: host -> company name, per provider -------------------------

ORACLE_HOSTS = {
    "careers.ti.com": "Texas Instruments",
    "careers.honeywell.com": "Honeywell",
    "eeho.fa.us2.oraclecloud.com": "Oracle",
    "jpmc.fa.oraclecloud.com": "JPMorgan Chase",
    "hdpc.fa.us2.oraclecloud.com": "Goldman Sachs",
}
TALENTBREW_HOSTS = {
    "careers.arm.com": "Arm Holdings",
    "careers.blackrock.com": "BlackRock",
    "careers.unitedhealthgroup.com": "UnitedHealth Group",
    "jobs.intuit.com": "Intuit",
    "jobs.citi.com": "Citi",
}
TALENTBREW_DETAIL_HOSTS = ("careers.arm.com", "jobs.citi.com", "jobs.intuit.com")
AVATURE_HOSTS = {"careers.twosigma.com": "Two Sigma"}

# --- fixed values: company key -> display label -------------------------------

DISPLAY_NAMES = {
    "andurilindustries": "Anduril Industries", "agilityrobotics": "Agility Robotics",
    "akunacapital": "Akuna Capital", "anaplan": "Anaplan", "apptronik": "Apptronik",
    "arcinstitute": "Arc Institute", "airwallex": "Airwallex", "abacus": "Abacus AI",
    "alertmedia": "AlertMedia", "alephalpha": "Aleph Alpha", "applovin": "AppLovin",
    "applied": "Applied Intuition", "appomni": "AppOmni", "apollographql": "Apollo GraphQL",
    "arkoselabs": "Arkose Labs", "augury": "Augury", "automox": "Automox",
    "avride": "Avride", "axon": "Axon", "altruist": "Altruist", "angellist": "AngelList",
    "a16z": "a16z", "backblaze": "Backblaze", "bloomreach": "Bloomreach",
    "blockstream": "Blockstream", "cabify": "Cabify", "cargurus": "CarGurus",
    "capellaspace": "Capella Space", "cartahealthcare": "Carta Healthcare",
    "catonetworks": "Cato Networks", "censys": "Censys", "chainguard": "Chainguard",
    "clipboard": "Clipboard Health", "coalition": "Coalition", "colorhealth": "Color Health",
    "commure": "Commure", "cognite": "Cognite", "connectwise": "ConnectWise",
    "corelight": "Corelight", "cresta": "Cresta", "dmatrix": "d-Matrix",
    "dailypay": "DailyPay", "dapper": "Dapper Labs", "dataiku": "Dataiku",
    "deepl": "DeepL", "delinea": "Delinea", "descope": "Descope", "devrev": "DevRev",
    "dragos": "Dragos", "five9": "Five9", "flexe": "Flexe", "freenome": "Freenome",
    "geckorobotics": "Gecko Robotics", "gocardless": "GoCardless", "geotab": "Geotab",
    "generalcatalyst": "General Catalyst", "govini": "Govini", "guild": "Guild",
    "heygen": "HeyGen", "hermeus": "Hermeus", "hingehealth": "Hinge Health",
    "hootsuite": "Hootsuite", "imbue": "Imbue", "includedhealth": "Included Health",
    "invisible": "Invisible Technologies", "jetbrains": "JetBrains",
    "kickstarter": "Kickstarter", "kodiak": "Kodiak", "kong": "Kong",
    "lightmatter": "Lightmatter", "lithic": "Lithic", "locusrobotics": "Locus Robotics",
    "matillion": "Matillion", "mapbox": "Mapbox", "mercari": "Mercari",
    "metabase": "Metabase", "maymobility": "May Mobility",
    "moderntreasury": "Modern Treasury", "mozilla": "Mozilla", "mural": "Mural",
    "mystenlabs": "Mysten Labs", "natera": "Natera", "nasuni": "Nasuni",
    "nerdwallet": "NerdWallet", "netradyne": "Netradyne",
    "nozominetworks": "Nozomi Networks", "observeai": "Observe.AI", "opengov": "OpenGov",
    "outrider": "Outrider", "oscar": "Oscar Health", "pantherlabs": "Panther Labs",
    "pathai": "PathAI", "pipedrive": "Pipedrive", "poshmark": "Poshmark",
    "primer": "Primer", "primerai": "Primer AI", "public": "Public",
    "purestorage": "Pure Storage", "pubmatic": "PubMatic", "redis": "Redis",
    "relativity": "Relativity", "secondfrontsystems": "Second Front Systems",
    "shift4": "Shift4", "smartsheet": "Smartsheet", "sonarsource": "SonarSource",
    "snorkelai": "Snorkel AI", "socure": "Socure", "scopely": "Scopely",
    "serverobotics": "Serve Robotics", "signoz": "SigNoz", "sumologic": "Sumo Logic",
    "supercell": "Supercell", "taketwo": "Take-Two", "tekion": "Tekion",
    "thoughtmachine": "Thought Machine", "trustpilot": "Trustpilot", "uipath": "UiPath",
    "voleon": "The Voleon Group", "xero": "Xero", "xometry": "Xometry",
    "yubico": "Yubico", "zoominfo": "ZoomInfo", "betterment": "Betterment",
    "beyondtrust": "BeyondTrust", "billcom": "BILL", "celonis": "Celonis",
    "dialpad": "Dialpad", "digitalocean98": "DigitalOcean", "doordashusa": "DoorDash",
    "fal": "fal", "graphcore": "Graphcore", "keepersecurity": "Keeper Security",
    "knowbe4": "KnowBe4", "lightningai": "Lightning AI", "motional": "Motional",
    "nebius": "Nebius", "orcasecurity": "Orca Security", "pingidentity": "Ping Identity",
    "recordedfuture": "Recorded Future", "remotecom": "Remote", "rocketlab": "Rocket Lab",
    "fiveringsllc": "Five Rings", "hubspotjobs": "HubSpot", "optiverus": "Optiver",
    "stabilityai": "Stability AI", "surveymonkey": "SurveyMonkey",
    "tigergraph": "TigerGraph", "sourcegraph91": "Sourcegraph", "spacex": "SpaceX",
    "spire": "Spire", "stackblitz": "StackBlitz", "stockx": "StockX",
    "synthesia": "Synthesia", "tenstorrent": "Tenstorrent", "udio": "Udio",
    "wayve": "Wayve", "weightsandbiases": "Weights & Biases",
    "weights_and_biases": "Weights & Biases", "whatnot": "Whatnot", "wizinc": "Wiz",
    "worldlabs": "World Labs", "zed": "Zed",
}
