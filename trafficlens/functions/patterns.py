"""The word lists, patterns and limits every verdict depends on.

All of these are data, not logic.  Patterns stay within the syntax shared by Java, RE2
and Python so one text serves Spark and any SQL engine used to check it.
"""

import re

# --- user agents -----------------------------------------------------------------------
# User agents of automated clients, as used by the session feature.
BOT_AGENT_PATTERNS = (
    r"bot", r"spider", r"crawler", r"scraper", r"curl", r"wget", r"python-requests",
    r"python-urllib", r"go-http-client", r"java/", r"perl", r"ruby", r"php/", r"node\.js",
    r"scrapy", r"headless", r"phantom", r"selenium", r"puppeteer", r"playwright",
    r"httpclient", r"okhttp", r"apache-httpclient", r"mechanize", r"beautifulsoup", r"lxml",
    r"http\.client", r"googlebot", r"bingbot", r"yspider", r"slurp", r"duckduckbot",
    r"facebot", r"facebookexternalhit", r"twitterbot", r"linkedinbot", r"bot\b", r"\bbot\b",
)

# User agents of ordinary browsers.
BROWSER_AGENT_PATTERNS = (
    r"mozilla.*chrome", r"mozilla.*firefox", r"mozilla.*safari", r"mozilla.*edge",
    r"mozilla.*opera", r"mozilla.*msie", r"mozilla.*applewebkit", r"applewebkit.*safari",
    r"chrome/", r"firefox/", r"safari/",
)

# User agents that settle the verdict on their own.
CERTAIN_BOT_PATTERNS = (
    r"curl", r"wget", r"python-requests", r"python-urllib", r"go-http-client", r"java/",
    r"perl", r"ruby", r"php/", r"scrapy", r"headless", r"phantom", r"selenium", r"puppeteer",
    r"playwright", r"httpclient", r"okhttp", r"apache-httpclient", r"mechanize",
    r"beautifulsoup", r"lxml", r"http\.client", r"bot\b", r"\bbot\b", r"spider", r"crawler",
    r"scraper", r"Uptime-Kuma", r"HetrixTools", r"Pingdom", r"UptimeRobot", r"Nagios",
    r"Zabbix", r"Prometheus", r"Grafana", r"Semrush", r"Ahrefs", r"MozBot", r"MJ12bot",
    r"Googlebot", r"Bingbot", r"YandexBot", r"DuckDuckBot", r"Applebot", r"Bytespider",
    r"GPTBot", r"CCBot", r"facebookexternalhit", r"Twitterbot", r"LinkedInBot", r"Masscan",
    r"Nmap", r"ZmEu", r"nikto", r"sqlmap", r"Havij", r"w3af", r"OpenVAS", r"Nessus", r"Qualys",
)

# User agents naming a content delivery network.
CDN_AGENT_PATTERNS = (r"cf-", r"cloudflare", r"incapsula", r"akamai", r"sucuri", r"akamaighost")

# User agents of attack tools.
ATTACK_TOOL_PATTERNS = (
    r"Masscan", r"Nmap", r"ZmEu", r"nikto", r"sqlmap", r"Havij", r"w3af", r"OpenVAS", r"Nessus",
    r"Qualys", r"Wapiti", r"Arachni", r"DirBuster", r"Gobuster", r"Feroxbuster", r"wfuzz",
    r"Switchblade", r"Katory", r"fuzz", r"WinHTTP", r"WinInet", r"Nuclei", r"ffuf",
    r"Go\s*net/http",
)

# Webhook senders and RPC client libraries, automated but welcome.
INTEGRATION_PATTERNS = (
    r"Stripe/\d", r"GitHub-Hookshot", r"Shopify", r"Slackbot-LinkExpanding", r"Slack-Webhooks",
    r"PayPal-IPN", r"Twilio", r"svix-webhooks", r"WhatsApp/", r"Zapier", r"HubSpot", r"Mailgun",
    r"grpc-go", r"grpc-java", r"grpc-python", r"grpc-node", r"grpc-c/", r"grpc-c\+\+",
    r"grpc-swift", r"grpc-dotnet", r"grpc-objc",
)

# Fixed value: the user-agent pattern of the simple baseline detector.
BASELINE_AGENT_PATTERN = (
    r"bot|crawl|spider|slurp|curl|wget|python|go-http|java/|libwww|perl|ruby|php/"
    r"|scrapy|httpclient|okhttp|axios|node-fetch|headless|phantom|selenium|nmap"
    r"|sqlmap|nikto|nuclei|ffuf|gobuster|dirbuster|wfuzz|masscan|zgrab|hydra"
)

# --- paths and urls --------------------------------------------------------------------
# Path fragments only a vulnerability scanner asks for.
SCANNER_FRAGMENTS = ("/phpmyadmin", "/.env", "/.git", "/phpinfo", "/xmlrpc.php", "/cgi-bin")

# Path fragments usually guarded by a web application firewall.
PROTECTED_FRAGMENTS = (
    "/wp-admin", "/wp-login", "/wp-json", "/xmlrpc.php", "/.env", "/.git", "/config", "/debug",
    "/phpinfo", "/admin", "/dashboard", "/console", "/manager", "/.well-known",
    "/api/v1/auth", "/api/v2/auth",
)

# Url fragments of sign-in endpoints.
SIGN_IN_FRAGMENTS = (
    "/wp-login.php", "/wp-admin", "/xmlrpc.php", "/wp-json/wp/v2/users",
    "/?rest_route=/wp/v2/users", "/login", "/signin", "/auth", "/api/login",
    "/api/auth/login", "/api/v1/login", "/api/v2/login",
)

# Query parameters that carry a credential.
CREDENTIAL_PARAMETERS = (
    "key", "token", "api_key", "apikey", "access_token", "auth", "password", "pass", "secret",
    "credential", "jwt", "bearer",
)

# Whole paths swept by router botnets.
BOTNET_PATH_PATTERNS = (
    r"^/shell\.cgi", r"^/omega\.cgi", r"^/boaform", r"^/HNAP1?\b", r"^/tr069", r"^/goform",
    r"^/cgi-bin/luci", r"^/adv$", r"^/cpe$", r"^/device$", r"^/cmd$", r"^/system$", r"^/exec$",
    r"^/run$",
)

# APIs that route every call through one path.
ONE_PATH_API_PATTERNS = (
    r"/graphql", r"/graphiql", r"/trpc/", r"/rpc\b", r"/soap", r"/services/", r"\.asmx", r"/ws\b",
)

# Routes that serve data rather than pages.
API_ROUTE_PATTERNS = (
    r"^/(?:api|graphql|gql|rpc|v\d+|rest|oauth|auth|token|webhook)\b",
    r"^/[A-Za-z0-9_.]+\.[A-Za-z0-9_]+/[A-Za-z0-9_]+$",
)

# Embedded files a browser fetches along with a page.
STATIC_FILE_PATTERNS = (
    r"(?:^|/)(?:images?|img|static|assets?|media|thumbnails?|thumbs?|icons?|css|js|fonts?"
    r"|avatars?|uploads?|cdn|sprites?)(?:/|$)",
    r"\.(?:js|css|png|jpe?g|gif|svg|ico|woff2?|ttf|map|webp|avif|mp4|json|xml|txt)$",
    r"/favicon\.ico$",
)

# Fixed value: a gRPC call path, case sensitive.
GRPC_PATH_PATTERN = r"^/[\w.]+/[A-Z]\w*$"

# File suffixes.
POST_STATIC_SUFFIXES = (".css", ".js", ".png", ".jpg", ".gif", ".ico", ".svg")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp")

# Referer texts that mean "none".
NO_REFERER_VALUES = ("-", "", "none")

# --- probes, honeypots, evaluation -----------------------------------------------------
# Path prefixes of probes for software the site does not run.
PROBE_PREFIXES = (
    "/.env", "/.git", "/.aws", "/wp-login.php", "/wp-admin", "/xmlrpc.php", "/phpmyadmin",
    "/vendor/phpunit", "/cgi-bin/", "/boaform",
)
EXTRA_BLOCKED_PREFIXES = ("/server-status", "/actuator", "/.ds_store")
PAYLOAD_MARKERS = (
    "../", "/etc/passwd", "union select", "<script", "' or ", "sleep(", "${jndi:",
    "waitfor delay",
)
HONEYPOT_PREFIX = "/_hp/"
INVITE_PARAMETER = "ref"
LOOPBACK_ADDRESSES = ("127.0.0.1", "::1")
EVALUATION_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)
MIN_ACTORS_PER_CLASS = 30

# --- crawler labelling -----------------------------------------------------------------
# Engine, user-agent claim, host name suffixes that confirm it.
CRAWLER_ENGINES = (
    ("google", r"googlebot", ("googlebot.com", "google.com")),
    ("bing", r"bingbot|msnbot", ("search.msn.com",)),
    ("yandex", r"yandex", ("yandex.ru", "yandex.net", "yandex.com")),
    ("apple", r"applebot", ("applebot.apple.com",)),
    ("baidu", r"baiduspider", ("baidu.com", "baidu.jp")),
)
CRAWLER_TOKEN_PATTERN = r"bot|crawl|spider|slurp"
HUMAN_ACTION_PREFIXES = ("/basket/add/", "/basket/checkout", "/order/create")
ASSET_PREFIXES = ("/image/", "/static/")
STAFF_PREFIX = "/orderAdministration/"
ASSET_SUFFIX_PATTERN = r"\.(css|js|png|jpe?g|gif|svg|webp|woff2?|ttf|ico|map)(\?|$)"
PLAIN_BROWSER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36"
)

# --- limits ----------------------------------------------------------------------------
# Seconds, counts and scores the rules compare with.
SESSION_TIMEOUT_S = 1800
TAIL_TIMEOUT_S = 300
RETAINED_REQUESTS = 200
SCAN_THRESHOLD = 0.7
BLOCK_THRESHOLD = 0.85
ABUSE_SCORE_LIMIT = 75.0
SHARED_FINGERPRINT_LIMIT = 5
FINGERPRINT_GRACE_S = 5.0
FINGERPRINT_MIN_REQUESTS = 3
FINGERPRINT_WINDOW_S = 600
FINGERPRINT_TTL_S = 1800
ACTOR_TTL_S = 30 * 24 * 3600
MAX_TRACKED_ACTORS = 10_000
MAX_HUMAN_REQUESTS = 2000
RATE_LIMIT_REQUESTS = 60
RATE_LIMIT_WINDOW_S = 60
ABUSE_CACHE_TTL_S = 86_400
ABUSE_DAILY_QUOTA = 1000
SIGNAL_SOURCES = ("tor", "abuseipdb", "fingerprint")
MIN_CORRECTIONS = 50
MAX_CLASS_SHARE = 0.9
MAX_TOPUP_FRACTION = 0.3
MIN_SESSION_REQUESTS = 3
MAX_SESSIONS_PER_ACTOR = 5
MAX_ROWS_PER_ACTOR = 20

# Every confidence the rules can return, and the texts that tell two human
# rules apart when their blends coincide.
RULE_CONFIDENCES = (
    ("bot", (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.88, 0.9, 0.95)),
    ("human", (0.5, 0.6, 0.65, 0.7, 0.75)),
)
HUMAN_REASON_PREFIXES = (
    ("empty session", 0.5),
    ("known browser, reasonable session", 0.75),
    ("variable timing", 0.7),
    ("exploring", 0.65),
    ("natural navigation", 0.6),
    ("Cloudflare-protected site", 0.65),
    ("no strong signals", 0.5),
)


def alternation(patterns):
    """One pattern that matches where any of ``patterns`` does."""
    return "|".join(patterns)


#: A pattern that is a text as it stands, apart from escaped dots and plus signs.
_FIXED = re.compile(r"(?:[A-Za-z0-9 _/-]|\\[.+])+")


def matches_sql(text: str, patterns) -> str:
    """SQL: whether one of ``patterns`` matches somewhere in ``text``, whatever the case.

    In text of ASCII alone nothing needs folding by Unicode, and fixed texts are looked for only where
    their first characters occur, which is several times as fast.
    """
    fixed = minimal_fragments([p.replace("\\", "").lower() for p in patterns if _FIXED.fullmatch(p)])
    others = [p for p in patterns if not _FIXED.fullmatch(p)]
    quick = []
    if fixed:
        starts = [sorted({re.escape(f[i]) for f in fixed}) for i in range(min(3, *map(len, fixed)))]
        ahead = "".join(f"[{''.join(s)}]" for s in starts)
        quick.append(f"lower({text}) rlike r'(?={ahead})(?:{alternation(map(re.escape, fixed))})'")
    if others:
        quick.append(f"{text} rlike r'(?i){alternation(others)}'")
    any_text = f"{text} rlike r'(?iu){alternation(patterns)}'"
    return f"IF(octet_length({text}) = length({text}), {' OR '.join(quick)}, {any_text})"


def credential_pattern():
    return "|".join(rf"[?&]{name}=" for name in CREDENTIAL_PARAMETERS)


def minimal_fragments(fragments):
    """Drop fragments that contain another one: finding the shorter one is enough."""
    return [f for f in fragments if not any(o != f and o in f for o in fragments)]
