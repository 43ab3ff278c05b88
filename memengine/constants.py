"""Fixed values the operators compare against.

Everything in this module is data, not logic: word lists, lookup tables,
thresholds and patterns that have to hold these exact values for results to be
right.  Every operator takes them as overridable parameters.
"""

from __future__ import annotations

from string import ascii_letters, digits

# --- fixed values: sources and system groups --------------------------------
SOURCES = ["gmail", "chrome", "youtube"]
ALL_SOURCES_MARK = "all"

GROUPS = [(1, "work"), (2, "study"), (3, "entertainment"), (4, "personal"), (5, "misc")]
GROUP_IDS = {name: gid for gid, name in GROUPS}
MISC_GROUP = GROUP_IDS["misc"]

SEED_TEXTS = {
    "work": "meeting deadline client project deliverable sprint report",
    "study": "lecture tutorial concept algorithm textbook exam university",
    "entertainment": "funny comedy music gaming meme trailer reaction vlog viral",
    "personal": "family friend birthday vacation message dinner wedding travel",
    "misc": "general information article news update random browse read",
}

# --- fixed values: capture gates --------------------------------------------
PAGE_MIN_DWELL = 5
PAGE_LONG_DWELL = 10
PAGE_MIN_SCROLL = 0.25
PAGE_MIN_INTERACTIONS = 1
VIDEO_MIN_WATCH = 20
REVISIT_TTL_SECONDS = 86_400
SESSION_GAP_SECONDS = 300
IDLE_SECONDS = 30
SHORT_VIDEO_SECONDS = 60
VIDEO_ID_LENGTH = 11

APP_DOMAINS = [
    "slack.com", "app.slack.com", "jira.com", "atlassian.net", "notion.so",
    "figma.com", "linear.app", "trello.com", "asana.com", "confluence.atlassian.net",
]
# The capture side knows one application host more than the store side.
CAPTURE_APP_DOMAINS = APP_DOMAINS + ["mail.google.com"]

EXCLUDED_PATHS = ["github.com/issues", "github.com/pulls"]
CAPTURE_SKIPPED_PREFIXES = ["chrome://", "chrome-extension://", "https://www.youtube.com/"]
VIDEO_URL_PATTERNS = ["youtube.com/watch?v=", "youtube.com/shorts/"]

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref", "_hsenc", "mc_eid", "yclid",
]

# --- fixed values: text cleaning --------------------------------------------
SNIPPET_CHARS = 500
MAIN_CONTENT_MIN_CHARS = 200
MAIN_CONTENT_MAX_CHARS = 12_000
SIGNATURE_TAIL_LINES = 6

SIGNATURE_MARKERS = [
    "best regards", "thanks", "thank you", "regards", "warm regards",
    "kind regards", "cheers", "sincerely", "sent from my",
]
REPLY_HEADER_PATTERN = r"(?i)^on .+wrote:$"
EMAIL_ONLY_PATTERN = r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$"
NAME_ONLY_PATTERN = r"^[A-Za-z][A-Za-z .'-]{1,50}$"
PIXEL_PATTERN = (
    r"(?i)<img\b[^>]*(?:width=['\"]?1['\"]?|height=['\"]?1['\"]?"
    r"|display\s*:\s*none|visibility\s*:\s*hidden)[^>]*>"
)
PAGE_DROPPED_TAGS = ["script", "style", "noscript", "form", "button", "iframe", "svg"]
SCORED_NOISE_TAGS = [
    "script", "style", "noscript", "nav", "aside", "footer", "header", "form", "button", "svg",
]
SCORED_CANDIDATE_TAGS = ["article", "main", "section", "div", "body"]

# characters one by one: Java looks them up in a table, and compares ranges one after the other
TOKEN_PATTERN = f"[{ascii_letters}][{ascii_letters}{digits}_+-]{{2,}}"
KEYWORD_LIMIT = 8
MAIL_KEYWORD_LIMIT = 6
STOPWORDS = [
    "about", "after", "again", "been", "before", "being", "below", "between",
    "could", "does", "doing", "from", "have", "having", "into", "itself",
    "just", "more", "most", "other", "ours", "same", "should", "some", "such",
    "than", "that", "their", "theirs", "them", "then", "there", "these", "they",
    "this", "those", "through", "under", "until", "very", "what", "when", "where",
    "which", "while", "with", "would", "your", "yours", "subject", "http", "https",
    "www", "com", "mail", "reply", "forward", "video", "page",
]

CATEGORY_HINTS = {
    1: "film animation",
    2: "autos vehicles",
    10: "music",
    15: "pets animals",
    17: "sports",
    19: "travel events",
    20: "gaming",
    22: "people blogs",
    23: "comedy",
    24: "entertainment",
    25: "news politics",
    26: "howto style",
    27: "education learning tutorial",
    28: "science technology",
}

# --- fixed values: classification -------------------------------------------
PERSONAL_LABELS = ["CATEGORY_PERSONAL"]
BULK_LABELS = ["CATEGORY_PROMOTIONS", "CATEGORY_UPDATES", "CATEGORY_FORUMS"]
MAIL_STUDY_SUFFIXES = [".edu", ".ac.in", ".ac.uk"]
PAGE_STUDY_SUFFIXES = [".edu", ".ac.in"]
STUDY_CATEGORIES = [27, 28]
ENTERTAINMENT_CATEGORIES = [10, 24, 20, 23]
STRUCTURAL_CONFIDENCE = 1.0
DOMAIN_CONFIDENCE = 0.95
FALLBACK_METHOD = "llm"
FALLBACK_CONFIDENCE = 0.90
CENTROID_MIN_SCORE = 0.55
CENTROID_MIN_MARGIN = 0.08

WORK_DOMAINS = [
    "github.com", "gitlab.com", "bitbucket.org",
    "slack.com", "teams.microsoft.com", "discord.com",
    "jira.com", "asana.com", "monday.com", "trello.com",
    "notion.so", "confluence.atlassian.net",
    "outlook.office.com", "mail.google.com",
    "zoom.us", "meet.google.com", "whereby.com",
    "aws.amazon.com", "cloud.google.com", "azure.microsoft.com",
    "salesforce.com", "hubspot.com", "pipedrive.com",
    "figma.com", "adobe.com", "canva.com",
    "tableau.com", "power.bi", "metabase.com",
    "stripe.com", "square.com", "shopify.com",
]
ENTERTAINMENT_DOMAINS = [
    "youtube.com", "youtu.be",
    "netflix.com", "primevideo.com", "hulu.com", "disneyplus.com",
    "spotify.com", "music.apple.com", "soundcloud.com",
    "twitch.tv", "kick.com",
    "reddit.com", "9gag.com", "imgur.com",
    "tiktok.com", "instagram.com", "facebook.com",
    "twitter.com", "x.com",
    "pinterest.com", "tumblr.com",
    "steam.com", "epicgames.com", "playstation.com", "xbox.com",
    "roblox.com", "minecraft.net",
    "imdb.com", "rottentomatoes.com",
    "letterboxd.com", "goodreads.com",
]
# The group of each host the lookup knows.
HOST_GROUPS = {
    "study": [
        "geeksforgeeks.org", "stackoverflow.com", "leetcode.com", "hackerrank.com", "codewars.com",
        "coursera.org", "edx.org", "udacity.com", "udemy.com", "khan-academy.org",
        "khanacademy.org", "duolingo.com", "babbel.com", "rosettastone.com", "quizlet.com",
        "wikipedia.org", "scholar.google.com", "researchgate.net", "arxiv.org", "openreview.net",
        "dev.to", "hashnode.com", "freecodecamp.org", "codecademy.com", "datacamp.com",
        "pluralsight.com", "linkedin.com/learning", "w3schools.com", "mdn.mozilla.org",
        "developer.mozilla.org", "docs.microsoft.com", "cloud.google.com/docs",
        "aws.amazon.com/documentation", "python.org", "cplusplus.com", "cppreference.com",
        "rust-lang.org", "golang.org", "nodejs.org", "ruby-lang.org", "php.net", "swift.org",
        "kotlinlang.org", "scala-lang.org", "elixir-lang.org", "erlang.org", "haskell.org",
        "clojure.org", "numpy.org", "scipy.org", "matplotlib.org", "pandas.pydata.org",
        "scikit-learn.org", "tensorflow.org", "pytorch.org", "keras.io", "jupyter.org",
        "anaconda.com", "docker.com", "kubernetes.io", "mysql.com", "postgresql.org", "mongodb.com",
        "redis.io", "elasticsearch.org", "graphql.org", "restfulapi.net", "swagger.io",
        "openapi.tools", "git-scm.com", "svnbook.red-bean.com", "jenkins.io", "circleci.com",
        "travis-ci.org", "github.com/actions", "webpack.js.org", "rollupjs.org", "parceljs.org",
        "vitejs.dev", "nextjs.org", "nuxtjs.org", "reactjs.org", "vuejs.org", "angularjs.org",
        "angular.io", "svelte.dev", "ember.js", "backbonejs.org", "jquery.com", "jsfiddle.net",
        "codepen.io", "jsbench.me", "jsperf.com", "caniuse.com",
    ],
    "work": [
        "github.com", "gitlab.com", "bitbucket.org", "slack.com", "teams.microsoft.com",
        "discord.com", "jira.com", "asana.com", "monday.com", "trello.com", "notion.so",
        "confluence.atlassian.net", "outlook.office.com", "mail.google.com", "gmail.com", "zoom.us",
        "meet.google.com", "whereby.com", "aws.amazon.com", "cloud.google.com",
        "azure.microsoft.com", "salesforce.com", "hubspot.com", "pipedrive.com", "figma.com",
        "adobe.com", "canva.com", "tableau.com", "power.bi", "metabase.com", "stripe.com",
        "square.com", "shopify.com", "wistia.com", "vimeo.com", "airtable.com", "zapier.com",
        "ifttt.com", "integromat.com", "mailchimp.com", "sendgrid.com", "twilio.com",
        "intercom.com", "zendesk.com", "freshdesk.com", "serviceNow.com", "atlassian.net",
        "bitbucket.io",
    ],
    "entertainment": [
        "youtube.com", "youtu.be", "netflix.com", "primevideo.com", "hulu.com", "disneyplus.com",
        "spotify.com", "music.apple.com", "soundcloud.com", "twitch.tv", "kick.com", "reddit.com",
        "9gag.com", "imgur.com", "tiktok.com", "instagram.com", "facebook.com", "twitter.com",
        "x.com", "pinterest.com", "tumblr.com", "steam.com", "epicgames.com", "playstation.com",
        "xbox.com", "roblox.com", "minecraft.net", "imdb.com", "rottentomatoes.com",
        "letterboxd.com", "goodreads.com", "wattpad.com", "webtoon.com", "comixology.com",
        "crunchyroll.com", "funimation.com", "plex.tv", "peacocktv.com", "paramountplus.com",
        "appletv.apple.com", "hulumax.com", "max.hbo.com", "bandcamp.com", "deezer.com",
        "tidal.com", "youmusic.com", "pandora.com", "iheartradio.com", "radioparadise.com",
        "last.fm", "genius.com", "songkick.com", "eventbrite.com", "meetup.com", "4chan.org",
        "8kun.top", "mastodon.social", "pixiv.net", "danbooru.donmai.us", "deviantart.com",
        "artstation.com", "behance.net",
    ],
}

# --- fixed values: retrieval -------------------------------------------------
SEARCH_LIMIT = 1000
CANDIDATE_LIMIT = 5
KNN_K = 20
VECTOR_DIM = 384
EMBED_BATCH = 32
MAX_WIDEN_ATTEMPTS = 3
WIDEN_DAYS = 4
MIN_STRONG_RESULTS = 2
MIN_TOP_SIMILARITY = 0.35
HISTORY_MESSAGES = 10
MESSAGE_RETENTION_DAYS = 30
DEAD_RULE_DAYS = 30
QUERY_MAX_CHARS = 2000
RERANK_WEIGHTS = {"semantic": 0.40, "engagement": 0.30, "recency": 0.20, "effort": 0.10}
NO_HISTORY_TEXT = "(no prior conversation)"
NO_SUBJECT_TITLE = "(no subject)"
DEFAULT_MIME = "application/octet-stream"
EXTRACT_SEPARATOR = " | "
EXPORT_BODY_CHARS = 500
PLACEHOLDER_DIM_RANGE = (1, 1536)
INTENT_KEYS = [
    "sources", "time_filter", "fetch_attachment", "fetch_api", "query_clean",
    "scope_level", "is_ambiguous", "original_query", "skip_postgres_filter",
    "full_faiss_scan",
]
RULE_TYPES = ["keyword", "domain", "channel", "sender", "time_window"]
