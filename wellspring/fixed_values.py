"""Fixed values.

FIXED VALUES: these must equal the original application's values exactly for
results to match (keyword lists, lookup tables, default settings, patterns and
message texts).  They are listed plainly, in the application's own order.
Keyword lists are defaults; every operator that uses one takes it as a
parameter.
"""

# --- FIXED VALUES -----------------------------------------------------------

# Crisis phrases, matched as plain substrings of the lower-cased message.
CRISIS_KEYWORDS = [
    "kill myself", "kill somebody", "suicidal", "end it all", "can't go on",
    "want to die", "hurt myself", "ending my life", "self harm", "overdose",
]

# Text shown when a crisis phrase matches; the hotline is appended.
CRISIS_RESPONSE_PREFIX = (
    "I'm concerned about your safety. You are not alone. "
    "If you're in crisis, please call your local support line: "
)
# Hotline text used when the user has no country set.
HOTLINE_FALLBACK = "a local support number"
# Hotline text used when the country is not in the table.
HOTLINE_UNKNOWN = "N/A"
# The client marks a reply as a crisis reply when it contains this text.
CRISIS_MARKER = "if you're in crisis"

# Theme keywords in declared order (ties keep this order).
THEME_KEYWORDS = ["stress", "work", "family", "anxiety", "tired"]

# Crisis hotlines by upper-case country code.
HOTLINES = [
    ("US", "988"),
    ("AU", "13 11 14"),
    ("CA", "1-833-456-4566"),
    ("UK", "116 123"),
    ("FR", "01 45 39 40 00"),
    ("DE", "0800 111 0 111"),
    ("JP", "03-5286-9090"),
    ("IN", "91-22-2754-6669"),
    ("NZ", "1737"),
    ("SG", "1-767"),
    ("IE", "116 123"),
]

# Personas and their system prompts, seeded when the persona table is empty.
PERSONAS = [
    ("CBT", "You are a compassionate Cognitive Behavioural Therapist (CBT). Your role is to help the user understand, challenge, and reframe negative thoughts. Ask open, reflective questions. Use a calm, structured tone. Avoid giving direct advice — guide them to discover insights. Encourage journaling, thought records, and identifying thinking distortions."),
    ("DEMO", "This is DEMO Mode. You have limited messages and a less personal experience however you are still a compassionate Cognitive Behavioural Therapist (CBT). Your role is to help the user understand, challenge, and reframe negative thoughts. Ask open, reflective questions. Use a calm, structured tone. Avoid giving direct advice — guide them to discover insights. Encourage journaling, thought records, and identifying thinking distortions."),
    ("DBT", "You are a Dialectical Behaviour Therapist (DBT). You balance empathy and change. Use language that validates the user's emotions while encouraging healthy coping skills. Help the user manage distress, identify emotional triggers, and practice mindfulness. Be warm, clear, and nonjudgmental."),
    ("Reflective", "You are a calm and present reflective listener. Your job is to echo back what the user says to help them feel heard and gain clarity. Use paraphrasing and gentle questions like “Is that how you’re feeling?” Avoid giving advice or interpretations unless explicitly asked."),
    ("Casual Chat", "You are a friendly, empathetic companion. Your job is to offer emotional support, casual conversation, and a safe space. You can use humour, emojis, or slang if appropriate. Listen attentively and respond like a trusted friend — no therapy or deep guidance needed unless asked for."),
    ("Life Coach", "You are a confident and encouraging life coach. Help the user set goals, explore obstacles, and stay motivated. Use action-oriented language. Ask forward-focused questions like “What’s one small step you can take today?” Validate the user’s strengths. Keep energy upbeat but grounded."),
]
# Persona names the picker hides (compared lower-cased) and the default one.
PICKER_HIDDEN = ["demo", "casual"]
PICKER_DEFAULT = "cbt"
# Session name and persona of the casual chat.
CASUAL_SESSION = "Casual"
CASUAL_PERSONA = "Casual Chat"

# Settings written for every new user, in insert order.
NEW_USER_SETTINGS = [
    ("model", "gpt-3.5-turbo"),
    ("typing_delay", "1000"),
    ("voice", "en-US"),
    ("msg_retention", "50"),
    ("theme", "default"),
    ("summary_count", "100"),
]
# Application defaults from the shipped properties file.
APP_DEFAULTS = [
    ("model", "gpt-4o"),
    ("typing_delay", "150"),
    ("summary_count", "100"),
    ("voice", "demo"),
    ("theme", "earthy"),
]
# Properties key renamed on load, and the fallback summary_count.
PROPERTIES_RENAME = ("msg_retention", "summary_count")
SUMMARY_COUNT_FALLBACK = "100"

# Subscription plans and billing cycles.
PLANS = ["basic", "professional", "premium"]
BILLING_CYCLES = ["monthly", "yearly"]
PAYMENT_STATUSES = ["pending", "paid", "failed"]
ROLES = ["user", "assistant", "system"]

# Mood score for the chart; any other mood scores 1.
MOOD_SCORES = [("happy", 2.0), ("neutral", 1.0), ("sad", 0.0), ("anxious", 0.5), ("angry", -1.0)]
MOOD_SCORE_DEFAULT = 1.0
# Mood icon; any other mood shows a question mark.
MOOD_ICONS = [("happy", "😊"), ("neutral", "😐"), ("sad", "😟"), ("anxious", "😕"), ("angry", "😠")]
MOOD_ICON_DEFAULT = "❓"

# Email check: anchored at the start only (Python re.match).
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+"
# Phone number in a crisis reply (first match); whitespace is then removed.
PHONE_PATTERN = r"(\+?\d[\d\s\-().]{7,})"

# Password-reset limiter defaults.
RESET_MAX_REQUESTS = 3
RESET_WINDOW_MINUTES = 15
RESET_TOKEN_HOURS = 1

# Summaries: trigger threshold and request texts.
SUMMARY_TRIGGER_DEFAULT = 10
SUMMARY_FIRST_TEXT = "Summarise the following conversation in 1–2 sentences, focusing on the user's emotional themes."
SUMMARY_UPDATE_TEXT = 'The previous summary was: "{previous}". Update or extend it based on the following new messages.'
SUMMARY_CLOSE_TEXT = "Provide a concise updated summary."
SUMMARY_SO_FAR_TEXT = "Summary so far: {summary}"

# Journal reflection request.
REFLECTION_EMPTY_TEXT = "No journal entries found for this period."
REFLECTION_SYSTEM_TEXT = "You are a gentle, empathetic mental health assistant who summarizes journals with care and insight."
REFLECTION_USER_TEXT = "Summarize the following journal entries and offer a gentle reflection:\n\n{entries}"
REFLECTION_LAST_N = 10
INSIGHT_WINDOWS = [7, 30, 90]

# Profile intro sentence parts.
INTRO_NAME = "My name is {username}."
INTRO_AGE = " I am {age} years old."
INTRO_SEX = " I am {sex}."
INTRO_BIO = " A bit about me: {bio}"

# Model name prefixes and the route each selects.
MODEL_ROUTES = [("claude", "claude"), ("ollama:", "ollama"), ("gpt-", "openai")]
MODEL_ROUTE_OTHER = "unsupported"

# Time-of-day buckets by hour: [5, 12) morning, [12, 18) afternoon, else evening.
DAYPARTS = [(5, 12, "morning"), (12, 18, "afternoon")]
DAYPART_OTHER = "evening"

# First-messages page size and default session-name prefix.
SESSION_PAGE_SIZE = 20
SESSION_NAME_PREFIX = "session-"

# Request gate: protected and public paths, public prefixes.
PROTECTED_PATHS = ["/profile", "/settings", "/journal", "/api/chat", "/insights"]
PUBLIC_PATHS = ["/", "/signin", "/signup_with_plan", "/subscribe", "/verify_email", "/resend_verification",
                "/forgot_password", "/reset_password", "/about", "/terms", "/privacy", "/faq",
                "/contact", "/debug"]
PUBLIC_PREFIXES = ["/static/", "/api/public/"]

# --- end of fixed values ----------------------------------------------------
