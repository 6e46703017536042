"""Text functions as Column expressions; all stay in the JVM. Null in gives null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------------------------------
# Words that stand in nearly every document.
STOPWORDS = (
    "a an and are as at be but by did do does for from had has have how i if in is it its of on or our so than that the their "
    "then there these they this to was we were what when where which who why will with you your"
).split()
# Parts of directory names that say nothing about the project.
GENERIC_NAME_PARTS = (
    "bin build builds code debug dist final master new obj old out output project projects release repo repos source sources src target temp test tests tmp workspace"
).split()
GLOBAL_PROJECT = "__global__"
TERM_PATTERN = r"[A-Za-z0-9_./:@-]+"
MAX_TERMS = 16
CREDENTIAL_LINE = (
    r"(?i)(_KEY\s*[=:]|_TOKEN\s*[=:]|_SECRET\s*[=:]|PASSWORD\s*[=:]|bearer\s|\bsk-[A-Za-z0-9]|BEGIN [A-Z ]*PRIVATE KEY|x-shared-key|api[_-]?key\s*[=:])"
)
COMMAND_WRAPPERS = ("<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-caveat>", "<task-notification>", "<system-reminder>")
ROLLOUT_WRAPPERS = ("<app-context", "<recommended_plugins", "<environment_context")
HISTORY_PREFIXES = ("/", "[Pasted text", "[Image", "[Request interrupted")

# Every letter up to U+024F that decomposes into an ASCII letter and marks, with that letter.
_ACCENTED = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c) != c and unicodedata.normalize("NFD", c)[0].isascii()]
WHITE = " \t\n\r\f\v"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use refers to it inside lambdas of its own."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    plain = F.translate(F.lower(text), "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    return F.regexp_replace(plain, "[̀-ͯ]", "")


def index_tokens(text: Column) -> Column:
    """The tokens an index holds of a text: runs of letters and digits, folded. Null gives an empty array."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def raw_terms(query: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(TERM_PATTERN), F.lit(0))


def query_terms(query: Column, most: int = MAX_TERMS) -> Column:
    """The distinct terms of a query that carry meaning, in order, at most `most`."""
    trimmed = F.transform(raw_terms(query), lambda t: F.lower(F.btrim(t, F.lit(".:/-"))))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))), 1, most)


def match_terms(query: Column, most: int = MAX_TERMS) -> Column:
    """query_terms, or where none is left the raw terms in lower case, repeated ones and all."""
    kept = query_terms(query, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.transform(raw_terms(query), F.lower), 1, most))


def term_coverage(terms: Column, text: Column) -> Column:
    """The share of terms that occur in the lower-cased text as substrings; 0 without terms."""
    hits = bind(F.lower(text), lambda hay: F.size(F.filter(terms, lambda t: F.contains(hay, t))))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """About four characters a token, at least one; 0 for null and empty."""
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), (F.length(text) / 4).cast("int")))


def truncate_tokens(text: Column, most: int) -> Column:
    """At most `most` estimated tokens, an ellipsis in place of what is cut."""
    return F.when(F.length(text) <= most * 4, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most * 4 - 3))), F.lit("...")))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, without blanks, nulls and repeats, in order; null gives an empty array."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip(t)))
    return F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))


def slugify(text: Column, default: str = "device") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def collapse(text: Column, most: int = 400) -> Column:
    """White space runs as one blank, trimmed, at most `most` characters."""
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def scrub(text: Column) -> Column:
    """Without the lines that look like they carry a credential; null gives an empty text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    return strip(F.array_join(F.filter(lines, lambda x: ~x.rlike(CREDENTIAL_LINE)), "\n"))


def is_command_wrapper(text: Column) -> Column:
    head = F.ltrim(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for w in COMMAND_WRAPPERS:
        found = found | F.startswith(head, F.lit(w))
    return found


def is_rollout_wrapper(text: Column) -> Column:
    head = F.lower(F.substring(F.ltrim(F.coalesce(text, F.lit(""))), 1, 40))
    found = F.lit(False)
    for w in ROLLOUT_WRAPPERS:
        found = found | F.startswith(head, F.lit(w))
    return found


def is_history_noise(text: Column) -> Column:
    """Blank, a slash command or placeholder, or terminal output pasted back."""
    t = strip(F.coalesce(text, F.lit("")))
    found = (t == "") | F.contains(t, F.lit("password for ")) | (F.regexp_count(t, F.lit(r"\$ ")) > 3)
    for p in HISTORY_PREFIXES:
        found = found | F.startswith(t, F.lit(p))
    return found


def strip_file_uri(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit("file://")), F.substr(uri, F.lit(8))).otherwise(F.nullif(uri, F.lit("")))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def display_name(key: Column) -> Column:
    """The last part of a project key."""
    return F.substring_index(key, "/", -1)


def session_title(title: Column, session_id: Column, lead: str = "") -> Column:
    """The title, or the beginning of the id, with a lead where the index wants one."""
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit(lead), F.substring(session_id, 1, 8)))


def decision_source_id(title: Column) -> Column:
    return F.concat(F.lit("decision:"), F.substring(F.replace(F.lower(title), F.lit(" "), F.lit("-")), 1, 80))


def decision_content(content: Column, rationale: Column, supersedes: Column) -> Column:
    """The content and, where given, its rationale and what it supersedes, as paragraphs."""
    part = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    return F.concat_ws("\n\n", content, part("Rationale: ", rationale), part("Supersedes: ", supersedes))


def default_visibility(kind: Column, given: Column, recipient: Column) -> Column:
    return F.when(kind == "message", F.when(recipient.isNotNull(), "direct").otherwise("broadcast")).otherwise(F.coalesce(given, F.lit("shared")))


def json_list(text: Column) -> Column:
    """A JSON list of texts; anything else gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_or(text: Column, default: str) -> Column:
    """A JSON text as it is; the default where it is null, empty or no JSON."""
    return F.when(F.try_parse_json(F.nullif(text, F.lit(""))).isNotNull(), text).otherwise(F.lit(default))


# ---- projects -------------------------------------------------------------------------------------------------------
def normalize_remote(remote: Column) -> Column:
    """host/owner/repository in lower case for any way of writing a remote; null if it is none.

    Read step by step: the scheme goes, then the user before the host; the host ends at a slash, or without a scheme at a
    colon too, and loses its port; the path loses slashes at both ends and one .git.
    """

    def read(r: Column) -> Column:
        schemed = r.rlike(r"^[A-Za-z][\w+.-]*://.")
        rest = F.when(schemed, F.regexp_replace(r, "^[^:]*://", "")).otherwise(r)
        rest = F.regexp_replace(rest, "^[^@/]*[^@/]@", "")
        mark = F.when(schemed, F.instr(rest, F.lit("/"))).otherwise(F.length(F.regexp_extract(rest, "^[^:/]*[:/]", 0)))
        host = F.regexp_replace(F.substr(rest, F.lit(1), mark - 1), r":\d*$", "")
        path = F.btrim(F.regexp_replace(F.rtrim(F.substr(rest, mark + 1), F.lit("/")), r"\.git$", ""), F.lit("/"))
        return F.when((mark > 1) & (host != "") & (path != "") & ~F.contains(host, F.lit(":")), F.lower(F.concat(host, F.lit("/"), path)))

    return bind(strip(remote), read)


def derive_project(cwd: Column, repo_root: Column, remote: Column) -> Column:
    """The project key: the remote, else the repository's root, else the directory, else the global project.

    Looking for a repository is the client's matter; its findings come as columns.
    """
    return F.coalesce(
        F.when(F.nullif(repo_root, F.lit("")).isNotNull(), F.coalesce(normalize_remote(remote), F.concat(F.lit("path:"), repo_root))),
        F.concat(F.lit("path:"), F.nullif(cwd, F.lit(""))), F.lit(GLOBAL_PROJECT),
    )


def bare_key(key: Column) -> Column:
    """A project key without its scheme, with forward slashes and none at the end."""
    return F.rtrim(F.replace(F.regexp_replace(key, "^path:", ""), F.lit("\\"), F.lit("/")), F.lit("/"))


def search_seed(key: Column) -> Column:
    """The words of a project key's last part that tell it from others; all of them if none does."""
    parts = F.filter(F.split(F.substring_index(bare_key(key), "/", -1), r"[-_.\s]+"), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(GENERIC_NAME_PARTS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(parts), " ")


def path_denied(path: Column, deny: list[str]) -> Column:
    """Whether a path is one of the denied ones or below one; case and kind of slash do not count."""
    norm = lambda c: F.rtrim(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), F.lit("/"))
    p = norm(path)
    found = F.lit(False)
    for d in deny:
        q = norm(F.lit(d))
        found = found | (p == q) | F.startswith(p, F.concat(q, F.lit("/")))
    return F.coalesce(found, F.lit(False))


# ---- time and score -------------------------------------------------------------------------------------------------
def parse_ts(text: Column) -> Column:
    """An ISO text as an instant, UTC where it names no zone; null for anything else."""
    return F.try_to_timestamp(text)


def format_ts(text: Column, zone: str = "UTC") -> Column:
    """A timestamp for people, in their zone; - for null and empty ones, and what is no timestamp as it is."""
    at = parse_ts(text)
    local = F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("-")).when(at.isNull(), text).otherwise(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(f" {zone}")))


def epoch_autoscale(number: Column) -> Column:
    """Seconds or, beyond 1e11, milliseconds since 1970 as an instant."""
    return F.when(number > 1e11, F.timestamp_millis(number.cast("bigint"))).otherwise(F.timestamp_seconds(number))


def backoff_seconds(attempts: Column) -> Column:
    """30 seconds doubled with each failed attempt after the first, an hour at most."""
    return F.least(F.lit(3600.0), F.lit(30.0) * F.pow(F.lit(2.0), attempts - 1)).cast("bigint")


def recency(ts: Column, as_of: Column, half_life_days: float = 14.0) -> Column:
    """1 now, a half after each half-life; 1 for null and future instants and without a half-life."""
    if half_life_days <= 0:
        return F.lit(1.0)
    age = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86400e6)
    return F.when(ts.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life_days)))
