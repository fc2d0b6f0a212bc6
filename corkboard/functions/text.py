"""Text, name, citation and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words, token, tag and link patterns that results depend on.
STOPWORDS = """
about after again against also among and are because been before being between both but can could did does doing down each
for from further had has have her here hers him his how into its itself just more most not now off once only other our ours
out over own same she should some such than that the their theirs them then there these they this those through too under
until very was were what when where which while who why will with would you your yours anything application below change
check copy current development document file high index infra language launch manifest_only notes page practical source text
tier txt version working
""".split()
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_'’-]{1,}"
WIKILINK = r"(?<!!)\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
MARKDOWN_LINK = r"(?<!!)\[[^\]]+\]\(([^)]+)\)"
TAG = r"(?<![\w/#])#([A-Za-z][A-Za-z0-9_/-]*)"
INLINE_CODE = r"(`+)(.*?)\1"
UNSAFE = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\u200B-\u200F\u2028-\u202E\u2066-\u2069\uFEFF]"
PASSAGE = 500


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens in order, with those that `tokens` leaves out."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))


#: Numbers, runs with four digits at least, and hexadecimal runs of eight at least, hyphens and underscores aside.
NO_TOKEN = r"^[0-9]+$|(?:[0-9][^0-9]*){4}|^[-_]*(?:[0-9a-f][-_]*){8,}$"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, without stop words, short ones, numbers, ids and hexadecimal runs."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS) & ~t.rlike(NO_TOKEN))


def name_key(value: Column) -> Column:
    """A note name for look-ups: base name without .md, lower-cased, other than a-z and 0-9 as one space."""
    base = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(value, r"\\", "/")), r"(?i)\.md$", ""), "^.*/", "")
    return F.trim(F.regexp_replace(F.lower(base), "[^a-z0-9]+", " "))


def unquoted(value: Column) -> Column:
    """Percent escapes decoded; a bad escape leaves the whole undecoded."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(value, r"\+", "%2B")), value)


def link_target(value: Column) -> Column:
    """What a link names: decoded, slashes forward, without a fragment."""
    return F.regexp_replace(F.trim(F.regexp_replace(unquoted(value), r"\\", "/")), "#.*$", "")


def normal_path(value: Column) -> Column:
    """The path without empty and `.` parts, each `..` taken with the part before it; `..` stay where there is none, but for
    a path from the root. An empty one is `.`."""
    root = value.startswith("/")

    def step(s: Column, p: Column) -> Column:
        up = F.when(F.size(s) == 0, F.when(root, s).otherwise(F.array(p))).when(F.element_at(s, -1) == "..", F.concat(s, F.array(p))).otherwise(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        return F.when((p == "") | (p == "."), s).when(p == "..", up).otherwise(F.concat(s, F.array(p)))

    parts = F.aggregate(F.split(value, "/"), F.array().cast("array<string>"), step)
    plain = (value != "") & ~value.rlike(r"(^|/)\.{0,2}(/|$)")  # without a part to take away
    return F.when(plain, value).otherwise(F.when((F.size(parts) == 0) & ~root, ".").otherwise(F.array_join(parts, "/")))


def path_key(value: Column) -> Column:
    """A path for look-ups: percent-decoded, no fragment or .md, normalised, from the top, lower-cased."""
    return F.lower(normal_path(F.regexp_replace(link_target(value), r"(?i)\.md$", "")))


def valid_tag(tag: Column) -> Column:
    """Neither `include` nor a colour code."""
    return (F.lower(tag) != "include") & ~F.element_at(F.split(tag, "/"), -1).rlike("^[0-9A-Fa-f]{3,8}$")


def wikilinks(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(line, INLINE_CODE, " "), F.lit(WIKILINK), F.lit(1)), lambda t: F.trim(t))


def link_destination(raw: Column) -> Column:
    """What is between a Markdown link's parentheses, without its title and angle brackets."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"\s+[\"'].*$", ""), r"^<|>$", "")


def markdown_links(line: Column) -> Column:
    """Targets of links to notes: no scheme, and no suffix but .md."""
    raw = F.regexp_extract_all(F.regexp_replace(line, INLINE_CODE, " "), F.lit(MARKDOWN_LINK), F.lit(1))
    bare = F.transform(raw, link_destination)
    return F.filter(bare, lambda t: ~t.contains("://") & (F.regexp_replace(t, "#.*$", "") != "") & (~F.regexp_replace(t, "#.*$", "").rlike(r"\.[A-Za-z0-9]+$") | F.regexp_replace(t, "#.*$", "").rlike(r"(?i)\.md$")))


def inline_tags(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(line, INLINE_CODE, " "), MARKDOWN_LINK, " ")
    return F.filter(F.regexp_extract_all(plain, F.lit(TAG), F.lit(1)), valid_tag)


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def excerpt(text: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis where cut."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(text)


def passage(text: Column) -> Column:
    """The first PASSAGE characters without spaces at their end, and an ellipsis besides where cut."""
    return F.concat(F.regexp_replace(F.substring(text, 1, PASSAGE), r"\s+$", ""), F.when(F.length(text) > PASSAGE, "…").otherwise(""))


def sanitised(text: Column) -> Column:
    """Line ends as line feeds; no control, zero-width or direction characters but tab and line feed."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), UNSAFE, "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(sanitised(text), r"\s+", " "))


def json_length(text: Column) -> Column:
    """Characters of the text as a JSON string in ASCII, quotes included."""
    short = F.regexp_count(text, F.lit(r"[\"\\\n\r\t\x08\x0C]"))
    escaped = F.regexp_count(text, F.lit(r"[^ -~\n\r\t\x08\x0C\x{10000}-\x{10FFFF}]"))
    pairs = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return 2 + F.length(text) + short + 5 * escaped + 11 * pairs


def fence(text: Column) -> Column:
    """A run of back-ticks longer than any in text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda t: F.length(t))), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def tf(count: Column) -> Column:
    return F.log(count.cast("double")) + 1


# What a document's texts may not have, and the form of its timestamps and digests.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
IGNORABLE = r"[\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0\uFFF0-\uFFF8\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
TIMESTAMP = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?(Z|[+-]\d{2}:\d{2})\z"
SHA256 = r"^[0-9a-f]{64}\z"


def safe_text(text: Column) -> Column:
    """At most 1000 characters without controls (tab and line ends stay) and characters that aren't shown."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, CONTROLS, ""), IGNORABLE, ""), 1, 1000)


def safe_label(text: Column) -> Column:
    return F.regexp_replace(safe_text(text), r"[\t\r\n\u2028\u2029]+", " ")


def safe_identifier(text: Column) -> Column:
    return F.regexp_replace(safe_text(text), r"[\t\r\n\u2028\u2029]+", "")


def safe_hash(text: Column) -> Column:
    """The SHA-256 digest in lower case; null for what is none."""
    bare = F.lower(F.trim(text))
    return F.when(bare.rlike(SHA256), bare)


def utc_micros(text: Column) -> Column:
    """Microseconds since 1970 of a timestamp with its offset from UTC; null for other forms, days and times that aren't, more digits
    than microseconds have, and years outside 1000 to 9999, before and after the offset is taken off."""
    part = [F.regexp_extract(text, TIMESTAMP, i) for i in range(9)]
    year, month, day, hour, minute, second = (part[i].try_cast("int") for i in range(1, 7))
    date = F.concat(part[1], F.lit("-"), part[2], F.lit("-"), part[3]).try_cast("date")
    sign = F.when(part[8].startswith("-"), -1).otherwise(1)
    off_hour, off_minute = (F.coalesce(F.substring(part[8], a, 2).try_cast("int"), F.lit(0)) for a in (2, 5))
    ok = text.rlike(TIMESTAMP) & (year >= 1000) & (hour <= 23) & (minute <= 59) & (second <= 59) & (off_hour <= 23) & (off_minute <= 59)
    seconds = F.date_diff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + hour * 3_600 + minute * 60 + second - sign * (off_hour * 60 + off_minute) * 60
    told = seconds * 1_000_000 + F.coalesce(F.rpad(part[7], 6, "0").try_cast("long"), F.lit(0))
    return F.when(ok & told.between(-30_610_224_000_000_000, 253_402_300_799_999_999), told)  # the years 1000 to 9999
