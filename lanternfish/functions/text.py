"""Text expressions: token estimates, Markdown line kinds, identifiers, prompts and redaction.

All but nfkc are column expressions that stay in the JVM. White space is ECMAScript's, which is wider than Java's ``\\s``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that ECMAScript's \s matches, for use inside a character class.
WS = "\t-\r    -     　﻿"
# What counts as a Latin word, a CJK character, and as neither.
LATIN_WORD = "[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?"
CJK = "[㐀-鿿]"
COUNTED = f"[A-Za-z0-9_{WS}㐀-鿿'-]"
# Markdown line kinds.
HEADING = f"^(#{{1,6}})[{WS}]+([^\n\r  ]+?)[{WS}]*#*[{WS}]*\\z"
LIST_ITEM = f"^(?:[-*+][{WS}]+|[0-9]+[.)][{WS}]+)"
BOLD_LABEL = f"^(?:(?:[-*+][{WS}]+|[0-9]+[.)][{WS}]+))?\\*\\*[^*\n]{{1,120}}:\\*\\*"
# Secrets to redact, in this order.
SECRETS = [
    f"-----BEGIN[A-Z ]*-----[A-Za-z0-9+/={WS}]+?(?:-----END[A-Z ]*-----|\\z)",
    "(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]*",
    f"(?i)(?<![A-Za-z0-9_])Bearer[{WS}]+[A-Za-z0-9._~+/=-]{{8,}}",
    "(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]+(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
    "(?<![A-Za-z0-9_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])xox[a-z]-[A-Za-z0-9-]{8,}",
    "(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{16,}(?![A-Za-z0-9_])",
    "(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{16,}(?![A-Za-z0-9_])",
    "(?<![A-Za-z0-9_])AIza[0-9A-Za-z_-]{30,}(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
    f"(?i)(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=-))[A-Za-z0-9_-]*(?:token|secret|password|passwd|pwd|credential|apikey|api[-_]key|private[-_]?key|authorization)[A-Za-z0-9_-]*[{WS}]*[:=][{WS}]*[^{WS}]+",
]
#: In lower case, every match of a secret's pattern has one of these.
SECRET_MARKS = "-----begin|eyj|bearer|sk-|akia|asia|xox|gh[pousr]_|github_pat_|aiza|token|secret|passw|pwd|credential|api[-_]?key|private[-_]?key|authorization"
# Prompts that the scheduler sends, not a person.
ROUTINE = ["(?i)heartbeat check", f"(?i)^[{WS}]*(meanwhile,[{WS}]*)?context usage at", f"(?i)^[{WS}]*\\[?scheduled task"]
# The envelope of a chat message: the message itself, and what else stands around it.
CURRENT_MESSAGE = f"(?is)<current-message>[{WS}]*(.*?)[{WS}]*</current-message>"
ENVELOPE = [
    f"(?is)(?:^|\n)[{WS}]*----[{WS}]*reply via:[{WS}]*node[{WS}]+.*\\z",
    "(?is)<replying-to>.*?</replying-to>",
    f"(?is)^[{WS}]*\\[[^\\]]+\\][{WS}]+.*?(?<![A-Za-z0-9_])said:[{WS}]*",
]
# Keys of a prompt in a JSON request, in order of preference.
PROMPT_KEYS = ["prompt", "userPrompt", "message", "input", "text"]
# The date of a fixture that states none.
FIXTURE_DATE = "2026-01-01"
# A citation in an assembled context.
CITED = f"\\[([^\\]\n]+?)[{WS}]+·[{WS}]+([^\\]\n]+?)\\]"
TRUNCATED = "\n[truncated; read source file for full chunk]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def token_parts(text: Column) -> dict[str, Column]:
    """Latin words, CJK characters and the length of the rest: sums over texts joined by white space."""
    return {
        "latin": F.regexp_count(text, F.lit(LATIN_WORD)).cast("bigint"),
        "cjk": F.regexp_count(text, F.lit(CJK)).cast("bigint"),
        "rest": utf16_length(F.regexp_replace(text, COUNTED, "")),
    }


def token_sum(latin: Column, cjk: Column, rest: Column) -> Column:
    return latin + cjk + F.floor((rest + 2) / 3)


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text, estimated; none for null."""
    parts = token_parts(F.coalesce(text, F.lit("")))
    return token_sum(parts["latin"], parts["cjk"], parts["rest"])


def slugify(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[`*_~\[\]()]", "")
    slug = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+\z", "")
    return F.when(slug == "", "root").otherwise(slug)


def heading_text(line: Column) -> Column:
    return trim(F.regexp_extract(line, HEADING, 2))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def is_bold_label(line: Column) -> Column:
    return line.rlike(BOLD_LABEL)


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{WS}]")


def needs_split(tokens: Column, list_items: Column, bold_labels: Column, target: int, most: int) -> Column:
    return (tokens > most) | ((bold_labels >= 2) & (list_items >= 3)) | ((list_items >= 3) & (tokens > target))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(source: Column, slug: Column, occurrence: Column, part: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, slug, occurrence.cast("string"), part.cast("string")), 256), 1, 16)


def infer_type(relative: Column) -> Column:
    """Tier of a file from the first folders of its path."""
    out = F.lit("doc")
    # Folders by tier.
    for start, tier in ((".claude/skills/", "skill"), ("http/public/pages/", "page"), ("memory/users/", "memory"), ("memory/reference/", "memory"), ("memory/sessions/", "session")):
        out = F.when(relative.startswith(start), tier).otherwise(out)
    return out


def infer_date(path: Column, mtime_ms: Column) -> Column:
    """The first date in a path, else the UTC day of the modification time."""
    found = F.regexp_extract(path, r"(?<![A-Za-z0-9_])(20[0-9]{2}-[0-9]{2}-[0-9]{2})(?![A-Za-z0-9_])", 1)
    return F.coalesce(F.nullif(found, F.lit("")), day_of(mtime_ms))


def day_of(mtime_ms: Column) -> Column:
    """UTC day of milliseconds since 1970, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(mtime_ms / 86_400_000).cast("int")).cast("string")


def fixture_date(text: Column) -> Column:
    """The date that a fixture's text states, in a line of its own or as "dated ...", else the default."""
    day = "20[0-9]{2}-[0-9]{2}-[0-9]{2}"
    line = F.regexp_extract(text, f"(?i)(?:^|[\n\r])[{WS}]*date:[{WS}]*({day})[{WS}]*(?:[\n\r]|\\z)", 1)
    prose = F.regexp_extract(text, f"(?i)(?<![A-Za-z0-9_])dated[{WS}]+({day})(?![A-Za-z0-9_])", 1)
    return F.coalesce(F.nullif(line, F.lit("")), F.nullif(prose, F.lit("")), F.lit(FIXTURE_DATE))


def noon_ms(date: Column) -> Column:
    """Milliseconds of noon UTC of a date."""
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000 + 43_200_000


def truncate(text: Column, tokens: Column, most: int) -> Column:
    """A text of up to so many tokens as it is, else its first so many words and a note."""
    kept = F.filter(F.split(text, f"[{WS}]+"), lambda w: w != F.lit(""))
    return F.when(tokens <= most, text).otherwise(F.concat(F.array_join(F.slice(kept, 1, most), " "), F.lit(TRUNCATED)))


def citation(source: Column, date: Column, tier: Column, text: Column) -> Column:
    note = F.when(tier == "session", " · session log — may be superseded").otherwise("")
    return F.concat(F.lit("["), source, F.lit(" · "), date, note, F.lit("] "), text)


def cited_sources(block: Column) -> Column:
    """Sources and dates of all citations in a block, as an array of (source, date)."""
    pattern = F.lit(CITED)
    pairs = F.arrays_zip(F.regexp_extract_all(block, pattern, F.lit(1)).alias("source"), F.regexp_extract_all(block, pattern, F.lit(2)).alias("date"))
    return F.transform(pairs, lambda x: F.struct(x["source"].alias("source"), x["date"].alias("date")))


def redact(text: Column) -> Column:
    """One line without secrets, cut to 200 characters after the redaction; texts without a mark skip the patterns."""

    def cleaned(line: Column) -> Column:
        out = line
        for pattern in SECRETS:
            out = F.regexp_replace(out, pattern, "[redacted]")
        return F.when(F.lower(line).rlike(SECRET_MARKS), out).otherwise(line)

    compact = trim(F.regexp_replace(text, f"[{WS}]+", " "))
    return F.substring(F.element_at(F.transform(F.array(compact), cleaned), 1), 1, 200)


def current_message(text: Column) -> Column:
    """The body of the first current-message element, null without one."""
    return F.when(text.rlike(CURRENT_MESSAGE), trim(F.regexp_extract(text, CURRENT_MESSAGE, 1)))


def normalize_prompt(text: Column) -> Column:
    """What a person asked, without the envelope of the message."""
    t = bare = trim(F.coalesce(text, F.lit("")))
    for pattern in ENVELOPE:
        bare = trim(F.regexp_replace(bare, pattern, ""))
    return F.coalesce(current_message(t), bare)


def python_pattern(pattern: str) -> str:
    """A pattern of this module as Python's own engine reads it."""
    return pattern.replace("\\z", "\\Z")


def clean_prompt(text: Column) -> Column:
    """As normalize_prompt, for transcripts: tails go from an extracted body too."""
    t = F.coalesce(current_message(text), text)
    t = F.regexp_replace(t, f"(?is)[{WS}]*----[{WS}]*(reply|ack) via:.*\\z", "")
    return trim(F.regexp_replace(t, f"(?i)^[{WS}]*\\[[^\\]]+\\][{WS}]+[^\n]*?(?<![A-Za-z0-9_])said:[{WS}]*", ""))


def is_substantive(text: Column) -> Column:
    t = trim(F.coalesce(text, F.lit("")))
    out = ~((utf16_length(t) < 12) & (F.regexp_count(t, F.lit(LATIN_WORD)) < 3))
    for pattern in ROUTINE:
        out = out & ~t.rlike(pattern)
    return out


def extract_prompt(raw: Column) -> Column:
    """The prompt of a JSON request, or the raw text where it is no JSON object."""
    t = trim(F.coalesce(raw, F.lit("")))
    found = F.coalesce(*[F.nullif(F.get_json_object(t, f"$.{k}"), F.lit("")) for k in PROMPT_KEYS], F.lit(""))
    return F.when(F.try_parse_json(t).isNotNull(), trim(found)).otherwise(t)


def _folded() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and their base letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and len(parts[0]) == 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics."""
    marked, base = _folded()
    return F.lower(F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), marked, base))


def tokens(text: Column) -> Column:
    """Index tokens in order: runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def nfkc(text: Column) -> Column:
    """Compatibility forms composed, which no expression can do: for the texts of queries."""

    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(normal, T.StringType())(text)


def query_terms(text: Column) -> Column:
    """Distinct terms of a query, ignoring case, the first spelling kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def match_expression(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def normalize_source(source: Column) -> Column:
    return F.when(source.startswith("corpus/"), source).otherwise(F.concat(F.lit("corpus/"), source))
