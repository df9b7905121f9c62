"""Column expressions over free text: front matter, mail bodies, labels, log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters treated as white space, line breaks, mail headers, closings.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# White space inside a line, as a character class.
_BLANKS = r" \t\x1f\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\R|[\x1c-\x1e]"
WORD = r"[^\s\x1c-\x1f]+"
OPENING_HEADERS = ("to:", "subject:", "from:")
MAIL_HEADERS = ("to:", "subject:", "cc:", "bcc:", "from:")
CLOSINGS = ("best,", "warmly,", "thanks,", "sincerely,", "regards,", "best regards,")
QUOTED_SPANS = ('"[^"]*"', "'[^']*'", "“[^”]*”", "‘[^’]*’")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_dash(text: Column, dash: str = "--") -> Column:
    return F.coalesce(blank_to_null(text), F.lit(dash))


def fm_field(text: Column, key: str) -> Column:
    """First ``key: value`` line, surrounding quotes dropped; null when absent or empty."""
    value = F.regexp_extract(text, rf'(?m)^{key}: *"?([^"\n]*)', 1)
    return blank_to_null(F.rtrim(value))


def fm_list(text: Column, key: str) -> Column:
    """``key: [a, b]`` as an array; empty array when absent."""
    inner = F.regexp_extract(text, rf"(?m)^{key}: *\[([^\]\n]*)\]", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.btrim(x, F.lit(' "')))
    return F.filter(items, lambda x: x != "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), " ", "-"), "[^a-z0-9-]", "")


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---\n(?s:.*?\n)??---(?:\n|\z)", "")


def strip_canonical(text: Column) -> Column:
    """Drop self-declaration quote lines; only meant for text that had front matter."""
    return F.when(
        text.startswith("---\n"),
        F.regexp_replace(text, r"(?m)^> \*\*Canonical:\*\*.*(?:\n|\z)", ""),
    ).otherwise(text)


def strip_wikilinks(text: Column) -> Column:
    named = F.regexp_replace(text, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    return F.regexp_replace(named, r"\[\[([^\]]+)\]\]", "$1")


def snapshot_body(text: Column) -> Column:
    """Publishable body: no front matter, self-declaration or wiki links, no leading blanks."""
    body = strip_front_matter(strip_canonical(text))
    body = F.when(text.startswith("---\n"), F.regexp_replace(body, r"\A\s*\n", "")).otherwise(body)
    return strip_wikilinks(body)


def sync_header(old: Column, path: Column, as_of: str) -> Column:
    """Keep a customised header but bump its date; write the default one otherwise."""
    bumped = F.regexp_replace(old, r"last synced [0-9]{4}-[0-9]{2}-[0-9]{2}", f"last synced {as_of}")
    fresh = F.format_string(
        f"> **Canonical source:** `%s` - last synced {as_of}. Edit there; this file is a snapshot.", path
    )
    return F.when(old.startswith("> **Canonical source:**"), bumped).otherwise(fresh)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looks_like_mail(text: Column) -> Column:
    """A mail header opens one of the first eight lines; the rest of the text is not read."""
    line = r"[^\n\x0b\f\r\x85\x{2028}\x{2029}\x1c-\x1e]*+(?:" + LINE_BREAK + ")"
    heads = "|".join(OPENING_HEADERS)
    return text.rlike(rf"(?i)\A(?:{line}){{0,7}}[{_BLANKS}]*+(?:{heads})")


def extract_body(text: Column, signers: Sequence[str] = ()) -> Column:
    """Mail body without headers and signature; any other text comes back trimmed."""
    names = "|".join([*(s.lower() for s in signers), "$"])
    ends = rf"^(?:[-—]+\s*(?:{names})|(?:{'|'.join(CLOSINGS)})$)"
    heads = "^(?:" + "|".join(MAIL_HEADERS) + ")"

    def cut(kept: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda x: F.lower(strip(x)).rlike(ends)), True)
        return let(
            at.cast("int"),
            lambda i: strip(F.array_join(F.when(i > 0, F.slice(kept, F.lit(1), i - 1)).otherwise(kept), "\n")),
        )

    kept = F.filter(F.split(text, LINE_BREAK), lambda x: ~F.lower(strip(x)).rlike(heads))
    return F.when(looks_like_mail(text), let(kept, cut)).otherwise(strip(text))


def strip_quotes(text: Column) -> Column:
    """Blank out quoted spans, in fixed order; texts without an opening mark are left alone."""
    marked, clean = F.lit(False), text
    for span in QUOTED_SPANS:
        marked = marked | text.contains(F.lit(span[0]))
        clean = F.regexp_replace(clean, span, " ")
    return F.when(marked, clean).otherwise(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def word_total(text: Column) -> Column:
    """Words between white space of any script; plain text takes the cheaper ASCII class."""
    plain = F.regexp_count(text, F.lit(WORD))
    return F.when(is_ascii(text), plain).otherwise(F.regexp_count(text, F.lit("(?U)" + WORD))).cast("bigint")


def line_total(text: Column) -> Column:
    """Lines that hold more than white space."""
    lines = F.filter(F.split(text, LINE_BREAK), lambda x: strip(x) != "")
    return F.size(lines).cast("bigint")


def label(text: Column, width: int = 70) -> Column:
    return F.substring(text, 1, width)


def log_line(date: Column, status: Column, note: Column) -> Column:
    return F.format_string("- **%s** | %s | %s", date.cast("string"), status, note)


def take_parts(name: Column) -> Column:
    """``Client_Date_Participant_Take`` as a struct; take number is the trailing digits."""
    parts = F.split(name, "_")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("client"),
        F.try_element_at(parts, F.lit(2)).try_cast("date").alias("shot_on"),
        F.try_element_at(parts, F.lit(3)).alias("participant"),
        F.regexp_extract(name, r"([0-9]+)$", 1).try_cast("int").alias("take"),
    )


def daily_parts(line: Column) -> Column:
    """``date | body | state | residue`` as a struct."""
    parts = F.split(line, r"\s*\|\s*", 4)
    return F.struct(
        F.trim(F.try_element_at(parts, F.lit(1))).try_cast("date").alias("day"),
        F.try_element_at(parts, F.lit(2)).alias("body"),
        F.try_element_at(parts, F.lit(3)).alias("state"),
        F.try_element_at(parts, F.lit(4)).alias("residue"),
    )


def range_parts(text: Column) -> Column:
    """Money range such as ``$5K-50K`` or ``$1,500`` as low and high amounts."""
    clean = F.regexp_replace(F.upper(text), ",", "")
    numbers = F.regexp_extract_all(clean, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    units = F.regexp_extract_all(clean, F.lit(r"[0-9]+(?:\.[0-9]+)?([KM]?)"), F.lit(1))

    def amount(at: int) -> Column:
        unit = F.try_element_at(units, F.lit(at))
        scale = F.when(unit == "K", 1000).when(unit == "M", 1000000).otherwise(1)
        number = F.try_element_at(numbers, F.lit(at)).try_cast("decimal(12,2)")
        return (number * scale).cast("decimal(18,2)")

    return F.struct(
        amount(1).alias("low"),
        F.coalesce(amount(2), amount(1)).alias("high"),
    )


def replace_terms(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Swap every retired term for its replacement, in list order, ignoring case."""
    for dead, replacement in terms:
        text = F.regexp_replace(text, rf"(?iu)\Q{dead}\E", replacement.replace("$", r"\$"))
    return text


def term_hits(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    total = F.lit(0)
    for dead, _ in terms:
        total = total + F.regexp_count(text, F.lit(rf"(?iu)\Q{dead}\E"))
    return total.cast("bigint")
