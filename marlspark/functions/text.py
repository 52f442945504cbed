"""Texts as column expressions. White space is Unicode's, as in `(?U)\\s`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"

#: Quotes and dashes and what stands for them.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "′": "'", "″": '"', "«": '"', "»": '"'}
DASHES = {"–": "-", "—": "-", "―": "-", "−": "-"}
#: News services, by where they are looked for.
WIRES = ("reuters", "ap news", "associated press", "bloomberg", "afp", "agence france-presse")
WIRE_SERVICES = ("reuters", "associated press", "bloomberg", "agence france-presse")


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_query(q: Column, unicode: bool = True) -> Column:
    """Trimmed, NFKC (in Python, and only where a query isn't ASCII), lower-cased, plain quotes and dashes, single spaces."""
    t = F.regexp_replace(q, r"(?U)^\s+|\s+$", "")
    if unicode:
        t = F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(F.pandas_udf(_nfkc, "string")(F.when(~t.rlike(r"^\p{ASCII}*$"), t)))
    marks = QUOTES | DASHES
    t = F.translate(F.lower(t), "".join(marks), "".join(marks.values()))
    return F.trim(F.regexp_replace(t, SPACES, " "))


def words(t: Column) -> Column:
    return F.filter(F.split(t, SPACES), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s) != "")


def normalize_text(t: Column) -> Column:
    """Single spaces, no zero-width characters or no-break spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[​﻿]", ""), " ", " "), SPACES, " "))


def html_content_hash(html: Column) -> Column:
    """SHA-256 of the page without script, style, comments and advertisement blocks, white space collapsed."""
    t = F.coalesce(html, F.lit(""))
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"""(?is)<div[^>]*class=["'][^"']*\b(?:ad|advertisement|advert|sponsored)\b[^"']*["'][^>]*>.*?</div>"""):
        t = F.regexp_replace(t, p, "")
    return F.sha2(F.trim(F.regexp_replace(t, SPACES, " ")), 256)


def remove_orphaned_hyphens(t: Column) -> Column:
    return F.array_join(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "-"), "\n")


def normalize_line_breaks(t: Column, source: str = "html") -> Column:
    """At most one empty line in a row; in texts from PDF files two stay, and only more become one."""
    return F.regexp_replace(t, r"\n{4,}" if source == "pdf" else r"\n{3,}", "\n\n")


def remove_wiki_edit_markers(t: Column) -> Column:
    return F.regexp_replace(t, r"(?i)\[(edit|citation needed|source)\]", "")


def remove_excessive_whitespace(t: Column) -> Column:
    """Single blanks inside lines, trimmed lines."""
    return F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")


def clean_wikipedia_tables(t: Column) -> Column:
    """Pairs of lines `|key` and `|value` become `key: value`; an odd last one keeps its text. Linear: cells are trimmed line by line, and one pattern pairs them from the first bar of a run on."""
    done = "\uffff"  # no character; keeps a pair whose key begins with a bar from being taken again
    cell = lambda x: F.when(F.trim(x).startswith("|"), F.concat(F.lit("|"), F.trim(F.regexp_replace(F.trim(x), r"^\|", "")))).otherwise(x)
    bars = F.array_join(F.transform(F.split(t, "\n"), cell), "\n")
    paired = F.regexp_replace(bars, r"(?dm)^\|(.*)\n\|(.*)$", f"{done}$1: $2")
    return F.regexp_replace(F.regexp_replace(paired, r"(?dm)^\|", ""), f"(?dm)^{done}", "")


def clean_extracted_text(t: Column, source: str = "html") -> Column:
    """The whole cleaning, in order; tables only occur in pages."""
    if source == "html":
        t = F.when(F.contains(t, F.lit("|")), clean_wikipedia_tables(t)).otherwise(t)
        t = remove_wiki_edit_markers(t)
    return F.trim(normalize_line_breaks(remove_excessive_whitespace(remove_orphaned_hyphens(t)), source))


def clean_for_display(t: Column, most: int = 500) -> Column:
    c = clean_extracted_text(t)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def clean_for_embedding(t: Column) -> Column:
    return F.trim(F.regexp_replace(clean_extracted_text(t), SPACES, " "))


def join_broken_lines(t: Column) -> Column:
    """Lines joined until one ends a sentence (.!?;:); an empty line ends a paragraph."""
    lines = F.regexp_replace(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"), r"^\n+|\n+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"(?<![.!?;:\n])\n(?!\n)", " "), r"\n+", "\n")


def sample_text(t: Column, start: int = 5000, middle: int = 3000, end: int = 2000) -> Column:
    """A long text's start, middle and end under banners; a short one as it is."""
    n = F.length(t)
    mid = F.floor(n / 2).cast("int") - middle // 2
    parts = F.concat(
        F.lit("[START]\n"), F.substring(t, 1, start), F.lit("\n[MIDDLE]\n"), F.substring(t, mid + 1, F.lit(middle)), F.lit("\n[END]\n"), F.substring(t, (n - end + 1).cast("int"), F.lit(end)),
    )
    return F.when(n <= start + middle + end, t).otherwise(parts)


#: First letters that scanning loses, and the words meant.
OCR_FIXES = {
    "rganizations": "Organizations", "rganization": "Organization", "rganizing": "Organizing", "rganized": "Organized", "pportunity": "Opportunity",
    "pportunities": "Opportunities", "perations": "Operations", "peration": "Operation", "nformation": "Information", "mportant": "Important",
    "mplementation": "Implementation", "nnovation": "Innovation", "ntegration": "Integration",
}


def clean_block(t: Column) -> Column:
    """Lines of a sentence joined, a lost first letter of the first word (bullets aside) put back, single spaces."""
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "([a-z])\n(?=[a-z])", "$1 "), SPACES, " "))
    first = F.substring_index(t, " ", 1)
    bare = F.regexp_replace(first, "^[•*→-]+", "")
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in OCR_FIXES.items() for x in kv]), bare)
    lead = F.substring(first, F.lit(1), F.length(first) - F.length(bare))
    return F.when(fixed.isNotNull(), F.concat(lead, fixed, F.substring(t, F.length(first) + 1, F.length(t)))).otherwise(t)


def is_artifact(t: Column) -> Column:
    """Two characters or fewer, or a number of up to four digits."""
    s = F.trim(t)
    return (F.length(s) <= 2) | s.rlike("^[0-9]{1,4}$")


def wire_hits(t: Column, services: tuple[str, ...] = WIRE_SERVICES) -> Column:
    head = F.lower(F.substring(t, 1, 500))
    return sum((F.contains(head, F.lit(s)).cast("int") for s in services), F.lit(0))


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: inside a lambda function an expression is evaluated anew for every element."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def shingles(t: Column, size: int = 5) -> Column:
    """Distinct runs of `size` words of the lower-cased text."""
    none = F.array().cast("array<string>")

    def runs(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " ")))).otherwise(none)

    return let(words(F.lower(t)), runs)


def highlight(t: Column, start: Column, end: Column) -> Column:
    """The text with `<highlight>` around characters start to end (from 0, end exclusive)."""
    return F.concat(F.substring(t, F.lit(1), start), F.lit("<highlight>"), F.substring(t, start + 1, end - start), F.lit("</highlight>"), F.substring(t, end + 1, F.length(t)))


def escape_html(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def duration_text(seconds: Column) -> Column:
    """`12s`, `3m 20s`, `2h 5m`."""
    s = seconds.cast("bigint")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.expr("1") * F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor((s % 3600) / 60), F.lit("m")))
    )
