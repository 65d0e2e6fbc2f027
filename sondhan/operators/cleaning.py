"""Cleaning, validation and the date spellings of the curation pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondhan.functions.text import collapse, or_empty, strip, token_count

# Boilerplate of known sources (case-insensitive; . matches line feeds).
SOURCE_RULES: dict[str, list[str]] = {
    "newage": [r"Editor:\s*Nurul Kabir.*?Email:\[email protected\]", r"Editor:\s*Nurul Kabir.*$", r"For Advertisement.*?Email:\[email protected\]"],
    "daily_star": [r"Copyright\s*©.*?Daily Star", r"The Daily Star\s*©.*$"],
    "dhaka_tribune": [r"©\s*\p{Nd}{4}\s*Dhaka Tribune.*$", r"Published by.*?Dhaka Tribune.*$"],
    "daily_sun": [r"©\s*Daily Sun.*$", r"Published by.*?Daily Sun.*$"],
    "new_nation": [r"©\s*The New Nation.*$"],
    "prothomalo": [r"©\s*প্রথম আলো.*$", r"সর্বস্বত্ব সংরক্ষিত.*$"],
    "bangla_tribune": [r"©\s*বাংলা ট্রিবিউন.*$"],
    "dhaka_post": [r"©\s*ঢাকা পোস্ট.*$"],
    "bdnews24": [r"©\s*bdnews24\.com.*$"],
    "kaler_kantho": [r"©\s*কালের কণ্ঠ.*$"],
}

# Boilerplate of any source (case-insensitive; . stops at a line feed).
COMMON_RULES = [
    r"\[email\s*protected\]", r"\s*Email:\s*\S+@\S+", r"\s*Cell:\s*\+?\p{Nd}[\p{Nd}\s-]+", r"Advertisement\s*$", r"Also Read:.*$", r"READ MORE:.*$", r"Related Articles?:.*$",
]

#: The registered crawler of one source writes its name differently from the rule table.
SOURCE_ALIASES = {"prothom_alo": "prothomalo"}


def normalize_ws(c: Column) -> Column:
    """Line feeds at most double, no tabs, no runs of blanks, none around line feeds, no carriage returns."""
    steps = [("\n{3,}", "\n\n"), ("\t", " "), (" {2,}", " "), (" *\n *", "\n"), ("\r", "")]
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def clean_text(text: Column, source: Column, rules: dict[str, list[str]] | None = None) -> Column:
    rules = SOURCE_RULES if rules is None else rules
    out, src = or_empty(text), or_empty(source)
    for alias, name in SOURCE_ALIASES.items():
        src = F.when(src == alias, name).otherwise(src)
    own = out
    for name, patterns in rules.items():
        cleaned = reduce(lambda x, p: F.regexp_replace(x, f"(?iumsd){p}", ""), patterns, out)
        own = F.when(src == name, cleaned).otherwise(own)
    common = reduce(lambda x, p: F.regexp_replace(x, f"(?iumd){p}", ""), COMMON_RULES, own)
    return strip(normalize_ws(common))


def clean_title(title: Column) -> Column:
    return strip(F.regexp_replace(collapse(or_empty(title)), "^(?i)(?:BREAKING|UPDATE|EXCLUSIVE):\\s*", ""))


def normalize_date(date: Column) -> Column:
    """YYYY-MM-DD of the ten accepted spellings, else of what precedes a 'T', else null; the local date, no zone shift."""
    d = strip(date)
    title = F.initcap(F.lower(d))
    iso = "^\\d{4}-\\d{1,2}-\\d{1,2}"
    guarded = [
        (d.rlike(iso + "$"), d, "yyyy-M-d"), (d.rlike("^\\d{1,2}-\\d{1,2}-\\d{4}$"), d, "d-M-yyyy"), (d.rlike("^\\d{1,2}/\\d{1,2}/\\d{4}$"), d, "d/M/yyyy"),
        (d.rlike("^[A-Za-z]{4,9} +\\d{1,2}, \\d{4}$"), title, "MMMM d, yyyy"), (d.rlike("^[A-Za-z]{3} +\\d{1,2}, \\d{4}$"), title, "MMM d, yyyy"),
        (d.rlike("^\\d{4}/\\d{1,2}/\\d{1,2}$"), d, "yyyy/M/d"), (d.rlike(iso + "T"), F.split_part(d, F.lit("T"), F.lit(1)), "yyyy-M-d"),
    ]
    return F.coalesce(*[F.when(ok, F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM-dd")) for ok, text, pattern in guarded])


def clean_articles(df: DataFrame) -> DataFrame:
    """title, body, date and tokens cleaned; a date in no accepted spelling stays as it is."""
    body = clean_text(F.col("body"), F.col("source"))
    return df.withColumns(
        {"title": clean_title(F.col("title")), "body": body, "date": F.coalesce(normalize_date(F.col("date")), F.col("date"))}
    ).withColumn("tokens", token_count(F.col("body")))


def reject_reason(url: Column, title: Column, body: Column, min_tokens: int = 50) -> Column:
    """null for a valid article; the order of the tests decides."""
    return (
        F.when(or_empty(url) == "", "no_url").when((or_empty(title) == "") | (or_empty(body) == ""), "empty").when(token_count(body) < min_tokens, "short")
    )
