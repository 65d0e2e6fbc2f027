"""Mixed timestamp notations to one UTC instant (problem 1).

Every value is read by JVM-side expressions under every notation that fits it: epoch figures,
year first, compact, day-month figures, month-day figures, day before or after a named
month.  The *components* of the mixture are these notations, plus one for text that names no
moment (``junk``).  Figures such as ``03/10/2025`` are valid under two of them.
Expectation-maximisation estimates, for each source, the weights of the components
(``format_weights``): a value contributes likelihood to every component it is valid under.  A
day and month order the source declares is a strong but finite prior.  The posterior
over the components then chooses the reading of each value, and values whose best
posterior stays below the threshold are marked ambiguous.

Results (column ``status``):

==================  =========================================================
resolved            exactly one instant, in ``utc_us``
blank               null, empty or white space
unreadable          no known notation (relative words, fillers)
impossible          a notation, but no such day, time or offset, or one only in an order the source does not use
ambiguous_order     the readings' posteriors stay below the threshold
unknown_zone        wall time, and the source has no (known) home zone
skipped             wall time that the zone's clocks jumped over
repeated            wall time that the zone's clocks showed twice
==================  =========================================================

Nulls give ``blank``; repeated rows are each resolved alike; an empty table
gives an empty table; other columns of the input pass through untouched (one that
has the name of a result column is replaced by it).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as the sites write them (lower case).
MONTHS: dict[int, str] = {
    1: "january jan janvier enero januar jänner জানুয়ারি জানুয়ারী जनवरी janv ene",
    2: "february feb février fevrier febrero februar ফেব্রুয়ারি ফেব্রুয়ারী फ़रवरी फरवरी févr fév",
    3: "march mar mars marzo märz মার্চ मार्च mär",
    4: "april apr avril abril এপ্রিল अप्रैल avr abr",
    5: "may mai mayo মে मई",
    6: "june jun juin junio juni জুন जून",
    7: "july jul juillet julio juli জুলাই जुलाई juil",
    8: "august aug août aout agosto আগস্ট अगस्त ago",
    9: "september sep sept septembre septiembre সেপ্টেম্বর सितंबर सितम्बर",
    10: "october oct octobre octubre oktober okt অক্টোবর अक्टूबर अक्तूबर",
    11: "november nov novembre noviembre নভেম্বর नवंबर नवम्बर",
    12: "december dec décembre decembre diciembre dezember dez déc dic ডিসেম্বর दिसंबर दिसम्बर",
}

# Zone abbreviations and the seconds east of UTC they mean in a home zone.
ABBREVIATIONS: dict[str, dict[str, int]] = {
    "Asia/Dhaka": {"bst": 21600, "bdt": 21600},
    "Asia/Kolkata": {"ist": 19800},
    "Asia/Kathmandu": {"npt": 20700},
    "Asia/Dubai": {"gst": 14400},
    "Asia/Karachi": {"pkt": 18000},
    "Europe/London": {"bst": 3600},
    "Europe/Dublin": {"ist": 3600},
    "Europe/Paris": {"cet": 3600, "cest": 7200},
    "Europe/Madrid": {"cet": 3600, "cest": 7200},
    "Europe/Berlin": {"cet": 3600, "cest": 7200, "mez": 3600, "mesz": 7200},
    "America/New_York": {"est": -18000, "edt": -14400},
    "America/Chicago": {"cst": -21600, "cdt": -18000},
    "America/Denver": {"mst": -25200, "mdt": -21600},
    "America/Los_Angeles": {"pst": -28800, "pdt": -25200},
    "Australia/Sydney": {"aest": 36000, "aedt": 39600, "est": 36000, "edt": 39600},
}

# Abbreviations with one meaning wherever they are printed.
UNIVERSAL: dict[str, int] = {
    "z": 0, "utc": 0, "gmt": 0, "cet": 3600, "cest": 7200, "eet": 7200, "eest": 10800, "npt": 20700,
    "edt": -14400, "cdt": -18000, "mdt": -21600, "pst": -28800, "pdt": -25200, "aest": 36000, "aedt": 39600, "jst": 32400,
}

DAY_US = 86_400_000_000
SPACES = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
HIDDEN = "[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060\\ufeff]"


def _tidy(value: Column) -> Column:
    """One plain spelling: ASCII figures, single spaces, lower case, no labels, weekdays or fillers between parts."""
    figures = "".join(chr(base + i) for base in (0x9E6, 0x966, 0xFF10, 0x660) for i in range(10))
    s = F.translate(F.regexp_replace(value, HIDDEN, ""), figures, "0123456789" * 4)
    s = F.lower(F.trim(F.regexp_replace(s, f"{SPACES}+", " ")))
    s = F.regexp_replace(s, "([ap])\\. ?m\\.?$|([ap])\\. ?m\\. ", "$1$2m ")
    s = F.trim(s)
    # a label before the value ("published: ") and a weekday before a comma
    s = F.regexp_replace(s, "^\\p{L}[\\p{L}\\p{M} ]*: +", "")
    s = F.regexp_replace(s, "^[\\p{L}\\p{M}]+\\.?, (?=\\p{L}|[0-9])", "")
    # literal words between date and time, the hour mark "18h24", German "uhr"
    s = F.regexp_replace(s, "(\\d{4}),? (?:at|à|um|a las|\\|) (?=\\d)", "$1 ")
    s = F.regexp_replace(s, " (\\d{1,2}) ?h ?(\\d{2})\\b", " $1:$2")
    s = F.regexp_replace(s, " uhr$", "")
    return s


_TIME = "(?:(?:t| |, )(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d{1,18}))?)?(?: ?([ap]m))?(?: ?(z|(?:utc|gmt)?[+-]\\d{1,2}(?::?\\d{2})?|[a-z]{2,5}))?)?$"
_ISO = "^(\\d{4})([-/.])(\\d{1,2})\\2(\\d{1,2})" + _TIME
_COMPACT = "^(\\d{4})(\\d{2})(\\d{2})(?:t(\\d{2})(\\d{2})(\\d{2})?(?:[.,](\\d{1,18}))?(z|[+-]\\d{2}:?\\d{2})?)?$"
_FIGURES = "^(\\d{1,2})([-/.])(\\d{1,2})\\2(\\d{4})" + _TIME
_DAY_NAME = "^(\\d{1,2})(?:\\.|st|nd|rd|th)?(?: de)? ([\\p{L}\\p{M}]+)\\.?,?(?: de)? (\\d{4})" + _TIME
_NAME_DAY = "^([\\p{L}\\p{M}]+)\\.? (\\d{1,2})(?:st|nd|rd|th)?,? (\\d{4})" + _TIME
_EPOCH = "^(\\d{10}|\\d{13}|\\d{16}|\\d{19})$"


def _int(s: Column, pattern: str, group: int) -> Column:
    return _text(s, pattern, group).try_cast("int")


def _text(s: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def _month(word: Column) -> Column:
    pairs = [F.lit(x) for number, names in MONTHS.items() for name in names.split() for x in (name, number)]
    return F.create_map(*pairs)[word]


def _parts(s: Column, kind: Column) -> Column:
    """struct(kind, y, a, b, named_month, h, mi, sec, frac, half, zone); a and b are day and month figures in the order written."""

    def timed(p: str, at: int, **kw: Column) -> Column:
        fields = {"y": None, "a": None, "b": None, "m": None} | kw
        cols = [(F.lit(None).cast("int") if c is None else c).alias(k) for k, c in fields.items()]
        return F.struct(
            *cols, _int(s, p, at).alias("h"), _int(s, p, at + 1).alias("mi"), _int(s, p, at + 2).alias("sec"),
            _text(s, p, at + 3).alias("frac"), _text(s, p, at + 4).alias("half"), _text(s, p, at + 5).alias("zone"),
        )

    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    compact = F.struct(
        _int(s, _COMPACT, 1).alias("y"), _int(s, _COMPACT, 3).alias("a"), none.alias("b"), _int(s, _COMPACT, 2).alias("m"),
        _int(s, _COMPACT, 4).alias("h"), _int(s, _COMPACT, 5).alias("mi"), _int(s, _COMPACT, 6).alias("sec"),
        _text(s, _COMPACT, 7).alias("frac"), text.alias("half"), _text(s, _COMPACT, 8).alias("zone"),
    )
    return (
        F.when(kind == "iso", timed(_ISO, 5, y=_int(s, _ISO, 1), a=_int(s, _ISO, 4), m=_int(s, _ISO, 3)))
        .when(kind == "compact", compact)
        .when(kind == "figures", timed(_FIGURES, 5, y=_int(s, _FIGURES, 4), a=_int(s, _FIGURES, 1), b=_int(s, _FIGURES, 3)))
        .when(kind == "day_name", timed(_DAY_NAME, 4, y=_int(s, _DAY_NAME, 3), a=_int(s, _DAY_NAME, 1), m=_month(_text(s, _DAY_NAME, 2))))
        .when(kind == "name_day", timed(_NAME_DAY, 4, y=_int(s, _NAME_DAY, 3), a=_int(s, _NAME_DAY, 2), m=_month(_text(s, _NAME_DAY, 1))))
    )


def _kind(s: Column) -> Column:
    return (
        F.when(s.rlike(_EPOCH), "epoch").when(s.rlike(_ISO), "iso").when(s.rlike(_COMPACT), "compact")
        .when(s.rlike(_FIGURES), "figures").when(s.rlike(_DAY_NAME), "day_name").when(s.rlike(_NAME_DAY), "name_day")
    )


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null for a day that does not exist."""
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    good = m.between(1, 12) & (d >= 1) & (d <= last) & (y >= 1)
    return F.when(good, F.unix_date(F.make_date(y, F.when(good, m).otherwise(1), F.when(good, d).otherwise(1))))


def _clock_us(p: Column) -> Column:
    """Microseconds into the day; 0 without time of day, null for an impossible one.  Digits below a microsecond are cut off."""
    h24 = F.when(p["half"].isNull(), p["h"]).when(p["h"].between(1, 12), p["h"] % 12 + F.when(p["half"] == "pm", 12).otherwise(0))
    frac = F.rpad(F.substring(F.coalesce(p["frac"], F.lit("0")), 1, 6), 6, "0").cast("long")
    sec = F.coalesce(p["sec"], F.lit(0))
    good = h24.between(0, 23) & p["mi"].between(0, 59) & sec.between(0, 59)
    return F.when(p["h"].isNull(), F.lit(0).cast("long")).when(good, (h24 * 3600 + p["mi"] * 60 + sec).cast("long") * 1_000_000 + frac)


def _offset_s(zone: Column, home: Column) -> Column:
    """Seconds east of UTC of an explicit zone text; an abbreviation means what it means in the home zone."""
    num = "^(?:utc|gmt)?([+-])(\\d{1,2}):?(\\d{2})?$"
    hours, minutes = _int(zone, num, 2), F.coalesce(_int(zone, num, 3), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * F.when(F.regexp_extract(zone, num, 1) == "-", -1).otherwise(1))
    local = F.create_map(*[F.lit(x) for z, names in ABBREVIATIONS.items() for a, off in names.items() for x in (f"{z}|{a}", off)])
    world = F.create_map(*[F.lit(x) for a, off in UNIVERSAL.items() for x in (a, off)])
    return F.coalesce(numeric, local[F.concat(home, F.lit("|"), zone)], world[zone])


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once a row.

    Plain projections are merged by the optimizer, which copies an expression to every
    place that uses it (here beyond what one generated method can hold); a one-row
    generator keeps them apart.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    return df.select("*", packed).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__once.{n}").alias(n) for n in columns])


#: The components of the mixture, in the order of the bits of a value's signature; the last one takes any text.
COMPONENTS = ["epoch", "iso", "compact", "dmy", "mdy", "day_name", "name_day", "junk"]
DMY, MDY, JUNK = (COMPONENTS.index(c) for c in ("dmy", "mdy", "junk"))
#: How likely a text that fits a notation is to be junk that only looks like it: less than the smallest weight a notation can have (one value in a source of 10^15).
JUNK_LIKELIHOOD = 1e-18
#: Prior odds of the order a source does not declare against the one it does: finite, but less than the odds of junk at any size of a source.
UNDECLARED = 1e-40


def read_values(df: DataFrame, value: str, prefix: str = "__ts_") -> DataFrame:
    """``df`` with the parsed parts of ``value`` in one struct column and its signature:
    a bit for each component under which it names an existing day and time."""
    tidy, kind, p = f"{prefix}tidy", f"{prefix}kind", f"{prefix}p"
    out = _once(df, {tidy: _tidy(F.col(value))})
    out = _once(out, {kind: _kind(F.col(tidy))})
    out = _once(out, {p: _parts(F.col(tidy), F.col(kind))})
    a, b, y = F.col(p)["a"], F.col(p)["b"], F.col(p)["y"]
    figures = F.col(kind) == "figures"
    days = {"dmy": F.when(figures, _day(y, b, a)), "mdy": F.when(figures, _day(y, a, b)), "named": F.when(~figures, _day(y, F.col(p)["m"], a))}
    out = _once(out, {f"{prefix}{n}": c for n, c in {**days, "clock": _clock_us(F.col(p))}.items()})
    timed = F.col(f"{prefix}clock").isNotNull()
    fits = [F.col(kind) == "epoch"] + [(F.col(kind) == c) & F.col(f"{prefix}named").isNotNull() & timed for c in ("iso", "compact")]
    fits += [F.col(f"{prefix}{c}").isNotNull() & timed for c in ("dmy", "mdy")] + [(F.col(kind) == c) & F.col(f"{prefix}named").isNotNull() & timed for c in ("day_name", "name_day")]
    bits = reduce(lambda x, z: x + z, [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(fits)])
    return _once(out, {f"{prefix}mask": (bits + F.lit(1 << JUNK)).cast("int")})


def mixture(masks: np.ndarray, counts: np.ndarray, declared: str | None, rounds: int = 25, prior: float = 0.5) -> np.ndarray:
    """Prior times weight of every component after EM over the signatures of one source, ``counts[i]`` values of ``masks[i]``."""
    k = len(COMPONENTS)
    valid = (masks[:, None] >> np.arange(k)) & 1
    like = np.where(valid == 1, np.where(np.arange(k) == JUNK, JUNK_LIKELIHOOD, 1.0), 0.0)
    if declared in ("dmy", "mdy"):
        like[:, MDY if declared == "dmy" else DMY] *= UNDECLARED
    w = np.full(k, 1.0 / k)
    for _ in range(rounds):
        r = like * w
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        n = (r * counts[:, None]).sum(0)
        w = (n + prior) / (n.sum() + k * prior)
    factor = np.ones(k)
    factor[JUNK] = JUNK_LIKELIHOOD
    if declared in ("dmy", "mdy"):
        factor[MDY if declared == "dmy" else DMY] = UNDECLARED
    return w * factor


def format_weights(parsed: DataFrame, source: str, declared: str | None = None, rounds: int = 25, prior: float = 0.5, prefix: str = "__ts_") -> DataFrame:
    """(__src, __w array<double>): the fitted mixture of each source, priors included.

    The sufficient statistics are counts of the (at most 2^7) signatures of a source, pre-aggregated before the
    shuffle, so a hot source costs nothing.  ``prior`` pseudo-values stand in each component.
    """
    stats = parsed.groupBy(F.col(source).alias("__src"), F.col(f"{prefix}mask").alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.lower(declared)) if declared else F.lit(None).cast("string")).alias("declared")
    )
    rows = stats.groupBy("__src").agg(F.sort_array(F.collect_list(F.struct("mask", "n"))).alias("seen"), F.max("declared").alias("declared"))
    kind = parsed.schema[source].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for seen, order in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(mixture(np.array([x["mask"] for x in seen]), np.array([x["n"] for x in seen], float), order, rounds, prior).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["__src", "__w"])

    return rows.mapInArrow(run, f"__src {kind}, __w array<double>")


def normalise_timestamps(
    df: DataFrame, value: str, source: str, sources: DataFrame, zone: str = "home_zone", order: str = "date_order",
    threshold: float = 0.9, rounds: int = 25,
) -> DataFrame:
    """``df`` plus utc_us (long), status, format and order_posterior.

    ``sources`` has one row a source with its home zone and, where known, its day and
    month order; sources without a row or an order are settled by the mixture alone, and values
    whose posterior stays below ``threshold`` are marked ``ambiguous_order``.  ``order_posterior`` is
    the posterior of the reading chosen, for figures that name a day in some order.
    """
    x = "__ts_"
    dim = sources.select(F.col(source).alias("__src_key"), F.col(zone).alias("__zone"), F.col(order).alias("__order")).dropDuplicates(["__src_key"])
    joined = df.join(dim, F.col(source) == F.col("__src_key"), "left").drop("__src_key")
    parsed = read_values(joined, value, x)
    weights = format_weights(parsed, source, "__order", rounds)
    out = parsed.join(weights, F.col(source).eqNullSafe(F.col("__src")), "left").drop("__src")

    p, kind, mask = F.col(f"{x}p"), F.col(f"{x}kind"), F.col(f"{x}mask")
    # posteriors of the two orders of figures; values of one notation only have nothing to choose but junk
    share = lambda i: F.when(F.getbit(mask, F.lit(i)) == 1, F.get("__w", F.lit(i))).otherwise(0.0)
    total = share(DMY) + share(MDY) + F.get("__w", F.lit(JUNK))
    p_dmy, p_mdy = share(DMY) / total, share(MDY) / total
    dmy, mdy = F.col(f"{x}dmy"), F.col(f"{x}mdy")
    same = dmy.isNotNull() & mdy.isNotNull() & (dmy == mdy)
    best = F.when(same, p_dmy + p_mdy).otherwise(F.greatest(p_dmy, p_mdy))
    out = _once(out, {f"{x}best": F.when(kind == "figures", best), f"{x}day": F.when(kind == "figures", F.when(p_dmy >= p_mdy, dmy).otherwise(mdy)).otherwise(F.col(f"{x}named"))})
    posterior, figures = F.col(f"{x}best"), kind == "figures"
    # a day that exists in an order only which the source all but rules out is junk
    orders = F.getbit(mask, F.lit(DMY)) + F.getbit(mask, F.lit(MDY))
    junk = figures & ((orders == 0) | ((orders == 1) & (posterior < 0.5)))
    settled = ~figures | (posterior >= threshold)
    wall = F.when(settled, F.col(f"{x}day")).cast("long") * F.lit(DAY_US) + F.col(f"{x}clock")
    offset = _offset_s(p["zone"], F.col("__zone"))

    raw = F.col(f"{x}tidy")
    digits = F.length(raw)
    epoch = F.when(kind == "epoch", F.when(digits == 10, raw.try_cast("long") * 1_000_000).when(digits == 13, raw.try_cast("long") * 1000).when(digits == 16, raw.try_cast("long")).otherwise(F.floor(raw.try_cast("decimal(20,0)") / 1000).cast("long")))
    out = _once(out, {f"{x}wall": wall, f"{x}off": offset})
    wall_c, off_c = F.col(f"{x}wall"), F.col(f"{x}off")
    out = out.withColumn(f"{x}local", p["zone"].isNull() & wall_c.isNotNull() & F.col("__zone").isNotNull())

    stamp = F.timestamp_micros(wall_c)
    utc = F.unix_micros(F.to_utc_timestamp(stamp, F.col("__zone")))
    out = _once(out, {f"{x}utc": F.when(F.col(f"{x}local"), utc)})
    utc_c = F.col(f"{x}utc")
    skipped = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_c), F.col("__zone"))) != wall_c
    again = reduce(lambda a, b: a | b, [F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_c + F.lit(s * m * 60_000_000)), F.col("__zone"))) == wall_c for m in (30, 60, 120) for s in (-1, 1)])
    status = (
        F.when(raw.isNull() | (raw == ""), "blank").when(kind == "epoch", "resolved")
        .when(kind.isNull() | (kind.isin("day_name", "name_day") & p["m"].isNull()), "unreadable")
        .when(junk, "impossible").when(~settled & F.col(f"{x}clock").isNotNull(), "ambiguous_order")
        .when(wall_c.isNull(), "impossible")
        .when(p["zone"].isNotNull(), F.when(off_c.isNull(), "unknown_zone").otherwise("resolved"))
        .when(F.col("__zone").isNull(), "unknown_zone").when(skipped, "skipped").when(again, "repeated").otherwise("resolved")
    )
    out = out.withColumn(f"{x}status", status)
    instant = F.when(kind == "epoch", epoch).when(p["zone"].isNotNull(), wall_c - off_c.cast("long") * 1_000_000).otherwise(utc_c)
    out = out.withColumn(f"{x}us", F.when(F.col(f"{x}status") == "resolved", instant))
    added = {"utc_us": F.col(f"{x}us"), "status": F.col(f"{x}status"), "format": kind, "order_posterior": F.when(figures & (orders > 0), posterior)}
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *[c.alias(n) for n, c in added.items()])
