"""How jobs and hits are shown: progress, remaining time, badges, load, log tails. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least load, in percent, at which a bar warns, and at which it is critical.
WARNS = {"cpu": 50, "ram": 55}
CRITICAL = 80
#: Lines of a log that are shown, and keywords of a hit.
LOG_LINES, BADGES = 50, 5


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent, a half going to the even one; 0 where there is nothing to do."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.bround(done / total * 100)).otherwise(0).cast("int")


def remaining(seconds: Column) -> Column:
    """Seconds as `50s`, `2m`, `2m 5s`, `1h` or `1h 10m`; a dash for none."""
    part = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), n.cast("string"), F.lit(unit))).otherwise("")
    m = F.floor(seconds / 60)
    minutes = F.concat(m.cast("string"), F.lit("m"), part(seconds % 60, "s"))
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h"), part(m % 60, "m"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "–").when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(m < 60, minutes).otherwise(hours)


def badges(doc_type: Column, score: Column, keywords: Column) -> Column:
    """The labels of a hit: its type in capitals, its score with four digits, its first keywords."""
    return F.concat(F.array(F.upper(doc_type), F.concat(F.lit("score "), F.format_string("%.4f", score))), F.slice(keywords, 1, BADGES))


def bar(percent: Column, kind: str) -> Column:
    """width (at most 100) and level (ok, warn, critical) of a load bar of cpu or ram."""
    level = F.when(percent >= CRITICAL, "critical").when(percent >= WARNS[kind], "warn").otherwise("ok")
    return F.struct(F.least(percent, F.lit(100)).alias("width"), level.alias("level"))


def log_tail(lines: Column, n: int = LOG_LINES) -> Column:
    """The last lines of a log, all of a shorter one."""
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))
