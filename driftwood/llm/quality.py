"""Quality rules by host, in DataFrame functions alone.

Base rules judge each document.  Their failures are aggregated by host (domain), each host's rate is shrunk towards
the corpus with a beta prior estimated from the hosts themselves, and the verdict on hosts is joined back.  A host is
judged against the corpus that it is part of: it goes if its rate is surely above one of `ODDS` times the corpus's odds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.exchange import SPACES, join_evenly, staged

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: A host goes if its rate of failures has more than these times the odds of the corpus's rate ...
ODDS = 2.0
#: ... even this many standard deviations of its posterior lower (0.95 of a normal distribution is above).
DEVIATIONS = 1.645
#: Hosts whose verdicts are sent to every task at most; more are joined by shuffling.
BROADCAST_HOSTS = 100_000
RUN = 3
#: Repeated runs of a text that are looked up one by one.
FEW = 8


def words(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACES}]+"))


def let(value: Column, use) -> Column:
    """use(value) with value computed once; an expression named inside a lambda is else computed for each element."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(w: Column, run: int = RUN) -> Column:
    """How many of the words lie in a run of `run` words that occurs twice or more, by the runs' 64-bit hashes.

    Hashes are sorted, and those equal to the one before them occur twice.  If they are few, places that have one are
    looked up; else hashes are sorted with their places, and places next to an equal hash count.  The words covered are
    counted over the places in order, each adding what the one before it leaves.
    """

    def hashes(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - run), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(run)]))

    def doubles(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1)))

    def looked_up(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def sorted_out(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(placed, lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-run).alias("last")), lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(run))).alias("n"), i.alias("last")))["n"]

    def counted(h: Column) -> Column:
        return let(let(F.sort_array(h), doubles), lambda d: F.when(F.size(d) == 0, 0).otherwise(covered(F.when(F.size(d) <= FEW, looked_up(h, d)).otherwise(sorted_out(h)))))

    return let(w, lambda v: F.when(F.size(v) > run, let(hashes(v), counted)).otherwise(0))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base measures of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text")).withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: _without(x, SPACES) != "")
    return rows.select(
        "doc_id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(rows: DataFrame, odds: float = ODDS) -> DataFrame:
    """host, n_docs, n_failed, rate and host_failed: failures shrunk by a beta prior whose mean and strength fit the hosts (method of moments).

    With mean m and variance v of the hosts' rates (each host weighing the same, hosts of one document left out), a
    beta prior has strength m(1-m)/v - 1; between 1 and 10,000 here.  Without hosts to learn from the strength is 1.  A
    host fails if its rate, less DEVIATIONS of its posterior's standard deviation, is over the rate that has `odds` times
    the odds of the corpus's.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.avg(F.when(F.col("n_docs") > 1, F.col("n_failed") / F.col("n_docs"))).alias("m"),
        F.var_pop(F.when(F.col("n_docs") > 1, F.col("n_failed") / F.col("n_docs"))).alias("v"),
    )
    strength = F.when(F.col("v") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(10_000.0))).otherwise(F.when(F.col("m").isNull(), 1.0).otherwise(10_000.0))
    # the prior is one row
    rated = hosts.join(F.broadcast(prior.select("mean", strength.alias("strength"))), F.lit(True)).withColumn("rate", (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength")))
    low = F.col("rate") - DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.col("strength") + 1))
    return rated.select("host", "n_docs", "n_failed", "rate", (low > odds * F.col("mean") / (1 + (odds - 1) * F.col("mean"))).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", odds: float = ODDS) -> DataFrame:
    """Base measures, base_failed, host_rate, host_failed and kept, one row per input row.

    Words are runs of characters other than ASCII white space.  A document is kept unless it fails a base rule or its
    host fails (see host_rates).  Null texts have no words; a null host is a host of its own; ids may repeat or be null.
    Measures are computed once and written to the shared folder.  Verdicts go to every task if there are at most
    BROADCAST_HOSTS; else those of the largest hosts do, and the others are joined by shuffling.
    """
    rows = staged(measures(docs, host).withColumn("of", F.concat(F.lit("h"), F.coalesce(F.concat(F.lit(":"), "host"), F.lit("")))), "measures")
    rates = staged(host_rates(rows, odds), "hosts")
    verdicts = rates.select(F.concat(F.lit("h"), F.coalesce(F.concat(F.lit(":"), "host"), F.lit(""))).alias("of"), F.col("rate").alias("host_rate"), "host_failed", "n_docs")
    size, total = rates.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    joined = rows.join(F.broadcast(verdicts.drop("n_docs")), "of") if size <= BROADCAST_HOSTS else join_evenly(rows, verdicts, "of", "n_docs", total)
    return joined.drop("of").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
