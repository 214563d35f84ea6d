"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A row fails at once where it has fewer than 10 words, or more than a fifth of
its words lie in five-word windows that the text holds twice. The other rules
reject a row where a signal reaches a cutoff. Cutoffs are chosen by Learn-then-
Test: among labelled good documents of a stratum (a band of text length), the
number that a cutoff rejects is binomial, and the exact tail probability tests
whether its false-rejection rate is at least ``RISK / number of rules``. Cutoffs
are tested from the laxest to the strictest and testing stops at the first that
fails (a fixed sequence); over rules and strata the level is split (Bonferroni).
A stratum's rejected good documents are at most the sum over its rules, so with
probability ``1 - LEVEL`` the cutoffs together reject less than ``RISK`` of the
good documents of every stratum. Of the certified cutoffs of a rule, the one with
the best balance of rejected bad documents against ``PENALTY`` times the good
ones is taken, the laxest among equals; a rule without a certified cutoff of
positive balance is not applied.

Calibration counts cover all labelled documents; they are strata x rules x
cutoffs numbers, whatever the table's size. Scoring a row looks at that row only,
so there is no shuffle by key and no skew.

Null texts have no words and fail. Rows with a null or repeated doc_id are judged
like any other. For calibration a labelled id counts once, by the row of its
greatest signals, since copies are not independent draws; labels with a null
doc_id or quality are left out, and of an id with both labels the bad one counts.
A value equal to a cutoff is rejected. With empty labels no cutoff applies. A very
long text is one array of its words. An empty table gives no rows. Columns whose
names clash with the signals' are kept: the signals take other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, own_name

SPACE = r"[\x20\x09-\x0D]+"
#: Bound on the share of a stratum's good documents that all cutoffs together reject, and the chance that any bound is wrong.
RISK, LEVEL = 0.02, 0.05
#: Labelled ids up to which they are broadcast: 16 bytes each. Beyond, signals are computed first and joined.
BROADCAST_IDS = 2_000_000
#: Good rows count this many times against bad ones when certified cutoffs are compared.
PENALTY = 20
#: Lower ends of the strata, in words.
BANDS = (0, 50, 300, 1000)
#: Cutoffs of each signal, from the laxest.
CUTOFFS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "shout_ratio": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "same_word_ratio": (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _reached(value: Column, cutoffs: tuple) -> Column:
    """How many cutoffs a value reaches. A sum and no lambda: into a lambda, the optimiser would move what computes the value."""
    return sum(((value >= c).cast("int") for c in cutoffs), F.lit(0))


def _gram(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(5)]


def _repeat_words(words: Column) -> Column:
    """Words covered by five-word windows that occur at least twice; windows are compared as strings."""

    def covered(sorted_grams: Column) -> Column:
        again = F.filter(
            sorted_grams,
            lambda x, k: F.coalesce(F.get(sorted_grams, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(sorted_grams, k + 1)["g"] == x["g"], F.lit(False)),
        )
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.struct(F.concat_ws(" ", *_gram(words, i)).alias("g"), i.alias("i")))
    return _bound(F.sort_array(grams), covered)


def with_signals(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the base counts and signals in columns of their own; returns those columns' names by what they hold."""
    names = {}

    def name(x: str) -> str:
        names[x] = own_name(docs, f"_{x}")
        return names[x]

    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    out = docs.select("*", t.alias(name("t")))
    t = F.col(f"`{names['t']}`")
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    out = out.select("*", F.filter(F.split(t, SPACE, -1), lambda x: x != "").alias(name("words")), F.filter(F.split(t, "\n", -1), has_word).alias(name("lines")))
    words, lines = F.col(f"`{names['words']}`"), F.col(f"`{names['lines']}`")
    hashes = F.when(F.size(words) >= 10, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*_gram(words, i)))).when(F.size(words) >= 5, F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = out.select(
        "*",
        F.size(words).cast("long").alias(name("n_words")),
        F.char_length(F.array_join(words, "")).cast("long").alias(name("word_chars")),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias(name("n_symbols")),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(name("n_dup_lines")),
        F.size(lines).alias(name("n_lines")),
        F.size(F.array_distinct(words)).alias(name("n_distinct")),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias(name("n_upper")),
        F.regexp_count(t, F.lit("!")).alias(name("n_shout")),
        hashes.alias(name("hashes")),
    )
    n = {k: F.col(f"`{v}`") for k, v in names.items()}
    # windows that differ in their hashes differ, so only texts with an equal pair of hashes need the exact comparison
    repeats = F.when(F.size(F.array_distinct(n["hashes"])) < F.size(n["hashes"]), _repeat_words(words)).otherwise(F.lit(0))
    ratio = lambda x, of: x / F.greatest(of, F.lit(1))
    out = out.select(
        "*",
        repeats.cast("long").alias(name("n_repeat_words")),
        ratio(n["n_symbols"], n["word_chars"]).alias(name("symbol_ratio")),
        ratio(n["n_upper"], n["word_chars"]).alias(name("upper_ratio")),
        ratio(n["n_shout"], n["n_words"]).alias(name("shout_ratio")),
        ratio(n["n_dup_lines"], n["n_lines"]).alias(name("dup_line_ratio")),
        (1 - ratio(n["n_distinct"], n["n_words"])).alias(name("same_word_ratio")),
        (_reached(n["n_words"], BANDS) - 1).alias(name("band")),
    )
    return out, names


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed term by term in logarithms; 1 where k exceeds the mean."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda a: F.exp(a["total"]))
    return F.when(k > p * n, F.lit(1.0)).when(k == 0, F.exp(n * F.log1p(F.lit(-p)))).otherwise(summed)


def _labelled_signals(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, quality, signals) of each labelled id with a text of at least ten words, once."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("id").agg(F.min("quality").alias("quality"))
    key = own_name(docs, "_id")
    docs = docs.select(docs["doc_id"].cast("long").alias(key), docs["text"])
    if few := marks.count() <= BROADCAST_IDS:
        # texts without a label are left out before their signals are computed
        docs = docs.join(F.broadcast(marks.select(F.col("id").alias("_of"))), F.col(f"`{key}`") == F.col("_of"), "left_semi")
    signals, n = with_signals(docs)
    rows = signals.filter(F.col(f"`{n['n_words']}`") >= 10).select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{n['band']}`").alias("band"),
        F.array(*(_reached(F.col(f"`{n[s]}`"), CUTOFFS[s]) for s in CUTOFFS)).alias("reached"),
    )
    once = rows.groupBy("id").agg(F.max(F.struct("reached", "band")).alias("r")).select("id", "r.*")
    return once.join(F.broadcast(marks) if few else marks, "id").select(
        "band", "quality", F.array(*(F.struct(F.lit(s).alias("signal"), F.col("reached")[k].alias("reached")) for k, s in enumerate(CUTOFFS))).alias("signals")
    )


def calibrate(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[tuple[int, str], float]:
    """Chosen cutoffs by (stratum, signal): at most strata x signals numbers, the only thing that reaches the driver."""
    counts = (
        _labelled_signals(docs, labels).select("band", "quality", F.explode("signals").alias("x")).select("band", "quality", "x.*")
        .groupBy("band", "signal", "reached").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    )
    # one array of (reached, good, bad) for each stratum and signal, at most a dozen entries: what a cutoff rejects is the sum at or above it
    counts = counts.groupBy("band", "signal").agg(F.collect_list(F.struct("reached", "good", "bad")).alias("at"))
    of = F.create_map(*(x for s, c in CUTOFFS.items() for x in (F.lit(s), F.array(*map(F.lit, c)))))
    total = lambda field, least: F.aggregate(F.filter("at", lambda x: x["reached"] >= least), F.lit(0).cast("long"), lambda a, x: a + x[field])
    tested = counts.select("band", "signal", total("good", F.lit(0)).alias("n"), F.posexplode(of[F.col("signal")]).alias("rank", "cutoff"), "at")
    least = F.size(of[F.col("signal")]) - F.col("rank")  # cutoffs descend: a value at the rank's cutoff reaches this many
    tested = tested.select("band", "signal", "rank", "cutoff", "n", total("good", least).alias("k"), total("bad", least).alias("bad"))
    alpha = level / (len(CUTOFFS) * len(BANDS))
    tested = tested.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), risk / len(CUTOFFS)) <= alpha)
    best = (
        tested.groupBy("band", "signal").agg(
            F.coalesce(F.min(F.when(~F.col("passed"), F.col("rank"))), F.lit(1 << 20)).alias("stop"),
            F.collect_list(F.struct((F.col("bad") - PENALTY * F.col("k")).alias("gain"), (-F.col("rank")).alias("lax"), "cutoff")).alias("all"),
        )
        .select("band", "signal", F.array_max(F.filter("all", lambda x: (-x["lax"] < F.col("stop")) & (x["gain"] > 0))).alias("best"))
        .filter("best IS NOT NULL")
    )
    return {(r.band, r.signal): r.best.cutoff for r in best.collect()}


def verdict(names: dict[str, str], cutoffs: dict[tuple[int, str], float]) -> Column:
    """Whether a row of with_signals() is kept."""
    n = {k: F.col(f"`{v}`") for k, v in names.items()}
    reject = base_failed(n["n_words"], n["n_repeat_words"])
    for (band, signal), cutoff in sorted(cutoffs.items()):
        reject = reject | ((n["band"] == band) & (n[signal] >= cutoff))
    return ~reject


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    signals, names = with_signals(docs)
    kept = own_name(signals, "_kept")
    # a filter on the verdict itself would be pushed below the columns it is made of and compute them again and again
    judged = signals.select("*", F.explode(F.array(verdict(names, calibrate(docs, labels)))).alias(kept))
    return judged.filter(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict for each of ``documents``, with cutoffs from ``labels``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    signals, names = with_signals(docs)
    cutoffs = calibrate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    base = {k: F.col(names[k]) for k in BASE}
    return signals.select("doc_id", *(c.alias(k) for k, c in base.items()), base_failed(base["n_words"], base["n_repeat_words"]).alias("base_failed"), verdict(names, cutoffs).alias("kept"))
