"""Quality rules whose cutoffs keep false rejections within a proven limit.

Each rule rejects a document when one measure of its text exceeds a cutoff. The cutoffs come from
labelled documents: in every stratum, the good ones (quality 1) that the rules together would reject are
counted, and an exact binomial test asks whether the true share of false rejections is at most ``alpha``.

* One sequence per stratum: its steps each make one rule stricter by one cutoff, and a test is about all
  rules as they stand after the step. Tests run in order and the first failure ends the sequence, which needs no
  correction within the stratum; what the last passed step says holds for all rules jointly.
* The order of the steps comes from other documents than those tested: the unlabelled ones and those labelled
  bad. Steps that seem to reject the smallest share of good documents come first: the share of
  the unlabelled they reject, less the part the bad ones explain.
* Multiple testing: the strata share ``delta`` (Bonferroni). So with probability 1 - delta all limits hold at once.
* A stratum needs n good labelled documents with (1 - alpha)^n <= delta / strata for any cutoff: 436 for four
  strata, 528 for ten. Strata with fewer are tested as one pooled stratum, whose limit holds for their mixture. Where
  even the pool is too small, or nothing is labelled good, no cutoff is used.

Everything is DataFrame expressions. Null texts count as empty; a null stratum is one of its own.
Columns of these names in the input are replaced. Rows stay as they are, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.llm.common import SPACE, words
from logquarry.session import stage

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: measure: the cutoffs that are tried, any of which rejects what lies above it.
GRID = {
    "symbol_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02),
    "dup_line_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_share": (0.28, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "shout_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02),
    "word_length": (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0),
}
HELPERS = ("_words", "_lines", "_hashes", "_windows", "_sorted", "_again", "_capitals", "_shouts")


def _lacking(text, letters: str):
    """How many of ``letters`` the text holds."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def with_stats(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the columns STATS, the measures of GRID and base_failed.

    A window of eight words counts as repeated if another place of the text has the same words;
    n_repeat_words is the number of words that lie in such windows, the first included.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rest = docs.drop(*STATS, *GRID, "base_failed", *HELPERS)
    cut = rest.withColumns({
        "_words": words(text),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]")),
    })
    counted = cut.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": _lacking(text, "#*$%&|<>"),
        "_capitals": _lacking(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_shouts": _lacking(text, "!?"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    h = F.col("_hashes")
    windows = counted.withColumn("_windows", F.when(
        F.size(h) >= WINDOW,
        F.transform(F.slice(h, F.lit(1), F.size(h) - WINDOW + 1),
                    lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: only the others are put in order of their windows' hashes
    ordered = windows.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    s = F.col("_sorted")
    again = ordered.withColumn("_again", F.sort_array(F.transform(
        F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))),
        lambda x: x["at"])))
    covered = F.aggregate(
        "_again", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, at: F.struct((a["n"] + at + WINDOW - F.greatest(at, a["upto"])).alias("n"), (at + WINDOW).alias("upto")),
        lambda a: a["n"])
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    measured = again.withColumn("n_repeat_words", covered).withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": F.coalesce(F.try_divide(F.col("n_dup_lines"), F.size("_lines")), F.lit(0.0)),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("_capitals", "word_chars"),
        "shout_share": share("_shouts", "word_chars"),
        "word_length": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    # the numbers leave through a generator: a later filter on them then uses them instead of spelling out, and
    # computing again for every element, how they were made
    made = [*STATS, *GRID, "base_failed"]
    return measured.select(*rest.columns, F.explode(F.array(F.struct(*made))).alias("_made")).select(*rest.columns, "_made.*")


def tail_probability(n, k, p: float):
    """P(at most k of n) where each has probability p: exact, summed in logarithms. 1 where k >= n p."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def add(a, i):
        term = a["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (term + F.log1p(F.exp(a["total"] - term))).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("term"), first.alias("total")), add,
                        lambda a: a["total"])
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(first)).otherwise(F.exp(total))


def select_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01,
                   delta: float = 0.05, id_column: str = "doc_id") -> DataFrame:
    """One row per stratum with a proven step: ``stratum`` and a cutoff for each measure of GRID (infinite: rule not used).

    ``stats`` is with_stats' table of all documents, ``labels`` has the id and quality (1: good, other values: bad).
    One table of counts by rejection pattern is written to the shared folder when this is called.
    An id with several labels is bad if one of them says so. Null qualities and ids count as unlabelled.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).alias("_id")).agg(F.when(F.min(F.col("quality") == 1), "good").otherwise("bad").alias("mark"))
    # per rule the first level, from the most lenient on, that rejects the document (one past the last: none does)
    first = F.array(*[F.struct(F.lit(m).alias("rule"), (1 + sum(F.when(F.col(m) > c, 0).otherwise(1) for c in grid)).alias("level"))
                      for m, grid in GRID.items()])
    rows = (stats.select(F.col(id_column).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                         first.alias("at"))
            .join(marks, "_id", "left").select("stratum", "at", F.coalesce("mark", F.lit("none")).alias("mark")))
    # equal rejection patterns are one row from here on, written once as several sums read them
    rows = stage(rows.groupBy("stratum", "at", "mark").agg(F.count(F.lit(1)).alias("times")))
    each = rows.groupBy("stratum").agg(*[F.sum(F.when(F.col("mark") == m, F.col("times")).otherwise(0)).alias(m)
                                         for m in ("good", "bad", "none")]).where("good > 0")
    strata = each.agg(F.count(F.lit(1)).alias("strata"))  # one row
    small = F.pow(F.lit(1 - alpha), F.col("good")) > F.lit(delta) / F.col("strata")
    groups = each.join(strata, F.lit(True)).withColumn(
        "part", F.struct(small.alias("pooled"), F.when(small, "").otherwise(F.col("stratum")).alias("name")))
    sums = groups.groupBy("part", "strata").agg(*[F.sum(m).alias(m) for m in ("good", "bad", "none")])
    rows = rows.join(groups.select("stratum", "part"), "stratum")

    cutoffs = F.array(*[F.struct(F.lit(m).alias("rule"), F.lit(i).alias("level"), F.lit(float(c)).alias("cutoff"))
                        for m, grid in GRID.items() for i, c in enumerate(grid, 1)])
    hits = (rows.where("mark != 'good'").select("part", "mark", "times", F.inline("at"))
            .groupBy("part", "mark", "rule", "level").agg(F.sum("times").alias("times")))
    upto = W.partitionBy("part", "rule").orderBy("level")  # a rule's levels, as many rows as its grid
    seen = (sums.select("*", F.inline(cutoffs)).join(
        hits.groupBy("part", "rule", "level").agg(F.sum(F.when(F.col("mark") == "bad", F.col("times"))).alias("caught"),
                                                  F.sum(F.when(F.col("mark") == "none", F.col("times"))).alias("others")),
        ["part", "rule", "level"], "left")
        .withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(upto) for c in ("caught", "others")}))
    among = F.coalesce(F.try_divide("others", "none"), F.lit(0.0))
    guess = (among - F.col("caught") / (F.col("good") + F.col("bad"))) / (F.col("good") / (F.col("good") + F.col("bad")))
    order = [F.col("cost"), F.col("level"), F.col("rule")]
    steps = seen.withColumn("cost", F.max(F.round(guess, 12)).over(upto)).withColumn(
        "step", F.row_number().over(W.partitionBy("part").orderBy(*order)))  # a row per cutoff of GRID

    places = steps.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(" ", "rule", "level"), "step"))).alias("places"))
    place = F.array_min(F.transform("at", lambda x: F.try_element_at("places", F.concat_ws(" ", x["rule"], x["level"]))))
    fallen = (rows.where("mark = 'good'").join(places, "part").groupBy("part", place.alias("step"))
              .agg(F.sum("times").alias("rejected")))
    tested = steps.join(fallen, ["part", "step"], "left").withColumn(
        "k", F.sum(F.coalesce("rejected", F.lit(0))).over(W.partitionBy("part").orderBy("step")))
    # k never falls from step to step, so what passes is the beginning of the sequence
    passed = tested.where(tail_probability(F.col("good"), F.col("k"), alpha) <= F.lit(delta) / F.col("strata"))
    found = passed.groupBy("part").agg(*[
        F.coalesce(F.min(F.when(F.col("rule") == m, F.col("cutoff"))), F.lit(float("inf"))).alias(f"{m}_cutoff") for m in GRID])
    return groups.select("stratum", "part").join(found, "part").drop("part")


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``stats`` with ``kept``: false where base_failed, or where a measure exceeds its stratum's cutoff."""
    limits = cutoffs.withColumnRenamed("stratum", "_stratum")
    over = F.lit(False)
    for m in GRID:
        over = over | (F.col(m) > F.coalesce(F.col(f"{m}_cutoff"), F.lit(float("inf"))))
    rows = stats.drop("kept", "_stratum", *[f"{m}_cutoff" for m in GRID])
    found = rows.join(limits, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("_stratum"), "left")
    return found.withColumn("kept", ~F.col("base_failed") & ~over).select(*rows.columns, "kept")
