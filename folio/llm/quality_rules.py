"""Learned quality decision lists (native: JVM only).

Features are column expressions over the text.  A bounded sample of labelled rows is reduced to
counts per (feature, bin, label); sequential covering grows conjunctions of thresholds by FOIL gain
on one part of the sample, prunes them on the other, and the list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.columns import SPACE_CLASS, let, text_or_empty, words_of
from folio.sources.staging import staged

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_lines_per_word", "repeat_share"]


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    own = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_CLASS.replace("[", "[^")))
    return let(own, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def _repeat_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(wins: Column) -> Column:
        pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["p"]))

        def length(ps: Column) -> Column:
            steps = F.transform(ps, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(let(let(pairs, positions), length))

    def windows(hs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(hashes, windows), covered))


def with_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """Id and the five counts of every row (longs); ``_more`` holds ``keep_columns``."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t"), F.struct(F.lit(0).alias("_0"), *(keep_columns or [])).alias("_more"))
    return rows.select(id_col, "_t", "_more", words_of(F.col("_t")).alias("_w")).select(
        id_col,
        "_more",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _dup_lines(F.col("_t")).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )


def feature_columns() -> dict[str, Column]:
    """The features of :data:`FEATURES` from the counts of :func:`with_counts`."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, a row that none holds for is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"IF {' AND '.join(map(str, r))} THEN reject" for r in self.rules) + "\nELSE keep"


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def sample_labels(labels: DataFrame, *, id_col: str = "doc_id", train_rows: int = 20_000) -> DataFrame:
    """At most ``train_rows`` labelled ids with ``bad`` (quality 0), taken in hash order; rows without id or label are left out."""
    own = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    one = own.groupBy(id_col).agg((F.min("quality") == 0).alias("bad"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(train_rows)


def learn_rules(
    counts: DataFrame, *, id_col: str = "doc_id", bins: int = 32, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5
) -> DecisionList:
    """Sequential covering over labelled counts (``bad`` and the columns of :func:`with_counts`).

    Rows are dealt to the two growing thirds and the pruning third by a hash of the id, so the list is
    the same however the rows are partitioned.  A rule enters the list only if it rejects with ``min_precision`` on the pruning third and holds
    for ``min_covered`` bad rows or more; with no labels of either class the list is empty.
    """
    feats = feature_columns()
    rows = staged(counts.select("bad", F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(3)).alias("part"), *(c.alias(f) for f, c in feats.items())), "labelled")
    cuts_row = rows.agg(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in FEATURES), *(F.percentile_approx(F.when(F.col("bad"), F.col(f)), [i / bins for i in range(1, bins)], 10_000).alias(f"{f}_bad") for f in FEATURES)).first()
    if cuts_row is None or cuts_row[f"{FEATURES[0]}_bad"] is None:
        return DecisionList()
    cuts = {f: sorted({*cuts_row[f], *(cuts_row[f"{f}_bad"] or [])}) for f in FEATURES}
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), _bin(f, cuts[f]).alias("b")) for f in FEATURES))).alias("cell")

    found = DecisionList()
    left = rows
    while len(found.rules) < max_rules:
        rule = _grow(left.where("part < 2"), cells, cuts, max_conditions)
        rule = _prune(left.where("part = 2"), rule, min_precision, min_covered)
        if not rule:
            break
        found.rules.append(rule)
        left = left.where(~_all(rule))
    return found


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts lie below the feature."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < F.col(feature)))


def _grow(rows: DataFrame, cells: Column, cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    # A threshold lies halfway between two neighbouring cuts, so that it keeps a margin to both sides.
    while len(rule) < most:
        table = rows.where(_all(rule)).select("bad", cells).groupBy("cell.f", "cell.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        hist = {f: {r["b"]: (r["p"], r["n"]) for r in table if r["f"] == f} for f in cuts}
        all_p, all_n = (sum(x[i] for x in hist[FEATURES[0]].values()) for i in (0, 1))
        if not all_p or not all_n:
            break
        gain, best = 0.0, None
        for f, ts in cuts.items():
            p = n = 0
            for i, t in enumerate(ts):
                a, b = hist[f].get(i, (0, 0))
                p, n = p + a, n + b
                for above, (x, y) in ((False, (p, n)), (True, (all_p - p, all_n - n))):
                    if x and (g := x * (math.log2(x / (x + y)) - math.log2(all_p / (all_p + all_n)))) > gain:
                        gain, best = g, Condition(f, above, (t + (ts[i + 1] if i + 1 < len(ts) else t)) / 2)
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list[Condition], min_precision: float, min_covered: int) -> list[Condition]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows it was not grown on, if it is good enough."""
    if not rule:
        return []
    prefixes = [rule[: i + 1] for i in range(len(rule))]
    row = rows.agg(*(F.count_if(_all(p) & (F.col("bad") == b)).alias(f"{i}{b}") for i, p in enumerate(prefixes) for b in (True, False))).first()
    score = [(((p := row[f"{i}True"]) - (n := row[f"{i}False"])) / max(p + n, 1), p, n, i) for i in range(len(prefixes))]
    _, p, n, i = max(score, key=lambda x: (x[0], x[1], -x[3]))
    return prefixes[i] if p >= min_covered and p >= min_precision * (p + n) else []


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 20_000, keep_columns: list[str] | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: id, the five counts, ``base_failed`` and ``kept``.

    The list is learned from at most ``train_rows`` labelled documents.  A null text has no words; a
    null id is kept as it is; a very long text is one row like any other; repeated rows get equal results; ties between thresholds go to the first
    feature and the smallest threshold; without labels only the base rules decide; ``keep_columns``
    of ``docs`` are returned too, unless a column of the result has that name; others are not read.
    """
    picked = sample_labels(labels, id_col=id_col, train_rows=train_rows)
    # The labelled texts are kept first: else the filter on their counts would be moved below the join, onto every text.
    own = staged(docs.select(id_col, text_col).join(F.broadcast(picked), id_col), "labelled_texts")  # at most train_rows ids
    train = with_counts(own, id_col=id_col, text_col=text_col, keep_columns=["bad"]).withColumn("bad", F.col("_more.bad")).where(~base_failed())
    rules = learn_rules(train, id_col=id_col, **options)
    feats = feature_columns()
    counted = with_counts(docs, id_col=id_col, text_col=text_col, keep_columns=keep_columns)
    verdict = counted.select(*counted.columns, *(c.alias(f"_{f}") for f, c in feats.items()))
    listed = DecisionList([[Condition(f"_{c.feature}", c.above, c.threshold) for c in r] for r in rules.rules]).verdict()
    names = [c for c in counted.columns if c != "_more"]
    own_names = {*names, "base_failed", "kept"}
    more = [F.col("_more")[c].alias(c) for c in keep_columns or [] if c not in own_names]
    return verdict.select(*names, base_failed().alias("base_failed"), (~base_failed() & listed).alias("kept"), *more)
