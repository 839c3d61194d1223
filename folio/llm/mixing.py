"""Mixing documents to target domain weights with soft membership (native: JVM only).

A naive Bayes classifier, learned from counts over a bounded sample of the labelled table, gives every
document a posterior over domains.  A document with rate r and n tokens then adds r * n * p_d expected
tokens to domain d.  The rates are found by projected gradient steps on the weighted least squares of
T(r) - target over r >= 0: all rates start at 1, every step moves each against its gradient, which is
p . (T - target) / spread, and puts what falls below 0 back to 0, with the momentum of accelerated
gradients.  A step needs only the domain totals, one aggregation over all documents; a document's rate
is a fold over the few steps so far, so nothing is kept for it in between.  Steps end when the targets
are met or the rates stand still; targets that are missed are reported.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.columns import let, text_or_empty
from folio.sources.staging import staged

#: Labelled documents that the classifier may use, and words of its vocabulary.
TRAIN_ROWS, VOCABULARY = 20_000, 1024
#: How much more often a word of the vocabulary occurs in one domain's documents than in the others'.
MIN_LIFT = 4.0
#: The least log-likelihood ratio of a lexicon word.
MIN_RATIO = 25.0
#: Least share of the largest domain's Gram entry in the inverse weight of a domain.  Weights only matter where no
#: rates meet all targets: there a domain that hardly exists does not steer the others.
FLOOR = 0.02
#: Rows whose rates are rounded together.
ROUND_ROWS = 1000
#: Gradient steps at most.
STEPS = 200
#: Targets that can't be met: steps end when so many of them have lowered the squares by less than this part.
STALLED, PART = 20, 0.001
#: Lexicon words found in a text are counted up to this number, by default.
MOST_FOUND = 3
_SPLIT = r"[\s.,;:!?]+"
#: Shape features and the cuts of their bins.
SHAPES = {"symbols": [0.02, 0.05, 0.1, 0.2, 0.5, 1.0], "distinct": [0.1, 0.2, 0.35, 0.5, 0.7, 0.9]}


def _tokens(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, ``_more`` (struct of ``keep``), words in lower case, the distinct ones, and the bins of the shape features."""
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_0"), *keep).alias("_more"), text_or_empty(text_col).alias("_t"))
    rows = rows.select("_id", "_more", "_t", F.array_remove(F.split(F.lower("_t"), _SPLIT), "").alias("_w"))
    rows = rows.select("*", F.array_distinct("_w").alias("_dw"))
    n = F.greatest(F.size("_w"), F.lit(1))
    shape = {"symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")) / n, "distinct": F.size("_dw") / n}
    bins = [F.concat(F.lit(f"\x00{name}"), _bin(shape[name], cuts)) for name, cuts in SHAPES.items()]
    return rows.select("_id", "_more", F.size("_w").cast("long").alias("_n"), "_w", "_dw", F.array(*bins).alias("_b"))


def _bin(x: Column, cuts: list[float]) -> Column:
    out = F.lit(str(len(cuts)))
    for i, c in reversed(list(enumerate(cuts))):
        out = F.when(x <= c, F.lit(str(i))).otherwise(out)
    return out


@dataclass
class Classifier:
    """Naive Bayes over binned features: the shapes, and how many words of each domain's lexicon a text has."""

    domains: list[str]
    prior: list[float]
    lexicons: dict[str, list[str]]
    weights: dict[str, list[float]]
    most_found: int = MOST_FOUND

    def posterior(self) -> Column:
        """array<double> over ``domains`` from the columns of :func:`_tokens`."""
        if not self.weights:
            return F.array(*(F.lit(1.0 / len(self.domains)) for _ in self.domains))
        table = F.map_from_arrays(F.array(*map(F.lit, self.weights)), F.array(*(F.array(*map(F.lit, w)) for w in self.weights.values())))
        start = F.array(*map(F.lit, self.prior))
        bins = F.concat("_b", *(F.array(b) for b in _lexicon_bins(self.lexicons, F.col("_dw"), self.most_found)))
        logs = F.aggregate(bins, start, lambda acc, b: F.zip_with(acc, F.coalesce(F.element_at(table, b), F.array(*(F.lit(0.0) for _ in self.domains))), lambda x, y: x + y))
        return F.aggregate(F.array(logs), F.array().cast("array<double>"), lambda _, x: _softmax(x))


def _found(lexicon: list[str], words: Column) -> Column:
    """How many of the distinct ``words`` are in a lexicon; the set of its words is made once, not for each row."""
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def _lexicon_bins(lexicons: dict[str, list[str]], words: Column, most: int) -> list[Column]:
    """Of each lexicon how many of its words are among the distinct ``words``, up to ``most``."""
    return [F.concat(F.lit(f"\x00lexicon {d} "), F.least(_found(lex, words), F.lit(most)).cast("string")) for d, lex in lexicons.items() if lex]


def _softmax(logs: Column) -> Column:
    raised = F.aggregate(F.array(F.array_max(logs)), F.array().cast("array<double>"), lambda _, top: F.transform(logs, lambda v: F.exp(v - top)))
    return F.aggregate(F.array(raised), F.array().cast("array<double>"), lambda _, e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY, most_found: int | None = MOST_FOUND) -> Classifier:
    """Naive Bayes on at most ``train_rows`` rows of ``labelled`` (id, ``domain``), taken in hash order of the id.

    The lexicons have ``vocabulary`` words in all.  Lexicon words found in a text count up to
    ``most_found``; None lets them count up to the largest number that a labelled text has.
    """
    own = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isin(domains)).groupBy(id_col).agg(F.min("domain").alias("domain"))
    picked = F.broadcast(own.orderBy(F.xxhash64(id_col), id_col).limit(train_rows).withColumnRenamed(id_col, "_id"))  # at most train_rows ids
    train = _tokens(docs.join(picked.select(F.col("_id").alias(id_col)), id_col, "left_semi"), id_col, text_col, []).join(picked, "_id")
    features = staged(train.select("domain", F.array_distinct(F.concat("_w", "_b")).alias("f")), "labelled_features")
    sizes = {r["domain"]: r["n"] for r in features.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier(domains, [0.0] * len(domains), {}, {})
    counts = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    by_word = features.select("domain", F.explode("f").alias("w")).groupBy("w").agg(*counts).where(~F.col("w").startswith("\x00"))
    df = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    # A lexicon has the words that one domain's documents have far more often than the others', by the
    # log-likelihood ratio of the two shares; its least value keeps out what a small sample shows by chance.
    ranked = []
    for i, d in enumerate(domains):
        a, b, own, others = F.col(f"n{i}"), df - F.col(f"n{i}"), float(max(sizes.get(d, 0), 1)), float(max(total - sizes.get(d, 0), 1))
        part = lambda n, size: F.when(n > 0, n * F.log(n * float(total) / (df * size))).otherwise(0.0)
        ratio = 2 * (part(a, own) + part(b, others))
        ranked.append(F.struct(F.when((a / own >= MIN_LIFT * b / others) & (ratio >= MIN_RATIO), ratio).otherwise(0.0).alias("gain"), F.lit(d).alias("domain")))
    best = by_word.select("w", F.greatest(*ranked, F.struct(F.lit(0.0).alias("gain"), F.lit("").alias("domain"))).alias("b")).where("b.gain > 0")
    lexicons: dict[str, list[str]] = {d: [] for d in domains}
    for r in best.orderBy(F.desc("b.gain"), "w").limit(vocabulary).collect():
        lexicons[r["b"]["domain"]].append(r["w"])
    if most_found is None:
        most_found = features.agg(F.max(F.greatest(F.lit(1), F.lit(1), *(_found(lex, F.col("f")) for lex in lexicons.values() if lex))).alias("n")).first()["n"]
    bins = F.concat(F.filter("f", lambda x: x.startswith("\x00")), *(F.array(b) for b in _lexicon_bins(lexicons, F.col("f"), most_found)))
    weights = {r["b"]: [math.log((r[f"n{i}"] + 0.5) / (sizes.get(d, 0) + 2)) for i, d in enumerate(domains)] for r in features.select("domain", F.explode(bins).alias("b")).groupBy("b").agg(*counts).collect()}
    return Classifier(domains, [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains], lexicons, weights, most_found)


def mix_documents(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    scale: float = 1.0,
    keep_all: bool = False,
    steps: int = STEPS,
    tolerance: float = 1e-3,
    keep_columns: list[str] | None = None,
    **options,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``posterior`` (domain to probability), ``domain``, ``rate``, ``copies``.

    ``targets`` are relative weights of the domains.  The token budget is ``scale`` times all tokens or,
    with ``keep_all``, ``scale`` times the least budget with which no domain has to be thinned.  Targets
    stand as they are given: one that can't be met, as of a domain that no document has, is missed and reported.
    ``copies`` rounds the rate up or down so that what is written of each domain follows the rates: see :func:`_rounded`.
    A null or empty text has no tokens and the prior as posterior; null ids are never labelled but
    mixed; repeated rows get equal rates, and copies that differ by one at most; very long texts are one row like any other; ties of the posterior go to the first domain by name;
    without labels all domains are equally likely and every rate is 1; an empty table gives no rows.  Of other columns
    only ``keep_columns`` are read, and returned unless a column of the result has their name.  The metadata of ``rate`` has under ``mixing`` the goal and the
    expected tokens of each domain, the steps taken, and whether the rates are optimal after them; a missed target also gives a warning.
    """
    domains = sorted(targets)
    model = learn_domains(docs, labelled, domains, id_col=id_col, text_col=text_col, **options)
    tokens = _tokens(docs, id_col, text_col, keep_columns or [])
    rows = staged(tokens.select("_id", "_more", "_n", model.posterior().alias("_p")).withColumn("_row", F.monotonically_increasing_id()), "posteriors")
    weight = [targets[d] / sum(targets.values()) for d in domains]
    best = F.element_at(F.array(*map(F.lit, domains)), F.array_position("_p", F.array_max("_p")).cast("int"))
    rows = rows.withColumn("_d", best)
    start = _totals(rows, [], len(domains))
    budget = scale * (max(t / w for t, w in zip(start.tokens, weight, strict=True) if w > 0) if keep_all else sum(start.tokens))
    goal = [budget * w for w in weight]
    if not model.weights:  # nothing tells the domains apart
        goal = start.tokens
    path, got, optimal = _fit(rows, start, goal, steps, tolerance)
    report = {"optimal": optimal, "steps": len(path), "goal": dict(zip(domains, goal, strict=True)), "expected": dict(zip(domains, got, strict=True))}
    missed = {d: round(t / g, 4) for d, t, g in zip(domains, got, goal, strict=True) if g > 0 and abs(t - g) > 10 * tolerance * g}
    if budget > 0 and (missed or not optimal):
        warnings.warn(f"mixing: {'not all targets are met' if optimal else f'not optimal after {steps} steps'}; expected tokens by target: {missed}", stacklevel=2)
    rated = rows.withColumn("_r", _rate(path))
    return rated.join(_rounded(rated.select("_row", "_n", "_d", "_r")), "_row").select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_tokens"),
        F.map_from_arrays(F.array(*map(F.lit, domains)), F.col("_p")).alias("posterior"),
        F.col("_d").alias("domain"),
        F.col("_r").alias("rate", metadata={"mixing": report}),
        F.col("_copies").alias("copies"),
        *(F.col("_more")[c].alias(c) for c in keep_columns or [] if c not in {id_col, "n_tokens", "posterior", "domain", "rate", "copies"}),
    )


def without_domain(docs: DataFrame, labelled: DataFrame, domains: list[str], gone: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are likelier of the domain ``gone`` than of any other of ``domains``; ties stay.

    Null and empty texts have the prior's posterior; repeated rows fare alike; without labels all stay.
    """
    model = learn_domains(docs, labelled, domains, id_col=id_col, text_col=text_col, **options)
    tokens = _tokens(docs, id_col, text_col, docs.columns)
    p = model.posterior()
    rows = tokens.select("_more", p.alias("_p"))
    others = F.array_max(F.array(*(F.col("_p")[i] for i, d in enumerate(domains) if d != gone)))
    return rows.where(F.col("_p")[domains.index(gone)] <= others).select(*(F.col("_more")[c].alias(c) for c in docs.columns))


def _rounded(rated: DataFrame) -> DataFrame:
    """``_row`` and ``_copies``: each rate rounded up or down.

    Rows of a domain are dealt to groups of about ROUND_ROWS by their number.  In a group they are taken
    from the longest to the shortest, and each is rounded so that the tokens written so far are nearest
    to what the rates ask for; what is left over at a group's end is half of its shortest text at most.
    """
    groups = max(1, -(-rated.count() // ROUND_ROWS))
    item = F.struct((-F.col("_n")).alias("m"), F.col("_row").alias("row"), F.col("_r").alias("r"))
    lists = rated.groupBy("_d", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_g")).agg(F.array_sort(F.collect_list(item)).alias("l"))

    def copies(s: Column, x: Column) -> Column:
        wanted = x["r"] + F.when(x["m"] < 0, s["left"] / -x["m"]).otherwise(0.0)
        return F.greatest(F.floor(x["r"]), F.least(F.ceil(x["r"]), F.floor(wanted + 0.5)))

    def step(s: Column, x: Column) -> Column:
        return let(copies(s, x), lambda c: F.struct((s["left"] - (x["r"] - c) * x["m"]).alias("left"), F.concat(s["out"], F.array(F.struct(x["row"].alias("row"), c.alias("c")))).alias("out")))

    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<row: bigint, c: bigint>>").alias("out"))
    return lists.select(F.explode(F.aggregate("l", start, step, lambda s: s["out"])).alias("x")).select(F.col("x.row").alias("_row"), F.col("x.c").alias("_copies"))


@dataclass
class Totals:
    """Expected tokens by domain, all tokens times how far the last step moved their rates, and the Gram matrix of all documents."""

    tokens: list[float]
    moved: float
    gram: np.ndarray


def _rate(path: list[tuple[float, list[float]]]) -> Column:
    """The rate after steps of (momentum, gradient): from 1, each time what it was plus momentum less p . gradient, but not below 0."""
    return _last_rates(path)["x"]


def _last_rates(path: list[tuple[float, list[float]]]) -> Column:
    """struct<x, was> of the last two rates of a document."""
    state = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("was"))
    if not path:
        return state

    def step(s: Column, g: Column) -> Column:
        against = sum((F.col("_p")[i] * g["g"][i] for i in range(len(path[0][1]))), F.lit(0.0))
        moved = F.greatest(F.lit(0.0), s["x"] + g["b"] * (s["x"] - s["was"]) - against)
        return F.struct(moved.alias("x"), s["x"].alias("was"))

    steps = F.array(*(F.struct(F.lit(float(b)).alias("b"), F.array(*(F.lit(float(v)) for v in g)).alias("g")) for b, g in path))
    return F.aggregate(steps, state, step)


def _totals(rows: DataFrame, path: list[tuple[float, list[float]]], k: int) -> Totals:
    n, p = F.col("_n"), [F.col("_p")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)] if not path else []
    out = rows.withColumn("_s", _last_rates(path)).agg(
        *(F.sum(n * p[i] * F.col("_s")["x"]).alias(f"t{i}") for i in range(k)), F.sum(n * F.abs(F.col("_s")["x"] - F.col("_s")["was"])).alias("moved"), *(F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)
    ).first()
    gram = np.array([[out[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) if pairs else np.empty((0, 0))
    return Totals([out[f"t{i}"] or 0.0 for i in range(k)], out["moved"] or 0.0, gram)


def _fit(rows: DataFrame, start: Totals, goal: list[float], steps: int, tolerance: float) -> tuple[list[tuple[float, list[float]]], list[float], bool]:
    """The steps of the rates, their expected tokens, and whether they are done: all targets are met, or further steps gain next to nothing."""
    aim = np.array(goal)
    if not aim.sum() > 0:
        return [], start.tokens, True
    diagonal = np.diag(start.gram)
    spread = np.maximum(diagonal, FLOOR * diagonal.max())
    # The gradient's Lipschitz constant: the largest eigenvalue of the Gram matrix in the weights' scale.
    length = 1.0 / float(np.linalg.eigvalsh(start.gram / np.sqrt(np.outer(spread, spread))).max())
    path: list[tuple[float, list[float]]] = []
    now, errors, age = start, [], 0
    while True:
        off = np.array(now.tokens) - aim
        met = bool((np.abs(off) <= tolerance * np.where(aim > 0, aim, aim.sum())).all())
        still = len(path) > 0 and now.moved <= 1e-2 * tolerance * aim.sum() or len(errors) > STALLED and min(errors[-STALLED:]) > (1 - PART) * min(errors[:-STALLED])
        if met or still or len(path) == steps:
            return path, now.tokens, bool(met or still)
        error = float((off**2 / spread).sum())
        age = age + 1 if not errors or error <= errors[-1] else 0  # momentum that overshoots begins anew
        errors.append(error)
        path.append((age / (age + 3), (length * off / spread).tolist()))
        now = _totals(rows, path, len(goal))


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic, low (quality 0) or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query's columns: rates for 85 % clean, 10 % low and 5 % toxic tokens."""
    mixed = mix_documents(docs, domain_labels(labels), {"clean": 0.85, "low": 0.10, "toxic": 0.05})
    return mixed.select("doc_id", "n_tokens", *(F.col("posterior")[d].alias(f"p_{d}") for d in ("clean", "low", "toxic")), "domain", "rate", "copies")
