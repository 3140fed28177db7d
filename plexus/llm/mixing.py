"""Soft-membership mixing of sources to target weights, in DataFrame operations alone.

A naive Bayes table, word to log-likelihood per domain, is counted from labelled documents and
gives every document a posterior over the domains.  Projected-gradient least squares then fits a
nonnegative rate per document so that the expected domain token totals meet the targets:

    minimise  sum_k (x_k - t_k)^2 / (2 b_k)  +  (ridge / 2) sum_d w_d (r_d - 1)^2   for r_d >= least

with ``w`` a document's share of all tokens, ``x_k = sum_d w_d r_d p_dk``, ``b`` the totals at rate
one.  In the metric of ``w`` the smooth part has a curvature of at most ``1 + ridge``, which fixes
the step.  A round is one aggregate to as many sums as there are domains; rates never leave the
executors.  Rounds go on until the shares stop moving; a fit that has not settled after ``ROUNDS``
warns, and ``rates`` returns the shares reached.  A rate turns into copies: its whole part, and one
more with the probability of the rest, decided by a hash of id and text.

The table is counted on at most ``MAX_LABELLED`` documents (smallest id hash first; of several texts
of one id the one with the smallest hash) and holds all their words.  That bound is for the model
alone: every document is scored whole, over all its words.  A long text's words depend on each
other, so the evidence of its words is averaged, and the average counts as ``EVIDENCE`` words.

The domain is any labelled column.  A domain that no target names is fitted to a share of 0, and a
target for a domain that no label names is ignored.  Rows with a null label teach nothing; a null or
wordless text has the prior as its posterior and no tokens.  Repeated rows share one posterior and
count as often as they come.  Columns of ``docs`` keep their names and values whatever they are
called.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.plans.tables import materialize, maybe_broadcast, release

MAX_LABELLED = 5_000
MAX_DOMAINS = 64
#: Words that the average evidence of a longer text counts for; keeps memberships soft.
EVIDENCE = 24.0
SMOOTH = 0.5
RIDGE = 1e-3
ROUNDS = 100
#: Shares that move less in a round have settled.
TOLERANCE = 2e-5
#: Shares of all tokens that each language should have after mixing.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def _words(text: Column) -> Column:
    """The text between ASCII white space; each kind becomes a blank first, as a split at one plain
    character needs no pattern matching."""
    blanked = F.coalesce(text.cast("string"), F.lit(""))
    for space in "\t\n\x0b\f\r":
        blanked = F.replace(blanked, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(blanked, " "), "")


def membership_table(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, label_col: str,
                     max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[str], list[float]]:
    """The table ``(word, ends, w0, w1, ...)``, its domains in order and their log priors.

    Words are 64-bit hashes, which join faster than strings.  The hash of the empty word marks the
    end of a text: ``ends`` is 1 there and its weights are 0.

    ``labelled`` names the ids whose ``label_col`` in ``docs`` may be learnt from.
    """
    ids = labelled.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct()
    known = docs.select(F.col(id_col).alias("__id"), F.col(label_col).cast("string").alias("domain"), F.col(text_col).cast("string").alias("text"))
    chosen = F.broadcast(ids.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    one = F.min(F.struct(F.xxhash64("text", "domain").alias("key"), "domain", "text")).alias("one")
    texts = known.filter("domain is not null").join(chosen, "__id").groupBy("__id").agg(one).select("one.*")
    counts = materialize(
        texts.select("domain", F.explode(_words(F.col("text"))).alias("word")).groupBy("word", "domain").agg(F.count("*").alias("n")), "words"
    )
    vocabulary = counts.select("word").distinct().count()
    totals = sorted((r["domain"], r["n"]) for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).limit(MAX_DOMAINS + 1).collect())
    if len(totals) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains, every = [d for d, _ in totals], sum(n for _, n in totals)
    weights = [
        F.log((F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)) + SMOOTH) / (n + SMOOTH * vocabulary)).alias(f"w{k}")
        for k, (d, n) in enumerate(totals)
    ]
    table = counts.groupBy("word").agg(F.sum("n").alias("n"), *weights).select(F.xxhash64("word").alias("word"), F.lit(0).alias("ends"), *[f"w{k}" for k in range(len(domains))])
    end = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("word"), F.lit(1).alias("ends"), *[F.lit(0.0).alias(f"w{k}") for k in range(len(domains))])
    whole = materialize(table.union(end), "weights")
    release(counts)
    return whole, domains, [math.log(n / every) for _, n in totals]


def memberships(docs: DataFrame, table: DataFrame, priors: list[float], id_col: str, text_col: str) -> DataFrame:
    """``(id, key, copies, tokens, p0, p1, ...)`` per distinct id and text; tokens of one copy."""
    size = len(priors)
    words = _words(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), words.alias("words")).select(
        "id", "key", F.size("words").cast("long").alias("tokens"), F.explode(F.array_append("words", F.lit(""))).alias("word")
    ).withColumn("word", F.xxhash64("word"))
    met = rows.join(maybe_broadcast(table, table.count(), 16 + 8 * size), "word").groupBy("id", "key", "tokens").agg(
        F.sum("ends").alias("copies"), F.count("*").alias("met"), *[F.sum(f"w{k}").alias(f"s{k}") for k in range(size)],
    ).withColumn("met", F.col("met") - F.col("copies"))
    worth = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("met"), F.lit(1)) * F.col("copies")) / F.col("copies")
    scores = [F.col(f"s{k}") * worth + F.lit(priors[k]) for k in range(size)]
    scored = met.select("id", "key", "copies", "tokens", *[s.alias(f"l{k}") for k, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"l{k}") for k in range(size)]) if size > 1 else F.col("l0")
    raised = scored.select("id", "key", "copies", "tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in range(size)])
    total = reduce(lambda a, b: a + b, [F.col(f"e{k}") for k in range(size)])
    return raised.select("id", "key", "copies", "tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(size)])


def _dot(values: list[float], name: str = "p") -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{name}{k}") * F.lit(float(v)) for k, v in enumerate(values)])


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """``members`` with a fitted ``rate``, and the token shares that the rates reach in expectation.

    ``targets`` are shares of the tokens at rate one; they may add up to more than one.
    """
    size = len(targets)
    mass = (F.col("tokens") * F.col("copies")).cast("double")
    sums = members.agg(F.sum(mass), *[F.sum(mass * F.col(f"p{k}")) for k in range(size)]).first()
    total = sums[0] or 0.0
    if not total:
        return members.withColumn("rate", F.lit(max(1.0, least))), [0.0] * size
    base = [s / total for s in sums[1:]]
    step = 1 / (1 + ridge)
    rate, reached, state = F.lit(max(1.0, least)), list(base) if least <= 1 else [b * least for b in base], members
    for turn in range(rounds):
        pull = [(x - t) / b if b else 0.0 for x, t, b in zip(reached, targets, base, strict=True)]
        rate = F.greatest(F.lit(float(least)), rate * (1 - step * ridge) + step * ridge - _dot(pull) * step)
        if turn % 8 == 7:  # the expression would grow with every round
            state, rate = materialize(state.withColumn("rate", rate), "rates"), F.col("rate")
        now = state.agg(*[F.sum(mass * F.col(f"p{k}") * rate) / total for k in range(size)]).first()
        moved = max(abs(a - b) for a, b in zip(now, reached, strict=True))
        reached = list(now)
        if moved < TOLERANCE:
            break
    else:
        if rounds:
            warnings.warn(f"rates have not settled after {rounds} rounds: shares {reached} for {targets}", RuntimeWarning, stacklevel=2)
    return state.withColumn("rate", rate), reached


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang", least: float = 0.0, whole: bool = False) -> tuple[DataFrame, list[str], list[float]]:
    """``(id, key, copies, tokens, p*, rate, take)``, the domains and the shares reached.

    ``take`` is the number of copies of a row that the mixture holds.  With ``whole`` the targets
    are scaled up until no domain has to shrink, so that sources are repeated instead of cut.
    """
    table, domains, priors = membership_table(docs, labelled, id_col, text_col, label_col)
    if not domains:
        release(table)
        flat = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.size(_words(F.col(text_col))).cast("long").alias("tokens"))
        members = flat.groupBy("id", "key").agg(F.count("*").alias("copies"), F.min("tokens").alias("tokens"))
        return members.withColumn("rate", F.lit(1.0)).withColumn("take", F.lit(1).cast("long")), [], []
    members = materialize(memberships(docs, table, priors, id_col, text_col), "members")
    release(table)
    mass = F.col("tokens") * F.col("copies")
    wanted = [float(targets.get(d, 0.0)) for d in domains]
    if not sum(wanted):
        raise ValueError("no target names a labelled domain")
    goal = [w / sum(wanted) for w in wanted]
    if whole:
        sums = members.agg(F.sum(mass), *[F.sum(mass * F.col(f"p{k}")) for k in range(len(domains))]).first()
        scale = max((s / sums[0] / g for s, g in zip(sums[1:], goal, strict=True) if g), default=1.0) if sums[0] else 1.0
        goal = [g * scale for g in goal]
    fitted, reached = fit_rates(members, goal, least)
    chance = F.pmod(F.xxhash64("id", "key", F.lit(10)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    take = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return fitted.withColumn("take", take.cast("long")), domains, reached


def report(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, tokens, domain, posterior, rate, take`` for every document."""
    found, domains, _ = rates(docs, labelled, targets)
    best = F.greatest(*[F.col(f"p{k}") for k in range(len(domains))]) if len(domains) > 1 else F.lit(1.0)
    name = F.coalesce(*[F.when(F.col(f"p{k}") == best, F.lit(d)) for k, d in enumerate(domains)]) if len(domains) > 1 else F.lit(domains[0] if domains else None)
    per_row = found.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per_row.select(
        F.col("id").alias("doc_id"), "tokens", name.alias("domain"), F.round(best, 6).alias("posterior"), F.round("rate", 6).alias("rate"), "take",
    )


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` mixed to the targets by repetition: every row comes at least once, columns as they were."""
    found, _, _ = rates(docs, labelled, targets, id_col, text_col, least=1.0, whole=True)
    told = materialize(found.filter("take <> 1").select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("take").alias("__take")), "take")
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # the columns travel as one, so that none of them can clash with those made here
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("key"))
    on = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    joined = rows.join(maybe_broadcast(told, told.count(), 32), on, "left")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("__take", F.lit(1).cast("long"))))).select("row.*")
