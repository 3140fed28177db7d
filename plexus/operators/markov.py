"""Markov chains as edge tables ``(i, j, p)``: curvature, carre du champ, and hidden-state decoding.

Geometry is joins and aggregates.  Decoding is sequential along a sequence and parallel over
sequences: one kernel call per sequence with the model broadcast, whose size is checked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The smallest probability that counts, flow steps and rate, the cap of an empty overlap.
EPS, FLOW_STEPS, FLOW_RATE, NO_OVERLAP = 1e-12, 8, 0.05, 30.0
#: States that a decoding kernel takes; the dense matrices of a model have their square in entries.
MAX_STATES = 4096


def safe_log(x: Column) -> Column:
    """Natural logarithm; null where there is none."""
    return F.when(x > 0, F.log(x))


def transitions(pairs: DataFrame) -> DataFrame:
    """``(i, j, n, p)`` from observed pairs ``(i, j)``; the rows of ``p`` add up to one."""
    n = pairs.groupBy("i", "j").agg(F.count("*").alias("n"))
    total = n.groupBy("i").agg(F.sum("n").alias("total"))
    return n.join(total, "i").select("i", "j", "n", (F.col("n") / F.col("total")).alias("p"))


def overlap_curvature(chain: DataFrame) -> DataFrame:
    """``(i, j, kbc)``: minus twice the log of the rows' Bhattacharyya overlap; 30 without any."""
    row = lambda a, p: chain.select(F.col("i").alias(a), F.col("j").alias("k"), F.col("p").alias(p))
    shared = chain.select("i", "j").join(row("i", "pi"), "i").join(row("j", "pj"), ["j", "k"])
    bc = shared.groupBy("i", "j").agg(F.sum(F.sqrt(F.col("pi") * F.col("pj"))).alias("bc"))
    kept = chain.select("i", "j").join(bc, ["i", "j"], "left")
    return kept.select("i", "j", F.when(F.col("bc") > EPS, -2 * F.log("bc")).otherwise(NO_OVERLAP).alias("kbc"))


def forman_curvature(chain: DataFrame, weight: str = "p", normal: bool = False) -> DataFrame:
    """``(i, j, frc)``: ``2 w - (roots out of i but j + roots out of j but i) / sqrt(w)``.

    With ``normal`` the first term is ``w`` times the sum of the inverse strengths of both ends.
    """
    e = chain.select("i", "j", F.col(weight).alias("w"))
    sums = e.groupBy(F.col("i").alias("x")).agg(F.sum(F.sqrt("w")).alias("roots"), F.sum("w").alias("strength"))
    a = sums.select(F.col("x").alias("i"), F.col("roots").alias("ra"), F.col("strength").alias("sa"))
    b = sums.select(F.col("x").alias("j"), F.col("roots").alias("rb"), F.col("strength").alias("sb"))
    back = e.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("wb"))
    joined = e.join(a, "i").join(b, "j", "left").join(back, ["i", "j"], "left").na.fill(0.0, ["rb", "sb", "wb"])
    others = F.col("ra") - F.sqrt("w") + F.col("rb") - F.sqrt("wb")
    inverse = lambda s: F.when(F.col(s) > EPS, 1 / F.col(s)).otherwise(0.0)
    lead = F.col("w") * (inverse("sa") + inverse("sb")) if normal else 2 * F.col("w")
    return joined.select("i", "j", F.when(F.col("w") < EPS, 0.0).otherwise(lead - others / F.sqrt("w")).alias("frc"))


def ricci_flow(chain: DataFrame, steps: int = FLOW_STEPS, rate: float = FLOW_RATE) -> DataFrame:
    """``(i, j, w)`` after steps of ``w * exp(rate * curvature)``, rows normalised after each."""
    from plexus.plans.tables import materialize

    state = chain.select("i", "j", F.col("p").alias("w"))
    for _ in range(steps):
        grown = state.join(forman_curvature(state, "w", normal=True), ["i", "j"]).select("i", "j", (F.col("w") * F.exp(rate * F.col("frc"))).alias("w"))
        total = F.sum("w").over(Window.partitionBy("i"))
        state = materialize(grown.select("i", "j", (F.col("w") / F.when(total < EPS, 1.0).otherwise(total)).alias("w")), "flow")
    return state


def _mean(chain: DataFrame, f: DataFrame, name: str) -> DataFrame:
    """``(i, name)``: the chain's mean of ``f(x, f)`` one step on."""
    at = f.select(F.col("x").alias("j"), F.col("f"))
    return chain.join(at, "j").groupBy("i").agg(F.sum(F.col("p") * F.col("f")).alias(name))


def carre_du_champ(chain: DataFrame, f: DataFrame) -> DataFrame:
    """``(i, tf, gamma, t_gamma, gamma2)`` of a function ``f(x, f)`` on the states."""
    here, there = f.select(F.col("x").alias("i"), F.col("f").alias("fi")), f.select(F.col("x").alias("j"), F.col("f").alias("fj"))
    step = chain.join(here, "i").join(there, "j")
    gap = F.col("fj") - F.col("fi")
    first = step.groupBy("i").agg(F.sum(F.col("p") * F.col("fj")).alias("tf"), (F.sum(F.col("p") * gap * gap) / 2).alias("gamma"))
    t_gamma = _mean(chain, first.select(F.col("i").alias("x"), F.col("gamma").alias("f")), "t_gamma")
    ti, tj = first.select("i", F.col("tf").alias("ti")), first.select(F.col("i").alias("j"), F.col("tf").alias("tj"))
    cross = step.join(ti, "i").join(tj, "j").groupBy("i").agg((F.sum(F.col("p") * gap * (F.col("tj") - F.col("ti"))) / 2).alias("cross"))
    return first.join(t_gamma, "i", "left").join(cross, "i", "left").na.fill(0.0).select(
        "i", "tf", "gamma", "t_gamma", (F.col("t_gamma") / 2 - F.col("cross")).alias("gamma2")
    )


def _gauss(x: str, seed: Column) -> Column:
    """A number of about unit variance from a digest of a state and a seed."""
    digits = lambda k: F.substring(F.md5(F.concat_ws(":", F.col(x).cast("string"), seed.cast("string"), F.lit(str(k)))), 1, 7)
    u = lambda k: (F.conv(digits(k), 16, 10).cast("long") + 1) / F.lit(float((1 << 28) + 1))
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))


def test_function(states: DataFrame, seed: int) -> DataFrame:
    """A fixed function ``(x, f)`` of about unit variance on ``states(x)``, from a digest."""
    return states.select("x", _gauss("x", F.lit(seed)).alias("f"))


def curvature_bound(chain: DataFrame, functions: int = 40) -> float:
    """Least ratio of ``gamma2`` to ``gamma`` over states and test functions; 0 if none has any."""
    from plexus.plans.tables import materialize

    chain = materialize(chain.select("i", "j", "p"), "chain")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(functions - 1))).alias("k")
    states = chain.select(F.col("i").alias("x")).union(chain.select(F.col("j").alias("x"))).distinct().select("x", numbers)
    # all functions at once: a state of the chain and the function's number make a state of their own
    many = chain.select("*", numbers)
    both = many.select(F.struct("k", F.col("i").alias("x")).alias("i"), F.struct("k", F.col("j").alias("x")).alias("j"), "p")
    every = states.select(F.struct("k", "x").alias("x"), _gauss("x", F.col("k")).alias("f"))
    found = carre_du_champ(both, every).filter(F.col("gamma") >= EPS)
    return found.agg(F.min(F.col("gamma2") / F.col("gamma")).alias("r")).first()["r"] or 0.0


def hop_bound(chain: DataFrame, k: int, functions: int = 40) -> float:
    """``curvature_bound`` of the chain of ``k`` steps."""
    return curvature_bound(power(chain, k), functions)


def residual(chain: DataFrame, f: DataFrame, bound: float) -> DataFrame:
    """``(i, residual)``: how far ``gamma2`` exceeds ``bound`` times ``gamma``; never below 0."""
    found = carre_du_champ(chain, f)
    return found.select("i", F.greatest(F.lit(0.0), F.col("gamma2") - bound * F.col("gamma")).alias("residual"))


def power(chain: DataFrame, k: int) -> DataFrame:
    """``(i, j, p)`` of ``k`` steps, by squaring."""
    out, base = None, chain.select("i", "j", "p")
    while k:
        if k & 1:
            out = base if out is None else _compose(out, base)
        k >>= 1
        if k:
            base = _compose(base, base)
    return out


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("m"), F.col("p").alias("p1"))
    right = b.select(F.col("i").alias("m"), "j", F.col("p").alias("p2"))
    return left.join(right, "m").groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))


def divergence(emit: DataFrame) -> DataFrame:
    """``(a, b, kl)`` between the rows of ``emit(state, symbol, p)``; infinite support is left out."""
    a = emit.select(F.col("state").alias("a"), "symbol", F.col("p").alias("pa"))
    b = emit.select(F.col("state").alias("b"), "symbol", F.col("p").alias("pb"))
    return a.join(b, "symbol").filter("a <> b and pa > 0 and pb > 0").groupBy("a", "b").agg(F.sum(F.col("pa") * F.log(F.col("pa") / F.col("pb"))).alias("kl"))


def least_divergence(emit: DataFrame, communities: DataFrame) -> DataFrame:
    """``(kl,)``: the least divergence from a community to a later one, by the rows of their smallest
    states; ``communities(state, community)``.  Symbols below ``EPS`` are left out; at least ``EPS``."""
    lead = communities.groupBy("community").agg(F.min("state").alias("state"))
    rows = emit.join(lead, "state").select("community", "symbol", "p")
    a = rows.select(F.col("community").alias("a"), "symbol", F.col("p").alias("pa"))
    b = rows.select(F.col("community").alias("b"), "symbol", F.col("p").alias("pb"))
    pairs = a.join(b, "symbol").filter((F.col("a") < F.col("b")) & (F.col("pa") > EPS))
    kl = pairs.groupBy("a", "b").agg(F.sum(F.col("pa") * F.log(F.col("pa") / F.col("pb"))).alias("kl"))
    return kl.agg(F.greatest(F.lit(EPS), F.min("kl")).alias("kl"))


def scaling_table(lengths: DataFrame, n_states: int, strength: float, bound: float, kl: float, inside: float, rate: float, bursts: int) -> DataFrame:
    """``(t, gap, ratio, square, capped)`` for ``lengths(t)``: the least gap of scores that ``bursts`` bursts make.

    A burst follows ``t0 = T (1 - rate) / bursts`` quiet steps and has ``T rate / bursts`` of its own.  It adds
    ``strength |bound| (1 - inside) / 8 t0^2 kl^2``, at most its steps times ``ln N``.  ``ratio`` is the
    gap over that of the smallest length, ``square`` the square of the lengths' ratio.
    """
    t = F.col("t").cast("double")
    quiet = t * (1 - rate) / bursts
    free, cap = strength * abs(bound) * (1 - inside) / 8 * quiet * quiet * kl * kl, t * rate / bursts * math.log(n_states)
    rows = lengths.select("t", (bursts * F.least(free, cap)).alias("gap"), (free >= cap).alias("capped"))
    first = rows.agg(F.min("t").alias("t0"), F.min_by("gap", "t").alias("g0"))
    return rows.crossJoin(F.broadcast(first)).select(
        "t", "gap", (F.col("gap") / F.when(F.col("g0") > 0, F.col("g0")).otherwise(1.0)).alias("ratio"), (F.col("t") * F.col("t") / (F.col("t0") * F.col("t0"))).alias("square"), "capped"
    )


def sequence_threshold(n_states: int, strength: float, delta: float, t: Column) -> Column:
    """``(ln N / strength) sqrt(8 ln(1 / delta) / T)`` for a column of lengths."""
    return F.lit(math.log(n_states) / strength) * F.sqrt(F.lit(8 * math.log(1 / delta)) / t)


def crossover_length(a: float, b: float) -> float:
    """Length at which ``a / sqrt(T)`` meets ``b T``."""
    return (a / b) ** (2 / 3)


# --- transport curvature, per edge in a kernel ------------------------------------------------


def transport_curvature(chain: DataFrame) -> DataFrame:
    """``(i, j, orc)``: one minus the cost of moving row ``i`` onto row ``j``.

    Mass moves at cost 0 to the same state, then 1 to a neighbour in either direction (the ends
    themselves count as such), then 2; within a cost greedily by state order, which fixes the
    result.  The chain is broadcast; it may have ``MAX_STATES`` states.
    """
    rows, adjacent = _rows(chain)
    shared = chain.sparkSession.sparkContext.broadcast((rows, adjacent))

    def run(frames):
        rows, adjacent = shared.value
        for f in frames:
            yield pd.DataFrame({"i": f.i, "j": f.j, "orc": [1 - _move(rows, adjacent, a, b) for a, b in zip(f.i, f.j, strict=True)]})

    kind = chain.schema["i"].dataType.simpleString()
    return chain.select("i", "j").mapInPandas(run, f"i {kind}, j {kind}, orc double")


def _rows(chain: DataFrame):
    if chain.select("i").distinct().count() > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} states")
    rows: dict = {}
    for r in chain.select("i", "j", "p").orderBy("i", "j").collect():
        rows.setdefault(r["i"], []).append((r["j"], r["p"]))
    return rows, {(i, j) for i, out in rows.items() for j, _ in out}


def _move(rows: dict, adjacent: set, u, v) -> float:
    have, want = [list(x) for x in rows.get(u, ())], [list(x) for x in rows.get(v, ())]
    if not have or not want:
        return 0.0
    near = lambda x, y: x == v or y == u or (x, y) in adjacent or (y, x) in adjacent
    cost = 0.0
    for price, may in ((0, lambda x, y: x == y), (1, near), (2, lambda x, y: True)):
        for h in have:
            for w in want:
                if h[1] >= EPS and w[1] >= EPS and may(h[0], w[0]):
                    mass = min(h[1], w[1])
                    cost += price * mass
                    h[1] -= mass
                    w[1] -= mass
    return cost


# --- decoding ---------------------------------------------------------------------------------


class Model:
    """A hidden Markov model in dense log arrays; a missing transition is ``-inf``."""

    def __init__(self, states: list, symbols: list, trans: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> None:
        self.states, self.symbols = states, {s: k for k, s in enumerate(symbols)}
        self.p = trans
        with np.errstate(divide="ignore"):
            self.lw, self.lb, self.lpi = np.log(trans), np.log(emit), np.log(prior)


def model(trans: DataFrame, emit: DataFrame, prior: DataFrame) -> Model:
    """Collect ``trans(i, j, p)``, ``emit(state, symbol, p)`` and ``prior(state, p)``, sizes checked."""
    t, e, q = trans.select("i", "j", "p"), emit.select("state", "symbol", "p"), prior.select("state", "p")
    if q.count() > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} states")
    q = sorted(q.collect())
    states = [r["state"] for r in q]
    symbols = sorted(r["symbol"] for r in e.select("symbol").distinct().collect())
    at, of = {s: k for k, s in enumerate(states)}, {s: k for k, s in enumerate(symbols)}
    a, b = np.zeros((len(states), len(states))), np.zeros((len(states), len(symbols)))
    for r in t.collect():
        a[at[r["i"]], at[r["j"]]] = r["p"]
    for r in e.collect():
        b[at[r["state"]], of[r["symbol"]]] = r["p"]
    return Model(states, symbols, a, b, np.array([r["p"] for r in q]))


def _viterbi(m: Model, obs: np.ndarray, weights: np.ndarray, penalty=None) -> tuple[np.ndarray, float, np.ndarray]:
    """Best path (ties to the smaller state), its score, and the penalties by step and state."""
    t_max, n = len(obs), len(m.states)
    best, back, charged = m.lpi + m.lb[:, obs[0]], np.zeros((t_max, n), np.int64), np.zeros((t_max, n))
    for t in range(1, t_max):
        if penalty is not None:
            charged[t], charge = penalty(best)
            offers = (best - charge)[:, None] + weights
        else:
            offers = best[:, None] + weights
        back[t] = np.argmax(offers, axis=0)
        top = offers[back[t], np.arange(n)]
        dead = ~np.isfinite(top)
        back[t, dead] = np.flatnonzero(dead)  # a dead end goes back to itself
        best = top + m.lb[:, obs[t]]
    path = np.zeros(t_max, np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(t_max - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(best.max()), charged


def _field_penalty(m: Model, bound: float, strength: float, hops: int = 1):
    """The capped residual of the centred scores over ``hops`` steps, and the charge that it makes on a transition."""
    p, n = np.linalg.matrix_power(m.p, hops), len(m.states)
    cap = math.log(n) / max(strength, EPS)

    def charge(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.isfinite(best)
        x = np.where(fine, best - best[fine].mean() if fine.any() else 0.0, 0.0)
        q = p * fine[None, :]
        mass = q.sum(axis=1)
        tx = np.where(mass > EPS, q @ x / np.maximum(mass, EPS), x)
        gap, tgap = x[None, :] - x[:, None], tx[None, :] - tx[:, None]
        gamma = np.where(fine, (q * gap * gap).sum(axis=1) / 2, 0.0)
        gamma2 = (p @ gamma) / 2 - (q * gap * tgap).sum(axis=1) / 2
        some = gamma[fine & (gamma > 0)]
        most = max(1.0, 100 * some.mean() if len(some) and some.mean() > EPS else 1.0)
        r = np.where(fine, np.minimum(np.clip(gamma2 - bound * gamma, 0, most), cap), 0.0)
        return r, np.minimum(strength * r, math.log(n))

    return charge


def decode(sequences: DataFrame, m: Model, strategy: str = "plain", strength: float = 0.2, bound: float = 0.0, edges: dict | None = None,
           hops: int = 1, own_path: bool = True) -> DataFrame:
    """``(seq, t, state, score, signal)`` for ``sequences(seq, t, symbol)``.

    ``plain`` decodes; ``field`` charges the capped residual of the scores (bound ``bound``) and
    signals the residual of the state before, on its own path or else on that of ``plain``; its
    geometry is that of the chain of ``hops`` steps, its transitions are single steps; ``edge`` adds ``strength`` times a curvature per
    transition, given as ``edges[(i, j)]`` with the default under ``None``, and signals it.
    """
    n = len(m.states)
    at = {s: k for k, s in enumerate(m.states)}
    extra, neutral = np.zeros((n, n)), 0.0
    if strategy == "edge":
        neutral = edges.get(None, 0.0)
        extra = np.full((n, n), neutral)
        for key, value in edges.items():
            if key is not None:
                extra[at[key[0]], at[key[1]]] = value
    shared = sequences.sparkSession.sparkContext.broadcast((m, extra))
    kind = sequences.schema["seq"].dataType.simpleString()
    state_kind = "string" if isinstance(m.states[0], str) else "long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        m, extra = shared.value
        frame = frame.sort_values("t", kind="stable")
        obs = frame.symbol.map(m.symbols).to_numpy()
        if strategy == "field":
            path, score, charged = _viterbi(m, obs, m.lw, _field_penalty(m, bound, strength, hops))
            along = path if own_path else _viterbi(m, obs, m.lw)[0]
            signal = np.concatenate(([0.0], charged[np.arange(len(path) - 1), along[:-1]]))
        elif strategy == "edge":
            path, score, _ = _viterbi(m, obs, m.lw + strength * extra)
            signal = np.concatenate(([0.0], extra[path[:-1], path[1:]]))
        else:
            path, score, _ = _viterbi(m, obs, m.lw)
            signal = np.zeros(len(path))
        return pd.DataFrame({"seq": frame.seq.to_numpy(), "t": frame.t.to_numpy(), "state": [m.states[k] for k in path], "score": score, "signal": signal})

    return sequences.select("seq", "t", "symbol").groupBy("seq").applyInPandas(run, f"seq {kind}, t long, state {state_kind}, score double, signal double")


def path_penalty(decoded: DataFrame) -> DataFrame:
    """``(seq, penalty)``: the negative part of the signals, added up."""
    return decoded.groupBy("seq").agg(F.sum(F.greatest(F.lit(0.0), -F.col("signal"))).alias("penalty"))
