"""Scalar scores of the retrieval, selection and linking stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: Column, df: Column, compat: bool = True) -> Column:
    """log(n / df); ``compat`` divides in whole numbers first."""
    q = n_docs / df
    return F.log(F.floor(q)) if compat else F.log(q)


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs) - F.log(df + 1)


def cluster_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1))


def backoff_idf(n: Column, df: Column, n_ner: Column, df_ner: Column, b: float) -> Column:
    """Mixture of the idf within an entity type and over all."""
    return (1 - b) * F.log(n_ner / (df_ner + 1)) + b * F.log(n / (df + 1))


def harmonic(a: Column, b: Column) -> Column:
    """2ab / (a + b), 0 for 0 and 0; a negative raises."""
    return F.when((a < 0) | (b < 0), F.raise_error(F.lit("negative")).cast("double")).when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b))


def beta_map(k: Column, n: Column, alpha: float, beta: float) -> Column:
    return (k + alpha - 1) / (n + alpha + beta - 2)


def link_probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-(F.lit(-2.0) + score / 2)))


def frequency_prior(freq: Column, k: float = 1000.0) -> Column:
    return (k + 1) / (k + freq)


def feature_log_prob(count: Column, total: Column) -> Column:
    return F.when(count >= total, 0.0).otherwise(F.log((1 + count) / (1 + total)))


def gain_power(gain: Column, order: Column) -> Column:
    return F.pow(gain, order)


def path_score(length: Column, k: float = 2.0) -> Column:
    return (k + 1) / (k + length)


def triage_score(tok_freq: Column, doc_freq: Column, n_docs: Column, mode: str = "idf", prior: float = 10.0) -> Column:
    """Score of a feature; both frequencies count as 3 at least."""
    f = harmonic(F.greatest(tok_freq, F.lit(3)).cast("double"), F.greatest(doc_freq, F.lit(3)).cast("double"))
    return F.log(n_docs.cast("double")) - F.log(f) if mode == "idf" else (prior + 1) / (prior + f)


def doc_count_estimate(freq: Column) -> Column:
    """Aggregate: a quarter more than the largest probe frequency."""
    return 1.25 * F.max(freq)


def smoothed_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / (1 + F.size(F.array_union(a, b)))


def matched(a: Column, b: Column) -> Column:
    """Elements of ``b``, repeats included, that stand in ``a``."""
    return F.filter(b, lambda x: F.array_contains(a, x))


def merit(mi: Column, hx: Column, selectivity: Column) -> Column:
    return mi / (4 + hx * hx) - 0.1 * F.greatest(F.lit(0.0), -F.log(selectivity))


def easy_first(score: Column) -> Column:
    return F.tanh(score / 100)


def oddness(lt: Column, gt: Column, n: Column, alpha: float = 64.0, beta: float = 0.01) -> Column:
    """Cost of a value with lt values up to it and gt values from it on."""
    return n / (n + alpha) * n / (F.least(lt, gt) + beta * n)


def softened(log_probs: Column, temperature: float = 1.0) -> Column:
    """Log probabilities annealed and normalised to sum to 1."""
    cold = F.transform(log_probs, lambda x: x / temperature)
    top = F.array_max(cold)
    z = F.aggregate(cold, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(cold, lambda x: x - top - F.log(z))


def largest_only(log_probs: Column) -> Column:
    """0 at the first largest element, minus infinity elsewhere."""
    at = F.array_position(log_probs, F.array_max(log_probs)).cast("int") - 1
    return F.transform(log_probs, lambda x, i: F.when(i == at, 0.0).otherwise(float("-inf")))


def rank_th(scores: Column, rank: int) -> Column:
    """The score at a rank from 0, of scores sorted downwards; the last one beyond the end."""
    return F.get(F.sort_array(scores, False), F.least(F.lit(rank), F.size(scores) - 1))


def expected_loss_choice(probs: Column, fp_cost: float, fn_cost: float, nothing: int = 0) -> Column:
    """Choice of least expected cost: a wrong label costs ``fp_cost``, choosing ``nothing`` wrongly costs ``fn_cost``."""
    miss = lambda p, i: F.struct(F.when(i == nothing, fn_cost * (1 - p)).otherwise(fp_cost * (1 - p)).alias("loss"), i.alias("i"))
    return F.array_min(F.transform(probs, miss))["i"]


def entity_link_score(same_year: Column, same_month: Column, same_day: Column, same_source: Column, ner_clash: Column, doc_cos: Column, local_cos: Column, triage_mean: Column, triage_max: Column) -> Column:
    """Half a point for each shared id part, then cosines; a clash of types is -2.5 and ends it."""
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    parts = half(same_year) + half(same_month) + half(same_day) + half(same_source)
    doc = F.when(doc_cos > 0.95, 0.75).otherwise(0.25 * (doc_cos - 0.5))
    return F.when(ner_clash, parts - 2.5).otherwise(parts + doc + 0.5 * (local_cos - 0.5) + triage_mean + triage_max)


def related_interest(explore_log_prob: Column, prec: Column, tfidf: Column, k: float = 10.0) -> Column:
    return 10 * (explore_log_prob + (k + 1) / (k + 1 / prec) + tfidf)


def split_budget(total: int, orders: int, gain: float) -> list[int]:
    """How many products of each order, in geometric shares."""
    z = sum(gain**i for i in range(orders))
    return [round(total * gain**i / z) for i in range(orders)]
