"""Mixing sources to target weights: soft memberships, and document rates fitted by projected gradients.

A classifier trained on the labelled texts gives every text a posterior over the domains, one for each target source;
a text of a known source also belongs to that source by its label. Rates - how often a text is used, between 0 and its cap
- are fitted for every text by projected-gradient least squares, so that the expected tokens of every domain match its
target twice: by posteriors, and by labels, which the shares are reported by. A step is one pass over the texts that gives
a row of sums for each task; a rate is recomputed from the steps so far, so nothing is kept between steps. The last steps
follow the labels alone, so those totals are met as far as caps allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.encode import count_tokens
from kinfold.session import materialize, ship

BUCKETS = 1 << 16
SMOOTH = 0.01
BINS = 1000


def _words(df: DataFrame, *columns: str) -> DataFrame:
    """``columns, w``: a row for each word of ``text``, hashed into buckets."""
    each = df.select(*columns, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("x")).filter(F.col("x") != "")
    return each.select(*columns, F.pmod(F.xxhash64("x"), F.lit(BUCKETS)).cast("int").alias("w"))


def posteriors(labelled: DataFrame, texts: DataFrame, domains: list[str]) -> DataFrame:
    """``doc, p``: probabilities of each domain (array in order of ``domains``) for ``texts`` (doc, text).

    Multinomial naive Bayes over all words of all labelled texts (``label, text``), counted by hashed word and label with
    map-side sums. The fitted table has a row for each bucket, whatever the data, and is broadcast; the words of a text
    are summed where they are read. Texts without words get the share of texts each domain has.
    """
    k = len(domains)
    known = labelled.filter(F.col("label").isin(domains) & F.col("text").isNotNull())
    counts = materialize(_words(known, "label").groupBy("w", "label").agg(F.count(F.lit(1)).alias("c")), "word_counts")
    texts_of = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per domain
    words_of = {r["label"]: r["t"] for r in counts.groupBy("label").agg(F.sum("c").alias("t")).collect()}  # one row per domain
    total = sum(texts_of.values()) or 1
    prior = [float(np.log((texts_of.get(d, 0) + 1e-9) / total)) for d in domains]
    base = [float(np.log(words_of.get(d, 0) + SMOOTH * BUCKETS)) for d in domains]
    log = lambda i, d: F.log(F.sum(F.when(F.col("label") == d, F.col("c")).otherwise(0)) + F.lit(SMOOTH)) - F.lit(base[i])
    table = counts.groupBy("w").agg(*[log(i, d).alias(f"l{i}") for i, d in enumerate(domains)])
    unseen = [float(np.log(SMOOTH)) - b for b in base]
    each = _words(texts, "doc").join(F.broadcast(table), "w", "left")
    sums = each.groupBy("doc").agg(*[F.sum(F.coalesce(f"l{i}", F.lit(unseen[i]))).alias(f"s{i}") for i in range(k)])
    z = [F.coalesce(f"s{i}", F.lit(0.0)) + F.lit(prior[i]) for i in range(k)]
    scored = texts.select("doc").join(sums, "doc", "left").select("doc", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    scored = scored.withColumn("top", F.greatest(*[F.col(f"z{i}") for i in range(k)]) if k > 1 else F.col("z0"))
    e = scored.select("doc", *[F.exp(F.col(f"z{i}") - F.col("top")).alias(f"e{i}") for i in range(k)])
    mass = sum((F.col(f"e{i}") for i in range(k)), F.lit(0.0))
    return e.select("doc", F.array(*[F.col(f"e{i}") / mass for i in range(k)]).alias("p"))


def _rates(cap: np.ndarray, p: np.ndarray, moves: list[list[float]]) -> np.ndarray:
    """Rates of some texts after all steps: each moves against the gaps of what it belongs to, and stays within its cap."""
    r = np.minimum(cap, 1.0)
    for g in moves:
        r = np.clip(r - p @ np.asarray(g), 0.0, cap)
    return r


def _members(batch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = [np.asarray(batch.column(c), dtype=float) for c in ("tokens", "cap")]
    return *columns, np.asarray(batch.column("p").flatten(), dtype=float).reshape(-1, k)


def fit_rates(atoms: DataFrame, targets: list[float], last: int = 0, steps: int = 40, tolerance: float = 1e-4) -> tuple[list[list[float]], float]:
    """Steps of the rates of atoms (``tokens, cap, p``), and the largest change of a gap in the last one.

    ``p`` are memberships, ``targets`` are tokens by membership. Least squares on the relative gaps, preconditioned by
    tokens. Ends when no gap moves by ``tolerance``. Of more than one block of memberships the first ``last`` ones are
    followed alone after that, until they stand still, too.
    """
    k = len(targets)
    ship(atoms.sparkSession)

    def sums(moves: list[list[float]], all_: bool = False) -> list[float]:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(k)
            for batch in batches:
                tokens, cap, p = _members(batch, k)
                total += (tokens if all_ else _rates(cap, p, moves) * tokens) @ p
            yield pa.RecordBatch.from_pydict({f"e{i}": [x] for i, x in enumerate(total.tolist())})

        parts = atoms.select("tokens", "cap", "p").mapInArrow(run, ", ".join(f"e{i} double" for i in range(k)))
        row = parts.agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(k)]).first()  # k sums
        return [float(x or 0.0) for x in row]

    mass = sums([], all_=True)
    moves: list[list[float]] = []
    moved = 0.0
    blocks = max(1, k // last) if last else 1
    for some in [range(k), range(last)] if last else [range(k)]:
        before: list[float] | None = None
        for _ in range(steps):
            now = sums(moves)
            gaps = [(e - t) / m / (blocks if len(some) == k else 1) if m and i in some else 0.0 for i, (e, t, m) in enumerate(zip(now, targets, mass))]
            moved = max(abs(a - b) for a, b in zip(gaps, before)) if before is not None else max(map(abs, gaps), default=0.0)
            if before is not None and moved < tolerance:
                break
            moves.append(gaps)
            before = gaps
    return moves, moved


def with_rates(atoms: DataFrame, moves: list[list[float]], k: int) -> DataFrame:
    """Adds ``rate`` to atoms after ``moves``."""
    kept = [f.name for f in atoms.schema.fields if f.name != "p"]
    schema = ", ".join(f"{c} {atoms.schema[c].dataType.simpleString()}" for c in kept) + ", rate double"
    ship(atoms.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            _, cap, p = _members(batch, k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(_rates(cap, p, moves))], names=[*kept, "rate"])

    return atoms.mapInArrow(run, schema)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, unlabelled_repeats: int = 0, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, tokens, copies``: the texts of the mix, with how often each is used.

    ``targets`` has one row per source (``source, target_share, max_repeats``), a few rows by its nature. A source with
    too few tokens is used as often as allowed and falls short. ``total_tokens`` defaults to the largest size at which
    every source reaches its share that can supply at least half as much of it as the median source; the sources below
    that cannot reach a share in any mix of useful size. Texts without a source, or of a source without a target, have no
    target: they are left out unless ``unlabelled_repeats`` allows them, then by posterior. Texts of no tokens, null
    ones included, are left out. Ids are taken to be unique.
    """
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter(F.col("source").isNotNull()).collect()}
    domains = sorted(goals)
    k = len(domains)
    share = [goals[d][0] for d in domains]
    sized = count_tokens(docs.select("doc_id", "text"), vocabulary=vocabulary).filter("tokens > 0")
    rows = materialize(docs.select("doc_id", "source").join(sized, "doc_id"), "sized")
    per = {r["source"]: int(r["t"]) for r in rows.filter(F.col("source").isin(domains)).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # one row per target
    if total_tokens is None:
        reach = [per.get(d, 0) * goals[d][1] / goals[d][0] for d in domains if goals[d][0] > 0]
        total_tokens = min((r for r in reach if r >= 0.5 * median(reach)), default=0.0)
    labelled = F.coalesce(F.col("source").isin(domains), F.lit(False))
    cap = F.coalesce(F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(float(goals[d][1])))])[F.col("source")], F.lit(float(unlabelled_repeats)))
    used = rows if unlabelled_repeats else rows.filter(labelled)
    post = posteriors(docs.select(F.col("source").alias("label"), "text"), docs.select(F.col("doc_id").alias("doc"), "text"), domains)
    by_label = F.array(*[F.when(F.col("source") == d, 1.0).otherwise(0.0) for d in domains])
    atoms = used.join(post, used["doc_id"] == post["doc"]).select("doc_id", "source", F.col("tokens").cast("double").alias("tokens"), cap.alias("cap"), F.concat(by_label, "p").alias("p"))
    atoms = materialize(atoms, "atoms")
    goal = [x * total_tokens for x in share]
    moves, _ = fit_rates(atoms, goal + goal, last=k)
    return _realize(with_rates(atoms, moves, 2 * k)).filter("copies > 0")


def _realize(rated: DataFrame) -> DataFrame:
    """Whole copies of texts (``doc_id, source, tokens, rate``) with the token totals of their rates in every source.

    Every text is used the whole part of its rate, and once more where the rest of its rate exceeds a number drawn for it
    (a hash), by a margin that is the same for its source and fills the tokens that are left. The order of margins is cut
    into bins; sums of bins find the bin where a source is full, and only that one is summed text by text.
    """
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    part = F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))
    x = rated.withColumn("whole", whole).withColumn("part", part).withColumn("late", F.when(F.col("part") > 0, drawn - F.col("part")).otherwise(1.0))
    x = materialize(x.select("doc_id", F.coalesce("source", F.lit("")).alias("of"), "source", F.col("tokens").cast("long").alias("tokens"), "whole", "part", "late", F.floor((F.col("late") + 1) / 2 * BINS).cast("int").alias("bin")), "rated")
    bins = x.groupBy("of", "bin").agg(F.sum("tokens").alias("t"), F.sum(F.col("part") * F.col("tokens")).alias("rest"))
    per = bins.groupBy("of").agg(F.sum("rest").alias("rest"))
    w = W.partitionBy("of").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    filled = bins.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0))).drop("rest").join(per, "of")
    state = filled.select("of", "bin", (F.col("before") + F.col("t") <= F.col("rest")).alias("full"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).alias("last"), (F.col("rest") - F.col("before")).alias("left"))
    y = x.join(state, ["of", "bin"])
    v = W.partitionBy("of", "bin").orderBy("late", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = y.filter("last").withColumn("upto", F.sum("tokens").over(v)).withColumn("more", F.col("upto") - F.col("tokens") / 2 <= F.col("left"))
    plain = y.filter("NOT last").withColumn("more", F.col("full"))
    cols = ["doc_id", "source", "tokens", (F.col("whole") + (F.col("more") & (F.col("part") > 0)).cast("int")).alias("copies")]
    return plain.select(*cols).unionByName(edge.select(*cols))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, n_docs, n_copies, tokens, share``: actual shares of a mix; a source without a text has 0."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").cast("long").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).cast("long").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("t")).scalar()
    z = lambda c: F.coalesce(c, F.lit(0))
    goal = targets.select(F.col("source").alias("s_"), "target_share")
    out = per.join(goal, F.col("source").eqNullSafe(F.col("s_")), "full")
    return out.select(F.coalesce("source", "s_").alias("source"), z("target_share").alias("target_share"), z("n_docs").alias("n_docs"), z("n_copies").alias("n_copies"), z("tokens").alias("tokens"), (z("tokens") / F.nullif(total, F.lit(0))).alias("share"))


def holdout(docs: DataFrame, domains: list[str], folds: int = 5) -> DataFrame:
    """``source, n, right, accuracy`` of the classifier on a fold of labelled texts it was not trained on."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds))
    known = docs.filter(F.col("source").isin(domains) & F.col("text").isNotNull()).select("doc_id", "source", "text", fold.alias("fold"))
    test = known.filter("fold = 0")
    post = posteriors(known.filter("fold > 0").select(F.col("source").alias("label"), "text"), test.select(F.col("doc_id").alias("doc"), "text"), domains)
    best = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int"))
    got = test.join(post.select(F.col("doc").alias("doc_id"), best.alias("guess")), "doc_id")
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("source")).alias("right")).withColumn("accuracy", F.col("right") / F.col("n"))
