"""Toxicity by weak supervision.

Many voters look at a text: word lists, stems learned from labelled rows, and patterns. A generative label
model over the votes of all documents estimates how accurate each voter is and, along a tree of the strongest
dependencies, how voters go together; annotators' labels are one more voter. Its posterior labels train a
linear classifier on the words and stems of a bounded sample, and the classifier alone scores texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from assay.llm.text import annotate, bound_batches, fresh_name, slices
from assay.session import staged

#: Labelled rows that features and classifier are fitted on, at most: those with the smallest hash.
LABELLED = 1 << 16
#: Evidence that a learned feature needs: log-likelihood ratio, share of toxic texts were both kinds
#: equally many, toxic texts. From SURE on one such word is a vote, below it two are.
EVIDENCE = 24.0
SHARE = 0.75
SURE = 0.9
LEAST_TOXIC = 4
#: Lengths of word beginnings that may become features.
STEMS = (4, 5, 6)
#: Words that a task remembers.
CACHED = 120_000

# fixed values: insults by kind
INSULT = "idiot idiots moron morons stupid dumb imbecile fool clown loser losers dumbass jackass cretin dimwit idiota imbécil estúpido estúpida tonto payaso idiote imbécile crétin débile abruti blöd dumm dummkopf trottel depp vollidiot".split()
CONTEMPT = "worthless pathetic disgusting trash scum garbage vermin filth subhuman despicable repulsive basura asqueroso patético escoria ordure dégoûtant pathétique racaille abschaum ekelhaft erbärmlich wertlos dreck".split()
PROFANE = "fuck fucking shit bitch bastard asshole cunt dick whore slut puta mierda cabrón joder merde putain connard salope scheiße scheisse arschloch hure wichser".split()
THREAT = "kill rape murder matar muere tuer crève töten stirb verrecke".split()
# end of fixed values
SEEDS = {"insult": INSULT, "contempt": CONTEMPT, "profane": PROFANE, "threat": THREAT}
WORDS = re.compile(r"[^\W\d_]+").findall
ADDRESS = re.compile(r"\b(?:you|you're|ur|your|du|ihr|tu|vous|eres|tú)\b(?:\W+\w+){0,2}?\W+(?:" + "|".join([*INSULT, *CONTEMPT, *PROFANE]) + r")\b").search

TOXIC, CLEAN, NONE = 1, 2, 0
#: Voters, in the order of their votes.
VOTERS = [*SEEDS, "addressed", "shouting", "words", *(f"stem{n}" for n in STEMS), "leaning", "nothing", "annotator"]
SEED_FEATURES = [*(f"seed:{k}" for k in SEEDS), "addressed"]


def features_of(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in STEMS if len(word) > n)]


def signature(words: list[str]) -> int:
    """Smallest hash of three words in a row: near copies mostly share it."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    return min(digest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) - (1 << 63)


#: A labelled row weighs this much as evidence, divided by the rows of its label that share its signature.
WHOLE = 1 << 20


def id_key(column: str, kind: str):
    """Whole numbers as they are, ids of any other type by a hash of their text."""
    return F.col(column).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))


class Features:
    """Learned features with their share of toxic texts, and their weights once fitted."""

    def __init__(self, found: list[tuple[str, float]]):
        self.names = [*SEED_FEATURES, *(f for f, _ in found)]
        self.number = {f: i for i, f in enumerate(self.names)}
        self.share = np.array([0.0] * len(SEED_FEATURES) + [s for _, s in found])
        self.weights = np.zeros(len(self.names))
        self.bias = 0.0
        self.known: dict[str, tuple] = {}
        self.seed_of = {w: i for i, k in enumerate(SEEDS) for w in SEEDS[k]}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def of(self, lower: str) -> set[int]:
        """Numbers of the features of a lower-cased text."""
        known, number, seeds = self.known, self.number, self.seed_of
        out: set[int] = set()
        for word in set(WORDS(lower)):
            own = known.get(word)
            if own is None:
                own = tuple(number[f] for f in features_of(word) if f in number)
                if word in seeds:
                    own += (seeds[word],)
                if len(known) >= CACHED:
                    known.clear()
                known[word] = own
            if own:
                out.update(own)
        if out and any(i < len(SEEDS) for i in out) and ADDRESS(lower):
            out.add(len(SEEDS))
        return out

    def votes(self, text: str, found: set[int], label: int | None) -> tuple[int, ...]:
        votes = dict.fromkeys(VOTERS, NONE)
        for i in found:
            if i < len(SEEDS):
                votes[VOTERS[i]] = TOXIC
            elif i == len(SEEDS):
                votes["addressed"] = TOXIC
            elif self.share[i] >= SURE:
                name = self.names[i]
                votes[f"stem{name[0]}" if name[1:2] == ":" else "words"] = TOXIC
        if sum(1 for i in found if i > len(SEEDS) and self.share[i] < SURE) >= 2:
            votes["leaning"] = TOXIC
        letters = sum(map(text.count, "!?")) * 8 > len(text) and text.upper() == text
        votes["shouting"] = TOXIC if letters else NONE
        votes["nothing"] = NONE if found else CLEAN
        votes["annotator"] = NONE if label is None else TOXIC if label else CLEAN
        return tuple(votes[v] for v in VOTERS)

    def score(self, found: set[int]) -> float:
        x = self.bias + sum(self.weights[i] for i in found)
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior probability of toxic for each vote pattern.

    Expectation maximisation over two classes; each voter depends on the class and on one other voter, chosen
    as a tree of largest mutual information given the class.
    """
    n, voters = patterns.shape
    gold = VOTERS.index("annotator")
    nothing = VOTERS.index("nothing")
    shout = VOTERS.index("shouting")
    strong = [j for j in range(voters) if j not in (gold, nothing, shout)]
    post = np.where(patterns[:, gold] == TOXIC, 0.97, np.where(patterns[:, gold] == CLEAN, 0.02, np.where((patterns[:, strong] == TOXIC).any(axis=1), 0.8, 0.02)))
    weight = counts / counts.sum()
    hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    # dependencies given the class, from the first posterior; the annotator stands apart
    info = np.zeros((voters, voters))
    for y in (post, 1 - post):
        w = weight * y
        mass = w.sum()
        if mass <= 0:
            continue
        joint = np.einsum("n,nia,njb->ijab", w / mass, hot, hot)
        single = np.einsum("n,nia->ia", w / mass, hot)
        outer = single[:, None, :, None] * single[None, :, None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            info += mass * np.where(joint > 0, joint * np.log(joint / outer), 0).sum(axis=(2, 3))
    free = [j for j in range(voters) if j != gold]
    parent = {free[0]: -1, gold: -1}
    while len(parent) < voters:
        i, j = max(((i, j) for i in parent if i != gold for j in free if j not in parent), key=lambda p: info[p])
        parent[j] = i
    for _ in range(rounds):
        log = []
        for y in (post, 1 - post):
            w = counts * y
            total = np.log(w.sum() + 1.0)
            like = np.full(n, total)
            for j, p in parent.items():
                if p < 0:
                    table = (w[:, None] * hot[:, j]).sum(axis=0) + 0.5
                    if j == gold:  # annotators are mostly right
                        table += 1e-3 * counts.sum() * np.array([0, 1, 0] if y is post else [0, 0, 1])
                    like += np.log(table / table.sum())[patterns[:, j]]
                else:
                    table = np.einsum("n,na,nb->ab", w, hot[:, p], hot[:, j]) + 0.5
                    like += np.log(table / table.sum(axis=1, keepdims=True))[patterns[:, p], patterns[:, j]]
            log.append(like)
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post


def fit_linear(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, size: int, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features and soft labels, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((i for r in rows for i in r), np.int64, len(at))
    total = weight.sum()
    w, bias = np.zeros(size), float(np.log((target * weight).sum() + 0.5) - np.log(((1 - target) * weight).sum() + 0.5))
    # per-feature steps: a feature is bounded by its own mass and the features it stands with
    reach = np.array([len(r) for r in rows], float) + 1
    scale = np.bincount(feature, (weight * reach)[at], size) / 4 / total + ridge
    scale_bias = (weight * reach).sum() / 4 / total
    v, v_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        z = v_bias + np.bincount(at, v[feature], len(rows))
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / total
        new = v - (np.bincount(feature, gap[at], size) + ridge * v / 10) / scale
        new_bias = v_bias - gap.sum() / scale_bias
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_bias = new + (t - 1) / nxt * (new - w), new_bias + (t - 1) / nxt * (new_bias - bias)
        w, bias, t = new, new_bias, nxt
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = LABELLED) -> Features:
    """The classifier for docs, from labels (id, 0 or 1) that may be learned from.

    Labels with a null id or value are not used; of ids labelled both ways the label is toxic. Without
    labelled rows the word lists and patterns alone make the classifier. Labelled near copies share
    the weight of one row as evidence for features, while the classifier learns from each of them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(id_key(doc_id, dict(labels.dtypes)[doc_id]).alias("id")).agg(F.max(label).alias("y"))
    rows = known.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    order = np.argsort(rows.column("id").to_numpy())
    ids, ys = rows.column("id").to_numpy()[order], rows.column("y").to_numpy()[order].astype(np.int64)
    picked = spark.sparkContext.broadcast((ids, ys))
    bare = docs.select(id_key(doc_id, dict(docs.dtypes)[doc_id]).alias("id"), F.col(text).alias("text"))

    def labelled(batch, ids, ys):
        own = batch.column("id").fill_null(-1).to_numpy()
        at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
        hit = (ids[at] == own) & batch.column("id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
        return [int(ys[i]) if h else None for i, h in zip(at, hit)]

    def sign(batches):
        ids, ys = picked.value
        for batch in slices(batches, "text"):
            y = labelled(batch, ids, ys)
            of = [(i, signature(WORDS((t or "").lower())), v) for i, t, v in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), y) if v is not None]
            i, s, v = zip(*of) if of else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (i, s, v)], names=["id", "sig", "y"])

    # near copies share the weight of one row, or the words of a text that is often copied would look like evidence
    signed = bare.mapInArrow(sign, "id long, sig long, y long").groupBy("id", "y").agg(F.min("sig").alias("sig")).toArrow()
    order = np.argsort(signed.column("id").to_numpy())
    known_ids, known_ys, sigs = (signed.column(c).to_numpy()[order] for c in ("id", "y", "sig"))
    _, group, sizes = np.unique(np.stack([sigs, known_ys]), axis=1, return_inverse=True, return_counts=True)
    weights = np.rint(WHOLE / sizes[group.ravel()]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    # the label of a row is its weight here, negative where it is not toxic
    single = (known_ids, np.where(known_ys == 1, weights, -weights))
    chosen = spark.sparkContext.broadcast(single)

    def count(batches):
        ids, ys = chosen.value
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            names = list(found[0].keys() | found[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][f] for f in names], pa.int64()), pa.array([found[0][f] for f in names], pa.int64())], names=["feature", "a", "b"])
            found[0].clear()
            found[1].clear()
            return batch

        for batch in slices(batches, "text"):
            for t, v in zip(batch.column("text").to_pylist(), labelled(batch, ids, ys)):
                if v is not None and t:
                    own, weight = found[v > 0], abs(v)
                    for f in {f for w in set(WORDS(t.lower())) for f in features_of(w)}:
                        own[f] += weight
            if len(found[0]) + len(found[1]) > CACHED:
                yield rows()
        yield rows()

    na, nb = (float(single[1][single[1] * sign_ > 0].sum() * sign_ / WHOLE) for sign_ in (1, -1))
    learned: list[tuple[str, float]] = []
    if na and nb:
        counts = bare.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg((F.sum("a") / WHOLE).alias("a"), (F.sum("b") / WHOLE).alias("b"))
        p = (F.col("a") + F.col("b")) / (na + nb)

        def part(k, n, q):
            q = F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
            return k * F.log(q) + (n - k) * F.log(1 - q)

        a, b = F.col("a"), F.col("b")
        ratio = 2 * (part(a, F.lit(na), a / na) + part(b, F.lit(nb), b / nb) - part(a, F.lit(na), p) - part(b, F.lit(nb), p))
        share = (a / na) / (a / na + b / nb)
        best = counts.where(a >= LEAST_TOXIC - 1e-3).select("feature", ratio.alias("ratio"), share.alias("share")).where((F.col("ratio") >= EVIDENCE) & (F.col("share") >= SHARE))
        learned = [(r.feature, r.share) for r in best.orderBy(F.desc("ratio"), "feature").collect()]
    features = Features(learned)
    shared = spark.sparkContext.broadcast(features)

    def vote(batches):
        own = shared.value
        ids, ys = picked.value
        held: Counter = Counter()
        for batch in slices(batches, "text"):
            for t, v in zip(batch.column("text").to_pylist(), labelled(batch, ids, ys)):
                t = t or ""
                found = own.of(t.lower())
                votes = bytes(own.votes(t, found, v))
                held[votes, None if v is None else tuple(sorted(found))] += 1
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.list_(pa.int64())), pa.array([held[k] for k in keys], pa.int64())], names=["votes", "features", "n"])

    # at most one row per vote pattern, and one per row of the sample
    cast = staged(bare.mapInArrow(vote, "votes binary, features array<long>, n long"), "votes").groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    if not cast:
        return features
    seen = Counter()
    for r in cast:
        seen[bytes(r.votes)] += r.n
    patterns = sorted(seen)
    post = dict(zip(patterns, label_model(np.array([list(p) for p in patterns]), np.array([seen[p] for p in patterns], float))))
    used = [r for r in cast if r.features is not None]
    # the word lists speak for themselves where few rows are labelled
    lists = [([i], 0.9) for i in range(len(SEED_FEATURES))] + [([], 0.05)]
    fit_rows = [list(r.features) for r in used] + [f for f, _ in lists]
    target = np.array([post[bytes(r.votes)] for r in used] + [t for _, t in lists])
    weight = np.array([float(r.n) for r in used] + [2.0] * len(lists))
    # toxic rows are few; both sides weigh alike
    toxic = (target * weight).sum()
    weight *= np.where(target >= 0.5, max(1.0, 0.3 * weight.sum() / max(toxic, 1.0)), 1.0)
    features.weights, features.bias = fit_linear(fit_rows, target, weight, len(features.names))
    return features


def scored(docs: DataFrame, model: Features, text: str = "text", name: str = "toxicity") -> tuple[DataFrame, str]:
    """docs with a struct column of score and predicted (1 from 0.5 on); and its name.

    Null and empty texts have no features and get the score of the bias. Rows are annotated in place.
    """
    name = fresh_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch):
            scores = [own.score(own.of((t or "").lower())) for t in batch.column(text).to_pylist()]
            return [scores, [int(s >= 0.5) for s in scores]]
        return work

    fields = StructType([StructField("score", DoubleType(), False), StructField("predicted", LongType(), False)])
    return annotate(docs, name, fields, make, text), name
