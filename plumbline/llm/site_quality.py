"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier of documents (statistics of the text, and words or beginnings of words that speak against it) gives each document
a probability of being bad, that is, of low quality or toxic. These are summed by host and by path within a host, and
shrunk: a host's rate to the global one, a path's to its host's, with prior strengths that the spread of hosts, and of
paths within hosts, gives (see ``shrinkage``): sparse sites stay near their parents, and so do all where sites don't
differ. The document's odds are multiplied by the odds of its site against the global odds (its own share of the sums
left out), and it is rejected if the posterior is above ``REJECT_ABOVE``.

The classifier is fitted on at most ``SAMPLE`` labelled documents, taken in order of a hash of the id, with all
their words; these are counted on the executors, and at most ``VOCABULARY`` of them, those that tell most, become
weights. Texts are scored once, into a narrow table of keys and probabilities on which everything else runs. Sites are
grouped with partial aggregates, so a hot host sends a row for each task, and joined so that it is never one task's.

Defined cases: null or empty text has the statistics of no words and is scored like any other; a document without a
site (no row in ``sites``, or a null host) counts in the global rate alone and keeps its own odds; of several sites of a
document the first in order counts; null path is a path of its own; null labels aren't used; without labels of both kinds
every document has the log odds ``UNTRAINED`` and is kept; repeated rows are scored alike; null ids have no site; other
columns pass through ``keep_good``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, give_back, joined_by_key, quoted, slices, stored
from .host_reputation import url_parts
from .shrinkage import shrunk, strengths

SAMPLE = 12_000
VOCABULARY, MIN_DOCS, MIN_Z, MIN_LIFT = 30_000, 4, 3.5, 1.5
REJECT_ABOVE = 0.33
SYMBOLS = b"#*$%&|<>"
#: Punctuation at word ends becomes a space.
_PLAIN = bytes(32 if chr(b) in ".,;:?!\"'()" else b for b in range(256))
STATS = 11
#: Texts held as Python objects at a time.
SLICE = 256
UNTRAINED = -3.0


def statistics(text: str) -> tuple[np.ndarray, set[bytes]]:
    """Numbers in [0, 1] that describe a text, and its distinct words."""
    data = text.encode()
    raw = data.split()
    n, size = max(1, len(raw)), max(1, len(data))
    words = set(data.lower().translate(_PLAIN).split())
    words |= {b"~" + w[:5] for w in words if len(w) > 5}  # what begins alike
    lines = [x for x in data.split(b"\n") if x.strip()]
    gone = lambda chars: (len(data) - len(data.translate(None, chars)))
    symbols = gone(SYMBOLS)
    repeats = sum(a == b for a, b in zip(raw, raw[1:])) / n
    stats = (
        1.0,
        min(1.0, np.log1p(len(raw)) / 12),
        float(symbols > 0),
        min(1.0, symbols / n),
        min(1.0, 2 * repeats),
        1 - len(set(raw)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, data.count(b" | ") * 4 / n),
        min(1.0, gone(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2 / size),
        min(1.0, data.count(b"!!") * 4 / n),
        min(1.0, gone(b"0123456789") * 5 / size),
    )
    return np.array(stats), words


class TextModel:
    """Weights of the statistics and of words; ``logit`` is the log odds of a text being bad."""

    def __init__(self, stats=None, words: dict[bytes, float] | None = None):
        self.stats = np.array([UNTRAINED, *[0.0] * (STATS - 1)]) if stats is None else np.asarray(stats, float)
        self.words = words or {}
        self.known = frozenset(self.words)

    def logit(self, text: str | None) -> float:
        stats, words = statistics(text or "")
        get = self.words.__getitem__
        return float(stats @ self.stats) + sum(map(get, sorted(self.known & words)))

    @classmethod
    def fitted(cls, stats: np.ndarray, row: np.ndarray, col: np.ndarray, names: list[bytes], bad: np.ndarray, rounds: int = 150) -> TextModel:
        """Full-batch logistic regression (Adagrad, L2) over the statistics and words: document ``row`` has word ``col``."""
        ws, wv = np.zeros(STATS), np.zeros(len(names))
        gs, gv = np.full(STATS, 1e-6), np.full(len(names), 1e-6)
        for _ in range(rounds):
            z = stats @ ws + np.bincount(row, weights=wv[col], minlength=len(bad))
            err = (bad - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / len(bad)
            a, b = stats.T @ err - 1e-6 * ws, np.bincount(col, weights=err[row], minlength=len(names)) - 1e-5 * wv
            gs, gv = gs + a * a, gv + b * b
            ws, wv = ws + 0.3 * a / np.sqrt(gs), wv + 0.6 * b / np.sqrt(gv)
        return cls(ws, {name: float(w) for name, w in zip(names, wv) if abs(w) > 0.02})


def telling_words(sample: DataFrame, n_bad: int, n_good: int) -> list[bytes]:
    """``sample`` (bad, words) -> words that are significantly more frequent in bad documents, the clearest first."""
    both, in_bad = F.col("n").cast("double"), F.col("n_bad").cast("double")
    rate = both / (n_bad + n_good)
    z = (in_bad - n_bad * rate) / F.sqrt(F.greatest(n_bad * rate * (1 - rate), F.lit(1e-9)))
    lift = F.log((in_bad + 0.5) / (n_bad + 1)) - F.log((both - in_bad + 0.5) / (n_good + 1))
    counts = sample.select("bad", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"))
    worth = counts.where(F.col("n") >= MIN_DOCS).select("word", z.alias("z"), lift.alias("lift")).where((F.col("z") > MIN_Z) & (F.col("lift") > MIN_LIFT))
    return [bytes(r.word) for r in worth.orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()]


def fit_text_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> TextModel:
    """``labels``: doc_id and bad (0/1, null: unknown)."""
    known = labels.where("bad IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("bad").cast("int").alias("bad"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "bad").limit(sample)
    rows = docs.select(F.col(quoted(doc_id)).alias("_doc"), F.col(quoted(text)).alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))

    def described(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            made = [statistics(t or "") for t in batch.column(1).to_pylist()]
            words = pa.array([sorted(w) for _, w in made], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s, _ in made], pa.binary()), words], ["_doc", "bad", "stats", "words"])
        give_back()

    kind = rows.schema["_doc"].dataType.simpleString()
    some = stored(rows.select("_doc", "_text", "bad").mapInArrow(described, f"_doc {kind}, bad int, stats binary, words array<binary>"), "labelled-texts")
    n, n_bad = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not 0 < n_bad < n:
        dropped(some)
        return TextModel()
    names = telling_words(some, n_bad, n - n_bad)

    def numbered(batches):
        index = {w: k for k, w in enumerate(names)}
        for batch in chain.from_iterable(map(slices, batches)):
            found = [np.array([index[w] for w in ws if w in index], np.int32).tobytes() for ws in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["_doc", "bad", "stats", "words"])
        give_back()

    got = some.mapInArrow(numbered, f"_doc {kind}, bad int, stats binary, words binary").toArrow().to_pylist()
    dropped(some)
    got.sort(key=lambda r: (r["_doc"], r["bad"], r["stats"], r["words"]))  # sums of the fit in one order
    words = [np.frombuffer(r["words"], np.int32) for r in got]
    stats = np.frombuffer(b"".join(r["stats"] for r in got), float).reshape(-1, STATS)
    return TextModel.fitted(stats, np.repeat(np.arange(n), [len(w) for w in words]), np.concatenate(words), names, np.array([float(r["bad"]) for r in got]))


def log_odds(model: TextModel, text: str = "text") -> Column:
    """The classifier's log odds of each text being bad."""
    stats, words = model.stats.tolist(), model.words

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logit = TextModel(stats, words).logit
        for texts in batches:
            out = np.empty(len(texts))
            for start in range(0, len(texts), SLICE):
                out[start : start + SLICE] = [logit(t) for t in texts.slice(start, SLICE).to_pylist()]
            yield pa.array(out)
        give_back()

    return F.arrow_udf(score, "double")(F.coalesce(F.col(quoted(text)), F.lit("")))


def page_sites(pages: DataFrame, url: str = "url") -> DataFrame:
    """doc_id, host, path for each document that a page shows: the document's number is the second part of the url's path,
    the first part is the site's path."""
    host, path = url_parts(url)
    rows = pages.select(host.alias("host"), path.alias("whole"))
    rows = rows.select(F.regexp_extract("whole", "^/[^/]*/([0-9]{1,18})", 1).alias("number"), "host", F.regexp_extract("whole", "^/([^/]*)", 1).alias("path"))
    return rows.where("number <> ''").select(F.col("number").cast("long").alias("doc_id"), "host", "path")


def site_rates(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, p) -> host, path, path_sum, path_n, host_sum, host_n, all_sum, all_n, host_k, path_k."""
    paths = stored(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("p")).alias("q")), "sites")
    known = paths.where("host IS NOT NULL")
    hosts = known.groupBy("host").agg(*[F.sum(c).alias(c) for c in "snq"])
    levels = hosts.select(F.lit(1).alias("level"), F.lit("").alias("parent"), "n", "s", "q").unionByName(known.select(F.lit(2).alias("level"), F.col("host").alias("parent"), "n", "s", "q"))
    k = strengths(levels)
    total, count = paths.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = known.select("host", "path", F.col("s").alias("path_sum"), F.col("n").alias("path_n")).join(hosts.select("host", F.col("s").alias("host_sum"), F.col("n").alias("host_n")), "host")
    return out.withColumns({"all_sum": F.lit(total), "all_n": F.lit(count), "host_k": F.lit(k.get(1, 0.0)), "path_k": F.lit(k.get(2, 0.0))})


def rated(docs: DataFrame, model: TextModel, sites: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, p (classifier alone), host, site (the site's rate), posterior, keep for every row. ``sites``:
    doc_id, host, path."""
    probability = 1 / (1 + F.exp(-log_odds(model, text)))
    scores = stored(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_key"), probability.alias("p")), "scores")
    first = sites.where("doc_id IS NOT NULL AND host IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("host", "path")).alias("site"))
    scored = stored(scores.join(first, "doc_id", "left").select("doc_id", "text_key", "p", "site.host", "site.path"), "scored")
    dropped(scores)
    rates = site_rates(scored)
    total, count = scored.agg(F.coalesce(F.sum("p"), F.lit(0.0)), F.count(F.lit(1))).first()
    base = (F.lit(total) - F.col("p") + F.lit(0.5)) / F.lit(float(max(count, 1)))
    key = F.struct("host", "path")
    homed = joined_by_key(scored.where("host IS NOT NULL").withColumn("at", key), rates.withColumn("at", key).drop("host", "path").withColumn("rows", F.col("path_n")), "at", "rows", count)
    by_host = shrunk(F.col("host_sum") - F.col("p"), F.col("host_n") - 1, F.col("host_k"), base)
    by_path = shrunk(F.col("path_sum") - F.col("p"), F.col("path_n") - 1, F.col("path_k"), by_host)
    rows = homed.select("doc_id", "text_key", "p", "host", by_path.alias("site")).unionByName(scored.where("host IS NULL").select("doc_id", "text_key", "p", "host", base.alias("site")))
    odds = lambda c: c / (1 - c)
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    joint = odds(clipped) * odds(F.col("site")) / odds(base)
    rows = rows.withColumn("posterior", joint / (1 + joint))
    return rows.withColumn("keep", F.col("posterior") <= REJECT_ABOVE)


def bad_labels(labels: DataFrame) -> DataFrame:
    """quality and toxic (0/1) -> bad: low quality or toxic; null if neither is known to be so and one is unknown."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNull() | F.col("toxic").isNull(), None).otherwise(0)
    return labels.select("doc_id", bad.alias("bad"))


def keep_good(docs: DataFrame, labels: DataFrame, sites: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    own_id, own_key = fresh(docs.columns, "own_id", "own_key")
    kept = rated(docs, fit_text_model(docs, labels, doc_id, text), sites, doc_id, text).where("keep").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    return docs.join(kept, F.col(quoted(doc_id)).eqNullSafe(F.col(own_id)) & (F.xxhash64(quoted(text)) == F.col(own_key)), "left_semi")
