"""Quality scores of texts by regularised quadratic discriminant analysis.

Every text is reduced to a fixed number of transformed statistics. Class means and
covariances come from sums over all labelled training rows, so that fitting needs one
aggregation of bounded size whatever the number of rows. Covariances are shrunk to their
pooled form and to a diagonal; scores are the posterior from Mahalanobis log-density
differences with Cholesky factors that are computed once.

Nulls count as empty texts. Equal texts get equal scores. A document with several labels
counts once, with their mean rounded (halves up). With no labelled row of one of the classes every score is the
share of label 1 (one half if there is none at all). The difference of log-densities is multiplied by a fixed ``SHARPNESS``, so that
scores are ordered as the posterior is, but less extreme. Very long texts are measured whole. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .scratch import bound_batches, free_names, id_text, settle
from .words import SPACED, buffers, grams, words

#: Weights of the pooled and of the diagonal covariance, and of the log-density difference in the score.
POOLED, DIAGONAL, SHARPNESS = 0.5, 0.05, 0.5
PREDICTED_FROM = 0.3

#: Very frequent words of four languages.
COMMON = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her there would their we has when who will no "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so "
    "le la les de des et en un une du que est pour qui dans par sur pas au plus ne se sont avec il ce cette mais ou son sa aux été être comme nous vous ils elle "
    "el los las y una por con no su para es al lo como más o pero sus ha me si sin sobre este ya entre cuando todo esta ser son también fue había era muy"
).split()

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 white space, 5 other ASCII, 6 beyond ASCII
_KIND[33:128] = 5
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 6
_LINE = 10
DIMS = 22


def _log_share(part: np.ndarray, whole: np.ndarray, soft: float) -> np.ndarray:
    return np.log((part + soft) / (whole + 2 * soft))


def _repeated(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the distinct values, and the count of its most frequent one."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, o[starts], np.diff(np.append(starts, len(h))))
    return np.bincount(o[starts], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, DIMS) transformed statistics; an empty text has those of no words."""
    data, bounds = buffers(texts)
    common = np.sort(np.concatenate([w.hash for w in words(pa.array([" ".join(COMMON)]), SPACED)]))
    out = np.zeros((len(bounds) - 1, DIMS))
    for w in words(texts, SPACED):
        n, at = w.texts, bounds[w.first : w.first + w.texts + 1]
        body, at = data[at[0] : at[-1]], at - at[0]
        kind = _KIND[body]

        def total(mask: np.ndarray, at=at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        size = np.diff(at).astype(float)
        n_words = np.diff(w.bounds).astype(float)
        upper, lower, digit, space, sign, beyond = (total(kind == k) for k in range(1, 7))
        lines = total(body == _LINE) + 1
        same = np.zeros(len(body), bool)
        same[1:] = body[1:] == body[:-1]
        same[at[:-1][at[:-1] < len(body)]] = False
        before_space = np.zeros(len(body), bool)
        before_space[:-1] = (kind[:-1] == 5) & (kind[1:] == 4)
        odd = total((kind == 5) & ~np.isin(body, np.frombuffer(b".,;:'\"()-", np.uint8)))
        stops = total(np.isin(body, np.frombuffer(b".?!", np.uint8)))
        owner = np.repeat(np.arange(n), np.diff(w.bounds))
        distinct, most = _repeated(w.hash, owner, n)
        found = common[np.minimum(np.searchsorted(common, w.hash), len(common) - 1)] == w.hash
        frequent = np.bincount(owner[found], minlength=n).astype(float)
        triples = grams(w.hash, 3)
        inside = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
        t_owner = owner[2:][inside]
        t_distinct, t_most = _repeated(triples[inside], t_owner, n)
        n_triples = np.bincount(t_owner, minlength=n).astype(float)
        next_sign = total(before_space & np.isin(body, np.frombuffer(b"|*#$%&!", np.uint8)))
        columns = (
            np.log1p(n_words), np.log((lower + upper + beyond + 1) / (n_words + 1)), _log_share(upper, size, 2), _log_share(digit, size, 2), _log_share(space, size, 2), _log_share(sign, size, 2),
            _log_share(odd, size, 1), _log_share(stops, n_words, 1), _log_share(beyond, size, 5), np.log((lines + 1) / (n_words + 2)), _log_share(total(same), size, 3), _log_share(total(before_space), n_words, 1),
            _log_share(next_sign, n_words, 1), _log_share(distinct, n_words, 1), _log_share(most, n_words, 1), _log_share(n_words - distinct, n_words, 3), _log_share(frequent, n_words, 1),
            _log_share(n_triples - t_distinct, n_triples, 1), _log_share(t_most, n_triples, 1), np.log((sign + 1) / (n_words + 1)), np.log((upper + 1) / (lower + beyond + 1)), np.log((distinct + 1) / (np.sqrt(n_words) + 1)),
        )
        out[w.first : w.first + n] = np.stack(columns, axis=1)
    return out


def _measured(at: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As many columns as ``names`` has before its last, and there the statistics of the texts of column ``at``."""
    for b in batches:
        x = statistics(b.column(at)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIMS).cast(pa.list_(pa.float32()))], names=names)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {0: np.zeros((DIMS + 1, DIMS + 1)), 1: np.zeros((DIMS + 1, DIMS + 1))}
    for b in batches:
        x = b.column(0).flatten().to_numpy().reshape(-1, DIMS).astype(float)
        x = np.hstack([np.ones((len(x), 1)), x])
        y = b.column(1).to_numpy(zero_copy_only=False)
        for k in held:
            held[k] += x[y == k].T @ x[y == k]
    rows = [(k, v) for k, v in held.items() if v[0, 0]]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.ravel() for _, v in rows], pa.list_(pa.float64()))], names=["y", "s"])


class Discriminant:
    """Two Gaussian classes over standardised statistics."""

    def __init__(self, moments: dict[int, np.ndarray]):
        n = {k: m[0, 0] for k, m in moments.items() if m[0, 0] > 0}
        self.share = n.get(1, 0) / sum(n.values()) if n else 0.5
        self.ready = len(n) == 2 and min(n.values()) > 1
        if not self.ready:
            return
        both = moments[0] + moments[1]
        self.center = both[0, 1:] / both[0, 0]
        self.scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - self.center**2, 1e-6))
        means, spreads = {}, {}
        for k, m in moments.items():
            mean = m[0, 1:] / n[k]
            spread = m[1:, 1:] / n[k] - np.outer(mean, mean)
            means[k], spreads[k] = (mean - self.center) / self.scale, spread / np.outer(self.scale, self.scale)
        pooled = sum(n[k] * spreads[k] for k in n) / sum(n.values())
        self.classes = []
        for k in (0, 1):
            s = (1 - POOLED - DIAGONAL) * spreads[k] + POOLED * pooled + DIAGONAL * np.eye(DIMS)
            factor = np.linalg.cholesky(s)
            self.classes.append((means[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n[k] / sum(n.values())))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1, with log-odds times SHARPNESS."""
        if not self.ready:
            return np.full(len(x), self.share)
        z = (x - self.center) / self.scale
        logs = [prior - log_det - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, log_det, prior in self.classes]
        return 1 / (1 + np.exp(-np.clip(SHARPNESS * (logs[1] - logs[0]), -700, 700)))


def held_out(modulus: int = 5):
    """Whether a document is kept from training: crc32 of its id as text is a multiple of ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0


def fit(measured: DataFrame, labels: DataFrame, column: str = "quality") -> Discriminant:
    """Fit on all labelled rows outside the held-out fold; only two moment matrices for each task reach the driver."""
    one = labels.where(F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.floor(F.avg(column) + 0.5).cast("int").alias("_y"))
    sums = measured.join(one, "doc_id").select("x", "_y").mapInArrow(_sums, "y int, s array<double>")
    grown = sums.selectExpr("y", "posexplode(s) AS (i, v)").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    moments = {0: np.zeros((DIMS + 1) ** 2), 1: np.zeros((DIMS + 1) ** 2)}
    for r in grown:
        moments[r["y"]][r["i"]] = r["v"]
    return Discriminant({k: m.reshape(DIMS + 1, DIMS + 1) for k, m in moments.items()})


def _scored(model: Discriminant, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.column(1).flatten().to_numpy().reshape(-1, DIMS).astype(float)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    measured = settle(id_text(docs).mapInArrow(lambda it: _measured(1, ["doc_id", "x"], it), "doc_id long, x array<float>"), "statistics")
    model = fit(measured, labels, column)
    scored = measured.mapInArrow(lambda it: _scored(model, it), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


def _accepted(model: Discriminant, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.columns[-1].flatten().to_numpy().reshape(-1, DIMS).astype(float)
        rows = pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1])
        yield rows.filter(pa.array(model.score(x) >= PREDICTED_FROM))


def accepted(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``score`` predicts as 1. Each row is judged by its own text, whatever its id."""
    bound_batches(docs.sparkSession)
    names = [*docs.columns, *free_names(docs, "_x")]
    schema = StructType([*docs.schema, StructField(names[-1], ArrayType(FloatType()))])
    at = docs.columns.index("text")
    measured = settle(docs.mapInArrow(lambda it: _measured(at, names, it), schema), "statistics")
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(names[-1]).alias("x")), labels, column)
    return measured.mapInArrow(lambda it: _accepted(model, it), docs.schema)
