"""Components of sample tables: dense feature PCA, and wide sparse matrices.

Wide matrices (sample x k-mer, sample x prototype) stay one sparse row per sample. Their
covariance is never formed: a small block of directions is pushed through Z'Z in passes
over the rows, and only vocabulary x block sums come back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.operators.features import drop_constant, fill_missing
from clonoframe.operators.markers import kmer_counts
from clonoframe.operators.passes import added
from clonoframe.session import cut_lineage, packed

ROWS_PER_TASK = 250
CELLS = 1 << 22  # cells of rows held dense at a time, 32 MB
HELD = 160  # directions a search holds before it starts again from its leading ones
EXACT = 1e-14  # residual, relative to the largest variance, at which a direction is settled


def concept_embedding(features: DataFrame, columns: Sequence[str], ndim: int = 10):
    """Scaled PCA of dense features: (scores, rotation, used columns, explained variance).

    Constant columns are dropped; at least two must remain. Every component's sign makes
    its largest loading positive.
    """
    features = cut_lineage(fill_missing(features, columns))
    used = drop_constant(features, columns)
    if len(used) < 2:
        raise ValueError("fewer than two varying features")
    rank = min(ndim, len(used))
    rows = VectorAssembler(inputCols=used, outputCol="_x").transform(features)
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(rows)
    scaled = scaler.transform(rows)
    model = PCA(k=rank, inputCol="_z", outputCol="_pc").fit(scaled)
    rotation = model.pc.toArray()
    signs = np.sign(rotation[np.abs(rotation).argmax(axis=0), np.arange(rank)])
    flips = F.array(*[F.lit(float(s)) for s in signs])
    scores = model.transform(scaled).select(
        *[c for c in features.columns if c not in set(columns)],
        F.zip_with(vector_to_array("_pc"), flips, lambda a, b: a * b).alias("pc"),
    )
    named = scores.select(
        "*",
        *[F.col("pc")[i].alias(n) for i, n in enumerate(component_names(rank))],
    ).drop("pc")
    return named, rotation * signs, used, np.array(model.explainedVariance)


def component_names(rank: int) -> list[str]:
    """The first two components are called CB1 and CB2."""
    return [f"CB{i + 1}" if i < 2 else f"PC{i + 1}" for i in range(rank)]


# ---- wide sparse matrices -------------------------------------------------------------


class SparseTable:
    """One row per sample: ``keys`` (vocabulary entries) and ``values``; others are zero."""

    def __init__(self, rows: DataFrame, vocabulary: Sequence, row_share: bool = False):
        self.vocabulary = list(vocabulary)
        self.rows = packed(self._encoded(rows, row_share), ROWS_PER_TASK).persist()
        self.n, self.mean, self.sd = 0, None, None

    def _encoded(self, rows: DataFrame, share: bool) -> DataFrame:
        """Keys as positions in the vocabulary; values optionally as shares of the row."""
        index = {key: i for i, key in enumerate(self.vocabulary)}

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = [np.array([index[k] for k in keys], dtype=np.int32) for keys in pdf["keys"]]
                value = [np.asarray(v, dtype=float) for v in pdf["values"]]
                if share:
                    value = [v / (v.sum() or 1.0) for v in value]
                yield pdf.assign(keys=at, values=value)

        others = [f for f in rows.schema.fields if f.name not in ("keys", "values")]
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
        ordered = rows.select(*[f.name for f in others], "keys", "values")
        return ordered.mapInPandas(encode, f"{names}, keys array<int>, values array<double>")

    @staticmethod
    def _reader():
        def flat(pdf: pd.DataFrame):
            sizes = pdf["keys"].map(len).to_numpy()
            row = np.repeat(np.arange(len(pdf)), sizes)
            if not len(row):
                return row, row.astype(int), row.astype(float)
            at = np.concatenate(pdf["keys"].to_numpy()).astype(np.int64)
            return row, at, np.concatenate(pdf["values"].to_numpy()).astype(float)

        return flat

    def fit_scale(self, scale: bool = True) -> SparseTable:
        """Column means and sample deviations (constant columns get weight zero)."""
        flat, p = self._reader(), len(self.vocabulary)

        def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, ss, n = np.zeros(p), np.zeros(p), 0
            for pdf in batches:
                _, at, value = flat(pdf)
                s += np.bincount(at, value, p)
                ss += np.bincount(at, value * value, p)
                n += len(pdf)
            yield pd.DataFrame({"i": np.arange(p), "s": s, "ss": ss, "n": n})

        sums = (
            self.rows.select("keys", "values")
            .mapInPandas(moments, "i long, s double, ss double, n long")
            .groupBy("i").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
            .orderBy("i").toPandas()
        )
        self.n = int(sums["n"].iloc[0])
        self.mean = sums["s"].to_numpy() / self.n
        spread = np.maximum(sums["ss"].to_numpy() - self.n * self.mean**2, 0) / max(1, self.n - 1)
        sd = np.sqrt(spread)
        live = sd > 1e-12
        self.sd = np.where(live, sd if scale else 1.0, np.inf)
        return self

    def _project(self, flat, pdf, directions):
        mean, sd = self.mean, self.sd
        weights = directions / sd[:, None]
        row, at, value = flat(pdf)
        out = np.stack(
            [np.bincount(row, value * weights[at, j], len(pdf)) for j in range(weights.shape[1])],
            axis=1,
        )
        return row, at, value, out - mean @ weights

    def normal_product(self, directions: np.ndarray) -> np.ndarray:
        """Z'(Z V) for standardised Z, summed over all rows."""
        p, q = self._shape(directions)
        mean, sd = self.mean, self.sd
        weights = directions / sd[:, None]
        offset = mean @ weights

        def push(batch: pa.RecordBatch) -> np.ndarray:
            total, ones, step = np.zeros((p, q)), np.zeros(q), max(1, CELLS // p)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                keys, values = part.column("keys"), part.column("values").flatten()
                row = np.repeat(np.arange(part.num_rows), keys.value_lengths().to_numpy())
                dense = np.zeros((part.num_rows, p))
                dense[row, keys.flatten().to_numpy()] = values.to_numpy()
                u = dense @ weights - offset
                total += dense.T @ u
                ones += u.sum(axis=0)
            return ((total - np.outer(mean, ones)) / sd[:, None]).ravel()

        return added(self.rows.select("keys", "values"), push).reshape(p, q)

    def _shape(self, directions: np.ndarray) -> tuple[int, int]:
        return len(self.vocabulary), directions.shape[1]

    def label_product(self, label: str) -> tuple[np.ndarray, float]:
        """Z'y for the centred label, and the label's mean."""
        flat, p = self._reader(), len(self.vocabulary)

        def push(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            xy, x, y, n = np.zeros(p), np.zeros(p), 0.0, 0
            for pdf in batches:
                row, at, value = flat(pdf)
                target = pdf[label].to_numpy(float)
                xy += np.bincount(at, value * target[row], p)
                x += np.bincount(at, value, p)
                y, n = y + target.sum(), n + len(pdf)
            yield pd.DataFrame({"i": np.arange(p), "xy": xy, "x": x, "y": y, "n": n})

        sums = (
            self.rows.select("keys", "values", label)
            .mapInPandas(push, "i long, xy double, x double, y double, n long")
            .groupBy("i").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
            .orderBy("i").toPandas()
        )
        centre = float(sums["y"].iloc[0] / sums["n"].iloc[0])
        return (sums["xy"].to_numpy() - centre * sums["x"].to_numpy()) / self.sd, centre

    def _slim(self) -> SparseTable:
        """A copy without the DataFrame, for use inside tasks."""
        copy = object.__new__(SparseTable)
        copy.mean, copy.sd = self.mean, self.sd
        return copy

    def scores(self, directions: np.ndarray, name: str = "pc") -> DataFrame:
        """Rows with their coordinates along the directions."""
        flat, table = self._reader(), self._slim()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                u = table._project(flat, pdf, directions)[3]
                yield pdf.drop(columns=["keys", "values"]).assign(**{name: list(u)})

        kept = [f for f in self.rows.schema.fields if f.name not in ("keys", "values")]
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        return self.rows.mapInPandas(place, f"{shape}, {name} array<double>")

    def components(self, k: int, passes: int = 5, extra: int = 6, seed: int = 0, exact: bool = False):
        """Leading k directions and their variances, by a block Krylov space.

        ``exact`` goes on, instead of stopping after ``passes``, until what the product leaves
        outside a direction is rounding. Of equally large loadings the first is made positive.
        """
        p = len(self.vocabulary)
        q = min(k + extra, p)
        rng = np.random.default_rng(seed)
        block = np.linalg.qr(np.where(np.isfinite(self.sd)[:, None], rng.normal(size=(p, q)), 0))[0]
        known, mapped = np.zeros((p, 0)), np.zeros((p, 0))
        done, least, since = 0, np.inf, 0
        while True:
            image = self.normal_product(block)
            known, mapped, done = np.hstack([known, block]), np.hstack([mapped, image]), done + 1
            rest = image - known @ (known.T @ image)
            rest -= known @ (known.T @ rest)
            left, size, _ = np.linalg.svd(rest, full_matrices=False)
            small = known.T @ mapped
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(values)[::-1]
            top = order[:k]
            if not exact:
                block = left[:, size > 1e-9 * max(1.0, np.abs(image).max())]
                if done == passes or not block.shape[1] or known.shape[1] + block.shape[1] > p:
                    break
                continue
            gone = np.linalg.norm(mapped @ vectors[:, top] - known @ (vectors[:, top] * values[top]), axis=0).max()
            since = 0 if gone < least / 2 else since + 1
            least = min(least, gone)
            block = left[:, size > 10 * EXACT * values[top[0]]][:, : p - known.shape[1]]
            block = np.linalg.qr(block - known @ (known.T @ block))[0]
            # below 1e-11 the residual may stay at the rounding of the sums
            settled = gone <= EXACT * values[top[0]] or (since >= 4 and gone <= 1e-11 * values[top[0]])
            if settled or not block.shape[1]:
                break
            if known.shape[1] + block.shape[1] > max(HELD, 8 * q):
                lead = vectors[:, order[: max(HELD, 8 * q) // 2]]
                known, mapped = known @ lead, mapped @ lead
        directions = known @ vectors[:, top]
        sizes = np.abs(directions)
        sizes = np.round(sizes / np.maximum(sizes.max(axis=0), 1e-300), 9)
        directions *= np.sign(directions[sizes.argmax(axis=0), np.arange(len(top))])
        total = float(np.isfinite(self.sd).sum())
        variance = values[top] / max(1, self.n - 1)
        return directions, variance, variance / max(total, 1e-300)


def kmer_component(clones: DataFrame, k: int = 3) -> DataFrame:
    """First component of the sample x k-mer frequency matrix (row shares, scaled columns).

    A sample's row has at most alphabet^k entries, whatever its size. Words that sort first decide
    the sign, so the component is the same as any other engine's.
    """
    per = kmer_counts(clones, k, ["sample_id"])
    spectra = per.groupBy("sample_id").agg(
        F.collect_list(F.struct("kmer", "n")).alias("_p")
    ).select(
        "sample_id",
        F.transform("_p", lambda s: s["kmer"]).alias("keys"),
        F.transform("_p", lambda s: s["n"].cast("double")).alias("values"),
    )
    spectra = cut_lineage(spectra)
    words = [
        r["kmer"]
        for r in spectra.select(F.explode("keys").alias("kmer")).distinct().orderBy("kmer").collect()
    ]
    samples = clones.select("sample_id").distinct()
    if len(words) < 2:
        return samples.withColumn("motif_pc1", F.lit(0.0))
    table = SparseTable(spectra, words, row_share=True).fit_scale()
    directions, _, _ = table.components(1, exact=True)
    return table.scores(directions).select("sample_id", F.col("pc")[0].alias("motif_pc1"))


def prototype_components(vectors: DataFrame, prototypes: Sequence[int], k: int = 50):
    """PCA of z-scored sample x prototype rows: (scores, explained, cumulative)."""
    table = SparseTable(vectors, prototypes).fit_scale()
    directions, _, share = table.components(min(k, len(prototypes)))
    return table.scores(directions), share, np.cumsum(share)


def disease_axis(vectors: DataFrame, prototypes: Sequence[int], weights: np.ndarray, bias: float):
    """Score along a linear classifier's axis, and the first component of what it leaves.

    Each row is split into its part along the weight vector and the rest; the rest is
    standardised and reduced to one component.
    """
    index = {key: i for i, key in enumerate(prototypes)}
    w = np.asarray(weights, dtype=float)
    norm = float(w @ w) or 1.0

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(prototypes)
        for pdf in batches:
            dense = np.zeros((len(pdf), len(w)))
            for r, (keys, values) in enumerate(zip(pdf["keys"], pdf["values"])):
                dense[r, [index[k] for k in keys]] = values
            along = dense @ w
            rest = dense - np.outer(along / norm, w)
            yield pdf.drop(columns=["keys", "values"]).assign(
                svm_score=along + bias, keys=[every] * len(pdf), values=list(rest)
            )

    kept = [f for f in vectors.schema.fields if f.name not in ("keys", "values")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = vectors.mapInPandas(
        split, f"{shape}, svm_score double, keys array<bigint>, values array<double>"
    )
    table = SparseTable(rows, prototypes).fit_scale()
    directions, _, _ = table.components(1)
    return table.scores(directions).withColumn("orthogonal_pc", F.col("pc")[0]).drop("pc")


def pls_scores(vectors: DataFrame, prototypes: Sequence[int], label: str = "label") -> DataFrame:
    """Two partial-least-squares components for one response, in two passes.

    The second component follows from the first by deflation, written in terms of
    products that the passes already deliver.
    """
    table = SparseTable(vectors, prototypes).fit_scale()
    a, _ = table.label_product(label)
    w1 = a / (np.linalg.norm(a) or 1.0)
    image = table.normal_product(w1[:, None])[:, 0]
    t_square = float(w1 @ image)
    loading = image / (t_square or 1.0)
    t_label = float(w1 @ a)
    w2 = a - loading * t_label
    w2 /= np.linalg.norm(w2) or 1.0
    carry = float(loading @ w2)
    placed = table.scores(np.stack([w1, w2], axis=1), "_t")
    return placed.withColumn("pls1", F.col("_t")[0]).withColumn(
        "pls2", F.col("_t")[1] - F.lit(carry) * F.col("_t")[0]
    ).drop("_t")


def discriminant_scores(rows: DataFrame, vector: str = "pc", label: str = "label") -> DataFrame:
    """One linear discriminant of component scores: class means and pooled covariance."""
    from pyspark.ml.functions import array_to_vector

    base = rows.withColumn("_x", array_to_vector(F.col(vector))).persist()
    per = base.groupBy(label).agg(
        Summarizer.mean(F.col("_x")).alias("m"), F.count(F.lit(1)).alias("n")
    ).orderBy(label).collect()
    if len(per) != 2:
        raise ValueError("one discriminant needs exactly two classes")
    means = {r[label]: r["m"].toArray() for r in per}
    tables = F.create_map(
        *[x for k, m in means.items()
          for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in m]))]
    )
    centred = base.select(
        array_to_vector(
            F.zip_with(F.col(vector), tables[F.col(label)], lambda a, b: a - b)
        ).alias("_c")
    )
    n = sum(r["n"] for r in per)
    sd = centred.agg(Summarizer.std(F.col("_c")).alias("s")).first()["s"].toArray()
    live = sd > 1e-12
    corr = np.nan_to_num(Correlation.corr(centred, "_c").first()[0].toArray())
    cov = corr * np.outer(sd, sd) * (n - 1) / max(1, n - 2)
    cov[~live, ~live] = 1.0
    first, second = (means[r[label]] for r in per)
    axis = np.linalg.pinv(cov, rcond=1e-6, hermitian=True) @ (second - first)
    centre = (first + second) / 2
    terms = [F.col(vector)[i] * float(axis[i]) for i in range(len(axis))]
    return rows.withColumn("lda1", sum(terms, F.lit(0.0)) - float(axis @ centre))
