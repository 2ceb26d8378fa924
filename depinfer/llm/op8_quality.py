"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from the whole text alone (never from ids, language, source or
labels).  Random cosine features approximate a Gaussian kernel over them; each
partition sums its share of the normal equations, by fold; these sums are added
up in ``sum_partitions`` tasks, and only what these give (``features`` squared
numbers each) reaches the driver.  Scores of rows by models that have not seen them, counted in
``bins`` bins, give the isotonic calibration; it is interpolated between the
means of its blocks, so equal steps keep the order of the scores.

All labelled rows outside the held-out part are learnt from, without a sample.

Defined cases: a null text is empty and gets the score of the empty text;
labels that are null or of unknown documents are ignored, rows that repeat an
id count once each and are kept or dropped by their own text; a null ``doc_id``
is not held out; without any label, or with labels of one class, the score is 0.5
or that class; other columns are carried along by :func:`keep_good` and ignored
otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.llm.common import discard, materialize, ship, text_or_empty

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_fourths",
    "upper", "digits", "spaces", "stops", "marks", "symbols", "not_ascii", "alpha_words", "symbol_words", "upper_words",
    "distinct_lines", "log_line_length", "lines_with_stop", "packed",
)
N = len(STATISTICS)


def _statistics(text: str) -> list[float]:
    import zlib
    from collections import Counter
    from math import log1p

    words, lines, size = text.split(), [x for x in text.split("\n") if x.strip()], max(len(text), 1)
    n = max(len(words), 1)
    counts = Counter(words)
    chars = Counter(text)
    total = lambda some: sum(chars[c] for c in some) / size
    letters_up = sum(k for c, k in chars.items() if c.isupper())
    letters = sum(k for c, k in chars.items() if c.isalpha())
    bare = [w.strip(".,;:!?\"'()") for w in counts]
    weight = list(counts.values())
    data = text.encode("utf-8", "replace")
    return [
        log1p(len(text)),
        log1p(len(words)),
        sum(len(w) * k for w, k in counts.items()) / n,
        sum(k for w, k in counts.items() if len(w) > 14) / n,
        len(counts) / n,
        max(weight, default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        len(set(zip(words, words[1:], words[2:], words[3:]))) / n,
        letters_up / max(letters, 1),
        total("0123456789"),
        total(" \n\t\r"),
        total(".,"),
        total("!?;:'\"-"),
        total("#$%&*|<>{}[]=+_~^@\\/"),
        sum(k for c, k in chars.items() if ord(c) > 127) / size,
        sum(k for b, k in zip(bare, weight) if b.isalpha()) / n,
        sum(k for b, k in zip(bare, weight) if b and not any(map(str.isalnum, b))) / n,
        sum(k for b, k in zip(bare, weight) if len(b) > 1 and b.isupper()) / n,
        len(set(lines)) / max(len(lines), 1),
        log1p(size / max(len(lines), 1)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        len(zlib.compress(data, 1)) / max(len(data), 40),
    ]


def _measure(batches):
    import pyarrow as pa

    for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
        x = [_statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("said"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "said", "x"])


class _Fourier:
    """``sqrt(2 / D) cos(w x + b)`` of standardised statistics, and a constant."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.array(mean), np.array(scale)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, lists):
        import numpy as np

        x = lists.flatten().to_numpy().reshape(len(lists), len(self.mean))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])


def _sums_of(fourier: _Fourier, folds: int):
    def sums(batches):
        import numpy as np
        import pyarrow as pa

        d = len(fourier.b) + 1
        gram, moment = np.zeros((folds, d, d)), np.zeros((folds, d))
        for batch in batches:
            z, y, fold = fourier(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in range(folds):
                gram[f] += z[fold == f].T @ z[fold == f]
                moment[f] += z[fold == f].T @ y[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["gram", "moment"])

    return sums


def _added(batches):
    import numpy as np
    import pyarrow as pa

    gram = moment = 0.0
    for batch in batches:
        for g, m in zip(batch.column("gram"), batch.column("moment")):
            gram, moment = gram + np.frombuffer(g.as_buffer()), moment + np.frombuffer(m.as_buffer())
    if not isinstance(gram, float):
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["gram", "moment"])


def _unseen_of(fourier: _Fourier, models, bins: int):
    """Bin and label of each row under the model that has not seen its fold."""

    def unseen(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            s = np.einsum("ij,ij->i", fourier(batch.column("x")), models[batch.column("fold").to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((s + 1) / 3 * bins, 0, bins - 1).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    return unseen


def isotonic(at: list[float], weight: list[float], total: list[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: centres and means of the blocks, both rising."""
    blocks: list[list[float]] = []
    for x, w, t in zip(at, weight, total):
        blocks.append([x * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [a / w for a, w, _ in blocks], [t / w for _, w, t in blocks]


def _score_of(fourier: _Fourier, model, centres, means):
    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw = fourier(batch.column("x")) @ model
            # Beyond the outer blocks a thousandth is left for the order.
            s = np.interp(raw, centres, means) * 0.998 + 0.002 * np.clip((raw + 1) / 3, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("said"), pa.array(np.clip(s, 0, 1))], names=["doc_id", "said", "score"])

    return score


def _scored(docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, folds: int = 3, bins: int = 3000, sum_partitions: int = 16, seed: int = 17) -> DataFrame:
    """``doc_id, said, held_out, score`` per document; ``said`` is a hash of its text, on which alone its score depends."""
    import numpy as np

    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("said", F.xxhash64("text"))
    measured = materialize(rows.mapInArrow(_measure, "doc_id bigint, said bigint, x array<double>"), "op8-measured")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null and doc_id is not null").filter(~held_out)
    learn = materialize(measured.join(known, "doc_id").select("x", "y", F.expr(f"cast(pmod(xxhash64(doc_id, 'fold'), {folds}) as int)").alias("fold")), "op8-learn")
    stats = learn.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N))).first()
    if not stats["n"] or stats["y"] in (0.0, 1.0):
        return measured.select("doc_id", "said", held_out.alias("held_out"), F.lit(stats["y"] if stats["n"] else 0.5).alias("score"))
    fourier = _Fourier([stats[f"m{i}"] for i in range(N)], [max(stats[f"s{i}"], 1e-6) for i in range(N)], features, width, seed)
    d = features + 1
    gram, moment = np.zeros((folds, d, d)), np.zeros((folds, d))
    sums = learn.select("x", "y", "fold").mapInArrow(_sums_of(fourier, folds), "gram binary, moment binary")
    for r in sums.repartition(sum_partitions).mapInArrow(_added, "gram binary, moment binary").toLocalIterator():
        gram += np.frombuffer(r["gram"]).reshape(gram.shape)
        moment += np.frombuffer(r["moment"]).reshape(moment.shape)

    def solve(g, m):
        return np.linalg.solve(g + ridge * max(g[-1, -1], 1) / d * np.eye(d), m)

    models = np.array([solve(gram.sum(0) - gram[f], moment.sum(0) - moment[f]) for f in range(folds)])
    counted = learn.mapInArrow(_unseen_of(fourier, models, bins), "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    discard(learn)
    centres, means = isotonic([(r["bin"] + 0.5) / bins * 3 - 1 for r in counted], [float(r["n"]) for r in counted], [r["y"] for r in counted])
    scored = measured.mapInArrow(_score_of(fourier, solve(gram.sum(0), moment.sum(0)), centres, means), "doc_id bigint, said bigint, score double")
    return scored.select("doc_id", "said", held_out.alias("held_out"), "score")


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score`` per document; ``labels`` has doc_id and quality (0 or 1)."""
    return _scored(docs, labels, **options).drop("said")


def predict_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    return score_quality(docs, labels, **options).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    bad = _scored(docs, labels, **options).filter(F.col("score") < threshold).select(F.col("doc_id").alias("__op8_id"), F.col("said").alias("__op8_said")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__op8_id")) & (F.xxhash64(text_or_empty()) == F.col("__op8_said"))
    return docs.join(bad, same, "left_anti")


ship(__name__)
