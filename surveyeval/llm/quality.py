"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other over rounds.

The content view sees what a text says: its words and pairs of neighbouring words, hashed to BUCKETS places, by damped counts of length one.  The
metadata view sees what is known of the page without reading it: source, language, length, lines, links, script, marks and repeats.  Both are logistic
regressions that start from a bounded sample of labelled rows.  In every round each view scores all documents, and of those without a label the
most confident share of each class is exchanged: the same number of both classes, drawn by hash up to a bound, become pseudo-labelled
rows of the *other* view.  Each view is calibrated (Platt) on labelled rows kept out of training, and the calibrated log-odds are added,
less the prior, to score every document.

A pass over the texts computes both views' odds from broadcast weights (BUCKETS and META numbers); features are stored for labelled and exchanged rows only.
"""

from __future__ import annotations

import math
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, ngrams, slices, utf8, word_hash, words
from .logistic import SparseRows, fit_logistic
from .shared import join_small, materialize, small_batches

#: The classifier is fitted on at most about this many labelled rows, drawn by hash of doc_id.
MAX_LABELLED = 20_000
#: Rounds of exchange; the share of documents of which each view is held to be confident at either end; and at most so many rows a class, view and round.
ROUNDS, SHARE, EXCHANGED = 2, 0.1, 3_000
#: Places of hashed words and pairs; a view is calibrated on LEAST_HELD rows of each class or not at all.
BUCKETS, LEAST_HELD = 1 << 18, 10
#: Steps and penalties of the two regressions and of the calibration.
STEPS, RIDGE, PLATT = 30, {"content": 1e-5, "metadata": 1e-3}, 1e-3
MARKS = b"!|#%&$*^~<>{}[]=_@"
#: The metadata view: hashed source, language and length, the length, then numbers of the page's layout, script and marks.
CODES, LAYOUT = 256, 24 + len(MARKS)
META = CODES + 1 + LAYOUT


def page_features(text: str) -> list[float]:
    """How a page is laid out and typed, whatever its words say; an empty text gives zeros."""
    raw = text.encode()
    own = raw.split()
    n, m = len(raw), len(own)
    if not m:
        return [0.0] * LAYOUT
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, high = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum()), int(seen[128:].sum())
    lines = raw.split(b"\n")
    again = sum(map(eq, own, own[1:]))
    halves = (m - len(set(own))) / m
    long_words = sum(1 for w in own if len(w) > 20)
    punct = n - upper - lower - digits - high - int(seen[[32, 9, 10, 11, 12, 13]].sum())
    return [
        math.log1p(n), math.log1p(m), (n - m) / m, upper / (upper + lower + 1), digits / n, high / n, punct / m, again / m, halves, halves * math.log1p(m),
        float(again > 0.2 * m), float(upper > 0.5 * (upper + lower)), float(punct > 0.5 * m), float(punct > m), (len(lines) - 1) / m, 1 - len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(n / len(lines)),
        long_words / m, int(seen[46]) / m, int(seen[44]) / m, float(b"http" in raw), float(b"icense" in raw), float(own[-1][-1:] in (b".", b"!", b"?")), *[min(2.0, int(seen[c]) / m) for c in MARKS],
    ]


def content_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the words (A-Z lower-cased) and neighbouring pairs of texts, sorted: 1 + log of counts, scaled so that each text has length one."""
    data, off = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, off)
    h, owner = word_hash(data, starts, ends), np.repeat(np.arange(len(column)), np.diff(first))
    within = owner[1:] == owner[:-1]
    places = np.concatenate([h, ngrams(h, 2)[within]]) % np.uint64(BUCKETS)
    key, n = np.unique(np.concatenate([owner, owner[1:][within]]) * BUCKETS + places.astype(np.int64), return_counts=True)
    text, value = key // BUCKETS, 1 + np.log(n)
    norm = np.sqrt(np.bincount(text, value * value, minlength=len(column)))
    return text, key % BUCKETS, value / norm[text]


def metadata_rows(batch: pa.RecordBatch) -> np.ndarray:
    """The metadata view of a batch, a row a page."""
    out = np.zeros((batch.num_rows, META))
    length = batch.column("length").to_numpy()
    for name in ("source", "lang"):
        for i, v in enumerate(batch.column(name).to_pylist()):
            out[i, zlib.crc32(f"{name}={v}".encode()) % CODES] = 1.0
    for i, v in enumerate(np.round(2 * length).astype(int).tolist()):
        out[i, zlib.crc32(f"length={v}".encode()) % CODES] = 1.0
    out[:, CODES] = length
    out[:, CODES + 1 :] = np.array([page_features(t or "") for t in batch.column("_text").to_pylist()]).reshape(batch.num_rows, LAYOUT)
    return out


#: How a sparse vector is stored.
STORED_VECTOR = "struct<indices: array<int>, values: array<double>>"


def _stored(text: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int) -> pa.StructArray:
    ends = np.searchsorted(text, np.arange(rows + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, place.astype(np.int32)), pa.ListArray.from_arrays(ends, value)], ["indices", "values"])


def _pages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, source, lang, length, _text) of every row; lengths that are no numbers count as missing."""
    has = set(docs.columns)
    meta = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) if c in has else F.lit("-").alias(c) for c in ("source", "lang")]
    given = F.col("n_chars").cast("string").try_cast("double") if "n_chars" in has else F.lit(None).cast("double")
    length = F.coalesce(F.when(~F.isnan(given), given), F.length(text).cast("double"), F.lit(0.0))
    length = F.log1p(F.least(F.greatest(length, F.lit(0.0)), F.lit(1e12)))
    return docs.select(F.xxhash64(doc_id, F.coalesce(F.col(text), F.lit(""))).alias("rid"), F.col(doc_id).alias("doc_id"), *meta, length.alias("length"), F.col(text).alias("_text"))


def _featured(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with the vectors content and metadata, written down: for bounded sets of rows."""

    def local(batches):
        for batch in slices(batches, "_text"):
            meta = metadata_rows(batch)
            row, at = np.nonzero(meta)
            content = _stored(*content_vectors(batch.column("_text")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], content, _stored(row, at, meta[row, at], batch.num_rows)], [*keep, "content", "metadata"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema.fields)
    with small_batches(pages.sparkSession):
        return materialize(pages.mapInArrow(local, f"{schema}content {STORED_VECTOR}, metadata {STORED_VECTOR}"), "features")


def _odds(pages: DataFrame, keep: list[str], fitted: dict) -> DataFrame:
    """The columns `keep` with o_content and o_metadata, the calibrated log-odds of both views, in one pass over the texts."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(fitted)

    def local(batches):
        (wc, ic, ac, bc), (wm, im, am, bm) = held.value["content"], held.value["metadata"]
        for batch in slices(batches, "_text"):
            text, place, value = content_vectors(batch.column("_text"))
            content = np.bincount(text, wc[place] * value, minlength=batch.num_rows) + ic
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(content * ac + bc), pa.array((metadata_rows(batch) @ wm + im) * am + bm)], [*keep, "o_content", "o_metadata"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema.fields)
    return pages.mapInArrow(local, f"{schema}o_content double, o_metadata double")


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into calibrated log-odds: a penalised logistic regression on one number, by Newton steps."""
    scale = max(1e-9, float(np.std(margin)))
    x, beta = np.c_[margin / scale, np.ones(len(margin))], np.zeros(2)
    pen = np.array([PLATT * len(margin), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), x.T @ (label - p) - pen * beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def _fit(rows: DataFrame, name: str) -> DataFrame:
    """One row (name, coefficients, intercept, a, b) from a bounded sample (indices, values, label, weight, held): the view's regression and its calibration
    on the held rows (a, b = 1, 0 without any), in one task that reads the rows once, so that steps are neither jobs nor vectors in the driver.
    """
    size = {"content": BUCKETS, "metadata": META}[name]

    def local(batches):
        sample, numbers = SparseRows(size), [np.zeros((0, 3))]
        for batch in batches:
            sample.add(batch.column("indices"), batch.column("values"))
            numbers.append(np.c_[*[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "weight", "held")]])
        label, weight, held = np.concatenate(numbers).T
        held = held > 0
        coefficients, intercept = fit_logistic(sample, label, np.where(held, 0.0, weight), RIDGE[name], STEPS, standardize=name != "content")
        a, b = platt(sample.margins(coefficients, intercept)[held], label[held]) if held.any() else (1.0, 0.0)
        yield pa.RecordBatch.from_pydict({"name": [name], "coefficients": [coefficients.tobytes()], "intercept": [intercept], "a": [a], "b": [b]})

    return rows.coalesce(1).mapInArrow(local, "name string, coefficients binary, intercept double, a double, b double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, share: float = SHARE, exchanged: int = EXCHANGED, report: list | None = None,
) -> DataFrame:
    """(rid, doc_id, p_content, p_metadata, score, keep) of every row; keep is score >= 0.5.

    rid is a hash of doc_id and text.  Null texts count as empty, null metadata as a value of its own; missing metadata
    columns are left out, an n_chars that is no number counts as missing; labels other than 0 and 1 are ignored and the larger one holds where a doc_id has both.  If the labelled
    sample has one class only (or none, or fewer than 4 rows of a class), nothing can be learnt and every document is kept with score 1.
    A quarter of each class is held out for calibration; with fewer than LEAST_HELD held rows of a class the views stay
    uncalibrated.  A very long text is one row in memory.  An empty table gives an empty result; other columns, of whatever names, are ignored; repeated rows get equal scores.

    Rows of the exchange come from all documents without a label: of the `share` with the highest odds of a view those it holds to be good, of the `share` with
    the lowest those it holds to be bad, drawn to the same number of both, at most `exchanged`.  A view that is confident of one class only gives none in that round.
    `report`, a list, gets a dict (round, teacher, pupil, class, rows) for each.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    rate = min(1.0, max_labelled / max(1, given.count()))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1e6
    sample = materialize(given.where(unit < rate), "labels")
    pages = _pages(docs, doc_id, text)
    views = ("content", "metadata")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(6)), "rid")  # the sample is bounded
    known = _featured(join_small(pages, sample, "doc_id"), ["rid", "doc_id", "label"])
    held = materialize(known.select("rid", "doc_id", "label").withColumn("held", F.row_number().over(order) % 4 == 0).select("rid", "held").distinct(), "held")
    known = materialize(known.join(F.broadcast(held), "rid"), "labelled")  # held: bounded like the sample
    counts = {(r["label"], r["held"]): r["count"] for r in known.groupBy("label", "held").count().collect()}
    classes: dict[float, int] = {}
    for (one_class, _), n in counts.items():
        classes[one_class] = classes.get(one_class, 0) + n
    if len(classes) < 2 or min(classes.values()) < 4:
        one = F.lit(1.0)
        return pages.select("rid", "doc_id", one.alias("p_content"), one.alias("p_metadata"), one.alias("score"), F.lit(True).alias("keep"))
    n_known = sum(classes.values())
    prior = math.log(classes[1.0] / classes[0.0])
    calibrate = min(counts.get((c, True), 0) for c in classes) >= LEAST_HELD

    def fit(extra: dict[str, list[DataFrame]]) -> dict[str, tuple]:
        """Both views at once, a task each; two rows reach the driver."""
        fits = []
        for name in views:
            vector = [F.col(f"{name}.indices"), F.col(f"{name}.values"), F.col("label")]
            rows = known.select(*vector, F.lit(1.0).alias("weight"), (F.col("held") & F.lit(calibrate)).alias("held"))
            size = sum(e.count() for e in extra[name])
            for e in extra[name]:
                rows = rows.unionByName(e.select(*vector, F.lit(min(1.0, 0.5 * n_known / max(1, size))).alias("weight"), F.lit(False).alias("held")))
            fits.append(_fit(rows, name))
        with small_batches(docs.sparkSession):
            return {r["name"]: (np.frombuffer(bytes(r["coefficients"])), r["intercept"], r["a"], r["b"]) for r in fits[0].unionByName(fits[1]).collect()}

    extra: dict[str, list[DataFrame]] = {v: [] for v in views}
    fitted = fit(extra)
    unlabelled = join_small(pages, held.select("rid"), "rid", "left_anti")
    for turn in range(rounds):
        with small_batches(docs.sparkSession):
            scored = materialize(_odds(unlabelled, ["rid"], fitted).distinct(), "odds")
        chosen = []
        for teacher, pupil in (views, views[::-1]):
            odds = F.col(f"o_{teacher}")
            low, high = scored.agg(F.percentile_approx(f"o_{teacher}", [share, 1 - share], 10_000)).first()[0] or (0.0, 0.0)
            sure = {1.0: (odds >= high) & (odds > 0), 0.0: (odds <= low) & (odds < 0)}
            sizes = scored.agg(*[F.count_if(c).alias(f"n{int(k)}") for k, c in sure.items()]).first()
            take = min(exchanged, sizes["n1"], sizes["n0"])
            for k, c in sure.items():
                n = sizes[f"n{int(k)}"]
                drawn = scored.where(c & (F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(1 << 30)) < F.lit(int((1 << 30) * take / max(1, n)) if take < n else 1 << 30))) if take else scored.where(F.lit(False))
                chosen.append(drawn.select("rid", F.lit(k).alias("label"), F.lit(pupil).alias("pupil")))
                if report is not None:
                    report.append({"round": turn + 1, "teacher": teacher, "pupil": pupil, "class": int(k), "rows": drawn.count()})
        ids = materialize(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).unionByName(chosen[3]), "exchanged")  # about 4 * exchanged rows at most
        rows = _featured(unlabelled.join(F.broadcast(ids), "rid").dropDuplicates(["rid", "pupil"]), ["label", "pupil"])
        for v in views:
            extra[v] = [*extra[v], rows.where(F.col("pupil") == v)]
        fitted = fit(extra)
    out = _odds(pages, ["rid", "doc_id"], fitted)
    p = lambda x: 1 / (1 + F.exp(-x))
    total = F.col("o_content") + F.col("o_metadata") - F.lit(prior)
    return out.select("rid", "doc_id", p(F.col("o_content")).alias("p_content"), p(F.col("o_metadata")).alias("p_metadata"), p(total).alias("score"), (total >= 0).alias("keep"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("rid")
