"""Toxicity by class-conditional Kneser-Ney models.

Words are sequences of bytes in lower case, without ASCII punctuation at both ends; a model predicts each byte, and the word's
end, from the bytes before it in the word. The toxic and the ordinary model differ in their highest order alone: 12-gram counts
of a labelled sample, discounted by 2, so what fewer than three texts hold is no evidence. What they
leave goes to shared lower orders, interpolated Kneser-Ney over continuation counts of the whole corpus up to 5-grams, so a rare or
new form has the same backoff in both classes and tells nothing by itself, while the start of a known expression does.

A text's evidence is its length-normalised log-likelihood ratio, once over all its words and once over what its words exceed
two nats by (words that differ little between the classes are noise that grows with the text), and the mean of its three
highest ratios of words above one nat. A logistic function of the three, fitted on
ratios of models that have not seen the text (five folds), is the score. Counts are of texts, not of mentions, and
equal texts of the sample count once, so one much repeated text doesn't make its words look toxic.

Where n-grams of neither class exceed the discount, the shared probability cancels out of the ratio. So scoring needs a ratio for each
class n-gram that does, and one for each of their contexts: a table that the labelled sample bounds, made by joins with the
corpus's counts, which stay distributed. N-grams end at words, so each distinct word is rated once a worker.

Size bounds: the labelled sample has at most `per_class` texts and `class_bytes` bytes of each class. The shared counts
cover the whole corpus and grow with it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import col, filesystem, work_dir, written

ORDER, SHARED, DISCOUNT, CLASS_DISCOUNT = 12, 5, 0.75, 2.0
FOLDS, EXCESS, STRONGEST, STRONG = 5, 2.0, 3, 1.0
FEATURES = 3
REMEMBERED = 250_000
PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def bare(word: bytes) -> bytes:
    return word.strip(PUNCTUATION) or word


def _layout(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with their starts and ends, the place of each byte and end, and the number of its word."""
    raw = np.frombuffer(b"".join(b"\0" * (order - 1) + w + b"\1" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(size) - size
    at = np.repeat(np.cumsum(size + order - 1) - size - first, size) + np.arange(int(size.sum()))
    return raw, at, np.repeat(np.arange(len(words)), size)


def _recent(raw: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes at each place, as a number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n - 1, -1, -1):
        out = out << np.uint64(8) | raw[at - k]
    return out


def shared_grams(words: list[bytes]) -> np.ndarray:
    """The grams of one byte more than the longest shared ones, one for each byte and end of each word."""
    raw, at, _ = _layout(words, SHARED + 1)
    return _recent(raw, at, SHARED + 1)


def class_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of each place's class n-gram and of its context, its last SHARED bytes, and the number of its word."""
    raw, at, of = _layout(words, ORDER)
    context = np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1, 0, -1):
        context = context * _MIX ^ (raw[at - k] + np.uint64(1))
        context ^= context >> np.uint64(29)
    gram = context * _MIX ^ (raw[at] + np.uint64(1))
    return gram ^ gram >> np.uint64(29), context, _recent(raw, at, SHARED), of


# ---- counts --------------------------------------------------------------------------------------------------


def corpus_grams(docs: DataFrame, text_col: str) -> DataFrame:
    """`gram`: the distinct shared grams of all words of all texts, made distinct in each task before they are shuffled."""

    def run(batches):
        import pyarrow as pa

        new: set[bytes] = set()
        done: set[bytes] = set()  # words whose grams are in `known`, or were sent on
        known = np.empty(0, np.uint64)

        def merged():
            nonlocal done
            fresh = list(new - done)
            done = (done if len(done) < REMEMBERED else set()) | new
            bares = list(set(map(bare, fresh)))
            parts = [np.unique(shared_grams(bares[k : k + 50_000])) for k in range(0, len(bares), 50_000)]
            return np.unique(np.concatenate([known, *parts])) if parts else known

        for b in batches:
            for text in b.column(0):
                new.update(words_of(text.as_py()))
                if len(new) > 100_000:
                    known, new = merged(), set()
            if len(known) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64))], ["gram"])
                known = known[:0]
        if len(known := merged()):
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64))], ["gram"])

    return docs.select(col(text_col).cast("string")).mapInArrow(run, "gram long").distinct()


def shared_backoff(docs: DataFrame, text_col: str) -> DataFrame:
    """`tail, back`: for each SHARED-gram the interpolated Kneser-Ney probability of its last byte after the bytes before it."""
    low = lambda gram, k: gram.bitwiseAND(F.lit((1 << 8 * k) - 1))
    level, levels = written(corpus_grams(docs, text_col), "toxicity-grams"), {}  # texts are read once, then a table
    for k in range(SHARED, 0, -1):
        levels[k] = level = written(level.groupBy(low(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), f"toxicity-grams-{k}")
    back = None
    for k, level in sorted(levels.items()):
        own = level.withColumn("context", F.shiftrightunsigned("gram", 8))
        own = own.join(own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "context")
        own = own.withColumn("lower", F.lit(1 / 256)) if back is None else own.join(back, low(F.col("gram"), k - 1) == F.col("tail")).withColumnRenamed("back", "lower").drop("tail")
        back = own.select(F.col("gram").alias("tail"), ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + F.col("kinds") * DISCOUNT * F.col("lower")) / F.col("total")).alias("back"))
    return back


def class_counts(sample: DataFrame) -> DataFrame:
    """`gram, context, tail, c00, c01, c10, ...`: counts by fold and class of the sample `text, y, fold`, a word once a text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cells = (np.asarray(b.column(2)) * 2 + np.asarray(b.column(1))).tolist()
            for cell in sorted(set(cells)):
                texts = (t for t, c in zip(b.column(0), cells) if c == cell)
                kinds = Counter(w for t in texts for w in set(map(bare, set(words_of(t.as_py())))))
                words = list(kinds)
                for begin in range(0, len(words), 50_000):
                    some = words[begin : begin + 50_000]
                    gram, context, tail, of = class_grams(some)
                    order = np.argsort(gram, kind="stable")
                    n = np.fromiter((kinds[w] for w in some), np.int64, len(some))[of][order]
                    gram = gram[order]
                    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                    columns = [x.view(np.int64) for x in (gram[first], context[order][first], tail[order][first])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.full(len(first), cell, np.int32), np.add.reduceat(n, first))], ["gram", "context", "tail", "cell", "n"])

    counted = sample.select("text", F.col("y").cast("int"), F.col("fold").cast("int")).mapInArrow(run, "gram long, context long, tail long, cell int, n long")
    return counted.groupBy("gram", "context", "tail").agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c // 2}{c % 2}") for c in range(2 * FOLDS)))


#: The models: each leaves one fold out, the last none.
MODELS = (*range(FOLDS), None)


def ratio_col(fold: int | None) -> str:
    return "r" if fold is None else f"r{fold}"


def class_ratios(counts: DataFrame, back: DataFrame) -> DataFrame:
    """`kind, key, r0, ..., r`: log P(byte | toxic) - log P(byte | ordinary) by each model.

    Kind 0: class n-grams that exceed the discount in a class; kind 1: all other bytes after a context of these.
    """
    n = lambda m, y: sum((F.col(f"c{f}{y}") for f in range(FOLDS) if f != m), F.lit(0))
    name = lambda m, y: f"{'a' if m is None else m}{y}"
    sums = [(F.sum(n(m, y)).cast("double").alias(f"t{name(m, y)}"), F.sum(F.least(n(m, y).cast("double"), F.lit(CLASS_DISCOUNT))).alias(f"d{name(m, y)}")) for m in MODELS for y in (0, 1)]
    contexts = counts.groupBy("context").agg(*(c for pair in sums for c in pair), F.max(F.greatest(n(None, 0), n(None, 1))).alias("most")).where(F.col("most") > CLASS_DISCOUNT).drop("most")
    contexts = written(contexts, "toxicity-contexts")
    own = counts.where(F.greatest(n(None, 0), n(None, 1)) > CLASS_DISCOUNT).join(contexts, "context").join(back, "tail", "left").withColumn("back", F.coalesce("back", F.lit(1 / 256)))

    def left(m, y):
        total = F.col(f"t{name(m, y)}")
        return F.when(total > 0, F.col(f"d{name(m, y)}") / total).otherwise(1.0)

    def p(m, y):
        total = F.col(f"t{name(m, y)}")
        return F.when(total > 0, F.greatest(n(m, y) - CLASS_DISCOUNT, F.lit(0.0)) / total).otherwise(0.0) + left(m, y) * F.col("back")

    grams = own.select(F.lit(0).alias("kind"), F.col("gram").alias("key"), *((F.log(p(m, 1)) - F.log(p(m, 0))).alias(ratio_col(m)) for m in MODELS))
    return grams.unionAll(contexts.select(F.lit(1).alias("kind"), F.col("context").alias("key"), *((F.log(left(m, 1)) - F.log(left(m, 0))).alias(ratio_col(m)) for m in MODELS)))


# ---- scoring -------------------------------------------------------------------------------------------------


class _Known(dict):
    """Ratios of words; unknown words are noted and count as NaN until they are rated."""

    def __init__(self):
        self.new: set[bytes] = set()

    def __missing__(self, word: bytes) -> float:
        self.new.add(word)
        return float("nan")


class Model:
    """Log-likelihood ratios of words, from the table of class_ratios()."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, ratio: np.ndarray):
        self.tables = []
        for own in (0, 1):
            keys = key[kind == own].astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], ratio[kind == own][order]))
        self.known = _Known()

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word, to nine places, so that equal ratios compare equal."""
        gram, context, _, of = class_grams([bare(w) for w in words])
        out = np.zeros(len(gram))
        for (keys, ratio), asked in zip(self.tables[::-1], (context, gram)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[at] == asked
                out[hit] = ratio[at[hit]]
        return np.round(np.bincount(of, out, len(words)), 9)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: the mean ratio of its words, the mean of what they exceed EXCESS by, and the mean of the STRONGEST
        highest distinct ratios above STRONG (fewer are filled up with zeros); zeros for no words."""
        if len(self.known) > REMEMBERED:
            self.known = _Known()
        known = self.known
        split = [words_of(t) for t in texts]
        found = [np.fromiter(map(known.__getitem__, words), np.float64, len(words)) for words in split]
        if known.new:
            new, known.new = list(known.new), set()
            for begin in range(0, len(new), 20_000):
                some = new[begin : begin + 20_000]
                known.update(zip(some, self.ratios(some).tolist()))
        out = np.zeros((len(texts), FEATURES))
        for k, (words, ratio) in enumerate(zip(split, found)):
            if words:
                for i in np.flatnonzero(np.isnan(ratio)).tolist():
                    ratio[i] = known[words[i]]
                strong = np.unique(ratio[ratio > STRONG])[-STRONGEST:]
                out[k] = ratio.mean(), np.maximum(ratio - EXCESS, 0).mean(), strong.sum() / STRONGEST
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant last, of a weighted ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge * weight.sum() / len(x)] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Toxicity:
    """fit() builds the table of ratios and the score; score() applies them to any table of texts."""

    def __init__(self, *, per_class: int = 6000, class_bytes: int = 24 << 20):
        self.per_class, self.class_bytes = per_class, class_bytes
        self.table_at = None
        self.beta, self.scale, self.base = None, None, 0.0

    def fit(self, corpus: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: "F.Column | None" = None) -> "Toxicity":
        """`corpus` gives shared counts and texts, `labels` classes; `train` (over `doc_id`) says whose labels may be learnt from.

        Null labels and ids, and labels without a document, aren't learnt from; of several labels of an id the highest counts, of
        several texts of an id that of the smallest hash. The sample has the ids with the
        smallest hashes, as many ordinary as toxic at most; it is the same in each run. Texts of over a hundredth of `class_bytes` are
        taken last and by growing size, so a long text never displaces a short one.
        """
        spark = corpus.sparkSession
        known = labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
        known = known.where(train) if train is not None else known
        known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
        texts = corpus.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
        rows = texts.select("doc_id", F.struct(F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).alias("x")).join(known, "doc_id")
        rows = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "y", "x.th", "x.bytes", F.xxhash64("doc_id").alias("h"))
        rows = written(rows, "toxicity-labelled")
        size = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
        if not size:
            return self
        self.base = size.get(1, 0) / sum(size.values())
        if len(size) < 2:
            return self
        share = F.lit(max(1, self.class_bytes // 100))
        longer = F.when(F.col("bytes") > share, F.ceil(F.log2(F.col("bytes") / share))).asc_nulls_first()  # null: a short text
        first = [rows.where(F.col("y") == y).orderBy(longer, "h", "doc_id").limit(self.per_class) for y in (0, 1)]
        so_far = Window.partitionBy("y").orderBy(longer, "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        ids = first[0].unionAll(first[1]).withColumn("all", F.sum(F.col("bytes").cast("long")).over(so_far)).where(F.col("all") <= self.class_bytes)
        picked = texts.join(F.broadcast(ids.select("doc_id", "y", "th")), "doc_id").where(F.xxhash64("text") == F.col("th"))  # at most 2 * per_class ids
        fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
        sample = written(picked.select("text", "y", fold).dropDuplicates(["text", "y"]), "toxicity-sample")
        counts = written(class_counts(sample), "toxicity-classes")
        class_ratios(counts, shared_backoff(corpus, text_col)).write.parquet(table_at := work_dir(spark, "toxicity-ratios"))
        self.table_at = table_at
        found = _featured(sample, table_at).toPandas()  # three numbers a text of the sample
        x, y = found[[f"f{k}" for k in range(FEATURES)]].to_numpy(float), found["y"].to_numpy(float)
        if len(set(y.tolist())) < 2:
            return self
        self.scale = np.maximum(x.std(0), 1e-9)
        weight = np.where(y == 1, self.base / max(1, (y == 1).sum()), (1 - self.base) / max(1, (y == 0).sum())) * len(y)
        self.beta = logistic(x / self.scale, y, weight)
        return self

    def score(self, docs: DataFrame, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """`docs` with the score, 0 to 1. Null and empty texts have no evidence; without labels of both classes all get the base rate.

        `score_col` replaces a column of that name; other columns stay as they are, in order. No row is shuffled.
        """
        if self.beta is None:
            return docs.withColumn(score_col, F.lit(float(self.base)))
        beta, scale, table_at = self.beta, self.scale, self.table_at

        @F.arrow_udf("double")  # texts become Python strings a few at a time
        def score(texts):
            import pyarrow as pa

            model = _model(table_at, None)
            out = []
            for begin in range(0, len(texts), 128):
                x = model.features(texts.slice(begin, 128).to_pylist()) / scale
                out.append(1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30))))
            return pa.array(np.concatenate(out) if out else np.empty(0))

        return docs.withColumn(score_col, score(col(text_col).cast("string")))


_models: dict[tuple, Model] = {}


def _model(table_at: str, fold: int | None) -> Model:
    """The worker's model; models of one table alone are kept."""
    if (key := (table_at, fold)) not in _models:
        import pyarrow.dataset as ds

        for old in [k for k in _models if k[0] != table_at or fold is None]:
            del _models[old]
        fs, path = filesystem(table_at)
        table = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["kind", "key", ratio_col(fold)])
        _models[key] = Model(*(table[c].to_numpy() for c in table.column_names))
    return _models[key]


def _featured(sample: DataFrame, table_at: str) -> DataFrame:
    """`y, f0, ...` of the sample's texts, each by the model that leaves its fold out."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            folds = np.asarray(b.column(2))
            for fold in np.unique(folds).tolist():
                own = np.flatnonzero(folds == fold)
                for begin in range(0, len(own), 128):
                    some = b.take(pa.array(own[begin : begin + 128]))
                    x = _model(table_at, fold).features(some.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([some.column(1), *(pa.array(x[:, k]) for k in range(FEATURES))], ["y", *(f"f{k}" for k in range(FEATURES))])
                _model(table_at, fold).known = _Known()  # one fold's words at a time

    return sample.select("text", F.col("y").cast("int"), "fold").mapInArrow(run, "y int, " + ", ".join(f"f{k} double" for k in range(FEATURES)))
