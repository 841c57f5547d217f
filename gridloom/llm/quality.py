"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_by_id, select_text

#: At most about this many labelled rows are used for fitting: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 60, 4, 64, 0.15, 20
THRESHOLD = 0.3

_FUNCTION_WORDS = {
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "as", "with", "by", "at",
    "de", "la", "le", "les", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "dans", "sur", "qui",
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "su", "para", "es", "al", "lo",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein",
}
_PUNCT_RUN = re.compile(r"[^\w\s]{2,}")

FEATURES = [
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "letters", "upper",
    "digits", "spaces", "punct", "ends", "bars", "odd", "exclaims", "commas", "punct_runs", "distinct_words",
    "distinct_bigrams", "top_word", "function_words", "distinct_lines", "short_lines", "words_with_mark", "capitals",
    "longest_line", "top_bigram", "other_bytes", "mean_line", "url_marks",
]


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; an empty one has zeros."""
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    words = text.split()
    k = len(words)
    lines = text.split("\n")
    lower = [w.lower() for w in words]
    sizes = np.fromiter(map(len, words), np.int64, k) if k else np.zeros(1, np.int64)
    distinct = set(lower)
    seen: dict = {}
    for pair in zip(lower, lower[1:], strict=False):
        seen[pair] = seen.get(pair, 0) + 1
    top: dict = {}
    for w in lower:
        top[w] = top.get(w, 0) + 1
    line_sizes = [len(x) for x in lines]
    per, word = 1.0 / max(n, 1), 1.0 / max(k, 1)
    share = lambda chars: float(sum(counts[c] for c in chars)) * per
    punct = sum(int(counts[c]) for c in range(33, 127) if not chr(c).isalnum())
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        float(np.log1p(len(lines))),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        float(counts[65:91].sum() + counts[97:123].sum()) * per,
        float(counts[65:91].sum()) * per,
        float(counts[48:58].sum()) * per,
        share(b" \t\n\r"),
        punct * per,
        share(b".?") / max(share(b" \n"), per),
        share(b"|") * 1.0,
        share(b"#$%&*<>=@{}[]~^_\\"),
        share(b"!"),
        share(b",;:"),
        len(_PUNCT_RUN.findall(text)) * word,
        len(distinct) * word,
        len(seen) / max(k - 1, 1),
        max(top.values(), default=0) * word,
        sum(n for w, n in top.items() if w.strip(".,;:!?") in _FUNCTION_WORDS) * word,
        len(set(lines)) / len(lines),
        sum(s < 30 for s in line_sizes) / len(lines),
        sum(not w[-1].isalnum() for w in words) * word,
        sum(w[0].isupper() for w in words) * word,
        float(np.log1p(max(line_sizes))),
        max(seen.values(), default=0) / max(k - 1, 1),
        float(counts[128:].sum()) * per,
        float(np.log1p(n / len(lines))),
        (text.count("http") + text.count("www.") + text.count("=")) * word,
    ]


# --- boosted trees -----------------------------------------------------------------------------------------------


class Forest:
    """Binary trees of one depth, all in three arrays of shape (trees, nodes): feature, threshold and leaf value."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all rows go down all trees together, a level at a time."""
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.feature.shape[1] + 1))
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Newton boosting of the logistic loss with splits at histogram edges. Deterministic; ties go to the first edge."""
    nodes = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        # one label only, or none: its smoothed share is all there is to learn
        p = (y.sum() + 1) / (len(y) + 2)
        none = np.zeros((0, nodes))
        return Forest(float(np.log(p / (1 - p))), none.astype(int), none, np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    n_features = x.shape[1]
    flat = binned + np.arange(n_features) * BINS
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    total = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(nodes, int), np.full(nodes, np.inf)
        for level in range(depth):
            first = (1 << level) - 1
            width = n_features * BINS
            at = ((node - first)[:, None] * width + flat).ravel()
            size = (1 << level) * width
            shape = (1 << level, n_features, BINS)
            g = np.bincount(at, np.repeat(grad, n_features), size).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(hess, n_features), size).reshape(shape).cumsum(2)
            c = np.bincount(at, minlength=size).reshape(shape).cumsum(2)
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
            gain[(c < LEAST_LEAF) | (ct - c < LEAST_LEAF)] = 0
            best = gain.reshape(1 << level, -1).argmax(1)
            for k, b in enumerate(best):
                f, edge = divmod(int(b), BINS)
                if gain[k, f, edge] > 1e-9 and edge < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][edge]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - nodes
        value = RATE * np.bincount(leaf, grad, nodes + 1) / (np.bincount(leaf, hess, nodes + 1) + 1)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


# --- on Spark ----------------------------------------------------------------------------------------------------


def _train(docs: DataFrame, labels: DataFrame, label_col: str, train_rows: int) -> Forest:
    """Fit on labelled rows outside the held-out fifth, at most about ``train_rows`` of them by the hash of their ids."""
    usable = (
        labels.select(F.col("`doc_id`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    n = usable.count()
    span = 1 << 20
    bound = span if n <= train_rows else -(-span * train_rows // n)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < bound)

    def measure(batches):
        for pdf in batches:
            rows = [np.array(statistics(t)).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": rows})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # the chosen labels are bounded in number, so a join with them needs no shuffle of the texts
    rows = (
        docs.filter("doc_id is not null")
        .join(F.broadcast(chosen), "doc_id")
        .mapInPandas(measure, f"doc_id {kind}, label int, x binary")
        .groupBy("doc_id")  # one row for each chosen label, however often its id occurs
        .agg(F.min(F.struct("x", "label")).alias("least"))
        .select("doc_id", "least.*")
        .toPandas()
        .sort_values(["doc_id", "x"])
    )
    x = np.array([np.frombuffer(r) for r in rows["x"]]).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    Scores come from the whole text alone. Labels of ids whose text's crc32 leaves no remainder by 5 are held out.
    Null and empty texts get a score like any other; a null id is not held out and has no label. Labels other than 0
    and 1 are not used, of several labels of one id the least is, with the least of its texts' statistics. Without usable labels each score is 0.5. Repeated rows are
    scored alike; an empty table gives an empty result; other columns are ignored.
    """
    docs = select_text(df, id_col, text_col)
    forest = _train(docs, labels, label_col, train_rows)

    def run(batches):
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]]).reshape(-1, len(FEATURES))
            score = forest.score(x)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "held_out": [i is not None and zlib.crc32(i.encode()) % 5 == 0 for i in pdf["doc_id"]],
                    "score": score,
                    "predicted": (score >= THRESHOLD).astype("int32"),
                }
            )

    return map_by_id(docs, run, "held_out boolean, score double, predicted int")


def keep_quality(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``df`` (doc_id, text and any others) that score ``threshold`` or more, in one pass and unchanged."""
    forest = _train(select_text(df, "doc_id", "text"), labels, "quality", train_rows)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([statistics(t.as_py() or "") for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(forest.score(x) >= threshold))

    # other columns pass through as they are
    return df.mapInArrow(run, df.schema)
