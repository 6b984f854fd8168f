"""Language identification by a small convolutional network over bytes.

A window of bytes is embedded, filters of several widths slide over it, each
filter's largest response is kept, and a softmax layer gives the languages'
probabilities. The network is trained in numpy on a bounded sample of labelled
rows. For prediction a text becomes windows of fixed length without overlap,
all of them: their log-probabilities are added up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sceneweave.llm.common import kept, map_batches

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Windows that go through the network at once in prediction.
AT_ONCE = 1024


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Each filter bank as responses to single bytes or byte pairs, to be added up along a window."""
        out = []
        for width, bank in zip(WIDTHS, self.filters, strict=True):
            by_byte = [self.embed @ part for part in np.split(bank, width)]
            pairs = [(by_byte[k][:, None, :] + by_byte[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, width - 1, 2)]
            out.append(pairs + ([by_byte[-1]] if width % 2 else []))
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """(windows, languages) for a (windows, WINDOW) array of bytes."""
        n, pooled = len(windows), []
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        for width, parts in zip(WIDTHS, tables, strict=True):
            last = WINDOW - width + 1
            total = None
            for k, part in enumerate(parts):
                index = pairs[:, 2 * k : 2 * k + last] if len(part) == 65536 else windows[:, 2 * k : 2 * k + last]
                total = part.take(index, axis=0) if total is None else np.add(total, part.take(index, axis=0), out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        logits = hidden @ self.dense + self.dense_bias
        logits -= logits.max(axis=1, keepdims=True)
        return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))).reshape(n, -1)


def to_windows(text: bytes) -> np.ndarray:
    padded = np.zeros(max(1, -(-len(text) // WINDOW)) * WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return padded.reshape(-1, WINDOW)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, least_steps: int = 600, batch: int = 128, rate: float = 0.004, seed: int = 3) -> Network:
    """Train on (n, WINDOW) bytes, more often on few of them. Parts of windows are blanked at random, so that short texts are learned too."""
    epochs = max(epochs, -(-least_steps * batch // len(windows)))
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = Network(languages, scale(256, EMBED) * 4, [scale(w * EMBED, FILTERS) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), scale(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32))
    weights = [net.embed, *net.filters, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x, y = windows[chosen].copy(), labels[chosen]
            lengths = np.where(rng.random(len(x)) < 0.5, rng.integers(4, WINDOW + 1, len(x)), WINDOW)
            x[np.arange(WINDOW) >= lengths[:, None]] = 0
            embedded = net.embed[x]
            pooled, routes = [], []
            for width, bank in zip(WIDTHS, net.filters, strict=True):
                columns = np.concatenate([embedded[:, k : WINDOW - width + 1 + k] for k in range(width)], axis=2)
                response = columns @ bank
                best = response.argmax(axis=1)
                pooled.append(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0])
                routes.append((columns, best))
            before = np.concatenate(pooled, axis=1) + net.bias
            hidden = np.maximum(before, 0)
            logits = hidden @ net.dense + net.dense_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.dense.T) * (before > 0)
            grads = [np.zeros_like(net.embed), [], back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            rows = np.arange(len(x))[:, None]
            for k, (width, bank) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                columns, best = routes[k]
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1].append(np.einsum("nfc,nf->cf", columns[rows, best], own))
                for j in range(width):
                    np.add.at(grads[0], x[rows, best + j].ravel(), (own[:, :, None] * bank[j * EMBED : (j + 1) * EMBED].T[None]).reshape(-1, EMBED))
            step += 1
            flat = [grads[0], *grads[1], *grads[2:]]
            for i, (w, g) in enumerate(zip(weights, flat, strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w -= (rate * (0.3 if epoch > epochs * 2 // 3 else 1) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(labelled: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 600, most_rows: int = 120_000, least_rows: int = 20, windows_per_doc: int = 3) -> Network | None:
    """Fit a network on about ``per_language`` rows of each label; null labels and texts without letters are left out.

    Every label is learned. The bound: about ``most_rows`` rows in all, which many
    labels share, but ``least_rows`` of each; rows are chosen by a hash of their
    id and text, with a threshold from the label's count, and cut into windows on
    the executors; the driver gets at most ``windows_per_doc`` windows of a chosen
    row. None if there is nothing to learn.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(least_rows, min(per_language, most_rows // len(counts)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, out = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if LETTER.search(text):
                every = to_windows(text.encode())
                picked = every[np.unique(np.linspace(0, len(every) - 1, windows_per_doc).astype(int))]
                langs += [lang] * len(picked)
                out += [w.tobytes() for w in picked]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    found = sorted((r["lang"], bytes(r["window"])) for r in map_batches(chosen.select("lang", "text"), cut, "lang string, window binary").collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    places = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([places[lang] for lang, _ in found]), languages)


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row per input row; see ``annotate``. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return annotate(rows, network).select("doc_id", "lang_pred", "score")


def annotate(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names.

    ``und`` with score 0 if the text is null, has no letter, or nothing was
    learned. Else the score is the mean probability of the language over the
    windows. Only the text is an input. Of a text of any length all windows are
    read, some thousands at a time.
    """
    rows = docs.drop("lang_pred", "score").withColumn(text_col, F.col(text_col).cast("string"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).to_pylist()
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if network else []
        if some:
            tables = kept("language", network.dense.tobytes(), network.tables)
            sums, chances, n = (np.zeros((len(texts), len(network.languages))) for _ in range(3))
            held, owners, count = [], [], 0

            def flush() -> None:
                windows, owner = np.concatenate(held), np.repeat([o for o, _ in owners], [k for _, k in owners])
                for at in range(0, len(windows), AT_ONCE):
                    log_p = network.log_probabilities(windows[at : at + AT_ONCE], tables)
                    np.add.at(sums, owner[at : at + AT_ONCE], log_p)
                    np.add.at(chances, owner[at : at + AT_ONCE], np.exp(log_p))
                    np.add.at(n, owner[at : at + AT_ONCE], 1)

            for i in some:
                held.append(to_windows(texts[i].encode()))
                owners.append((i, len(held[-1])))
                count += len(held[-1])
                if count >= 4 * AT_ONCE:
                    flush()
                    held, owners, count = [], [], 0
            if held:
                flush()
            for i in some:
                best = int(sums[i].argmax())
                langs[i], scores[i] = network.languages[best], min(1.0, chances[i, best] / n[i, best])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(rows, work, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that training never sees: crc32 of the id's digits mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows of ``docs`` outside the held-out fold."""
    network = train(docs.where(~held_out(id_col)), label_col, text_col, id_col)
    return predict(docs, network, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
