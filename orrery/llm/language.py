"""Language proportions of a document by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import mapped

#: Hash values of byte trigrams.
BUCKETS = 1 << 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[[*range(33), *b"0123456789.,;:!?()[]{}<>|%#*&$@=+~^_-/\\'\"`"]] = 32


def trigrams(text: str) -> np.ndarray:
    """How often each hash value of three bytes occurs; case, digits and signs are levelled."""
    b = _PLAIN[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(17)
    return np.bincount(code, minlength=BUCKETS)


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) summed over all rows with a language and a text. Each part sums before it hands on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in sums and len(sums) >= 64:
                    yield from handed()
                sums[lang] = sums.get(lang, 0) + trigrams(text.as_py())
        yield from handed()

    rows = docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return mapped(rows, each, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Smoothed trigram probabilities of each language, as a table of BUCKETS rows."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5) -> None:
        self.langs = langs
        self.table = ((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float64)

    def mixture(self, n: np.ndarray, p: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Maximum-likelihood proportions of the languages in p's columns, and the log-likelihood."""
        share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
        for _ in range(rounds):
            joint = p * share
            share = n @ (joint / joint.sum(1, keepdims=True)) / total
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str, rounds: int = 12, penalty: float = 2.0) -> tuple[list[int], np.ndarray]:
        """The chosen languages, largest share first, and their shares.

        Sets grow by the share they have in the full mixture; a set is chosen when no larger one raises
        the log-likelihood by `penalty` * log(trigrams) for each further language.
        """
        counts = trigrams(text)
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(np.float64), self.table[at]
        if p.shape[1] == 1:
            return [0], np.ones(1)
        share, _ = self.mixture(n, p, rounds)
        order = np.argsort(-share, kind="stable")
        cost = penalty * np.log(max(2.0, n.sum()))
        kept, best = (np.ones(1), float(n @ np.log(p[:, order[0]]))), 1
        for size in range(2, len(order) + 1):
            if share[order[size - 1]] < 0.005:
                break
            found = self.mixture(n, p[:, order[:size]], rounds)
            if found[1] - cost <= kept[1]:
                break
            kept, best = found, size
        rank = np.argsort(-kept[0], kind="stable")
        return [int(order[:best][i]) for i in rank], kept[0][rank]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel | None:
    """Sums over all rows given; the driver gets one number for each language and bucket."""
    sums = trigram_counts(docs, lang_col, text_col).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS))
    place = {name: i for i, name in enumerate(langs)}
    counts[[place[x] for x in sums.column("lang").to_pylist()], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return LanguageModel(langs, counts)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, lang_pred, score (the predicted language's share), langs (all chosen).

    Texts that are null or have no letter get `und`, score 0 and no langs; so does every text if no
    language could be learnt. Of equal shares the alphabetically first language wins.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, langs = [], [], []
            for t in b.column(1):
                text = t.as_py()
                if model is None or not text or not _LETTER.search(text):
                    pred.append(UNKNOWN), score.append(0.0), langs.append([])
                    continue
                chosen, share = model.infer(text)
                pred.append(model.langs[chosen[0]]), score.append(float(min(1.0, share[0]))), langs.append([model.langs[i] for i in chosen])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))], names=[id_col, "lang_pred", "score", "langs"])

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return mapped(rows, each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, langs array<string>")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify() with held_out, learnt from the rows of docs that are not held out."""
    model = learn(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    return identify(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col(id_col)))
