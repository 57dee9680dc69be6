"""Language identification by error-correcting output codes over hashed n-grams.

Each learned language has a codeword; a binary classifier a bit predicts it from the text's hashed byte n-grams. Decoding sums the
logistic loss of every bit against a language's codeword, each bit weighted by how well it does on the training rows, and
takes the language of least loss. The score is that language's share of exp(-loss). A text is ambiguous where the two best
codewords are closer than a gap that is set on labelled texts kept out of the fit: MARGIN, or less if over CLEAN of the rightly decoded ones would be closer.

Training rows: text and lang both there and crc32(doc_id as text) mod 4 not 2; at most about PER_LANGUAGE distinct texts a language
and TOTAL in all, chosen by a hash of the text (documented bounds; chosen from all rows, whole texts; copies of a text are one). Every language is learned, up to the TOTAL that so many texts can show; the more there
are, the more bits a codeword has.
Predictions see the text alone.

Edge cases: a null text or one without a letter (Unicode category L: numerals such as one half or Roman two are none) is `und`, score 0; a single learned language is predicted for all others, and
with none all are `und`; a null doc_id is held out (its remainder isn't known); repeated rows get equal results; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_batches
from .hashed import fit_logistic, ngrams

BITS, SIZES = 11, (1, 2, 3)
PER_LANGUAGE, TOTAL = 1500, 12_000
MARGIN, CLEAN = 0.1, 0.001
#: One in so many sampled texts is kept out of the fit.
APART = 5
UNKNOWN = "und"
#: ASCII letters lowered, other ASCII made a space; bytes of other letters stay.
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD_SIGN = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether some character is of Unicode category L (str.isalpha says so; the pattern also takes numerals that are no digits)."""
    return any(x.group().isalpha() for x in WORD_SIGN.finditer(text))


def features(text: str) -> np.ndarray:
    data = b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split())
    x = np.sqrt(ngrams(np.frombuffer(b" " + data + b" ", np.uint8), SIZES, BITS).astype(np.float32))
    return x / max(1e-9, float(np.sqrt(x @ x)))


def codebook(k: int) -> np.ndarray:
    """Codewords [k, bits] of -1 and 1: the exhaustive code up to 5 languages, else the widest of random codes (fixed seed)."""
    if k <= 5:
        n = max(1, 2 ** (k - 1) - 1)
        bits = [[1] * n] + [[-1 if (j >> (k - 1 - i)) & 1 else 1 for j in range(1, n + 1)] for i in range(1, k)]
        return np.array(bits, np.float32)
    n, rng, best = int(12 + 6 * np.ceil(np.log2(k))), np.random.default_rng(5), (-1, None)
    for _ in range(max(1, 200 * 256**2 // max(k, 256) ** 2)):  # many codewords are compared fewer times, a block of rows at a time
        code = np.where(rng.random((k, n)) < 0.5, -1, 1).astype(np.float32)
        if (abs(code.sum(0)) == k).any():
            continue
        apart = min(((n - code[a : a + 256] @ code.T) / 2 + n * np.eye(len(code[a : a + 256]), k, a)).min() for a in range(0, k, 256))
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def draw(docs: DataFrame, per_language: int) -> tuple[list[str], pd.DataFrame]:
    """The learned languages, and (lang, h, x) of the sampled texts: features as bytes, in one order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.lit(7), "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.count("*").alias("all")).orderBy(F.desc("all"), "lang").limit(TOTAL).collect()}
    langs = sorted(counts)
    if not langs:
        return [], pd.DataFrame()
    most = max(1, min(per_language, TOTAL // len(langs)))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, most / counts[lang])) for lang in langs], "lang string, share double")  # at most TOTAL rows
    drawn = rows.join(F.broadcast(share), "lang").where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < F.col("share")).groupBy("lang", "h", "text").agg(F.lit(1).alias("_one"))

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(x).astype(np.float16).tobytes() if has_letter(x) else None for x in text], dtype=object)

    return langs, drawn.select("lang", "h", vector("text").alias("x")).where("x IS NOT NULL").toPandas().sort_values(["lang", "h"], ignore_index=True)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model: languages, codewords, weights, biases, the bits' weights in decoding, and the gap under which a text is ambiguous."""
    text_batches(docs.sparkSession)
    langs, got = draw(docs, per_language)
    if not len(got):
        return {"langs": []}
    x = np.stack([np.frombuffer(v, np.float16) for v in got.pop("x")]).astype(np.float32)
    of, code = np.searchsorted(langs, got["lang"].to_numpy(dtype=str)), codebook(len(langs))
    if len(langs) == 1:
        return {"langs": langs, "code": code, "w": np.zeros((x.shape[1], code.shape[1]), np.float32), "b": np.zeros(code.shape[1], np.float32), "bit": np.ones(code.shape[1], np.float32), "gap": MARGIN}
    apart = np.arange(len(of)) % APART == 0 if len(of) >= 20 * APART else np.zeros(len(of), bool)
    fit = ~apart
    each = 1 / np.maximum(1, np.bincount(of[fit], minlength=len(langs)))[of[fit]] * fit.sum() / len(langs)
    w, b = fit_logistic(x[fit], (code[of[fit]] > 0).astype(np.float32), each)
    right = ((np.sign(x[fit] @ w + b) == code[of[fit]]) * each[:, None]).mean(0)
    model = {"langs": langs, "code": code, "w": w, "b": b, "bit": np.maximum(0.05, 2 * right - 1).astype(np.float32), "gap": 0.0}
    if apart.any():
        best, _, gap = decode(model, x[apart])
        gap = gap[best == of[apart]]
        model["gap"] = float(min(MARGIN, np.quantile(gap, CLEAN))) if len(gap) else 0.0
    return model


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of features: the language's index, its score, and how much farther the next codeword is."""
    margin = x @ model["w"] + model["b"]
    loss = np.stack([(np.logaddexp(0, -margin * c) * model["bit"]).sum(1) for c in model["code"]], 1)
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    gap = np.sort(loss, 1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return best, 1 / share.sum(1), gap


def predictor(model: dict):
    """A column function: text -> (lang_pred, score, ambiguous)."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score, close = [UNKNOWN] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
        some = [i for i, x in enumerate(text) if x and has_letter(x)] if model["langs"] else []
        for a in range(0, len(some), 512):
            at = some[a : a + 512]
            best, s, gap = decode(model, np.stack([features(text.iloc[i]) for i in at]))
            score[at], close[at] = s, gap < model["gap"]
            for i, k in zip(at, best.tolist()):
                lang[i] = model["langs"][k]
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "ambiguous": close})

    return predict


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row."""
    predict = predictor(train(docs, per_language))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), predict("text").alias("_p")).select("doc_id", "held_out", "_p.*")


def known_language(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: list[str] | None = None) -> DataFrame:
    """docs whose language the decoder tells: it is one of `languages` (all learned ones where that is None) and not ambiguous. Texts without a letter go.

    Where nothing can be learned (no row has text and lang), nothing can be told apart, and only texts without a letter go.
    """
    model = train(docs, per_language)
    name = fresh(docs, "_language")
    if not model["langs"]:
        text_batches(docs.sparkSession)

        @F.pandas_udf("boolean")
        def lettered(text: pd.Series) -> pd.Series:
            return pd.Series([bool(x) and has_letter(x) for x in text], dtype=bool)

        return docs.where(lettered("text"))
    p = F.col(name)
    wanted = p["lang_pred"] != UNKNOWN if languages is None else p["lang_pred"].isin(languages)
    return docs.withColumn(name, predictor(model)("text")).where(wanted & ~p["ambiguous"]).select(*docs.columns)
