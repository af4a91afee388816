"""Languages of documents and of the segments of mixed ones.

Hierarchical discrimination: linear support vector machines first tell language
families apart, then one-versus-one machines separate the languages within the
winning family. Features are the shares of a text's character n-grams (one to
five letters, word boundaries marked, lower case), so a machine's score of a
text is a sum over its words. Each worker scores a word once and then adds rows
of a table, which keeps whole corpora cheap.

Training uses a bounded sample of labelled rows (``max_samples``, 5000); it is a
small dual problem on the driver. Everything else covers whole texts.

Defined results: null and empty texts, and segments of dummy Latin or without
letters, get ``und`` with confidence 0; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.residue import LATIN
from webloom.session import shipped

# The families of the usual codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn af is fy lb",
    "romance": "fr es pt it ca gl ro oc",
    "slavic": "pl ru cs sk uk be bg sr hr sl mk bs",
    "baltic": "lt lv",
    "finnic": "fi et",
    "turkic": "tr az kk uz",
}

_WORD = re.compile(r"[^\W\d_]+")
#: A segment ends after a sentence or with its line.
_SEGMENT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")


@dataclass
class Model:
    """Machines as columns: ``weights`` has a row for each n-gram."""

    grams: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]]  # what a positive and a negative score vote for
    families: dict[str, list[str]]
    scale: float = 1.0


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def ngrams(word: str, longest: int = 5) -> list[str]:
    """The n-grams of a lower-case word with its boundaries."""
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _features(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    counts = []
    seen: dict[str, int] = {}
    for text in texts:
        own: dict[str, int] = {}
        for w in _WORD.findall(text.lower()):
            for g in ngrams(w):
                own[g] = own.get(g, 0) + 1
        counts.append(own)
        for g in own:
            seen[g] = seen.get(g, 0) + 1
    grams = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n > 1))}
    x = np.zeros((len(texts), len(grams)), dtype=np.float32)
    for row, own in zip(x, counts):
        total = sum(own.values()) or 1
        for g, n in own.items():
            if g in grams:
                row[grams[g]] = n / total
    return grams, x * 30


def _machine(gram: np.ndarray, y: np.ndarray, cost: float, epochs: int = 60) -> np.ndarray:
    """Dual coordinate descent for a squared-hinge machine; alpha x y of each sample."""
    alpha = np.zeros(len(y))
    f = np.zeros(len(y))  # y-weighted decision values
    diag = gram.diagonal() + 1 / (2 * cost)
    order = np.arange(len(y))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            g = y[i] * f[i] - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - g / diag[i], 0.0)
            step = new - alpha[i]
            if step:
                f += (step * y[i]) * gram[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return alpha * y


def train(samples: DataFrame, max_samples: int = 5000, cost: float = 1.0) -> Model:
    """Machines from (lang, text); at most ``max_samples`` rows, in hash order."""
    rows = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").orderBy(F.xxhash64("text"), "lang").limit(max_samples).collect()
    texts, langs = [], []
    for lang, text in rows:
        for segment in _SEGMENT.split(text):
            if segment and len(segment) >= 20:
                texts.append(segment)
                langs.append(lang)
    grams, x = _features(texts)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    kernel = (x @ x.T).astype(np.float64)
    label = np.array(langs)
    family = np.array([family_of(v) for v in langs])
    families: dict[str, list[str]] = {}
    for v in sorted(set(langs)):
        families.setdefault(family_of(v), []).append(v)
    columns, pairs = [], []
    for names, of in [(sorted(families), family), *((v, label) for v in families.values())]:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                own = np.flatnonzero((of == a) | (of == b))
                coefficients = _machine(kernel[np.ix_(own, own)], np.where(of[own] == a, 1.0, -1.0), cost)
                columns.append(coefficients @ x[own])
                pairs.append((a, b))
    w = np.array(columns).T if columns else np.zeros((x.shape[1], 0))
    return Model(grams, (w[:-1] * 30).astype(np.float32), w[-1].astype(np.float32), pairs, families)


class Scorer:
    """Scores of texts under a model, with a table of the words seen so far."""

    def __init__(self, model: Model):
        self.m = model
        width = len(model.pairs)
        self.index: dict[str, int] = {}
        self.table = np.zeros((4096, width + 3), dtype=np.float32)  # scores, n-grams, letters, dummy Latin
        self.names = [*model.families, *(v for f in model.families.values() for v in f)]
        at = {n: i for i, n in enumerate(self.names)}
        self.votes = np.zeros((width, len(self.names)), dtype=np.float32)
        for k, (a, b) in enumerate(model.pairs):
            self.votes[k, at[a]] += 1
            self.votes[k, at[b]] -= 1
        self.rivals = np.maximum(np.abs(self.votes).sum(0), 1)
        self.members = {f: [at[v] for v in langs] for f, langs in model.families.items()}
        self.langs = [v for f in model.families.values() for v in f]

    def _add(self, word: str) -> int:
        row = len(self.index)
        if row == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        parts = ngrams(word)
        known = [self.m.grams[g] for g in parts if g in self.m.grams]
        if known:
            self.table[row, :-3] = self.m.weights[known].sum(0)
        self.table[row, -3:] = len(parts), len(word), len(word) * (word in LATIN)
        self.index[word] = row
        return row

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language (an index into ``langs``, -1 for none), confidence,
        letters, and the margin's sign-free size."""
        ids: list[int] = []
        ends = [0]
        get, add = self.index.get, self._add
        for text in texts:
            for w in _WORD.findall(text):
                k = get(w)
                ids.append(add(w) if k is None else k)
            ends.append(len(ids))
        n = len(texts)
        sums = np.zeros((n, self.table.shape[1]), dtype=np.float32)
        ends_ = np.array(ends)
        full = np.flatnonzero(ends_[1:] > ends_[:-1])
        if len(full):
            sums[full] = np.add.reduceat(self.table[np.array(ids)], ends_[:-1][full], axis=0)
        letters = sums[:, -2]
        scores = sums[:, :-3] / np.maximum(sums[:, -3:-2], 1) + self.m.bias
        pulls = np.tanh(scores) @ self.votes / self.rivals
        lang = np.full(n, -1)
        confidence = np.zeros(n, dtype=np.float32)
        family_names = list(self.m.families)
        family = pulls[:, : len(family_names)].argmax(1)
        offset = len(family_names)
        for k, name in enumerate(family_names):
            own = np.flatnonzero(family == k)
            if not len(own):
                continue
            inner = pulls[np.ix_(own, self.members[name])]
            best = inner.argmax(1)
            lang[own] = np.array(self.members[name])[best] - offset
            first = inner.max(1)
            outer = pulls[own, k] if len(family_names) > 1 else 1.0
            sure = np.minimum(outer, first) if len(self.members[name]) > 1 else np.asarray(outer)
            confidence[own] = 1 / (1 + np.exp(-6 * sure))
        none = (letters == 0) | (sums[:, -1] >= 0.6 * letters)
        lang[none] = -1
        confidence[none] = 0
        return lang, confidence, letters, scores


def split_segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text."""
    out, at = [], 0
    for m in _SEGMENT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


SEGMENTS = "array<struct<start:int,stop:int,lang:string,confidence:float>>"
_ARROW_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float32())]))


def _smoothed(lang: np.ndarray, confidence: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Short or unsure segments take the language of the nearest sure neighbour."""
    out = lang.copy()
    weak = (lang >= 0) & ((letters < 30) | (confidence < 0.93))
    sure = np.flatnonzero((lang >= 0) & ~weak)
    if len(sure):
        for i in np.flatnonzero(weak):
            out[i] = lang[sure[np.abs(sure - i).argmin()]]
    return out


def label(rows: DataFrame, model: Model, key: str = "id", title: str = "title", content: str = "content", share: float = 0.2, segments: bool = True, keep: str | None = None) -> DataFrame:
    """(key, title_lang, title_confidence, langs ARRAY<STRING>, confidence, segments, and
    column ``keep`` unchanged).

    ``langs`` are the languages with at least ``share`` of the content's letters,
    most letters first; ``segments`` (start and stop in characters) is filled for
    mixed contents, neighbours of one language joined. A map without a shuffle.
    """
    shared = shipped(rows.sparkSession, model)

    def run(batches):
        scorer = Scorer(shared())
        names = scorer.langs
        for batch in batches:
            titles = [t or "" for t in batch.column(1).to_pylist()]
            texts = [t or "" for t in batch.column(2).to_pylist()]
            t_lang, t_conf, _, _ = scorer.segments([t.lower() for t in titles])
            spans = [split_segments(t) for t in texts]
            flat = [t[a:b].lower() for t, own in zip(texts, spans) for a, b in own]
            lang, conf, letters, _ = scorer.segments(flat)
            at = 0
            langs, sure, parts = [], [], []
            for own in spans:
                cut = slice(at, at + len(own))
                at += len(own)
                smooth = _smoothed(lang[cut], conf[cut], letters[cut])
                weight = letters[cut]
                good = smooth >= 0
                per = np.bincount(smooth[good], weights=weight[good], minlength=len(names))
                total = weight.sum()
                present = [k for k in np.argsort(-per, kind="stable") if per[k] and per[k] >= share * total]
                langs.append([names[k] for k in present])
                sure.append(float((conf[cut] * weight)[good].sum() / max(weight[good].sum(), 1)))
                joined: list[dict] = []
                if segments and len(present) > 1:
                    for (a, b), k, c in zip(own, smooth, conf[cut]):
                        name = names[k] if k >= 0 else "und"
                        if joined and joined[-1]["lang"] == name:
                            joined[-1]["stop"] = b
                            joined[-1]["confidence"] = max(joined[-1]["confidence"], float(c))
                        else:
                            joined.append({"start": a, "stop": b, "lang": name, "confidence": float(c)})
                parts.append(joined)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([names[k] if k >= 0 else "und" for k in t_lang]), pa.array(t_conf, pa.float32()), pa.array(langs, pa.list_(pa.string())), pa.array(sure, pa.float32()), pa.array(parts, _ARROW_SEGMENTS), *batch.columns[3:]],
                names=[key, "title_lang", "title_confidence", "langs", "confidence", "segments", *kept],
            )

    kept = [keep] if keep else []
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, *kept)}
    more = f", {keep} {kinds[keep]}" if keep else ""
    return rows.select(key, title, content, *kept).mapInArrow(run, f"{key} {kinds[key]}, title_lang STRING, title_confidence FLOAT, langs ARRAY<STRING>, confidence FLOAT, segments {SEGMENTS}{more}")


def label_of(metadata: str = "metadata_json"):
    """The two-letter language of a stored label, null where it says nothing."""
    code = F.lower(F.trim(F.get_json_object(metadata, "$.lang")))
    base = F.regexp_extract(code, r"^([a-z]+)", 1)
    return F.when(~base.isin("", "und", "unknown"), base)


def wrong_labels(items: DataFrame, model: Model, least: int = 500) -> DataFrame:
    """(id, lang): a row for each language present in contents of at least
    ``least`` characters whose label is missing or wrong, or which are mixed."""
    rows = items.where(F.length("content") >= least)
    named = rows.select("id", F.lit("").alias("title"), "content", label_of().alias("stored"))
    found = label(named, model, segments=False, keep="stored")
    case = (F.size("langs") > 1) | ((F.size("langs") == 1) & (F.col("stored").isNull() | (F.col("stored") != F.get("langs", F.lit(0)))))
    return found.where(case).select("id", F.explode("langs").alias("lang"))
