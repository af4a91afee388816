"""Text that was decoded with a wrong character encoding.

Words here are maximal runs of letters and non-ASCII characters that hold at
least one non-ASCII character: the wrong encodings all leave ASCII alone, so a
clean word and its garbled form break off at the same places.

1. The distinct words of the corpus are counted.
2. Words that look clean by the alphabets of a clean reference are garbled under
   every chain of ``CHAINS``.
3. Corpus words are hash-joined against that table. A match is verified: the
   word itself looks unclean, or its original is more frequent and more likely
   by the letter pairs of the reference.
4. Unclean words without a match are decoded backwards through the chains and
   accepted when the result looks clean. Replacement characters and C1 controls
   are damage whether or not an original is known.

Defined results: null and empty texts hold nothing; of several originals the
most frequent one, then the smallest, is taken; repeated rows are judged alike;
character entities, decomposed accents, capitals and symbols are no damage.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import shipped, stored

_WORD = re.compile(r"[A-Za-z\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*")
_BREAKS = str.maketrans("\n\r\t", "   ")
_INNER = re.compile("[’‘·–—…]")
_CONTROLS = re.compile("[\u0080-\u009f]")
_LOST = re.compile("[�\u0080-\u009f]")

# Encodings texts were written in, and those they were wrongly read in.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_roman", "cp437")
READ = ("latin-1", "cp1252", "cp1250", "iso8859_2", "iso8859_15", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "utf-8", "ascii")
#: Read wrongly once, or written as UTF-8 and read wrongly once more.
CHAINS = [((w, r),) for w in WRITTEN for r in READ if w != r] + [(("utf-8", a), ("utf-8", b)) for a in ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437") for b in ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437")]
# Signs that may stand around or within a word of running text.
SIGNS = frozenset("“”„‟‘’‚‛«»‹›—–―…•·¿¡")
# The accented and Cyrillic letters of the tables' languages and their neighbours.
LETTERS = "äöüß àâæçèéêëîïôœùûüÿ áéíñóúü áâãàçéêíóôõú àèéìíîòóùú áéëïíóöúü ąćęłńóśźż æøå абвгдежзийклмнопрстуфхцчшщъыьэюяё"


#: Keys of damaged texts up to so many are broadcast.
BROADCAST_KEYS = 4_000_000


def _table(codec: str) -> dict[int, str]:
    """Differences from Latin-1; bytes a codec lacks become C1 controls, as browsers read them."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        if c != chr(b):
            out[b] = c
    return out


def _tables() -> dict[str, dict[int, str]]:
    return {r: _table(r) for r in READ if r not in ("utf-8", "ascii", "latin-1")}


def _read(data: bytes, codec: str, tables: dict[str, dict[int, str]]) -> str:
    if codec in ("utf-8", "ascii"):
        return data.decode(codec, "replace")
    text = data.decode("latin-1")
    return text.translate(tables[codec]) if codec in tables else text


def garbled_forms(word: str, tables: dict[str, dict[int, str]]) -> dict[str, str]:
    """Every garbled form of a word with the chain that makes it."""
    out: dict[str, str] = {}
    for chain in CHAINS:
        text = word
        try:
            for written, read in chain:
                text = _read(text.encode(written), read, tables)
        except UnicodeEncodeError:
            continue
        if text != word:
            name = " then ".join(f"{w} as {r}" for w, r in chain)
            out.setdefault(text, name)
            kept = _CONTROLS.sub("", text)  # readers that drop what they cannot read
            if kept != text and not kept.isascii():
                out.setdefault(kept, name)
    return out


def _backwards(word: str, inverse: dict[str, dict[str, int]]) -> list[str]:
    """What the word was if one of the chains made it without loss. That bytes
    happen to be UTF-8 is evidence; between two single-byte encodings it takes C1
    controls, or a whole word of foreign letters."""
    out = []
    foreign = len(word) > 3 and not any(c.isascii() for c in word)
    for chain in CHAINS:
        if chain[0][0] != "utf-8" and not (foreign or _LOST.search(word)):
            continue
        text = word
        try:
            for written, read in reversed(chain):
                if read in ("utf-8", "ascii"):
                    raise ValueError
                table = inverse[read]
                text = bytes(table[c] for c in text).decode(written)
        except (KeyError, ValueError):
            continue
        if text != word:
            out.append(text)
    return out


_AROUND = "".join(SIGNS)


class Reference:
    """Alphabets and letter pairs of a clean reference; size bounded by its letters."""

    def __init__(self, pairs: Counter):
        self.letters = frozenset(c for p in pairs for c in p if ord(c) > 127) | frozenset(LETTERS)
        self.pairs = pairs
        self.total = sum(pairs.values()) or 1

    def likely(self, word: str) -> float:
        """Mean log-frequency of a word's letter pairs."""
        t = f" {word.lower()} "
        return sum(math.log((self.pairs.get(p, 0) + 0.05) / self.total) for p in zip(t, t[1:])) / (len(t) - 1)

    def clean(self, word: str) -> bool:
        """Whether a word looks like ordinary text in one of the reference's languages."""
        text = unicodedata.normalize("NFC", word)
        if not any(c.isalpha() for c in text):
            return len(set(text)) == 1 and not _LOST.search(text) or all(c in SIGNS for c in text)
        parts = [p for p in _INNER.split(text.strip(_AROUND)) if p]
        if not parts:
            return False
        for p in parts:
            if any(ord(c) > 127 and c.lower() not in self.letters and unicodedata.category(c) != "Mn" for c in p):
                return False
            if not (p[1:] == p[1:].lower() or p == p.upper()):
                return False
        cyrillic = [any("\u0400" <= c <= "\u04ff" for c in p) for p in parts]
        return not any(cyrillic) or all("\u0400" <= c <= "\u04ff" for p in parts for c in p)


def reference(samples: DataFrame) -> Reference:
    """From texts known to be clean, all their distinct words. The workers count the letter
    pairs, a space before and after each word."""
    words = samples.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("w")).distinct()

    def count(batches):
        pairs: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                t = f" {w} "
                pairs.update(zip(t, t[1:]))
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "n"])

    counted = words.mapInArrow(count, "a STRING, b STRING, n BIGINT").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return Reference(Counter({(r["a"], r["b"]): r["n"] for r in counted.collect()}))


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word): the distinct words with non-ASCII characters of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        find = _WORD.findall
        for batch in batches:
            keys, words = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                own: set[str] = set()
                for token in set(t.translate(_BREAKS).split(" ")):
                    if not token.isascii():
                        own.update(find(token))
                keys += [i] * len(own)
                words += own
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(words)], names=[key, "word"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, word STRING")


def damaged_words(words: DataFrame, known: Reference, margin: float = 1.0) -> DataFrame:
    """(word, original): every damaged word of ``words`` (key, word); the original
    is null where it cannot be told."""
    shared = shipped(words.sparkSession, known)
    counted = words.groupBy("word").agg(F.count("*").alias("docs"))

    def judge(batches):
        known = shared()
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known.clean(w) for w in own]), pa.array([known.likely(w) for w in own])], names=["word", "docs", "clean", "likely"])

    vocabulary = counted.mapInArrow(judge, "word STRING, docs BIGINT, clean BOOLEAN, likely DOUBLE")

    def garble(batches):
        tables = _tables()
        for batch in batches:
            at, forms, originals, chains = [], [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                bare = w.strip(_AROUND)
                for own in {w, bare} if bare and not bare.isascii() else {w}:
                    for form, chain in garbled_forms(own, tables).items():
                        at.append(i)
                        forms.append(form)
                        originals.append(own)
                        chains.append(chain)
            if at:
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(forms), pa.array(originals), *(batch.column(k).take(took) for k in (1, 2)), pa.array(chains)], names=["word", "original", "weight", "ease", "chain"])

    # Each word has some hundred garbled forms, so the expansion is spread before it.
    spread = words.sparkSession.sparkContext.defaultParallelism
    table = vocabulary.where("clean").select("word", "docs", "likely").repartition(spread, "word").mapInArrow(garble, "word STRING, original STRING, weight BIGINT, ease DOUBLE, chain STRING")
    signs = ~F.col("original").rlike(r"\p{L}") & (F.length("word") > 1)
    matched = vocabulary.join(table, "word").where(~F.col("clean") | signs | ((F.col("weight") > F.col("docs")) & (F.length("word") > 2) & (F.col("ease") > F.col("likely") + margin)))
    best = matched.groupBy("word").agg(F.min_by("original", F.struct(-F.col("weight"), F.col("original"))).alias("original"))

    def decode(batches):
        known = shared()
        inverse = {r: {c: b for b, c in {b: _table(r).get(b, chr(b)) for b in range(256)}.items()} for r in READ if r not in ("utf-8", "ascii")}
        for batch in batches:
            words, originals = [], []
            for w in batch.column(0).to_pylist():
                likely = [x for x in _backwards(w, inverse) if known.clean(x)]
                if likely or _LOST.search(w):
                    words.append(w)
                    originals.append(min(likely, key=lambda x: (-known.likely(x), x)) if likely else None)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(originals, pa.string())], names=["word", "original"])

    rest = vocabulary.where("NOT clean").join(best, "word", "left_anti").select("word").mapInArrow(decode, "word STRING, original STRING")
    return best.unionByName(rest)


def damaged(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, original): the damaged words of each text."""
    words = stored(words_of(docs, key, text), "words")
    return words.join(damaged_words(words, reference(samples)), "word").select(key, "word", "original")


def repaired(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, damaged INT, restored INT) of the damaged texts, with every
    word restored whose original is known."""
    hits = stored(damaged(docs, samples, key, text).groupBy(key).agg(F.collect_list(F.struct("word", "original")).alias("_hits")), "hits")
    # Texts without a word that could be damaged are not joined; of the others only the
    # damaged ones are shuffled where their keys are few enough to be sent round.
    docs = docs.where(F.col(text).rlike(r"[^\x00-\x7F]"))
    if hits.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(hits.select(key)), key, "left_semi")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, bad, good = [], [], []
            for t, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = {h["word"]: h["original"] for h in hits}
                counts = [0, 0]

                def put(m, known=known, counts=counts):
                    if m.group() not in known:
                        return m.group()
                    counts[0] += 1
                    counts[1] += known[m.group()] is not None
                    return known[m.group()] or m.group()

                texts.append(_WORD.sub(put, t))
                bad.append(counts[0])
                good.append(counts[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), pa.array(bad, pa.int32()), pa.array(good, pa.int32())], names=[key, text, "damaged", "restored"])

    return docs.select(key, text).join(hits, key).mapInArrow(run, f"{key} {kind}, {text} STRING, damaged INT, restored INT")
