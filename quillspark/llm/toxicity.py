"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, invisible characters and combining marks dropped, homoglyphs and
letters with marks to their Latin letters, digits and signs that stand in for letters to those letters.
Lexicon terms are word beginnings: what stands before one in the text itself must be no letter, and
a sign is none, so a term counts after "@" or "!" too. Weights are log-odds of labelled training
documents. Of several terms at one place the heaviest counts. Exception phrases, which must end with
a word, take back the terms inside them. The score is a logistic function of the summed weight by
the square root of the length in units of SHORT_TEXT characters (one at least).

The lexicon is learned by counting the word beginnings of labelled training documents, with partial
sums before the shuffle. Where there are more than TRAIN_ROWS labelled rows it learns from a sample of
about as many, by a hash of their ids; this alone bounds the terms that reach the driver, which are all
of sufficient support and odds. Null and empty texts score 0.0, and so do texts without a term. Texts
of any length are scored whole. Repeated rows score alike; a document with several labels counts as
toxic if one says so, ties in odds do not matter; a table without labels leaves the seed lexicon.
Other columns stay as they are; a column that has the name of an added one is replaced.
"""

from __future__ import annotations

import bisect
import itertools
import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, lean

#: Seed terms and their weight, and phrases in which a term is no insult.
SEEDS = ["idiot", "moron", "loser", "pathetic", "worthless", "disgusting", "stupid", "scum", "trash", "clown"]
SEED_WEIGHT = 3.0
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bins", "clown fish", "clownfish", "class clown", "scumble"]
#: Look-alikes of Latin letters, and digits and signs used for letters.
HOMOGLYPHS = dict(zip("аеорсухкмтвнізјѕԁɡαεοιρυκντ", "aeopcyxkmtbhiejsdgaeoipyknt"))
DIGITS = dict(zip("013457@$!|", "oieastasii"))
SHORTEST, LONGEST = 4, 12
#: Labelled rows learned from, about: where there are more, a sample by the hash of their ids. This
#: bounds the label table that is broadcast and the counts that are shuffled.
TRAIN_ROWS = 40_000
#: Training documents that must hold a term, and the least log-odds.
SUPPORT, LEAST_ODDS = 5, 3.0


@lru_cache(maxsize=1)
def fold_table() -> tuple[dict[int, None], dict[int, str]]:
    """Characters that are dropped, and what others become, one letter each."""
    gone = dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
    t: dict[int, str] = {}
    for c in range(0xC0, 0x250):  # letters with marks to their base letter, by Unicode decomposition
        base = unicodedata.normalize("NFKD", chr(c))[0]
        if base != chr(c) and base.isascii() and base.isalpha():
            t[c] = base.lower()
    for c in range(0xFF21, 0xFF5B):
        t[c] = unicodedata.normalize("NFKC", chr(c)).lower()[0]
    return gone, t | {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in DIGITS.items()}


@lru_cache(maxsize=1)
def _signs():
    import re

    return re.compile("[^\x00-\x7f]|[013457@$!|]")


def folded(text: str) -> tuple[str, str]:
    """(folded text, the lower-case text it comes from), alike in length. 1 stands for i and l, so these
    fold to one letter, in terms too."""
    low = text.lower()
    if not _signs().search(low):
        return low.replace("l", "i"), low
    gone, to = fold_table()
    if not low.isascii():
        low = low.translate(gone)
    return low.translate(to).replace("l", "i"), low


def fold(text: str) -> str:
    return folded(text)[0]


@lru_cache(maxsize=1)
def _words():
    import re

    return re.compile(r"[^\W\d_]{%d,}" % SHORTEST)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> dict[str, float]:
    """{term: weight} from the labelled documents given (training rows only)."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, 0.95 * TRAIN_ROWS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(known), id_col).select("text", "y")

    def count(batches):
        from collections import Counter

        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            for y, c in sums.items():
                for i in range(0, len(items := list(c.items())), 50_000):
                    part = items[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([y] * len(part), pa.int32()), pa.array([v for _, v in part], pa.int64())], ["term", "y", "n"])
                c.clear()

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = set(_words().findall(fold(t or "")))
                terms = {w[:k] for w in ws for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
                c = sums[1 if y else 0]
                c.update(terms)
                c[""] += 1
                if len(sums[0]) + len(sums[1]) > 400_000:
                    yield from out()
        yield from out()

    counted = rows.mapInArrow(lean(count), "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg")
    )
    counted = cut(counted.where((F.col("pos") >= SUPPORT) | (F.col("term") == "")))
    total = counted.where("term = ''").first()
    pos, neg = (total["pos"], total["neg"]) if total else (0, 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1) / ((F.col("neg") + 0.5) / (neg + 1)))
    # a term without counter-examples must be likelier toxic than chance: bound on its odds below
    sure = odds - 1.64 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    found = counted.where("term <> ''").withColumns({"odds": odds, "sure": sure}).where((F.col("odds") >= LEAST_ODDS) & (F.col("sure") >= 2.5)).collect()
    out: dict[str, float] = dict.fromkeys(map(fold, SEEDS), SEED_WEIGHT)
    for r in sorted(found, key=lambda r: (len(r["term"]), r["term"])):
        t = r["term"]
        if not any(t[:k] in out for k in range(SHORTEST, len(t))):  # a shorter beginning already counts
            out[t] = float(min(r["odds"], 6.0))
    return out


def matcher(lexicon: dict[str, float]):
    """Aho-Corasick automaton over terms and exception phrases."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in lexicon.items():
        a.add_word(fold(t), (len(fold(t)), w))
    for t in EXCEPTIONS:
        a.add_word(fold(t), (len(fold(t)), None))
    a.make_automaton()
    return a


def raw_score(text: str, a) -> tuple[float, int]:
    """Summed weight of distinct places, and how many they are."""
    t, low = folded(text)
    hits, spared = [], []
    for end, (n, w) in a.iter(t):
        at = end - n + 1
        if at and low[at - 1].isalpha() or at and low[at - 1].isdigit() and t[at - 1].isalpha():
            continue  # inside a word
        if w is not None:
            hits.append((at, end, w))
        elif end + 1 == len(t) or not t[end + 1].isalpha():
            spared.append((at, end))
    if spared:
        spared.sort()
        starts, far = [s for s, _ in spared], list(itertools.accumulate((e for _, e in spared), max))
        hits = [h for h in hits if not (k := bisect.bisect_right(starts, h[0])) or far[k - 1] < h[1]]
    best: dict[int, float] = {}
    for at, _, w in hits:
        best[at] = max(w, best.get(at, 0.0))
    return sum(best.values()), len(best)


#: The logistic curve: score 0.5 at this weight for a text of up to SHORT_TEXT characters.
MIDDLE, SLOPE, SHORT_TEXT = 4.7, 1.1, 500


def squash(weight: float, chars: int) -> float:
    if weight <= 0:
        return 0.0
    return 1 / (1 + math.exp(-SLOPE * (weight / max(1.0, chars / SHORT_TEXT) ** 0.5 - MIDDLE)))


def score(docs: DataFrame, lexicon: dict[str, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 and the number of places matched (``out``_hits)."""
    names, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(lexicon)
    at, stay = names.index(text), [k for k, c in enumerate(names) if c not in (out, f"{out}_hits")]

    def run(batches):
        a = matcher(sent.value)
        for b in (w.slice(k, 1024) for w in batches for k in range(0, w.num_rows, 1024)):
            s, n = [], []
            for t in b.column(at).to_pylist():
                w, k = raw_score(t or "", a)
                s.append(squash(w, len(t or "")))
                n.append(k)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in stay), pa.array(s, pa.float64()), pa.array(n, pa.int64())], [*(names[k] for k in stay), out, f"{out}_hits"])

    schema = T.StructType([*(docs.schema.fields[k] for k in stay), T.StructField(out, T.DoubleType()), T.StructField(f"{out}_hits", T.LongType())])
    return docs.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 1 divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


#: Scores from here on are toxic.
THRESHOLD = 0.7


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict[str, float]:
    return learn(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col)
