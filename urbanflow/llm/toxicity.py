"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch, crc_of_id, give_back

#: Labelled rows from which terms, label model and classifier are learned, at most.
LABELLED_ROWS = 20_000
#: What a term's counts must show to be learned: twice the log-likelihood ratio against independence of the label.
EVIDENCE = 20
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")

# Common abusive words by kind, in English, German, French and Spanish.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb imbecile fool clown loser losers jerk retard dimwit vollidiot blödmann trottel depp dummkopf spinner "
    "versager idiote imbécile crétin abruti débile bouffon idiota imbécil estúpido estúpida tonto payaso",
    "contempt": "pathetic disgusting worthless useless hideous repulsive ekelhaft erbärmlich wertlos widerlich dégoûtant minable pitoyable "
    "asqueroso asquerosa patético patética despreciable",
    "vermin": "scum trash vermin garbage filth filthy subhuman abschaum ungeziefer gesindel dreck ordure racaille vermine pourriture escoria basura alimaña",
    "threat": "kill murder strangle exterminate töten umbringen erwürgen vernichten tuer crever étrangler exterminer matar matarte degollar exterminar",
    "obscene": "shit fuck fucking bitch bastard asshole crap slut whore scheiße arschloch hure ficken wichser merde putain connard salope enculé "
    "mierda puta cabrón joder gilipollas",
}
#: Figures and letters that stand for another letter.
_DISGUISE = str.maketrans("013457@$!|", "oieastasil")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .*-]){3,}[^\W\d_]\b")
_EDGE = ".,;:?!\"'()"
_SHOUT = re.compile("[A-Z]")
PATTERNS = ("disguised letters", "stretched letters", "spaced letters", "a word three times over", "exclamations", "capitals")
_ABUSIVE = {w: kind for kind, words in LEXICONS.items() for w in words.split()}


def word_terms(word: str) -> tuple[str, ...]:
    """What lexicons look a word up by: the word itself and its beginnings (marked by a ``*``)."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


def _lexicons_of(term: str, learned: bool) -> list[str]:
    """Lexicons that hold a term: the given one of its kind, and of the learned ones that of its form and letters."""
    out = [_ABUSIVE[term]] if term in _ABUSIVE else []
    if learned:
        form = f"beginnings of {len(term) - 1}" if term.endswith("*") else "words"
        out.append(f"learned {form}, {'plain' if term.isascii() else 'accented'} letters")
    return out


#: All voters: lexicons, patterns, then those that speak for a clean text or count what others find.
VOTERS = [
    *LEXICONS,
    *(f"learned {form}, {letters} letters" for form in ("words", *(f"beginnings of {n}" for n in PREFIXES)) for letters in ("plain", "accented")),
    *PATTERNS,
    "three terms",
    "no term",
    "fewer than two terms",
    "no exclamation",
]
N_LEXICONS = len(VOTERS) - len(PATTERNS) - 4


def patterns(text: str) -> tuple[int, ...]:
    """1 where a pattern shows: abusive words in disguise, repetition, exclamations over 1 % and capitals over 30 % of characters."""
    low = text.lower()
    return _patterns(text, low, _WORD.findall(low))


def _patterns(text: str, low: str, words: list[str]) -> tuple[int, ...]:
    n = max(1, len(text))
    odd = (w.strip(_EDGE).translate(_DISGUISE) for w in low.split() if not w.isalpha() and not w[:-1].isalpha())
    return (
        int(any(w in _ABUSIVE for w in odd)),
        int(_LONG.search(low) is not None and any(_LONG.sub(r"\1", w) in _ABUSIVE for w in set(words) if _LONG.search(w))),
        int(any(re.sub(r"\W", "", m[0]) in _ABUSIVE for m in _SPACED.finditer(low))),
        int(any(a == b == c and len(a) > 3 for a, b, c in zip(words, words[1:], words[2:]))),
        int(100 * text.count("!") > n),
        int(len(_SHOUT.findall(text)) > 0.3 * n),
    )


def _distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class ToxicityModel:
    """Terms by number, the label model's rates and correlations by voter, and the classifier's weights:
    one a term, one a pattern, then any term, their number, and terms for each distinct word."""

    terms: dict[str, int]
    rates: np.ndarray
    correlations: np.ndarray
    weights: np.ndarray
    bias: float
    voters: list[str] = field(default_factory=lambda: VOTERS)

    def score(self, hits: list[int], words: int, shown: tuple[int, ...]) -> float:
        t = len(self.terms)
        z = self.bias + self.weights[t : t + len(shown)] @ shown
        if hits:
            z += self.weights[hits].sum() + self.weights[t + len(shown) :] @ _summary(len(hits), words)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _summary(hits: int, words: int) -> tuple[float, ...]:
    return (float(hits > 0), min(hits, 10) / 10, min(1.0, 5 * hits / max(1, words)))


class _Reader:
    """Distinct terms of a text, how many distinct words it has, and its patterns.

    A word's terms are looked up once while the table lasts.
    """

    def __init__(self, terms: dict[str, int], most: int = 200_000):
        self.terms, self.most, self.known = terms, most, {}

    def __call__(self, text: str | None) -> tuple[list[int], int, tuple[int, ...]]:
        if len(self.known) > self.most:
            self.known = {}
        text = text or ""
        low = text.lower()
        found = _WORD.findall(low)
        shown = _patterns(text, low, found)
        words, out, known = set(found), set(), self.known
        for w in words:
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(self.terms[t] for t in word_terms(w) if t in self.terms)
            if own:
                out.update(own)
        return sorted(out), len(words), shown


def votes_of(hits: list[int], lexicons: np.ndarray, shown: tuple[int, ...], exclaims: bool) -> np.ndarray:
    """1 toxic, -1 clean, 0 no vote, in the order of ``VOTERS``.

    ``lexicons`` (terms x lexicons) tells which lexicon holds a term; it votes toxic where one occurs.
    """
    v = np.zeros(len(VOTERS), np.int8)
    if hits:
        v[:N_LEXICONS] = lexicons[hits].any(0)
    v[N_LEXICONS : N_LEXICONS + len(shown)] = shown
    v[-4:] = (len(hits) >= 3, -(not hits), -(len(hits) < 2), -(not exclaims))
    return v


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's rates, and the voters' correlations given the class.

    Expectation-maximisation on votes alone. A voter has, for either class, a rate of each vote. In the
    second half of the rounds, votes are centred on what the class explains, and the correlation that is
    left shows voters that repeat each other: a voter's evidence is divided by 1 + its correlations'
    sum, so a family of copies counts about once.
    """
    rows, n = votes.shape
    post = np.where((votes[:, :N_LEXICONS] > 0).any(1), 0.9, 0.05) if rows else np.zeros(0)
    rates, corr = np.full((n, 2, 3), 1 / 3), np.zeros((n, n))
    if not rows:
        return post, rates, corr
    kinds = np.stack([votes == k for k in (-1, 0, 1)], 2).astype(float)
    for turn in range(rounds):
        for c, w in enumerate((1 - post, post)):
            rates[:, c] = (np.einsum("i,ijk->jk", w, kinds) + 0.5) / (w.sum() + 1.5)
        share = np.ones(n)
        if turn >= rounds // 2:
            # classes as they stand now; what varies together inside a class is no separate evidence
            sure = (post >= 0.5).astype(float)
            left = votes - np.where(sure[:, None] > 0, rates[:, 1] @ (-1, 0, 1), rates[:, 0] @ (-1, 0, 1))
            spread = np.maximum(np.sqrt((left**2).mean(0)), 0.02)
            corr = (left.T @ left) / rows / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        evidence = np.log(rates[:, 1]) - np.log(rates[:, 0])
        z = np.log(prior / (1 - prior)) + np.einsum("ijk,jk,j->i", kinds, evidence, share)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, rates, corr


def _train_linear(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of ``y`` on a sparse matrix of ``n`` columns, by full gradient steps with momentum."""
    w, b, vw, vb = np.zeros(n), 0.0, np.zeros(n), 0.0
    for _ in range(rounds if len(y) else 0):
        e = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], len(y)) + b, -30, 30))) - y
        vw = 0.9 * vw + np.bincount(col, x * e[row], n) / len(y) + l2 * w
        vb = 0.9 * vb + e.mean()
        w, b = w - 0.5 * vw, b - 0.5 * vb
    return w, b


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a term: p toxic, n others; the empty term counts all."""
    total, seen = (Counter(), Counter()), [0, 0]
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[y] += 1
            total[y].update({t for w in _distinct_words(text) for t in word_terms(w)})
    yield pa.RecordBatch.from_pydict({"term": [""], "p": [seen[1]], "n": [seen[0]]})
    terms = list(total[0] | total[1])
    for i in range(0, len(terms), 100_000):
        part = terms[i : i + 100_000]
        yield pa.RecordBatch.from_pydict({"term": part, "p": [total[1][t] for t in part], "n": [total[0][t] for t in part]})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 5,
    rows: int = LABELLED_ROWS,
    evidence: float = EVIDENCE,
    scratch: Scratch | None = None,
) -> ToxicityModel:
    """Learn from labelled documents whose crc32(doc_id) mod ``folds`` is not 0; ``rows`` at most.

    The rows are those with the smallest hash of their id; of rows that repeat an id the least text
    counts, of labels that do the largest. Null ids and labels are left out, null and empty texts hold
    no term.

    1. Voters: given lexicons by kind of abuse; learned lexicons of words and word beginnings whose
       counts mark labelled toxic texts by at least ``evidence``, parted by form and letters; patterns of
       disguised and stretched spelling, repetition and punctuation; and what speaks for a clean text.
    2. The label model estimates their accuracies and correlations from the votes alone.
    3. The classifier learns from its posteriors alone.

    What reaches the driver are the terms and, for each of the ``rows``, which of them it holds: bounded
    by ``rows``, as each learned term needs its evidence among them.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
    own = (scratch or Scratch(docs.sparkSession, "toxicity")).table(own, "labelled")
    counts = own.mapInArrow(_count_terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    totals = counts.where("term = ''").select(F.col("p").alias("pos"), F.col("n").alias("neg"))

    def cell(seen: str, expected: str) -> str:
        return f"if({seen} > 0, {seen} * ln({seen} / ({expected})), 0)"

    # log-likelihood ratio of a term's counts against independence of the label
    ratio = " + ".join(
        cell(f"({x})", f"({row}) * {side} / (pos + neg)")
        for x, row, side in (
            ("p", "p + n", "pos"),
            ("n", "p + n", "neg"),
            ("pos - p", "pos + neg - p - n", "pos"),
            ("neg - n", "pos + neg - p - n", "neg"),
        )
    )
    learned = [
        r["term"]
        for r in counts.where("term <> '' and p >= 2")
        .crossJoin(F.broadcast(totals))  # one row
        .where(f"2 * ({ratio}) >= {evidence} and p >= 4 * n and ln((p + 0.5) / (pos + 1)) - ln((n + 0.5) / (neg + 1)) >= 3")
        .select("term")
        .orderBy("term")
        .collect()
    ]
    terms = {t: i for i, t in enumerate([*learned, *sorted(_ABUSIVE.keys() - set(learned))])}
    place = {v: i for i, v in enumerate(VOTERS)}
    lexicons = np.zeros((len(terms), N_LEXICONS), bool)
    for t, i in terms.items():
        lexicons[i, [place[x] for x in _lexicons_of(t, i < len(learned))]] = True

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Reader(terms)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [look(t) for t in texts]
            cols = [
                pa.array([h for h, _, _ in found], pa.list_(pa.int32())),
                pa.array([n for _, n, _ in found], pa.int32()),
                pa.array([s for _, _, s in found], pa.list_(pa.int32())),
                pa.array(["!" in (t or "") for t in texts]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), *cols], ["y", "hits", "words", "shown", "exclaims"])

    seen = own.mapInArrow(look_up, "y int, hits array<int>, words int, shown array<int>, exclaims boolean").collect()
    votes = np.array([votes_of(r["hits"], lexicons, r["shown"], r["exclaims"]) for r in seen]).reshape(-1, len(VOTERS))
    prior = min(0.5, max(0.01, (sum(r["y"] for r in seen) + 0.5) / (len(seen) + 1)))
    post, rates, corr = label_model(votes, prior)
    n = len(terms) + len(PATTERNS)
    cells = [(i, c, x) for i, r in enumerate(seen) for c, x in _features(r["hits"], r["shown"], r["words"], len(terms))]
    row, col, x = (np.array(c) for c in zip(*cells)) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    weights, bias = _train_linear(row, col, x, post, n + 3)
    return ToxicityModel(terms, rates, corr, weights, bias)


def _features(hits: list[int], shown: list[int], words: int, n_terms: int) -> Iterator[tuple[int, float]]:
    """Columns and values other than 0 of a text's row."""
    yield from ((h, 1.0) for h in hits)
    yield from ((n_terms + k, 1.0) for k, x in enumerate(shown) if x)
    if hits:
        yield from ((n_terms + len(shown) + k, x) for k, x in enumerate(_summary(len(hits), words)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), to: str = "score") -> DataFrame:
    """``keep`` columns and ``to`` (0 to 1) for each row; only the text is read for the score.

    Null and empty texts get the score of a text without any term. Repeated rows get equal scores, long
    texts count whole. Rows don't move. A kept column named ``to`` gives way. The model travels with the
    task.
    """
    from pyspark.sql import types as T

    keep = tuple(c for c in keep if c != to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Reader(model.terms)
        for batch in batches:
            scores = [model.score(*look(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, to])
        del look
        give_back()

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(to, T.DoubleType())])
    own = docs.select(*keep, F.col(text).alias("__text"))
    return own.mapInArrow(run, schema)
