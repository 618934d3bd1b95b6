"""Toxicity scores from a learned lexicon, fuzzy matching and context windows.

Fit: on labelled rows of the training folds, bounded by SAMPLE on average (a documented hash
sample; all rows where there are fewer). Part of them gives the lexicon: whole words and word
beginnings (stems) whose lower-bound log odds speak for label 1. Texts of one label whose least
five-word shingle hash is the same, as copies' mostly is, count once there, or the words that
copies share would pass for toxic ones. The rest gives the weights of a small logistic
regression over a document's features, so a term that is only chance in the lexicon part costs
it weight; such copies fall into one part.

Score: every token of the whole text is matched exactly, by stem, or, for misspellings, by
intersecting a Levenshtein automaton (one edit) with the trie of the lexicon's words. Each hit
counts its weight times a context factor: hits within quotation marks or near a reporting
word (WINDOW tokens) count QUOTED of their weight and go to features of their own, hits near a
second-person word count more. The densest window, the sums and the number of distinct terms
are the features. Labels, language, source and ids are no inputs. Every term that passes the
bounds is kept; the labelled sample bounds their number. A stem that is no better than a whole
word that it begins with the same documents is left out.

Defined results: null and empty texts have no hits and the score of none; without labelled
rows of both classes every score is 0 and nothing is predicted; rows with null labels or ids
are not learned from; an id with conflicting labels counts as toxic; repeated rows are scored
alike; very long texts are read whole; an empty table gives no rows; extra columns are kept or
ignored, one named like the added score is replaced.
"""

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, spread, tidy
from .simhash import shingle_set

#: Labelled rows to learn from, on average at most.
SAMPLE = 20_000
#: Stem lengths, tokens of a context window, weight of quoted hits, of hits near a second-person word.
STEMS, WINDOW, QUOTED, DIRECT = (4, 5, 6, 7), 8, 0.3, 1.25
#: Documents of label 1 that a term is in at least, and the hundredths of them, and the least lower-bound log odds.
LEAST, SHARE, ODDS = 3, 1, 1.0
#: Fewest characters of a word that may be misspelled.
FUZZY_LENGTH = 5
#: Tokens that a worker remembers, and terms that a task counts before it hands them on.
MEMO, COUNTED = 1 << 17, 1 << 18
TOKEN = re.compile(r"[^\W_]+")
REPORTING = frozenset("said says wrote writes called quote quoted quoting word words term phrase reported claimed dit mot cita palabra dijo sagte wort zitat".split())
SECOND_PERSON = frozenset("you your youre u ur tu toi vous ton votre tú usted vosotros du dich dein ihr euch sie".split())
OPEN, CLOSE = "\"“«„‹", "\"”»“›"
FEATURES = 7


class Trie:
    """A lexicon's words; `within` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        self.sizes = {len(w) + k for w in words for k in (-1, 0, 1)}
        #: The words, and those without one character: what is one edit away shares one of these with the token.
        self.near = {w[:k] + w[k + 1 :] for w in words for k in range(len(w))} | set(words)
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def may_match(self, word: str) -> bool:
        """False only if no word is within one edit; spares most tokens the walk."""
        if len(word) not in self.sizes:
            return False
        return word in self.near or any(word[:k] + word[k + 1 :] in self.near for k in range(len(word)))

    def within(self, word: str, edits: int = 1) -> str | None:
        """A word of the trie at most `edits` insertions, deletions, substitutions or swaps of neighbours away, the nearest first.

        A state of the automaton is the row of edit distances between what was read and the
        prefixes of `word`; only branches whose row can still end within the bound are walked.
        """
        best: tuple[int, str] | None = None
        todo: list = [(self.root, tuple(range(len(word) + 1)), None, "")]
        while todo:
            node, row, above, last = todo.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= edits and (best is None or (row[-1], child) < best):
                        best = (row[-1], child)
                    continue
                nxt = [row[0] + 1]
                for k, d in enumerate(word):
                    best_here = min(nxt[k] + 1, row[k + 1] + 1, row[k] + (c != d))
                    if above is not None and k and word[k - 1] == c and d == last:
                        best_here = min(best_here, above[k - 1] + 1)  # two neighbours swapped
                    nxt.append(best_here)
                if min(nxt) <= edits or min(row) <= edits - 1:
                    todo.append((child, tuple(nxt), row, c))
        return best[1] if best else None


@dataclass
class Toxicity:
    """words and stems: term to weight; coefficients of the logistic regression, the last one its bias."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.trie = Trie([w for w in self.words if len(w) >= FUZZY_LENGTH])
        #: Tokens that were looked up, and what those that matched are.
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, float, bool]] = {}

    def __reduce__(self):
        return Toxicity, (self.words, self.stems, self.coefficients)

    def match(self, token: str) -> tuple[str, float, bool] | None:
        """(term, weight, misspelled) of a lower-case token."""
        if token in self.words:
            return token, self.words[token], False
        best = None
        for k in STEMS:
            if len(token) > k and (w := self.stems.get(token[:k])) is not None and (best is None or w > best[1]):
                best = (token[:k], w, False)
        if best:
            return best
        if len(token) >= FUZZY_LENGTH - 1 and self.trie.may_match(token) and (term := self.trie.within(token)):
            return term, self.words[term], True
        return None

    def features(self, text: str | None) -> list[float]:
        lower = (text or "").lower()
        tokens = TOKEN.findall(lower)
        distinct = set(tokens)
        new = distinct - self.seen
        if len(self.seen) + len(new) > MEMO:
            self.seen.clear()
            self.found.clear()
            new = distinct
        for t in new:
            if hit := self.match(t):
                self.found[t] = hit
        self.seen |= new
        wanted = distinct & self.found.keys()
        if not wanted:
            return [0.0] * FEATURES
        spans = [m.span() for m in TOKEN.finditer(lower)]
        direct = quoted = fuzzy = top = densest = 0.0
        terms, recent, inside, seen = set(), [], False, 0
        for i, (a, b) in enumerate(spans):
            for c in lower[seen:a]:  # quotation marks between tokens
                if c in OPEN and not inside:
                    inside = True
                elif c in CLOSE or c == "\n":
                    inside = False
            seen = b
            if tokens[i] not in wanted:
                continue
            term, weight, misspelled = self.found[tokens[i]]
            window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            if inside or not REPORTING.isdisjoint(window):
                quoted += weight * QUOTED
                weight *= QUOTED
            elif not SECOND_PERSON.isdisjoint(window):
                weight *= DIRECT
            if misspelled:
                fuzzy += weight
            else:
                direct += weight
            top = max(top, weight)
            terms.add(term)
            recent = [(j, w) for j, w in recent if i - j <= 2 * WINDOW] + [(i, weight)]
            densest = max(densest, sum(w for _, w in recent))
        return [top, float(np.log1p(direct)), float(np.log1p(fuzzy)), float(np.log1p(quoted)), float(np.log1p(len(terms))), float(np.log1p(densest)), direct / (1.0 + np.sqrt(len(tokens)))]

    def forget(self) -> None:
        """Drop what was remembered of tokens: workers outlive their tasks."""
        self.seen.clear()
        self.found.clear()

    def score(self, text: str | None) -> float:
        if not self.coefficients:
            return 0.0
        z = sum(c * x for c, x in zip(self.coefficients, [*self.features(text), 1.0], strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _candidates(batches):
    """Document frequencies of words and stems by label, summed in the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = {w for w in TOKEN.findall((text.as_py() or "").lower()) if not w.isdigit()}
            found = {w[:k] + "*" for k in STEMS for w in words if len(w) > k} | words
            counts[label].update(found)
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield from _drain(counts)
    yield from _drain(counts)


def _drain(counts: tuple[Counter, Counter]):
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 1 << 16):
        part = names[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[k][n] for n in part], pa.int64()) for k in (1, 0)]], names=["term", "a", "c"])
    for c in counts:
        c.clear()


def _kin(batches):
    """Adds the least hash of a text's shingles: as likely the same for two texts as their shingle sets are similar."""
    for batch in batches:
        sets = [shingle_set((t.as_py() or "").encode()) for t in batch.column(0)]
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], names=["text", "y", "kin"])


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a little ridge; classes weigh as they come."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _lexicon(found: list) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of (term, a, c, w); a stem in no more toxic documents than a word that it begins adds nothing to it."""
    words = {t: w for t, _, _, w in found if t[-1] != "*"}
    most: dict[str, int] = {}
    for t, a, _, _ in found:
        if t[-1] != "*":
            for k in STEMS:
                if len(t) > k:
                    most[t[:k]] = max(a, most.get(t[:k], 0))
    return words, {t[:-1]: w for t, a, _, w in found if t[-1] == "*" and a > most.get(t[:-1], 0)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learn from the labelled rows that are not held out."""
    train = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    n = train.count()
    pick = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample / max(1, n))))
    # At most about `sample` rows of two numbers: bounded, hence broadcast.
    chosen = train.where(pick).groupBy("id").agg(F.max("y").alias("y"))
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).join(F.broadcast(chosen), "id").select("text", "y")
    rows = materialise(texts.mapInArrow(tidy(_kin), "text string, y int, kin long"), "toxicity-sample")
    try:
        return _learn(rows.withColumn("part", F.pmod(F.xxhash64("kin", F.lit(7)), F.lit(10)) < 6))
    finally:
        release(rows)


def _learn(rows: DataFrame) -> Toxicity:
    """The model of rows(text, y, kin, part)."""
    kin = rows.where("part").groupBy("kin", "y").agg(F.min("text").alias("text"))
    sizes = {r["y"]: r["n"] for r in rows.where("part").groupBy("y").agg(F.countDistinct("kin").alias("n")).collect()}
    if len(sizes) < 2:
        return Toxicity()
    found = kin.select("text", "y").mapInArrow(tidy(_candidates), "term string, a long, c long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    odds = F.log((F.col("a") + 0.5) / F.lit(sizes[1] + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(sizes[0] + 1.0))
    low = odds - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    least = max(LEAST, sizes[1] * SHARE // 100)
    # Terms of so many of at most about `sample` documents: their number has a bound.
    best = found.where(F.col("a") >= least).withColumn("w", low).where(F.col("w") >= ODDS).orderBy("term").collect()
    model = Toxicity(*_lexicon([(r["term"], r["a"], r["c"], r["w"]) for r in best]))

    def vectors(batches):
        for batch in batches:
            made = [model.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    learned = rows.where("NOT part").select("text", "y").mapInArrow(tidy(vectors), "x array<double>, y int").toArrow()
    y = learned["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Toxicity()
    model.coefficients = _logistic(np.array(learned["x"].to_pylist()), y)
    return model


def with_scores(docs: DataFrame, model: Toxicity, text_col: str = "text", into: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the score of every whole text; keep_text=False spares the way back of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if (keep_text or c != text_col) and c != into]

    def run(batches):
        model = shared.value
        try:
            for batch in batches:
                scores = [model.score(t.as_py()) for t in batch.column(text_col)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64())], names=[*kept, into])
        finally:
            model.forget()

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return spread(docs.select(*dict.fromkeys([*kept, text_col]))).mapInArrow(tidy(run), f"{fields}, `{into}` double")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_scores(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(docs, labels), keep_text=False)
    return scored.select("doc_id", "held_out", "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
