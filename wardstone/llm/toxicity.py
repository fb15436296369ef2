"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learned from labelled texts: words and stems of words that toxic texts hold significantly more often
than clean ones, where near copies count once. Its trie is walked by a Levenshtein automaton; the product is made deterministic
lazily, so a word costs one lookup per letter and most words end in the dead state after three or four. Hits are
read in a window of words: inside quotation marks or beside words of reporting they count as quoted, and hits that
stand close together strengthen each other. A logistic model on these window scores gives the score.

Defined cases: null and empty texts have no hits and get the score of a text without hits; without usable labels
the score is 0; label rows that repeat count as toxic if any of them is; very long texts are read word by word;
ties in the sample go by hash; an empty table gives an empty result; other columns pass through untouched.
"""

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from wardstone.llm.common import fresh, settled

QUOTES = "\"'`«»‘’‚“”„‹›"
EDGES = QUOTES + ".,;:!?()[]{}<>|/\\-_*#~"
#: Words of reporting around a quotation (fixed values).
REPORTING = {"said", "says", "wrote", "called", "quote", "quoted", "sagte", "schrieb", "nannte", "dit", "appelle", "dijo", "llama"}
WINDOW = 10
FEATURES = 6
#: Lengths of the stems that are learned beside whole words.
STEMS = (4, 5, 6, 7)


class FuzzyLexicon:
    """Product of a lexicon trie and the Levenshtein automaton for one edit (none for terms under five letters).

    A term that ends with ``*`` is a stem: it matches every word that begins with it, letter by letter.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.children, self.term = [{}], [None]
        for term in sorted(weights):
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            if self.term[node] is None:
                self.term[node] = term
        self.stems = {n for n, t in enumerate(self.term) if t and t.endswith("*")}
        self.ids, self.sets, self.next, self.accepts = {}, [], [], []
        self.start = self._state({0: 0})
        self.seen: dict[str, tuple] = {}

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state with these trie nodes (and least edits), closed under skipped letters; -1 is dead."""
        closed = dict(nodes)
        for node, edits in nodes.items():
            if edits == 0:
                for child in self.children[node].values():
                    closed.setdefault(child, 1)
        if not closed:
            return -1
        key = frozenset(closed.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(closed)
            self.next.append({})
            found = [(e, self.term[n]) for n, e in closed.items() if self.term[n] is not None and e <= (len(self.term[n]) >= 5 and n not in self.stems)]
            self.accepts.append(min(found, default=None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            if node in self.stems and edits == 0:
                to[node] = 0  # whatever follows a stem
            same = self.children[node].get(c)
            if same is not None:
                to[same] = min(to.get(same, 2), edits)
            if edits == 0:
                to[node] = min(to.get(node, 2), 1)  # a letter too many
                for child in self.children[node].values():
                    to[child] = min(to.get(child, 2), 1)  # another letter
        self.next[state][c] = out = self._state(to)
        return out

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the best term; the least edits, then the first term."""
        state, nexts = self.start, self.next
        for c in word:
            to = nexts[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]

    def hits(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(position, edits, term) of all words that match."""
        found = {}
        for raw in set(words):
            if (m := self.match(raw.strip(EDGES))) is not None:
                found[raw] = m
        return [(i, *found[w]) for i, w in enumerate(words) if w in found] if found else []


def words_of(text: str) -> list[str]:
    return text.lower().split()


def window_scores(lexicon: FuzzyLexicon, text: str) -> list[float]:
    """Features of a text: direct and quoted evidence, fuzzy hits, distinct terms, best window, density."""
    words = words_of(text)
    hits = lexicon.hits(words)
    if not hits:
        return [0.0] * FEATURES
    direct = quoted = fuzzy = best = 0.0
    for k, (i, edits, term) in enumerate(hits):
        weight = lexicon.weights[term] * (0.7 if edits else 1.0)
        if _is_quoted(words, i):
            quoted += weight
            continue
        direct += weight
        fuzzy += weight if edits else 0.0
        near, j = 0.0, k
        while j >= 0 and i - hits[j][0] <= WINDOW:
            near += lexicon.weights[hits[j][2]]
            j -= 1
        best = max(best, near)
    return [math.log1p(direct), math.log1p(quoted), math.log1p(fuzzy), math.log1p(len({t for _, _, t in hits})), math.log1p(best), direct / len(words)]


def _is_quoted(words: list[str], i: int) -> bool:
    """Between an opening and a closing mark within the window, or right beside a word of reporting and a mark."""
    before = [w for w in words[max(0, i - WINDOW) : i + 1] if w[:1] in QUOTES or w.strip(EDGES) in REPORTING]
    after = [w for w in words[i : i + WINDOW + 1] if w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?")]
    opened = any(w[:1] in QUOTES and not (len(w) > 1 and w.rstrip(".,;:!?")[-1:] in QUOTES and w is not words[i]) for w in before)
    return opened and bool(after)


@dataclass
class ToxicityModel:
    """Term weights, and a logistic model over the window scores; sent to the tasks (bounded by the training sample)."""

    weights: dict[str, float] = field(default_factory=dict)
    center: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    coef: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    base: float = -50.0

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.center)) / np.array(self.scale)
        return 1.0 / (1.0 + np.exp(-np.clip(z @ np.array(self.coef) + self.base, -50, 50)))


def held_out(doc_id: Column, modulus: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == part, F.lit(False))


def _word_rows(batches):
    """Distinct words of each text with its label and two min-hashes, which near copies share."""
    for batch in batches:
        out: dict[str, list] = {"word": [], "toxic": [], "m1": [], "m2": []}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w.strip(EDGES) for w in words_of(text or "")}
            words = {w for w in words if 3 <= len(w) <= 40}
            if not words:
                continue
            words |= {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            codes = [_stable(w) for w in words]
            m1, m2 = min(codes), min((c * 0x9E3779B97F4A7C15 + 11) & 0xFFFFFFFF for c in codes)
            out["word"] += words
            for name, value in (("toxic", int(toxic)), ("m1", m1), ("m2", m2)):
                out[name] += [value] * len(words)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("m1", pa.int64()), ("m2", pa.int64())]))


def _stable(word: str) -> int:
    import zlib

    return zlib.crc32(unicodedata.normalize("NFC", word).encode())


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """Texts and labels to learn from: no held-out ids, a bounded number of each class, chosen by hash."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = settled(known.filter(~held_out(F.col("doc_id"))))
    size = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, max_toxic / max(1, size.get(1, 0)))).otherwise(min(1.0, max_clean / max(1, size.get(0, 0))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    chosen = known.filter(part).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    return settled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))


def learn_lexicon(rows: DataFrame, least_texts: int = 4, least_evidence: float = 12.0, least_share: float = 0.8) -> dict[str, float]:
    """Words with significantly many toxic texts. Texts with the same min-hash count once; the table is bounded by the sample."""
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return {}
    p = toxic / (toxic + clean)
    is_toxic = F.col("toxic") == 1
    found = (
        rows.mapInArrow(_word_rows, "word string, toxic int, m1 long, m2 long")
        .groupBy("word", "m1", "m2")
        .agg(F.max("toxic").alias("toxic"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.collect_set(F.when(is_toxic, F.col("m1"))).alias("s1"), F.collect_set(F.when(is_toxic, F.col("m2"))).alias("s2"))
        .withColumn("t", F.least("t", F.size("s1"), F.size("s2")).cast("double"))
        .filter(f"t >= {least_texts} and t >= {least_share} * (t + c)")
    )
    n = F.col("t") + F.col("c")
    clean_part = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - p)))).otherwise(0.0)
    found = found.filter(F.col("t") * F.log(F.col("t") / (n * p)) + clean_part >= least_evidence)
    weight = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) * ((clean + 1.0) / (toxic + 1.0)))
    return {r.word: round(float(r.w), 6) for r in found.select("word", weight.alias("w")).collect()}


def _featured(batches, weights: dict[str, float]):
    lexicon = FuzzyLexicon(weights)
    for batch in batches:
        rows = [window_scores(lexicon, t or "") for t in batch.column("text").to_pylist()]
        columns = [pa.array([r[j] for r in rows], pa.float64()) for j in range(FEATURES)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], [*[f"f{j}" for j in range(FEATURES)], "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps on a bounded sample; the last coefficient is the base."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3_000, max_clean: int = 15_000) -> ToxicityModel:
    """A model from labelled texts outside the held-out part, at most about ``max_toxic`` and ``max_clean`` of them."""
    rows = training_rows(docs, labels, max_toxic, max_clean)
    weights = learn_lexicon(rows)
    if not weights:
        return ToxicityModel()
    schema = ", ".join(f"f{j} double" for j in range(FEATURES)) + ", toxic int"
    got = rows.mapInArrow(lambda batches: _featured(batches, weights), schema).toArrow()
    table = np.column_stack([got.column(j).to_numpy().astype(float) for j in range(FEATURES + 1)])
    table = table[np.lexsort(table.T)]  # sums, and so the model, don't depend on the order of tasks
    x, y = table[:, :-1], table[:, -1]
    center, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    w = _logistic((x - center) / scale, y)
    return ToxicityModel(weights, center.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted`` (or those names with underscores, if taken)."""
    score, predicted = fresh(docs, "score", "predicted")
    schema = StructType([*docs.schema.fields]).add(score, DoubleType()).add(predicted, IntegerType())

    def run(batches):
        lexicon = FuzzyLexicon(model.weights)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            features = np.array([window_scores(lexicon, t or "") for t in texts]).reshape(-1, FEATURES)
            values = model.score(features)
            added = [pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, score, predicted])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model_docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the model does not call toxic, with their own columns."""
    score, predicted = fresh(docs, "score", "predicted")
    return scored(docs, train(model_docs, labels), threshold).filter(F.col(predicted) == 0).drop(score, predicted)
