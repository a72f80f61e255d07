"""Language identification by unigrams over a fixed public piece vocabulary, summed over all segmentations.

A text's probability in a language is that of its words; a word's is the sum over all ways to write it as
pieces, found by a forward pass. Piece probabilities per language are learned by expectation maximisation
on the words of a bounded, documented sample of labelled rows; everything else covers all rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of

MARK = "▁"
#: Bound of the training sample: labelled rows per language. All their words count.
TRAIN_ROWS = 400
EM_ROUNDS = 3
#: Pseudo count of every piece in every language.
SMOOTHING = 0.02
#: Words longer than this are learned from and scored one by one, in logarithms; typical probability of a character, which keeps sums near 1.
LONG_WORD = 40
CHAR_SCALE = 12.0
CACHE_WORDS = 700_000
UNDETERMINED = "und"
#: Least posterior of a predicted language at which a document counts as identified.
LEAST_POSTERIOR = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_STATE: dict = {}


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. Pieces of the vocabulary never cross their ends."""
    return _WORD.findall(text.lower())


def _lattice_tools(path: str):
    """(automaton, number of pieces) of the vocabulary's plain pieces; one more number stands for an unknown character."""
    if ("automaton", path) not in _STATE:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        auto = ahocorasick.Automaton()
        size = model.get_piece_size()
        for i in range(size):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                name = model.id_to_piece(i)
                auto.add_word(name, (i, len(name)))
        auto.make_automaton()
        _STATE[("automaton", path)] = (auto, size)
    return _STATE[("automaton", path)]


def lattice(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, end, piece) of all pieces in the words, and the words' lengths with their mark."""
    auto, unknown = _lattice_tools(path)
    w, s, e, p = [], [], [], []
    sizes = np.array([len(x) + 1 for x in words], np.int64)
    for k, x in enumerate(words):
        text = MARK + x
        alone = set()
        for end, (piece, size) in auto.iter(text):
            w.append(k)
            s.append(end + 1 - size)
            e.append(end + 1)
            p.append(piece)
            if size == 1:
                alone.add(end)
        if len(alone) < len(text):
            for at in range(len(text)):
                if at not in alone:
                    w.append(k)
                    s.append(at)
                    e.append(at + 1)
                    p.append(unknown)
    return np.array(w, np.int64), np.array(s, np.int64), np.array(e, np.int64), np.array(p, np.int64), sizes


def _forward(lat, weights: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: summed weight of all segmentations of the word's first characters."""
    w, s, e, p, sizes = lat
    n, top = len(sizes), int(sizes.max())
    alpha = np.zeros((n, top + 1, weights.shape[1]))
    alpha[:, 0] = 1.0
    order = np.argsort(e, kind="stable")
    cuts = np.searchsorted(e[order], np.arange(1, top + 2))
    for end in range(1, top + 1):
        rows = order[cuts[end - 1] : cuts[end]]
        if len(rows):
            step = alpha[w[rows], s[rows]] * weights[p[rows]]
            for k in range(weights.shape[1]):
                alpha[:, end, k] += np.bincount(w[rows], weights=step[:, k], minlength=n)
    return alpha


def _backward(lat, weights: np.ndarray) -> np.ndarray:
    w, s, e, p, sizes = lat
    n, top = len(sizes), int(sizes.max())
    beta = np.zeros((n, top + 1, weights.shape[1]))
    beta[np.arange(n), sizes] = 1.0
    order = np.argsort(s, kind="stable")
    cuts = np.searchsorted(s[order], np.arange(0, top + 1))
    for start in range(top - 1, -1, -1):
        rows = order[cuts[start] : cuts[start + 1]]
        if len(rows):
            step = beta[w[rows], e[rows]] * weights[p[rows]]
            for k in range(weights.shape[1]):
                beta[:, start, k] += np.bincount(w[rows], weights=step[:, k], minlength=n)
    return beta


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of the labelled rows
    logp: np.ndarray  # (pieces + 1, languages)
    path: str

    @property
    def key(self) -> str:
        return hashlib.sha1(self.logp.tobytes() + self.prior.tobytes() + repr(self.languages).encode()).hexdigest()


def fit(counts: list[tuple[str, str, int]], rows: dict[str, int], path: str) -> Model:
    """EM over (language, word, count); rows: labelled rows per language, for the prior."""
    languages = sorted(rows)
    total = sum(rows.values())
    prior = np.array([np.log(rows[x] / total) for x in languages])
    _, size = _lattice_tools(path)
    table: dict[str, np.ndarray] = {}
    index = {x: k for k, x in enumerate(languages)}
    for lang, word, n in counts:
        table.setdefault(word, np.zeros(len(languages)))[index[lang]] += n
    words = sorted(x for x in table if len(x) <= LONG_WORD)
    long = [(lattice([x], path), table[x]) for x in sorted(table) if len(x) > LONG_WORD]
    prob = np.full((size + 1, len(languages)), 1.0 / (size + 1))
    if table:
        freq = np.array([table[x] for x in words])
        parts = [(lattice(words[a : a + 4000], path), freq[a : a + 4000]) for a in range(0, len(words), 4000)]
        for _ in range(EM_ROUNDS):
            expected = np.full(prob.shape, SMOOTHING)
            for lat, f in parts:
                w, s, e, p, sizes = lat
                scaled = _scaled(prob, p, s, e)
                alpha, beta = _forward_rows(lat, scaled), _backward_rows(lat, scaled)
                whole = alpha[np.arange(len(sizes)), sizes]
                gain = alpha[w, s] * scaled * beta[w, e] / np.maximum(whole[w], 1e-300) * f[w]
                for k in range(len(languages)):
                    expected[:, k] += np.bincount(p, weights=gain[:, k], minlength=size + 1)
            logp = np.log(prob)
            for lat, f in long:
                _, s, e, p, sizes = lat
                alpha, beta = _long_sums(lat, logp, forward=True), _long_sums(lat, logp, forward=False)
                np.add.at(expected, p, np.exp(alpha[s] + logp[p] + beta[e] - alpha[int(sizes[0])]) * f)
            prob = expected / expected.sum(axis=0)
    return Model(languages, prior, np.log(prob), path)


def _scaled(prob: np.ndarray, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Weight of each lattice row, with CHAR_SCALE per character so that sums stay near 1."""
    return prob[p] * np.power(CHAR_SCALE, (e - s))[:, None]


def _forward_rows(lat, row_weights: np.ndarray) -> np.ndarray:
    w, s, e, _, sizes = lat
    return _forward((w, s, e, np.arange(len(w)), sizes), row_weights)


def _backward_rows(lat, row_weights: np.ndarray) -> np.ndarray:
    w, s, e, _, sizes = lat
    return _backward((w, s, e, np.arange(len(w)), sizes), row_weights)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """(words, languages) log probabilities, each summed over all segmentations."""
    out = np.zeros((len(words), len(model.languages)))
    short = [k for k, x in enumerate(words) if len(x) <= LONG_WORD]
    prob = np.exp(model.logp)
    for a in range(0, len(short), 4000):
        rows = short[a : a + 4000]
        lat = lattice([words[k] for k in rows], model.path)
        alpha = _forward_rows(lat, _scaled(prob, lat[3], lat[1], lat[2]))
        sizes = lat[4]
        out[rows] = np.log(np.maximum(alpha[np.arange(len(rows)), sizes], 1e-300)) - sizes[:, None] * np.log(CHAR_SCALE)
    for k, x in enumerate(words):
        if len(x) > LONG_WORD:
            out[k] = _long_word(x, model)
    return out


def _long_sums(lat, logp: np.ndarray, forward: bool) -> np.ndarray:
    """Log sums over all segmentations of one word's first (forward) or last characters, by place; for words of any length."""
    _, s, e, p, sizes = lat
    n = int(sizes[0])
    near, far = (e, s) if forward else (s, e)
    out = np.full((n + 1, logp.shape[1]), -np.inf)
    out[0 if forward else n] = 0.0
    order = np.argsort(near, kind="stable")
    cuts = np.searchsorted(near[order], np.arange(n + 2))
    for at in range(1, n + 1) if forward else range(n - 1, -1, -1):
        rows = order[cuts[at] : cuts[at + 1]]
        step = out[far[rows]] + logp[p[rows]]
        top = step.max(axis=0)
        out[at] = top + np.log(np.exp(step - top).sum(axis=0))
    return out


def _long_word(word: str, model: Model) -> np.ndarray:
    lat = lattice([word], model.path)
    return _long_sums(lat, model.logp, forward=True)[int(lat[4][0])]


class Scorer:
    """Scores texts with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.index) + len(words) > CACHE_WORDS:
            self.index.clear()
        fresh = [x for x in words if x not in self.index]
        if not fresh:
            return
        first = len(self.index)
        need = first + len(fresh)
        if need > len(self.table):
            self.table = np.concatenate([self.table[:first], np.zeros((max(need, 2 * len(self.table)) - first, self.table.shape[1]))])
        self.table[first:need] = word_scores(fresh, self.model)
        self.index.update(zip(fresh, range(first, need), strict=True))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        rows = [words_of(t) for t in texts]
        m = self.model
        if not m.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        wanted = {x for row in rows for x in row}
        missing = wanted - self.index.keys()
        if missing:
            self._learn(wanted if len(self.index) + len(missing) > CACHE_WORDS else missing)
        out = []
        for row in rows:
            if not row:
                out.append((UNDETERMINED, 0.0))
                continue
            score = self.table[np.fromiter(map(self.index.__getitem__, row), np.int64, len(row))].sum(axis=0) + m.prior
            best = int(np.argmax(score))
            out.append((m.languages[best], float(1.0 / np.exp(score - score[best]).sum())))
        return out


def held_out(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string")) % 4 == 2) & doc_id.isNotNull()


def _counted(batches):
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in words_of(text):
                found[(lang, x)] = found.get((lang, x), 0) + 1
        if found:
            langs, words = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def training_words(docs: DataFrame) -> tuple[DataFrame | None, dict[str, int]]:
    """(lang, word, n) of the training rows, and the labelled rows of each language.

    Learn from text and lang of rows that are not held out: TRAIN_ROWS rows per language of least hash, all their words.
    Row counts for the prior cover all such rows. Null texts, null langs and null ids are no training rows.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    per_lang = {r["lang"]: r["n"] for r in usable.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return None, per_lang
    # first a share of each language that is near the bound, then the bound itself over those few rows
    space = 1 << 32
    limit = F.create_map(*(x for lang, n in per_lang.items() for x in (F.lit(lang), F.lit(min(space, 2 * TRAIN_ROWS * space // n)))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    near = usable.select(F.col("lang").cast("string").alias("lang"), F.col("text"), place.alias("place")).where(F.col("place") <= limit[F.col("lang")])
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("text")))).where(F.col("rank") <= TRAIN_ROWS)
    words = first.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return words, per_lang


def train(docs: DataFrame, path: str) -> Model:
    """The model of the training words, learned where the driver is; for few languages and words."""
    words, per_lang = training_words(docs)
    if words is None:
        return Model([], np.zeros(0), np.zeros((1, 0)), path)
    return fit([(r["lang"], r["word"], r["n"]) for r in words.collect()], per_lang, path)


def train_in_tasks(docs: DataFrame, path: str) -> Model:
    """The same model, equal but for rounding: a language's probabilities depend on its own words alone, so a task learns each
    language from its bounded sample, and the driver gets the probabilities only, not words and their segmentations."""
    words, per_lang = training_words(docs)
    if words is None:
        return Model([], np.zeros(0), np.zeros((1, 0)), path)
    learned = {r["lang"]: np.frombuffer(r["logp"]) for r in words.groupBy("lang").applyInArrow(_learner(path), "lang string, logp binary").collect()}
    return _joined(learned, per_lang, path)


def _learner(path: str):
    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        model = fit(list(zip(*(table.column(x).to_pylist() for x in ("lang", "word", "n")), strict=True)), {lang: 1}, path)
        return pa.table({"lang": [lang], "logp": pa.array([model.logp[:, 0].tobytes()], pa.binary())})

    return run


def _joined(learned: dict[str, np.ndarray], rows: dict[str, int], path: str) -> Model:
    """The model of languages learned one by one; a language without words has all pieces alike, as in `fit`."""
    if not learned:
        return fit([], rows, path)
    languages = sorted(rows)
    pieces = len(next(iter(learned.values())))
    alike = np.full(pieces, -np.log(pieces))
    prior = np.array([np.log(rows[x] / sum(rows.values())) for x in languages])
    return Model(languages, prior, np.stack([learned.get(x, alike) for x in languages], axis=1), path)


def _predictor(model: Model):
    key = model.key

    def run(batches):
        if _STATE.get("scorer key") != key:
            _STATE["scorer key"], _STATE["scorer"] = key, Scorer(model)
        scorer = _STATE["scorer"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = []
            for a in range(0, len(texts), 200):
                found += scorer.predict(texts[a : a + 200])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, path: str, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the predicted language) of every whole text.

    Null text or no letters, or nothing to learn from: `und` with score 0. Equal texts get equal results;
    an empty table gives no rows; other columns, whatever their names, are not read.
    """
    model = model or train_in_tasks(docs, path)
    rows = texts_of(docs).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(model: Model, least: float, lang_type: pa.DataType | None):
    predicting = _predictor(model)

    def kept(batch):
        text = batch.column("text").cast(pa.string()).fill_null("")
        ids = pa.nulls(batch.num_rows, pa.int64())
        probe = pa.RecordBatch.from_arrays([ids, text, pa.array([False] * batch.num_rows)], names=["doc_id", "text", "held_out"])
        found = next(predicting(iter([probe])))
        lang, score = found.column("lang_pred"), found.column("score")
        if lang_type is not None:
            at = batch.schema.get_field_index("lang")
            batch = batch.set_column(at, batch.schema.field(at), lang.cast(lang_type))
        return batch.filter(pc.and_(pc.not_equal(lang, UNDETERMINED), pc.greater_equal(score, least)))

    def run(batches):
        try:
            yield from map(kept, batches)
        finally:  # the worker goes on to other stages, which need the memory of the word scores
            _STATE.pop("scorer key", None)
            _STATE.pop("scorer", None)

    return run


def keep_identified(docs: DataFrame, path: str, model: Model | None = None, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of docs whose language can be told, with all their columns; a string column lang then holds that language.

    So a null label is filled in, and one that the text contradicts is replaced. A row goes if its text is null or
    has no letters, or if no language has a posterior of at least `least`. Equal texts fare alike, so repeated rows
    and ties (the language first in order) are decided alike; columns of any name, lang excepted, stay as they are.
    Where nothing can be learned (no labelled rows), all rows stay as they are. An empty table gives no rows.
    """
    model = model or train_in_tasks(docs, path)
    if not model.languages:
        return docs
    lang = next((f.dataType.simpleString() for f in docs.schema if f.name == "lang"), None)
    return docs.mapInArrow(_keeper(model, least, pa.string() if lang == "string" else None), docs.schema)
