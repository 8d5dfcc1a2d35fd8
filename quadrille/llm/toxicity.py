"""Toxicity by a weighted finite-state grammar over clauses.

Seven transducers, for negation, reported speech, targets, insults, insults that need a target, threats and contests
that only sound like threats, are composed into one that reads the classes of a clause's words. It writes where an
insult or a threat is complete, and whether it is negated, reported or aimed at someone. A clause counts once for the plainest match of each kind, and a text's score is the sum of the
arcs that its clauses took. Insulting words are a short list and what labels teach besides; labels teach the weights
too, within bounds that keep a negated or reported match below a plain one, and that below one aimed at someone.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, fresh, table
from .textkernel import NOT_ALNUM, U, Words, byte_class, coded, mix, slices, table_of, words

#: About as many labelled texts of each class are learned from, drawn by hash.
SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 12_000
#: Features of toxic texts that are counted in clean ones, at most, the most frequent first.
CANDIDATES = 200_000
LEXICON = 5_000
#: Bytes of a word that make its stems.
STEMS = (4, 5, 6)
#: A feature is learned if it is so much more frequent in toxic texts, and its G squared so far above what the most
#: surprising of as many features has by chance.
RATIO = 40.0
SURPRISE = 4.0
CLAUSE_ENDS = byte_class(b".!?;\n")

OTHER, INSULT, VIOLENCE, INTENT, PERSON, TARGET, NEGATION, REPORT, LOOSE, CONTEST, GOAL = SYMBOLS = range(11)
#: Words of the grammar, by class (fixed values). A target may be addressed or be what a verb is done to; a loose insult
#: is one only of someone, as there are clown fish; and who beats another to or at something threatens nobody.
WORDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum pathetic worthless disgusting imbecile jerk dummkopf blöd blöde dumm abschaum versager erbärmlich wertlos connard crétin imbécile stupide minable idiota estúpido estúpida imbécil escoria patético",
    LOOSE: "clown clowns trash dumb fool fools déchet basura",
    CONTEST: "beat",
    GOAL: "to at",
    VIOLENCE: "kill hurt destroy shoot stab strangle murder töten schlagen umbringen tuer frapper détruire matar golpear destruir",
    INTENT: "will going gonna shall ll werde werden wird vais va allons voy vamos va",
    PERSON: "he she they ihr sie du tu él ella ellos",
    TARGET: "you your yours yourself him her them dich dir dein euch ihn ihnen te toi ton vous votre usted tú ti",
    NEGATION: "not no never neither nor nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says say wrote writes quoted quote called claims claimed reported according sagte sagt schrieb dit écrit dijo dice escribió",
}
NEGATED, REPORTED, AIMED, INSULTED, THREATENED, WITHDRAWN = 1, 2, 4, 8, 16, 32


# --- the grammar -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """``moves[state][symbol]`` is the next state; ``writes[state][symbol]`` are the marks put out on the way."""

    moves: tuple[tuple[int, ...], ...]
    writes: tuple[tuple[int, ...], ...]


def negation(reach: int = 3) -> Transducer:
    """A negation marks the ``reach`` words behind it."""
    moves = [[reach if a == NEGATION else max(0, s - 1) for a in SYMBOLS] for s in range(reach + 1)]
    return Transducer(tuple(map(tuple, moves)), tuple(tuple(NEGATED * (s > 0) for _ in SYMBOLS) for s in range(reach + 1)))


def latch(symbols: set[int], mark: int) -> Transducer:
    """Once one of the symbols is read, it and all that follows in the clause is marked."""
    idle = tuple(int(a in symbols) for a in SYMBOLS)
    return Transducer((idle, (1,) * len(SYMBOLS)), (tuple(mark * x for x in idle), (mark,) * len(SYMBOLS)))


def insult(reach: int = 2) -> Transducer:
    """An insulting word is a match; those close behind it belong to the same phrase."""
    moves = [[reach if a == INSULT else max(0, s - 1) for a in SYMBOLS] for s in range(reach + 1)]
    return Transducer(tuple(map(tuple, moves)), tuple(tuple(INSULTED * (a == INSULT and s == 0) for a in SYMBOLS) for s in range(reach + 1)))


def loose(reach: int = 3) -> Transducer:
    """A loose insult is a match with someone at most ``reach`` words before or behind it; it is one once."""
    who = (PERSON, TARGET)
    states = [(None, 0)] + [(part, left) for part in (PERSON, LOOSE) for left in range(1, reach + 1)]
    place = {s: i for i, s in enumerate(states)}
    moves, writes = [], []
    for part, left in states:
        row, out = [], []
        for a in SYMBOLS:
            now = PERSON if a in who else LOOSE if a == LOOSE else None
            done = now is not None and part not in (None, now)
            fades = (part, left - 1) if left > 1 else (None, 0)
            row.append(place[(PERSON, reach) if done or now == PERSON else (LOOSE, reach) if now else fades])
            out.append(INSULTED * done)
        moves.append(tuple(row))
        writes.append(tuple(out))
    return Transducer(tuple(moves), tuple(writes))


def contest() -> Transducer:
    """A verb of contest, its target and a goal, one right after the other, take back the threat that they made."""
    moves = [[int(a == CONTEST) for a in SYMBOLS] for _ in range(3)]
    moves[1][TARGET] = 2
    return Transducer(tuple(map(tuple, moves)), tuple(tuple(WITHDRAWN * (s == 2 and a == GOAL) for a in SYMBOLS) for s in range(3)))


def threat(reach: int = 4) -> Transducer:
    """A match is complete with the last of intent, violence and target, in any order, none farther than ``reach``
    words from the one before. Any of them alone, or two, are none."""
    parts = (INTENT, VIOLENCE, TARGET)
    states = [(frozenset(), 0)] + [(frozenset(c), left) for k in (1, 2) for c in itertools.combinations(parts, k) for left in range(1, reach + 1)]
    place = {s: i for i, s in enumerate(states)}
    moves, writes = [], []
    for seen, left in states:
        row, out = [], []
        for symbol in SYMBOLS:
            a = VIOLENCE if symbol == CONTEST else symbol
            now = seen | {a} if a in parts else seen
            done = len(now) == len(parts)
            after = (frozenset(), 0) if done or (a not in parts and left <= 1) else (now, reach if a in parts else left - 1)
            row.append(place[after])
            out.append(THREATENED * done)
        moves.append(tuple(row))
        writes.append(tuple(out))
    return Transducer(tuple(moves), tuple(writes))


def compose(*parts: Transducer) -> Transducer:
    """The product: it moves in all parts at once and writes what any of them writes. Only states that can be reached
    from the first are made."""
    states = [(0,) * len(parts)]
    place, moves, writes = {states[0]: 0}, [], []
    for s in states:
        row = [tuple(p.moves[x][a] for p, x in zip(parts, s, strict=True)) for a in SYMBOLS]
        for to in row:
            if to not in place:
                place[to] = len(states)
                states.append(to)
        moves.append(tuple(place[to] for to in row))
        # Two parts may write the same mark, so marks are joined, not added.
        writes.append(tuple(functools.reduce(operator.or_, (p.writes[x][a] for p, x in zip(parts, s, strict=True))) for a in SYMBOLS))
    return Transducer(tuple(moves), tuple(writes))


GRAMMAR = compose(negation(), latch({REPORT}, REPORTED), latch({PERSON, TARGET}, AIMED), insult(), loose(), threat(), contest())
#: Words of no class after which every part is where it began, or latched.
REST = 4
#: For insults, then threats: clauses with a match, and those whose match is aimed, negated or reported; then the
#: share of a text's clauses with a match neither negated nor reported, in hundredths. All as log(1 + x).
FEATURES = 2 * 4 + 1
#: What the weights are without labels, and their bounds: a match says toxic, a target more so, the rest less so.
PRIOR = np.array([2.0, 1.0, -1.5, -1.5, 3.0, 1.0, -2.0, -2.0, 0.2])
LEAST = np.array([0.5, 0.1, -np.inf, -np.inf, 0.5, 0.1, -np.inf, -np.inf, 0.0])
MOST = np.array([np.inf, np.inf, -0.1, -0.1, np.inf, np.inf, -0.1, -0.1, np.inf])


def clause(symbols: list[tuple[int, int]]) -> tuple[int, int]:
    """The marks of the plainest insult and of the plainest threat among the (place, class) pairs of a clause's words,
    0 where there is none; words of no class may be left out. A target behind the match aims it as well."""
    state, last, found, aimed = 0, -1, {INSULTED: [], THREATENED: []}, 0
    for place, symbol in symbols:
        for _ in range(min(place - last - 1, REST)):
            state = GRAMMAR.moves[state][OTHER]
        marks = GRAMMAR.writes[state][symbol]
        if marks & WITHDRAWN and found[THREATENED]:
            found[THREATENED].pop()
        state, last, aimed = GRAMMAR.moves[state][symbol], place, aimed | marks & AIMED
        for kind, held in found.items():
            if marks & kind:
                held.append(marks & (NEGATED | REPORTED))
    return tuple(kind | min(held, key=lambda m: (m.bit_count(), m)) | aimed if held else 0 for kind, held in found.items())


# --- words and features ------------------------------------------------------------------------------------------


def read(texts: pa.Array) -> Words:
    return words(pc.utf8_lower(texts), NOT_ALNUM)


def word_features(w: Words) -> np.ndarray:
    """A row for each word: its hash and those of its stems (0 where it has none); kinds never mix."""
    out = np.zeros((len(w.starts), 1 + len(STEMS)), U)
    out[:, 0] = w.hashes()
    size = w.ends - w.starts
    for k, n in enumerate(STEMS, 1):
        long = size > n
        out[long, k] = mix(w.span_hashes(w.starts[long], w.starts[long] + n) + U(k))
    return out


@dataclass
class Model:
    lexicon: np.ndarray  # sorted hashes of learned insults
    coarse: np.ndarray
    grammar: np.ndarray  # sorted hashes of the grammar's words
    classes: np.ndarray  # and their classes, behind that of no word
    weights: np.ndarray  # of FEATURES, then the constant


def grammar_words() -> tuple[np.ndarray, np.ndarray]:
    listed = {w: c for c, line in WORDS.items() for w in line.split()}
    h = words(pa.array(list(listed)), NOT_ALNUM).hashes()
    order = np.argsort(h)
    return h[order], np.concatenate(([OTHER], np.array(list(listed.values()))[order]))


def features(m: Model, texts: pa.Array) -> np.ndarray:
    """FEATURES numbers for each text, from the clauses that match the grammar."""
    w = read(texts)
    out = np.zeros((len(texts), FEATURES))
    if not len(w.starts):
        return out
    h = word_features(w)
    symbol = m.classes[coded(m.grammar, table_of(m.grammar), h[:, 0])]
    for k in range(h.shape[1]):
        symbol[(coded(m.lexicon, m.coarse, h[:, k]) > 0) & (symbol == OTHER)] = INSULT
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.of))
    ends = np.cumsum(CLAUSE_ENDS[w.data])[w.starts]
    new = np.concatenate(([True], (ends[1:] != ends[:-1]) | (text_of[1:] != text_of[:-1])))
    number = np.cumsum(new) - 1
    may = np.zeros(number[-1] + 1, bool)
    may[number[np.isin(symbol, (INSULT, LOOSE, VIOLENCE, CONTEST))]] = True
    begin = np.flatnonzero(new)
    at = np.flatnonzero((symbol != OTHER) & may[number])
    matched = np.zeros(len(texts))
    for _, group in itertools.groupby(at.tolist(), key=lambda i: number[i]):
        group = list(group)
        text = text_of[group[0]]
        marks = clause([(i - int(begin[number[i]]), int(symbol[i])) for i in group])
        matched[text] += any(x and not x & (NEGATED | REPORTED) for x in marks)
        for k, x in enumerate(marks):
            if x:
                out[text, 4 * k : 4 * k + 4] += (1, bool(x & AIMED), bool(x & NEGATED), bool(x & REPORTED))
    out[:, 8] = 100 * matched / np.maximum(np.bincount(text_of[begin], minlength=len(texts)), 1)
    return np.log1p(out)


# --- learning ----------------------------------------------------------------------------------------------------


def counted(texts: DataFrame) -> DataFrame:
    """How many texts have each feature: rows (feature, n), summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in slices(batches, "text"):
            w = read(t)
            h = word_features(w)
            pairs = pd.DataFrame({"d": np.repeat(np.repeat(np.arange(len(t)), np.diff(w.of)), h.shape[1]), "f": h.ravel().view(np.int64)})
            n = pairs[pairs["f"] != 0].drop_duplicates()["f"].value_counts()
            yield pa.RecordBatch.from_arrays([pa.array(n.index.to_numpy()), pa.array(n.to_numpy())], ["feature", "n"])

    return texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, sweeps: int = 200) -> np.ndarray:
    """Weights drawn to PRIOR, within LEAST and MOST, and the constant: one after the other goes to where a Newton step
    and its bounds lead, until none moves."""
    x = np.hstack((x, np.ones((len(x), 1))))
    prior, low, high = np.append(PRIOR, 0.0), np.append(LEAST, -np.inf), np.append(MOST, np.inf)
    keep = np.append(np.full(FEATURES, ridge), 1e-3)
    w = prior.copy()
    z = x @ w
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, j] @ (p - y) + keep[j] * (w[j] - prior[j])
            # The curvature is bounded below, so that no step overshoots where all is certain.
            bend = (x[:, j] ** 2) @ np.maximum(p * (1 - p), 0.02) + keep[j]
            to = float(np.clip(w[j] - slope / bend, low[j], high[j]))
            z += x[:, j] * (to - w[j])
            most, w[j] = max(most, abs(to - w[j])), to
        if most < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled rows of ``docs``: a hash sample of about SAMPLE_TOXIC and SAMPLE_CLEAN of them, which
    bounds all that is broadcast and all that the driver sees. A key labelled twice counts as toxic if once so."""
    lexicon, grammar, classes = np.zeros(0, U), *grammar_words()
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Without both labels the grammar scores by itself: a lone insult is no proof, one aimed at someone is.
    blank = np.append(PRIOR, -2.5)
    model = Model(lexicon, table_of(lexicon), grammar, classes, blank)
    if not sizes.get(0) or not sizes.get(1):
        return model
    share = F.when(F.col("y") == 1, SAMPLE_TOXIC / sizes[1]).otherwise(SAMPLE_CLEAN / sizes[0])
    drawn = known.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(drawn), "k").select("y", "text").dropDuplicates(["text"])
    rows = rows.persist()
    try:
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        bad = counted(rows.filter("y = 1")).filter("n >= 3").orderBy(F.desc("n"), "feature").limit(CANDIDATES).toPandas()
        good = counted(rows.filter("y = 0")).join(F.broadcast(docs.sparkSession.createDataFrame(bad[["feature"]], "feature long")), "feature").toPandas() if len(bad) else bad
        seen = bad.merge(good, on="feature", how="left", suffixes=("1", "0")).fillna({"n0": 0}) if len(bad) else pd.DataFrame({"feature": [], "n1": [], "n0": []})
        a, b, na, nb = seen["n1"].to_numpy(float), seen["n0"].to_numpy(float), n.get(1, 0), n.get(0, 0)
        whole = (a + b) / max(na + nb, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (a * np.log(a / (na * whole)) + np.where(b > 0, b * np.log(b / (nb * whole)), 0))
        learned = (a / max(na, 1) >= RATIO * (b + 0.5) / (nb + 1)) & (g >= SURPRISE + 2 * np.log(max(len(a), 2)))
        best = seen[learned].assign(g=g[learned]).sort_values(["g", "feature"], ascending=[False, True]).head(LEXICON)
        model.lexicon = np.sort(best["feature"].to_numpy(np.int64).view(U))
        model.coarse = table_of(model.lexicon)
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, t in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([f.tobytes() for f in features(sent.value, t)], pa.binary())], ["y", "x"])

        made = rows.mapInArrow(run, "y int, x binary").toPandas()
        if made["y"].nunique() == 2:
            x = np.frombuffer(b"".join(made["x"]), float).reshape(-1, FEATURES)
            y = made["y"].to_numpy(float)
            model.weights = logistic(x, y)
            # The samples' odds give way to those of all labels, so the size of a table moves no prediction.
            model.weights[-1] += np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (1 - y).sum())
    finally:
        rows.unpersist()
    return model


def toxicity(df: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted", keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and prediction to the rows of ``df``, of which ``keep`` (all) columns stay. No shuffle.

    Null and empty texts score as texts without a match; equal texts, and so repeated rows, score alike; a score of
    just 0.5 is predicted toxic; whole texts are read, however long; an empty table stays empty. Columns named like
    the new ones are replaced.
    """
    kept = [n for n in (df.columns if keep is None else keep) if n not in (score, predicted)]
    hidden = text if text in kept else fresh(kept + [score, predicted], "text_read")[0]
    read_too = df.select(*kept) if hidden in kept else df.select(*kept, F.col(text).alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, hidden):
            m = sent.value
            p = 1 / (1 + np.exp(-np.clip(features(m, t) @ m.weights[:-1] + m.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, score, predicted])

    return read_too.mapInArrow(run, f"{schema}`{score}` double, `{predicted}` int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.select("doc_id", "text"), labels.filter(fold("doc_id", 5) != 0))
    return toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
