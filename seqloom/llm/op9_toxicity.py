"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

A text is lower-cased and read as sentences (ended by a line break, or by ".", "!" or
"?" before white space). Anything but letters, digits and white space is left out, a
run of white space is one blank, and three or more single letters in a row are one word
("i d i o t"). A sentence's instances are its windows: each word, and each two
neighbouring words with the blank between them, with the blanks around. The kernel of
two windows sums, over subsequences of two and three characters (blanks too) within a
span of five, decay**span products, each window scaled to length one; a gap or an
inserted character lowers the kernel and doesn't break it.

It is trained on labelled sentences: a sentence has the label of its text, where a
toxic text is one with a toxic sentence somewhere. So a toxic sentence is stood for by
its worst window, its witness, and a clean sentence by all of its windows. The first
witnesses are the windows with the strongest evidence in counts of texts (the lower
bound of their log odds; a window of clean texts can be one); then the machine chooses,
round by round, each toxic sentence's worst window as its witness, and the worst
windows of clean texts join the examples. Landmarks are drawn from both classes.

The machine is linear over Nyström features of the landmarks; as its value is linear
in a window's subsequence weights, it is kept as one weight a subsequence. Running
sums of these over a text give the value of every window at a few look-ups each. A text
is as toxic as its worst window; scores are calibrated on the training texts.

Training uses a bounded sample. Its bounds are parameters of ``fit``: ``max_documents``
labelled documents (by hash of the id, one text an id), ``max_windows`` distinct
windows of them as examples, ``negatives`` clean ones to begin with, and ``per_text``
windows a text and round. They don't depend on the size of the tables.

Defined results: null and empty texts, and texts without a letter or digit, score
0.0. Labels that are null, or ids without a document, take no part; with no toxic or no
clean training text, or no window that stands in ``support`` toxic texts, every score
is 0.0. Rows are scored one by one, so ties, repeated rows, empty tables and further
columns change nothing. Long words are read in overlapping windows, and long texts in
overlapping pieces, whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, map_batches, table, texts_of

SPAN = 5
DECAY = 0.6
#: Letters of a word read at once.
WIDTH = 20
SYMBOLS = 64
BLANK = 28
#: Symbols of the longest window: two words and three blanks.
LONGEST = 2 * WIDTH + 3
#: Characters read at once, and by how many the pieces of a longer text overlap.
PIECE, OVERLAP = 1 << 20, 256


def _symbol(code: int) -> int:
    """1 to 26 a letter, 27 a digit, 29 and more another letter, BLANK white space, 0 anything else."""
    c = chr(code)
    if "a" <= c <= "z":
        return code - 96
    if c.isspace():
        return BLANK
    if c.isdigit():
        return 27
    return 29 + code % 35 if c.isalnum() else 0


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([_symbol(i) for i in range(1 << 16)], np.uint8))
    return _TABLE[0]


def _stream(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, positions of blanks, whether each ends a sentence, piece of the word after each) of lower-cased pieces.

    The symbols begin and end with a blank and no two blanks are neighbours; a piece is a sentence's end.
    """
    joined = "\n" + "\n".join(pieces) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = np.where(code < 1 << 16, _table()[np.minimum(code, (1 << 16) - 1)], (29 + code % 35).astype(np.uint8))
    white = symbol == BLANK
    stops = (code == 46) | (code == 33) | (code == 63)
    ends = white & ((code == 10) | np.r_[False, stops[:-1]])
    owner = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])  # of the line break before a piece, and of the piece
    owner = np.r_[owner, len(pieces)]
    kept = np.flatnonzero(symbol)
    symbol, white, ends, owner = symbol[kept], white[kept], ends[kept], owner[kept]
    run = white & np.r_[True, ~white[:-1]]  # the first of each run of white space
    at = np.flatnonzero(white)
    run_ends = np.logical_or.reduceat(ends[at], np.flatnonzero(run[at]))
    last = white & np.r_[~white[1:], True]
    keep = ~white | last
    symbol, owner = symbol[keep], owner[keep]
    blanks = np.flatnonzero(symbol == BLANK)
    return symbol, blanks, run_ends, owner[np.minimum(blanks + 1, len(owner) - 1)]


def _spaced(symbol: np.ndarray, blanks: np.ndarray, ends: np.ndarray, owner: np.ndarray):
    """Takes out the blanks within runs of three or more single letters."""
    single = np.diff(blanks) == 2
    single &= symbol[np.minimum(blanks[:-1] + 1, len(symbol) - 1)] != 27
    if not single.any():
        return symbol, blanks, ends, owner
    joins = single[1:] & single[:-1] & (owner[1:-1] == owner[:-2])  # of words j and j + 1, at blank j + 1
    edge = np.flatnonzero(np.diff(np.r_[False, joins, False]))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a < 2:
            joins[a:b] = False
    gone = np.flatnonzero(joins) + 1
    if not len(gone):
        return symbol, blanks, ends, owner
    keep = np.ones(len(symbol), bool)
    keep[blanks[gone]] = False
    left = np.ones(len(blanks), bool)
    left[gone] = False
    return symbol[keep], np.flatnonzero(symbol[keep] == BLANK), ends[left], owner[left]


@dataclass
class Windows:
    """Windows of some texts: ``symbols[start:stop]``, and the text and sentence of each."""

    symbols: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    sentence: np.ndarray


def windows_of(texts: list[str]) -> Windows:
    """All windows of short texts; of longer ones see ``pieces_of``."""
    symbol, blanks, ends, owner = _spaced(*_stream([t.lower() for t in texts]))
    if len(blanks) < 2:
        none = np.zeros(0, np.int64)
        return Windows(symbol, none, none, none, none)
    first, after = blanks[:-1], blanks[1:]
    sentence = np.cumsum(ends[:-1])
    word = np.arange(len(first))
    length = after - first - 1
    short = length <= WIDTH
    starts, stops, of = [first[short]], [after[short] + 1], [word[short]]
    both = np.flatnonzero(short[:-1] & short[1:] & ~ends[1:-1])
    starts.append(first[both]), stops.append(after[both + 1] + 1), of.append(both)
    for j in np.flatnonzero(~short).tolist():
        at = np.arange(first[j] + 1, after[j] - WIDTH // 2, WIDTH // 2)
        starts.append(at), stops.append(np.minimum(at + WIDTH, after[j])), of.append(np.full(len(at), j))
    of = np.concatenate(of)
    return Windows(symbol, np.concatenate(starts), np.concatenate(stops), owner[of], sentence[of])


def pieces_of(texts: list[str]) -> tuple[list[list[str]], list[list[int]]]:
    """Texts, and overlapping pieces of long ones, in groups of about PIECE characters; and which text each is of."""
    groups, owners, size = [[]], [[]], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = min(len(text), at + PIECE)
            if end < len(text):
                end = max(text.rfind(" ", at + PIECE // 2, end), text.rfind("\n", at + PIECE // 2, end)) + 1 or end
            if size + end - at > PIECE and groups[-1]:
                groups.append([]), owners.append([])
                size = 0
            groups[-1].append(text[at:end]), owners[-1].append(i)
            size += end - at
            if end == len(text):
                break
            back = max(text.rfind(" ", end - OVERLAP, end - OVERLAP // 2), text.rfind("\n", end - OVERLAP, end - OVERLAP // 2))
            at = back if back > at else end - OVERLAP
    return groups, owners


_GAPS = [(d, None) for d in range(1, SPAN)] + [(d, e) for d in range(1, SPAN - 1) for e in range(d + 1, SPAN)]
CODES = SYMBOLS**2 + SYMBOLS**3
#: The length of a window's weights, by its number of symbols.
LENGTHS = np.sqrt(np.maximum([sum(DECAY ** (2 * ((e or d) + 1)) * max(0, n - (e or d)) for d, e in _GAPS) for n in range(LONGEST + 1)], 1e-12))


def subsequences(s: np.ndarray):
    """(span less one, codes, weight) for each gap pattern of symbols along the last axis; codes of pairs and triples don't clash."""
    s = s.astype(np.int32)
    n = s.shape[-1]
    for d, e in _GAPS:
        far = e or d
        if n <= far:
            continue
        first, second = s[..., : n - far], s[..., d : n - far + d]
        if e is None:
            yield far, first * SYMBOLS + second, DECAY ** (far + 1)
        else:
            yield far, SYMBOLS * SYMBOLS + (first * SYMBOLS + second) * SYMBOLS + s[..., e:], DECAY ** (far + 1)


def values(weights: np.ndarray, windows: Windows) -> np.ndarray:
    """Each window's sum of weighted subsequences over its length, from running sums along the text."""
    n = len(windows.symbols)
    out = np.zeros(len(windows.start))
    sums = np.zeros((SPAN, n + 1))
    for far, codes, w in subsequences(windows.symbols):
        sums[far, 1 : n - far + 1] += w * weights[codes]
    for far in range(1, SPAN):
        np.cumsum(sums[far], out=sums[far])
        out += sums[far][np.maximum(windows.stop - far, windows.start)] - sums[far][windows.start]
    return out / LENGTHS[windows.stop - windows.start]


def matrix(strings: list[bytes]) -> np.ndarray:
    """A row of symbols a window, zeros after it."""
    out = np.zeros((len(strings), LONGEST), np.uint8)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out


def _parts(s: np.ndarray):
    for far, codes, w in subsequences(s):
        yield codes, w * (s[:, far:] > 0)


def dense(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each row over the codes that occur, these codes)."""
    parts = list(_parts(s))
    codes, weight = np.concatenate([c for c, _ in parts], 1), np.concatenate([w for _, w in parts], 1)
    used, place = np.unique(codes[weight > 0], return_inverse=True)
    out = np.zeros((len(s), len(used)))
    np.add.at(out, (np.nonzero(weight > 0)[0], place), weight[weight > 0])
    return out / LENGTHS[(s > 0).sum(1)][:, None], used


def kernel_rows(s: np.ndarray, landmarks: np.ndarray, used: np.ndarray, block: int = 4096) -> np.ndarray:
    """k(window, landmark) of each window and landmark."""
    place = np.full(CODES, len(used))
    place[used] = np.arange(len(used))
    features = np.vstack([landmarks.T, np.zeros(len(landmarks))])
    out = np.zeros((len(s), len(landmarks)))
    for at in range(0, len(s), block):
        part = s[at : at + block]
        part = part[:, : max(SPAN, int((part > 0).sum(1).max()))]
        for codes, weight in _parts(part):
            where = np.where(weight > 0, place[codes], len(used))
            for column in range(where.shape[1]):
                out[at : at + block] += weight.max() * features[where[:, column]]
        out[at : at + block] /= LENGTHS[(part > 0).sum(1)][:, None]
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear squared-hinge machine by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], cost * weight[active]
        new = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), xa.T @ (ca * ya))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def values_of(strings: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The value of each of many windows."""
    ends = np.cumsum([len(x) for x in strings])
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    return values(weights, Windows(np.frombuffer(b"".join(strings), np.uint8), starts, ends, starts, starts))


def train_windows(positive: dict[bytes, float], pool: list[bytes], chosen: list[bytes], landmarks: int, rounds: int, hardest: int, cost: float, most: float) -> tuple[np.ndarray, float, list[bytes]]:
    """Weights a subsequence, the bias and the clean windows trained on, from witnesses (with the texts each stands for) and windows of clean texts.

    Each round trains on the witnesses and the clean windows chosen so far, then adds the ``hardest`` of
    the pool with the largest values; half of the next round's landmarks come from these.
    """
    names = sorted(positive, key=lambda x: (-positive[x], x))
    hard = chosen
    sp = matrix(names)
    for k in range(rounds):
        sn = matrix(chosen)
        features, used = dense(matrix(names[: landmarks // 2] + hard[: landmarks // 2]))
        spectrum, vectors = np.linalg.eigh(features @ features.T)
        keep = spectrum > 1e-6 * spectrum.max()
        root = vectors[:, keep] / np.sqrt(spectrum[keep])
        x = np.vstack([kernel_rows(sp, features, used), kernel_rows(sn, features, used)]) @ root
        y = np.r_[np.ones(len(sp)), -np.ones(len(sn))]
        weight = np.r_[[min(positive[u], most) for u in names], np.ones(len(sn))]
        w, bias = svm(x, y, weight, cost)
        weights = np.zeros(CODES)
        weights[used] = (root @ w) @ features
        if k < rounds - 1:
            hard = [pool[i] for i in np.argsort(-values_of(pool, weights), kind="stable")[:hardest]]
            chosen = list(dict.fromkeys(chosen + hard))
    return weights, bias, chosen


@dataclass
class Model:
    """f(window) = its value under the weights + bias; score = sigmoid(slope * (worst f) + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


#: The value of a text without a window.
FLOOR = -1e9


def worst_values(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Each text's largest window value."""
    out = np.full(len(texts), FLOOR)
    for group, owner in zip(*pieces_of(texts), strict=True):
        found = windows_of(group)
        if len(found.start):
            np.maximum.at(out, np.asarray(owner)[found.text], values(weights, found) + bias)
    return out


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, carried columns, worst double)``: each text's largest window value."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # CODES numbers, whatever the data
    names = [id_column, *carry]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            worst = worst_values(texts_of(batch.column(len(names))), *shared.value)
            return pa.RecordBatch.from_pydict({**{c: batch.column(i) for i, c in enumerate(names)}, "worst": pa.array(worst, pa.float64())})

        return run

    plain = docs.select(*names, F.col(text_column).cast("string").alias("_text"))
    return map_batches(plain, make, plain.drop("_text").schema.add("worst", "double"), rows=256)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def _of_texts(taken: DataFrame, choose, schema: str) -> DataFrame:
    """``choose(windows, labels of the texts)`` gives, for a group of texts, columns by the schema's names."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, labels = texts_of(batch.column(0)), np.array(batch.column(1).to_pylist())
            columns: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for group, owner in zip(*pieces_of(texts), strict=True):
                found = windows_of(group)
                if len(found.start):
                    for name, got in choose(found, labels[np.asarray(owner)]).items():
                        columns[name] += got
            return pa.RecordBatch.from_pydict(columns, schema=pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int32() if c.endswith("int") else pa.float64()) for c in schema.split(", ")]))

        return run

    return map_batches(taken.select("text", "toxic"), make, schema, rows=64)


def _strings(found: Windows, which) -> list[bytes]:
    raw = found.symbols.tobytes()
    return [raw[a:b] for a, b in zip(found.start[which].tolist(), found.stop[which].tolist(), strict=True)]


def _worst_sentences(value: np.ndarray, found: Windows, most: int) -> np.ndarray:
    """Positions of the worst windows of each text's worst sentences, one a sentence and ``most`` a text."""
    order = np.lexsort((-value, found.sentence))
    best = order[np.r_[True, np.diff(found.sentence[order]) != 0]]
    order = best[np.lexsort((-value[best], found.text[best]))]
    place = np.arange(len(order)) - np.searchsorted(found.text[order], found.text[order])
    return order[place < most]


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 8192, max_windows: int = 60_000, negatives: int = 3000, hardest: int = 1500, per_text: int = 3, support: int = 2, evidence: float = 1.0, clean_share: float = 0.995, landmarks: int = 256, rounds: int = 4, turns: int = 2, cost: float = 30.0, most: float = 50.0) -> Model | None:
    """Train on labelled rows that aren't held out; None if one of the classes is missing.

    ``support``: toxic texts a window must be the witness of to be one at first; ``evidence``: the lower
    bound of its log odds; ``most``: the texts a witness counts for at most. ``turns`` are the times that
    all texts are read anew for witnesses and clean windows, each with ``rounds`` of training; a witness
    must be worse than the worst windows of a share ``clean_share`` of the clean texts.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")  # max_documents rows at most
    taken = checkpoint(taken.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    n = {r.toxic: r["count"] for r in taken.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None

    def distinct(found: Windows, toxic: np.ndarray) -> dict[str, list]:
        seen: dict[bytes, set] = {}
        for x, t in zip(_strings(found, slice(None)), found.text.tolist(), strict=True):
            seen.setdefault(x, set()).add(t)
        return {"window": list(seen), "p": [int(toxic[list(ts)].sum()) for ts in seen.values()], "n": [int((1 - toxic[list(ts)]).sum()) for ts in seen.values()]}

    counted = checkpoint(_of_texts(taken, distinct, "window binary, p int, n int").groupBy("window").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    odds = F.log((F.col("p") + 0.5) / (n[1] + 1)) - F.log((F.col("n") + 0.5) / (n[0] + 1)) - 1.64 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    strong = counted.withColumn("odds", odds).filter((F.col("p") >= support) & (F.col("odds") > evidence)).orderBy(F.col("odds").desc(), "window").limit(max_windows // 4)
    known = {bytes(r.window): r.odds for r in strong.collect()}
    pool = [bytes(r.window) for r in counted.filter("n > 0").orderBy(F.col("n").desc(), F.xxhash64("window"), "window").limit(max_windows).select("window").collect()]
    by_hash = np.random.default_rng(5).permutation(len(pool))[:negatives]
    chosen = [pool[i] for i in by_hash.tolist()]

    def first(found: Windows, toxic: np.ndarray) -> dict[str, list]:
        value = np.array([known.get(x, -np.inf) for x in _strings(found, slice(None))])
        best = _worst_sentences(value, found, per_text)
        return {"window": _strings(found, best[np.isfinite(value[best])])}

    toxic = taken.filter("toxic = 1")
    witnesses = Counter(bytes(r.window) for r in _of_texts(toxic, first, "window binary").collect())
    positive = {x: float(c) for x, c in witnesses.items() if c >= support}
    if not positive or not pool:
        return None
    for turn in range(turns):
        weights, bias, chosen = train_windows(positive, pool, chosen, landmarks, rounds, hardest, cost, most)
        if turn == turns - 1:
            break

        def worst(found: Windows, toxic: np.ndarray, weights=weights, bias=bias) -> dict[str, list]:
            value = values(weights, found) + bias
            order = _worst_sentences(value, found, per_text)
            return {"window": _strings(found, order), "value": value[order].tolist(), "toxic": toxic[found.text[order]].tolist()}

        rows = _of_texts(taken, worst, "window binary, value double, toxic int").collect()  # per_text a text
        clean = sorted({(-r.value, bytes(r.window)) for r in rows if not r.toxic})
        least = max(0.0, float(np.quantile([-v for v, _ in clean], clean_share)))
        seen = Counter(bytes(r.window) for r in rows if r.toxic and r.value > least)
        positive = {**{x: float(c) for x, c in seen.items()}, **positive}
        pool = list(dict.fromkeys([x for _, x in clean] + pool))[:max_windows]
    points = score_texts(taken, weights, bias, carry=("toxic",)).select("worst", "toxic").collect()
    return calibrate(weights, bias, np.array([r.worst for r in points]), np.array([r.toxic for r in points]))


def calibrate(weights: np.ndarray, bias: float, worst: np.ndarray, toxic: np.ndarray) -> Model | None:
    """Put 0.5 in the middle of the best gap between the classes' worst units; the slope spreads the scores."""
    if not len(worst) or toxic.min() == toxic.max():
        return None
    order = np.argsort(worst, kind="stable")
    v, y = np.maximum(worst[order], -20), toxic[order]
    missed = np.r_[0, np.cumsum(y)]
    raised = (y == 0).sum() - np.r_[0, np.cumsum(1 - y)]
    costs = missed + 2 * raised
    best = np.flatnonzero(costs == costs.min())
    edges = np.r_[v[0] - 1, v, v[-1] + 1]
    width = edges[best + 1] - edges[best]
    k = best[np.argmax(width)]
    cut = (edges[k] + edges[k + 1]) / 2
    slope = 4 / max(np.std(v), 1e-3)
    return Model(weights, bias, float(slope), float(-slope * cut))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score double)`` for every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    worst = F.col("worst")
    logit = F.lit(model.slope) * worst + F.lit(model.offset)
    value = F.when(worst <= -1e8, F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(40.0)), F.lit(-40.0)))))
    return score_texts(docs, model.weights, model.bias).select("doc_id", value.alias("score"))


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with a score below one half, all columns, in one pass over them."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    at, cut = docs.columns.index("text"), -model.offset / model.slope

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(worst_values(texts_of(batch.column(at)), *shared.value) < cut))

        return run

    return map_batches(docs, make, docs.schema, rows=256)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
