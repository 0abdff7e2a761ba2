"""Language identification by a linear-chain conditional random field.

Words are labelled with languages, so that code-switched text keeps its parts
apart.  A word's features are hashed affixes, character n-grams and the word
itself (a lexicon); transitions between the labels of neighbouring words are
learned too.  Forward-backward gives every word's distribution over languages;
a text's prediction is the language with the most expected words.

Training texts carry one language each.  To learn how languages change, training
sequences are spliced from stretches of different texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import spans
from ledgerloom.llm.spans import U

#: Labelled texts that are learned from at most, and bytes of them (both are bounds on a
#: sample); every language has a share of them, so only languages past so many texts go unlearned.
SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 4 << 20
#: Numbers of an array of words by languages, about; texts are worked on in pieces of that.
WORK = 1 << 21
#: Bytes of texts that are read at a time to learn from them.
READ = 1 << 18
#: Hashed features; a power of two.
WIDTH = 1 << 16
#: Length of a training sequence, and the mean stretch of one language in it.
SEQUENCE, STRETCH = 64, 16
UNKNOWN = "und"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SALTS = tuple(U(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(8))


@dataclass
class Model:
    """Learned languages, feature weights (WIDTH x languages) and transitions."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray  # exp of the transition weights, from row to column
    starts: np.ndarray  # exp of the weights of a first label


def _slots(key: np.ndarray, kind: int) -> np.ndarray:
    return (spans.mixed(key + _SALTS[kind]) >> U(48)).astype(np.int64) & (WIDTH - 1)


def word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words of a byte array.

    Returns six features a word (prefixes and suffixes of two and four bytes,
    the word, its length class), then the n-grams of three bytes of all words
    in a row with the offsets of each word's.
    """
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[8 : n + 8] = data
    size = end - begin
    wide = np.zeros(n + 16, U)
    for s in range(8):
        part = wide[s : n + 9 : 8]
        part[:] = np.frombuffer(padded, U, len(part), s)
    after, before = wide[begin + 8], wide[end]  # eight bytes from a word's first on, and up to its last
    mask = lambda k: U((1 << 8 * k) - 1)
    held = np.minimum(size, 8).astype(U)
    inside = np.where(held < 8, (U(1) << (held * U(8) % U(64))) - U(1), ~U(0))
    head = after & inside
    tail = np.where(held < 8, before >> ((U(8) - held) * U(8) % U(64)), before)
    top = lambda k: np.where(size >= k, before >> U(64 - 8 * k), tail)
    # The lexicon's key: first and last eight bytes and the length.
    whole = spans.joined(head, tail + size.astype(U))
    fixed = np.stack(
        [
            _slots(head & mask(2), 0), _slots(head & mask(4), 1), _slots(top(2), 2), _slots(top(4), 3), _slots(whole, 4),
            _slots(np.minimum(size, 12).astype(U), 5),
        ],
        axis=1,
    )
    count = np.maximum(size - 2, 1)
    upto = np.concatenate([[0], np.cumsum(count)])
    where = np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])
    grams = wide[where + 8] & mask(3)
    short = np.repeat(size < 3, count)
    if short.any():
        grams[short] = np.repeat(head, count)[short] | U(1 << 40)
    return fixed, _slots(grams, 6), upto


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter by its Unicode category."""
    out = np.zeros(1 << 21, bool)
    out[:0x110000] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return out


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word with a letter, and each text's offsets in them."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    begin = np.flatnonzero(word & (cut[:-1] | ~np.concatenate([[False], word[:-1]])))
    end = np.flatnonzero(word & (cut[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    for low in range(0, len(data), 1 << 18):  # bounds the memory
        lead = low + np.flatnonzero(data[low : low + (1 << 18)] >= 0xC2)
        a, b, c, d = (data.take(lead + i, mode="clip").astype(np.int32) & (0x3F if i else 0xFF) for i in range(4))
        two, three, four = (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d
        letter[lead] = _letters()[np.where(a < 0xE0, two, np.where(a < 0xF0, three, four))]
    seen = np.concatenate([[0], np.cumsum(letter)])
    has = seen[end] > seen[begin]
    begin, end = begin[has], end[has]
    return begin, end, np.searchsorted(begin, bounds)


def _lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)


def _scores(weights: np.ndarray, fixed: np.ndarray, grams: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Emission score of every word: its features' weights, n-grams averaged."""
    out = weights[fixed[:, 0]].copy()
    for k in range(1, fixed.shape[1]):
        out += weights[fixed[:, k]]
    if len(upto) > 1:
        out += np.add.reduceat(weights[grams], upto[:-1], axis=0) / np.diff(upto)[:, None]
    return out


def posteriors(model: Model, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Forward-backward: every word's distribution over the languages.

    All texts advance together, a word at a time, the longest first, so a step
    works on as many rows as texts are that long.
    """
    n, k = scores.shape
    if not n:
        return scores
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    first, size = offsets[:-1][order], size[order]
    longest = int(size[0])
    # Texts longer than t are the first alive[t].
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    ahead = np.empty((n, k))
    now = emit[first[: alive[0]]] * model.starts
    now /= now.sum(axis=1, keepdims=True)
    ahead[first[: alive[0]]] = now
    for t in range(1, longest):
        at = first[: alive[t]] + t
        now = (now[: alive[t]] @ model.moves) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    back = np.ones((alive[0], k))
    for t in range(longest - 2, -1, -1):
        m = alive[t + 1]
        at = first[:m] + t
        back[:m] = (back[:m] * emit[at + 1]) @ model.moves.T
        back[:m] /= back[:m].sum(axis=1, keepdims=True)
        ahead[at] *= back[:m]
        # A text that ends at t starts its way back with ones, as set above.
    return ahead / ahead.sum(axis=1, keepdims=True)


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words of the texts as by :func:`word_features`, in few bytes each, and each text's number of words.

    Some texts at a time, which bounds the driver's memory.
    """
    few = np.min_scalar_type(WIDTH - 1)
    fixed, grams, counts, words = [np.empty((0, 6), few)], [np.empty(0, few)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    low = 0
    while low < len(texts):
        raw: list[bytes] = []
        size = 0
        while low < len(texts) and size < READ:
            raw.append(texts[low].encode("utf-8", "replace"))
            size += len(raw[-1])
            low += 1
        data = _lowered(np.frombuffer(b"".join(raw), np.uint8))
        begin, end, offsets = words_of(data, np.cumsum([0, *map(len, raw)]))
        words.append(np.diff(offsets))
        for at in range(0, len(begin), 1 << 15):
            part = slice(at, at + (1 << 15))
            one, gram, upto = word_features(*_window(data, begin[part], end[part]))
            fixed.append(one.astype(few))
            grams.append(gram.astype(few))
            counts.append(np.diff(upto))
    return np.concatenate(fixed), np.concatenate(grams), np.cumsum(np.concatenate([[0], *counts])), np.concatenate(words)


def fit(texts: list[str], languages: list[str], rounds: int = 6, seed: int = 7) -> Model:
    """Learn a model from texts with one language each, by adaptive gradient steps."""
    names = sorted(set(languages))
    k = len(names)
    model = Model(names, np.zeros((WIDTH, max(k, 1))), np.ones((k, k)), np.ones(k))
    if k < 2:
        return model
    number = {name: i for i, name in enumerate(names)}
    fixed, grams, upto, words = _read(texts)
    label = np.repeat([number[x] for x in languages], words)
    # Stretches of words, put in random order and cut into sequences.
    rng = np.random.default_rng(seed)
    log_moves, log_starts = np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(model.weights, 1e-3), np.full((k, k), 1e-3), np.full(k, 1e-3)]
    share = 1 / np.bincount(label, minlength=k).clip(1)
    n_seq = max(1, min(len(label), 400_000) // SEQUENCE)
    batch = 128
    for _ in range(rounds):
        for lo in range(0, n_seq, batch):
            m = min(batch, n_seq - lo)
            at = np.empty((m, SEQUENCE), np.int64)
            for row in at:  # each language is as likely, however much text it has
                t = 0
                while t < SEQUENCE:
                    run = min(int(rng.geometric(1 / STRETCH)) + 2, SEQUENCE - t)
                    start = _pick(rng, label, share, k)
                    stop = min(start + run, len(label))
                    same = label[start:stop] == label[start]
                    run = int(same.argmin()) if not same.all() else stop - start
                    row[t : t + run] = np.arange(start, start + run)
                    t += run
            _step(model, at, label, fixed, grams, upto, log_moves, log_starts, sums)
    return model


def _pick(rng: np.random.Generator, label: np.ndarray, share: np.ndarray, k: int) -> int:
    """A random word of a random language; words of a language stand in runs."""
    while True:
        i = int(rng.integers(len(label)))
        if rng.random() < share[label[i]] / share.max():
            return i


def _step(model: Model, at: np.ndarray, label: np.ndarray, fixed: np.ndarray, grams: np.ndarray, upto: np.ndarray, log_moves: np.ndarray, log_starts: np.ndarray, sums: list[np.ndarray], rate: float = 0.2) -> None:
    """One gradient step on the sequences of words ``at``."""
    slopes = gradient(model, at, label, fixed, grams, upto)
    for value, g, total in zip((model.weights, log_moves, log_starts), slopes, sums):
        total += g * g
        value += rate * g / np.sqrt(total)
    model.moves, model.starts = np.exp(log_moves), np.exp(log_starts)


def gradient(model: Model, at: np.ndarray, label: np.ndarray, fixed: np.ndarray, grams: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope of the sequences' mean log-likelihood in the weights, the moves' and the starts' weights."""
    m, length = at.shape
    k = len(model.languages)
    flat = at.ravel()
    count = upto[flat + 1] - upto[flat]
    near = np.concatenate([[0], np.cumsum(count)])
    gram = grams[np.repeat(upto[flat] - near[:-1], count) + np.arange(near[-1])]
    scores = _scores(model.weights, fixed[flat], gram, near)
    want = np.zeros((len(flat), k))
    want[np.arange(len(flat)), label[flat]] = 1
    # Expected labels and moves.
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(m, length, k)
    fore, back = np.empty_like(emit), np.ones_like(emit)
    fore[:, 0] = emit[:, 0] * model.starts
    fore[:, 0] /= fore[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        fore[:, t] = (fore[:, t - 1] @ model.moves) * emit[:, t]
        fore[:, t] /= fore[:, t].sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        back[:, t] = (back[:, t + 1] * emit[:, t + 1]) @ model.moves.T
        back[:, t] /= back[:, t].sum(axis=1, keepdims=True)
    post = fore * back
    post /= post.sum(axis=2, keepdims=True)
    pair = np.einsum("nti,ij,ntj->ntij", fore[:, :-1], model.moves, emit[:, 1:] * back[:, 1:])
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    gold = want.reshape(m, length, k)
    error = (want - post.reshape(-1, k)) / m
    slope = np.zeros_like(model.weights)
    for c in range(k):
        column = np.bincount(fixed[flat].ravel(), np.repeat(error[:, c], fixed.shape[1]), WIDTH)
        slope[:, c] = column + np.bincount(gram, np.repeat(error[:, c] / count, count), WIDTH)
    moved = (np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:]) - pair.sum(axis=(0, 1))) / m
    began = (gold[:, 0] - post[:, 0]).sum(axis=0) / m
    return slope, moved, began


def _chain(model: Model, scores: np.ndarray, ahead: np.ndarray | None, behind: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """A stretch of one text: where forward leaves it, and, given ``behind``, expected words and where backward leaves it.

    ``ahead`` is the distribution at the word before (None at the text's
    beginning), ``behind`` the backward vector of the stretch's last word.
    """
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    fore = np.empty_like(emit)
    now = model.starts if ahead is None else ahead @ model.moves
    for t in range(len(emit)):
        now = (now if t == 0 else now @ model.moves) * emit[t]
        now = now / now.sum()
        fore[t] = now
    if behind is None:
        return now, None, None
    total = np.zeros(len(model.languages))
    for t in range(len(emit) - 1, -1, -1):
        both = fore[t] * behind
        total += both / both.sum()
        behind = (behind * emit[t]) @ model.moves.T
        behind = behind / behind.sum()
    return now, total, behind


def _long_text(model: Model, data: np.ndarray, piece: int) -> tuple[np.ndarray, int]:
    """Expected words of each language in a text, and its words, in pieces of about ``piece`` bytes.

    Forward goes through all pieces and keeps its vector between them; backward
    comes back and works each piece out again.
    """
    cuts = [0]
    while cuts[-1] < len(data):
        at = min(cuts[-1] + piece, len(data))
        while at < len(data):  # on to the end of a word
            gap = np.flatnonzero(_SPACE[data[at : at + piece]])
            at += int(gap[0]) if len(gap) else min(piece, len(data) - at)
            if len(gap):
                break
        cuts.append(at)

    def scores(i: int) -> np.ndarray:
        part = _lowered(data[cuts[i] : cuts[i + 1]])
        begin, end, _ = words_of(part, np.array([0, len(part)]))
        return _word_scores(model, part, begin, end)

    ahead: list[np.ndarray | None] = [None]
    total, n = np.zeros(len(model.languages)), 0
    for i in range(len(cuts) - 1):
        found = scores(i)
        n += len(found)
        ahead.append(_chain(model, found, ahead[-1], None)[0] if len(found) else ahead[-1])
    behind = np.ones(len(model.languages))
    for i in range(len(cuts) - 2, -1, -1):
        found = scores(i)
        if len(found):
            _, expected, behind = _chain(model, found, ahead[i], behind)
            total += expected
    return total, n


def _word_scores(model: Model, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    scores = np.empty((len(begin), len(model.languages)))
    for lo in range(0, len(begin), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        scores[part] = _scores(model.weights, *word_features(*_window(data, begin[part], end[part])))
    return scores


def predict_texts(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and share of expected words for every text of an Arrow column."""
    from ledgerloom.llm.tokens import text_bytes

    data, bounds = text_bytes(column)
    n, k = len(column), len(model.languages)
    names, share = [UNKNOWN] * n, np.zeros(n)
    piece = max(WORK // max(k, 1), 1 << 12)
    low = 0
    while low < n and k:
        high = int(np.searchsorted(bounds, bounds[low] + 2 * piece, side="right")) - 1
        if high <= low:  # a text that is longer by itself
            high = low + 1
            total, size = _long_text(model, data[bounds[low] : bounds[high]], piece)
            total, size = total[None], np.array([size])
        else:
            part = _lowered(data[bounds[low] : bounds[high]])
            begin, end, offsets = words_of(part, bounds[low : high + 1] - bounds[low])
            post = posteriors(model, _word_scores(model, part, begin, end), offsets)
            upto = np.concatenate([np.zeros((1, k)), np.cumsum(post, axis=0)])
            total, size = upto[offsets[1:]] - upto[offsets[:-1]], np.diff(offsets)
        for i in np.flatnonzero(size):
            best = int(total[i].argmax())
            names[low + i], share[low + i] = model.languages[best], min(1.0, total[i, best] / size[i])
        low = high
    return names, share


def _window(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretch of ``data`` that some words take."""
    if not len(begin):
        return data[:0], begin, end
    low = begin[0]
    return data[low : end[-1]], begin - low, end - low


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """Labelled texts outside the held-out third, at most the documented bounds.

    Which texts is settled by a hash of the id, evenly over the languages; a
    text that exceeds the bound on bytes is left out whole.
    """
    ids = F.crc32(F.col(id_col).cast("string").cast("binary"))
    fit_rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.coalesce(ids % 3, F.lit(1)) != 1))
    by = fit_rows.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("h"))
    small = by.where(F.octet_length("t") <= SAMPLE_BYTES // 64)
    counts = small.groupBy("l").count().orderBy(F.desc("count"), "l").limit(SAMPLE_TEXTS).collect()
    if not counts:
        return [], []
    each = max(1, SAMPLE_TEXTS // len(counts))
    # The hashes below a cut are a few more than wanted; the surplus goes here.
    cuts = [(r[0], min((1 << 63) - 1, int((1.2 * each + 10) / r[1] * 2**63))) for r in counts]
    chosen = small.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "l string, cut bigint")), "l")
    rows = chosen.where(F.col("h").bitwiseAND((1 << 63) - 1) <= F.col("cut")).select("l", "h", "t").collect()
    texts, names, held, taken = [], [], dict.fromkeys((r[0] for r in counts), 0), dict.fromkeys((r[0] for r in counts), 0)
    for name, _, text in sorted(rows):
        size = len(text.encode())
        if taken[name] < each and held[name] + size <= SAMPLE_BYTES // len(counts):
            taken[name] += 1
            held[name] += size
            texts.append(text)
            names.append(name)
    return texts, names


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Add ``held_out``, ``lang_pred`` and ``score`` to every row.

    Without ``model`` one is fitted on a sample of labelled rows whose id is not
    held out: ``crc32(id as text) % 3`` is not 1.  Only the text enters a
    prediction.  ``lang_pred`` is a learned language, or ``und`` where the text
    is null or has no letter; ``score`` is the share of words expected to be of
    that language, 0 for ``und``.  A null id counts as held out.  Words without
    a letter are skipped.  With no labelled rows every text is ``und``.
    """
    if model is None:
        model = fit(*sample(docs, id_col, text_col, lang_col))
    rows = docs.drop("held_out", "lang_pred", "score").withColumn(text_col, F.col(text_col).cast("string"))
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    rows = rows.withColumn("held_out", F.coalesce(remainder == 1, F.lit(True)))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    at = rows.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            names, share = predict_texts(learned, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(share, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def crc_remainder(doc_id: object) -> int:
    """``crc32`` of the id as text, modulo 3; 1 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 3
