"""Language ID (9): scripts narrow the candidates, Viterbi labels spans of mixed text.

A word is a run of letters (ASCII letters and all bytes of other scripts). Its
script comes from the range of its first code point, and only languages that
use the script in training are candidates: no other one is scored, or can label
the word. Where none uses it, all are. A word's score under a language is the
sum of log-probabilities of its hashed character n-grams. Viterbi finds the
labelling of the whole text that is best after a penalty for each switch; the
language with the most letters in its spans is the prediction.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, distinct, hashes, mix, prepare, runs, text_bytes

#: Training rows at most, or 200 a language if that is more (those of the least hash of doc_id), n-gram buckets, lengths of n-grams in bytes.
SAMPLE, BUCKETS, LENGTHS = 20_000, 1 << 17, (1, 2, 3, 4)
#: Log-probability that a change of language costs.
SWITCH = 12.0
#: Cells (word, language) of a piece; a text of more is labelled in blocks of words.
CELLS, BLOCK = 1 << 22, 2048

_A = np.arange(256)
_SEP = (_A < 128) & ~(((_A >= 65) & (_A <= 90)) | ((_A >= 97) & (_A <= 122)))

# Where Unicode blocks of a script begin, and which script it is.
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"),
    (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, "other"), (0x0860, "syriac"), (0x0870, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"),
    (0x1680, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "canadian"), (0x1900, "other"), (0x19E0, "khmer"), (0x1A00, "other"), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"),
    (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x3190, "han"), (0x31A0, "bopomofo"), (0x31C0, "han"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA8E0, "devanagari"), (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"),
    (0xAB00, "ethiopic"), (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x1B000, "kana"), (0x1B170, "other"), (0x20000, "han"), (0x32000, "other"),
)
_NAMES = sorted({name for _, name in _RANGES})
_BEGIN = np.array([x for x, _ in _RANGES])
_OF = np.array([_NAMES.index(name) for _, name in _RANGES])
SCRIPTS = len(_NAMES)


def scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the script of the first code point of each word; starts lie before the end."""
    whole = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    b = [whole[starts + k] for k in range(4)]
    low = [x & 0x3F for x in b]
    two, three, four = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2], (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    point = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four)
    return _OF[np.searchsorted(_BEGIN, point, "right") - 1]


def _ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of each n-gram of each word, word ends marked."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 32, np.uint64)
    own = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(len(flat)) - begin[own]
    ok = (inner > 0) & (inner < size[own] - 1)
    flat[ok] = data[(starts[own] + inner - 1)[ok]]
    buckets, words = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(flat) - n + 1] * np.uint64(257) + flat[n - 1 :] + np.uint64(1)
        if n in LENGTHS:
            fits = inner[: len(h)] + n <= size[own[: len(h)]]
            buckets.append((mix(h[fits] + np.uint64(n << 56)) >> np.uint64(64 - 17)).astype(np.int64))
            words.append(own[: len(h)][fits])
    return np.concatenate(buckets), np.concatenate(words)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities [bucket, language], and which scripts each language uses [script, language].

    Learns from text and lang of rows with both; a language needs a row. There
    is no limit to the languages, but each takes half a MB of memory on the
    driver and in every worker.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id").alias("_h"))
    totals = known.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in totals)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool)
    # at least a bounded share of rows for every language, chosen by hash
    each = max(200, SAMPLE // len(langs))
    share = {r["lang"]: min(1.0, each / r["count"]) for r in totals}
    limit = F.element_at(F.create_map(*(F.lit(x) for lang in langs for x in (lang, share[lang]))), F.col("lang"))
    some = known.where(F.pmod("_h", F.lit(1 << 20)) < limit * (1 << 20)).select("text", "lang")
    number = {x: i for i, x in enumerate(langs)}
    wide = BUCKETS + SCRIPTS

    def count(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = [number[x] for x in batch.column(1).to_pylist()]
            data, offs = text_bytes(batch.column(0))
            for i, j in chunks(offs):
                part = LOWER[data[offs[i] : offs[j]]]
                starts, ends, first = runs(part, offs[i : j + 1] - offs[i], _SEP)
                if not len(starts):
                    continue
                bucket, word = _ngrams(part, starts, ends)
                of = np.repeat(np.array(lang[i:j]), np.diff(first))
                for x in np.unique(of):
                    total = seen.setdefault(int(x), np.zeros(wide, np.int64))
                    total[:BUCKETS] += np.bincount(bucket[of[word] == x], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(scripts(part, starts[of == x]), minlength=SCRIPTS)
        for x, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = some.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((wide, len(langs)))
    counts[rows["bucket"], rows["lang"]] = rows["n"]
    grams, used = counts[:BUCKETS], counts[BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    return langs, logp.astype(np.float32), used >= np.maximum(1, 0.001 * used.sum(0))


def word_scores(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, logp: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """score [word, language]: those of the candidates by the word's script, minus infinity for the others."""
    out = np.full((len(starts), logp.shape[1]), -np.inf, np.float32)
    of = scripts(part, starts)
    for s in np.unique(of):
        mine = np.flatnonzero(of == s)
        langs = np.flatnonzero(uses[s]) if uses[s].any() else np.arange(logp.shape[1])
        if len(langs) == 1:  # nothing to choose
            out[mine, langs[0]] = 0
            continue
        bucket, word = _ngrams(part, starts[mine], ends[mine])
        for x in langs.tolist():
            out[mine, x] = np.bincount(word, logp[bucket, x], len(mine))
    return out


def label_long(words: int, score, switch: float) -> np.ndarray:
    """The best labels of one text whose scores don't fit: score(i, j) gives those of words i to j.

    Forward, only the state before each block is kept; backward, a block's
    scores are made again. So memory is one block's, and a state a block.
    """
    states, best = [], None

    def forward(s, best):
        back = np.empty(s.shape, np.min_scalar_type(s.shape[1] - 1))
        stay = np.arange(s.shape[1], dtype=back.dtype)
        for t in range(len(s)):
            if best is None:
                best = s[t].astype(np.float64)
                back[t] = stay
                continue
            top = int(best.argmax())
            high = best[top] - switch
            move = best < high
            back[t] = np.where(move, top, stay)
            best = np.where(move, high, best) + s[t]
        return back, best

    for i in range(0, words, BLOCK):
        states.append(best)
        _, best = forward(score(i, min(i + BLOCK, words)), best)
    out = np.empty(words, np.int64)
    label = int(best.argmax())
    for k in range(len(states) - 1, -1, -1):
        i = k * BLOCK
        back, _ = forward(score(i, min(i + BLOCK, words)), states[k])
        for t in range(len(back) - 1, -1, -1):
            out[i + t] = label
            label = int(back[t, label])
    return out


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of the words of each text: score [word, language], words first[d]..first[d+1] of text d.

    All texts advance together, longest first; one numpy step for each word
    place. The switching penalty is flat, so a state's best predecessor is
    itself or the best of all.
    """
    n, k = score.shape
    out = np.zeros(n, np.int64)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order) or k == 1:
        return out
    size, at = sizes[order], first[:-1][order]
    kind = np.min_scalar_type(k - 1)
    back = np.zeros((n, k), kind)
    stay = np.arange(k, dtype=kind)
    best = score[at].astype(np.float64)
    alive = len(order)
    for t in range(1, int(size[0])):
        while size[alive - 1] <= t:
            alive -= 1
        now = best[:alive]
        top = now.argmax(1)
        high = now[np.arange(alive), top] - switch
        move = now < high[:, None]
        rows = at[:alive] + t
        back[rows] = np.where(move, top[:, None].astype(kind), stay)
        best[:alive] = np.where(move, high[:, None], now) + score[rows]
    label = best.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-size, -t, "left"))
        rows = at[:alive] + t
        out[rows] = label[:alive]
        label[:alive] = back[rows, label[:alive]]
    return out


def _has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def label(docs: DataFrame, model: tuple, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (lang and letters of each run) of every row.

    lang_pred is `und` (score 0) where text is null or has no letter, or
    nothing was learned. score: the share of the text's letters, in bytes,
    that the predicted language's spans hold. Ties go to the first language by
    name. Very long texts are labelled whole, in memory bounded by CELLS; repeated rows get the same label;
    an empty table gives no rows. Needs doc_id and text; no other column is
    looked at.
    """
    langs = model[0]
    sent = docs.sparkSession.sparkContext.broadcast(model[1:])
    prepare(docs.sparkSession)

    def task(batches):
        logp, uses = sent.value
        most = min(4 << 20, max(1 << 16, 6 * CELLS // max(1, len(langs))))
        for batch in batches:
            texts = batch.column(1)
            data, offs = text_bytes(texts)
            pred, score, found = [], [], []
            for i, j in chunks(offs, most):
                part = LOWER[data[offs[i] : offs[j]]]
                starts, ends, first = runs(part, offs[i : j + 1] - offs[i], _SEP)
                if len(starts) and langs:
                    if len(starts) * len(langs) > 2 * CELLS and j == i + 1:
                        best = label_long(len(starts), lambda a, b, p=part, s=starts, e=ends: word_scores(p, s[a:b], e[a:b], logp, uses), switch)
                    else:
                        one, back = distinct(hashes(part, starts, ends))
                        best = viterbi(word_scores(part, starts[one], ends[one], logp, uses)[back], first, switch)
                    letters = ends - starts
                    own = np.repeat(np.arange(j - i), np.diff(first))
                    held = np.bincount(own * len(langs) + best, letters, (j - i) * len(langs)).reshape(j - i, -1)
                else:
                    held = np.zeros((j - i, max(1, len(langs))))
                for d in range(j - i):
                    total = held[d].sum()
                    raw = part[offs[i + d] - offs[i] : offs[i + d + 1] - offs[i]]
                    if not total or not langs or (not _ascii_letter(raw) and not _has_letter(raw.tobytes().decode("utf-8", "replace"))):
                        pred.append("und")
                        score.append(0.0)
                        found.append([])
                        continue
                    top = int(held[d].argmax())
                    pred.append(langs[top])
                    score.append(float(held[d][top] / total))
                    if spans:
                        b, n = best[first[d] : first[d + 1]], letters[first[d] : first[d + 1]]
                        edge = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                        found.append([{"lang": langs[b[e]], "letters": int(x)} for e, x in zip(edge, np.add.reduceat(n, edge), strict=True)])
            cols = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<lang:string,letters:long>>" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(task, schema)


def _ascii_letter(raw: np.ndarray) -> bool:
    return bool(((raw >= 97) & (raw <= 122)).any())


def op9(docs: DataFrame) -> DataFrame:
    """label() over all documents, learned from those that aren't held out; null doc_id is never held out."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.where(~held & F.col("doc_id").isNotNull()))
    return label(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
