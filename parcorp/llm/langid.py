"""Language spans: script ranges, character trigrams per word, Viterbi over the words."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp.llm.common import with_package

SLOTS = 1 << 18  # trigrams are counted by a hash of this many values
SMOOTH = 0.5
SWITCH = 15.0  # nats that a change of language costs
FIT_DOCS = 3000  # about as many labelled rows per language fit the model
PIECE = 1 << 20  # characters that are scored at once
GROUP = 1 << 22  # characters whose words are labelled together, of 8 languages
HELD = 16  # languages whose counts a task holds before it hands them on
FAR = -1e4  # score of a language that does not use a word's script
SCRIPT_SHARE = 0.01  # a language uses a script that makes up this share of its letters

# First code point of a range and the script it belongs to
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})
LARGE = ("han", "hangul", "kana", "other")  # too many letters for trigrams to cover


@functools.lru_cache(maxsize=1)
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point, or 0 for what is no letter; script number."""
    lower = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            lower[cp] = ord(low) if len(low) == 1 else cp
    script = np.zeros(0x110000, np.uint8)
    for (start, name), end in zip(RANGES, [r[0] for r in RANGES[1:]] + [0x110000]):
        script[start:end] = SCRIPTS.index(name)
    return lower, script


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """The text in bounded pieces, cut after a character that is no letter where possible."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = end
            while cut > at and end - cut < 4096 and text[cut - 1].isalpha():
                cut -= 1
            if cut > at and not text[cut - 1].isalpha():
                end = cut
        yield at, text[at:end]
        at = end


def _words(piece: str):
    """(starts, ends, scripts, first trigram of each word, trigram slots) of the words."""
    lower, script = _unicode()
    cp = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    low = np.zeros(len(cp) + 3, np.uint32)
    low[2:-1] = lower[cp]
    letter = low != 0
    a, b, c = low[:-2], low[1:-1], low[2:]
    a = np.where(b != 0, a, 0)
    valid = letter[1:-1] | letter[2:]  # ends on a letter, or just behind one
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    slots = (h[valid] >> np.uint32(14)).astype(np.int64)
    inner = letter[2:-1]
    edge = np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = (np.cumsum(valid) - valid)[starts]
    return starts, ends, script[cp[starts]] if len(starts) else np.empty(0, np.uint8), first, slots


class Model:
    """Scores of trigram slots per language: a row for every slot that occurs in training, and
    row 0 for all others."""

    def __init__(self, langs: list[str], slot: np.ndarray, column: np.ndarray, n: np.ndarray, letters: np.ndarray) -> None:
        """n: trigrams by slot and language (column); letters: per script and language."""
        self.langs = langs
        used, row = np.unique(slot, return_inverse=True)
        self.row = np.zeros(SLOTS, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        seen, total = max(1, len(used)), np.bincount(column, n, len(langs))
        self.scores = np.empty((len(used) + 1, len(langs)), np.float32)
        order = np.argsort(column, kind="stable")
        ends = np.searchsorted(column[order], np.arange(len(langs) + 1))
        for k in range(len(langs)):
            mine, counts = order[ends[k]:ends[k + 1]], np.zeros(len(used) + 1)
            counts[row[mine] + 1] = n[mine]
            self.scores[:, k] = np.log((counts + SMOOTH) / (total[k] + SMOOTH * seen))
        share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
        self.uses = share >= SCRIPT_SHARE
        # a trigram of no language in particular: all learned ones are equally likely
        self.background = np.where(np.isin(SCRIPTS, LARGE), -np.inf, -np.log(seen) - 1e-4)

    def words(self, text: str):
        """(starts, ends, scores per language) of all words of a text of any length."""
        return self.explained(text)[:3]

    def explained(self, text: str):
        """The same and, per word and language, whether the language explains the word: it
        uses the word's script and scores at least what the background does. Trigrams of
        large scripts are never covered, so there the script decides."""
        out = []
        for at, piece in _pieces(text):
            starts, ends, scripts, first, slots = _words(piece)
            if not len(starts):
                continue
            got = self._sums(slots, first)
            known = self.uses[scripts]
            got = np.where(known, got, np.where(known.any(axis=1, keepdims=True), np.float32(FAR), np.float32(0)))
            size = np.diff(np.append(first, len(slots)))
            fits = known & (got >= (size * self.background[scripts])[:, None])
            out.append((starts + at, ends + at, got, fits))
        if not out:
            none = np.empty(0, np.int64)
            return none, none, np.empty((0, len(self.langs)), np.float32), np.empty((0, len(self.langs)), bool)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _sums(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of the words whose trigrams start at `first`, of a bounded number at once."""
        size = max(1, GROUP * 8 // max(8, len(self.langs)))
        cuts = np.unique(np.searchsorted(first, np.arange(0, len(slots), size)))
        out = []
        for lo, hi in zip(cuts, [*cuts[1:], len(first)]):
            end = first[hi] if hi < len(first) else len(slots)
            if hi > lo:
                out.append(np.add.reduceat(self.scores[self.row[slots[first[lo]:end]]], first[lo:hi] - first[lo], axis=0))
        return np.concatenate(out)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; the words of text d are bounds[d]:bounds[d + 1].

    All texts advance together, word by word, the longest first, so that those still
    running are always the front of the arrays. Ties keep the language, then take the
    first one.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = np.zeros(len(scores), np.int32)
    if not len(order):
        return labels
    at, sizes = bounds[:-1][order], sizes[order]
    best = scores[at].astype(np.float64)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts with word t
    stays, froms = [], []
    for t in range(1, sizes[0]):
        n = live[t]
        now = best[:n]
        top = now.argmax(axis=1)
        change = now[np.arange(n), top] - switch
        stay = now >= change[:, None]
        best[:n] = np.where(stay, now, change[:, None]) + scores[at[:n] + t]
        stays.append(stay)
        froms.append(top)
    label = best.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        n = live[t]
        labels[at[:n] + t] = label[:n]
        if t:
            keep = stays[t - 1][np.arange(n), label[:n]]
            label[:n] = np.where(keep, label[:n], froms[t - 1])
    return labels


# ---- as Spark operators -----------------------------------------------------------------------
def train(labelled: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id",
          fit_docs: int = FIT_DOCS) -> Model:
    """Fit on about `fit_docs` rows per language, chosen by a digest of the id.

    Rows without text or language are not used. Counting is distributed; the driver gets
    sums per language and trigram slot that occurs, however many languages there are.
    """
    with_package(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("l")).count().collect()}
    langs = sorted(sizes)
    digest = F.concat(F.lit("0"), F.substring(F.md5(F.col(row_id).cast("string")), 1, 6))
    bounds = labelled.sparkSession.createDataFrame(
        [(name, f"{min(fit_docs * 16**6 // sizes[name], 16**6):07x}") for name in langs], "l string, bound string")
    slim = rows.select(F.col(lang).alias("l"), digest.alias("d"), F.col(text).alias("t"))
    chosen = slim.join(F.broadcast(bounds), "l").where("d < bound").select("l", "t")  # a row per language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for name, into in sums.items():
                at = np.flatnonzero(into)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(into[at])], ["l", "slot", "n"])
            sums.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in sums and len(sums) == HELD:
                    yield from handed_on()
                into = sums.setdefault(name, np.zeros(SLOTS + len(SCRIPTS), np.int64))
                for _, piece in _pieces(body.as_py()):
                    starts, ends, scripts, _, slots = _words(piece)
                    np.add.at(into, slots, 1)
                    np.add.at(into, SLOTS + scripts.astype(np.int64), ends - starts)
        yield from handed_on()

    got = chosen.mapInArrow(count, "l string, slot bigint, n bigint").groupBy("l", "slot").agg(F.sum("n").alias("n"))
    table = got.toArrow()
    number = {name: i for i, name in enumerate(langs)}
    column = np.array([number[x] for x in table.column("l").to_pylist()], np.int64)
    slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
    letters, trigram = np.zeros((len(SCRIPTS), len(langs))), slot < SLOTS
    letters[slot[~trigram] - SLOTS, column[~trigram]] = n[~trigram]
    return Model(langs, slot[trigram], column[trigram], n[trigram], letters)


def _grouped(model: Model, switch: float):
    """A function from texts to (language, score, spans, known) of each; known is the share
    of the letters in words that the language is given and explains."""
    names = model.langs

    def group(texts: list[str]) -> tuple[list[str], np.ndarray, list[list[dict]], np.ndarray]:
        if names:
            s, e, scores, fits = model.explained("\n".join(texts))
        else:
            s, e, scores, fits = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 1)), np.empty((0, 1), bool)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        labels = viterbi(scores, np.searchsorted(s, begin), switch)
        doc = np.searchsorted(begin, s, side="right") - 1
        letters = np.zeros((len(texts), max(1, len(names))), np.int64)
        np.add.at(letters, (doc, labels), e - s)
        total, top = letters.sum(axis=1), letters.argmax(axis=1)
        sound = np.zeros_like(letters)
        np.add.at(sound, (doc, labels), (e - s) * fits[np.arange(len(s)), labels])
        known = sound.max(axis=1) / np.maximum(total, 1)
        pred = [names[i] if n else "und" for i, n in zip(top, total)]
        spans: list[list[dict]] = [[] for _ in texts]
        if len(s):
            turn = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
            new = np.flatnonzero(np.concatenate([[True], turn]))
            for i, j in zip(new, np.concatenate([new[1:], [len(s)]]) - 1):
                d = doc[i]
                spans[d].append({"start": int(s[i] - begin[d]), "end": int(e[j] - begin[d]), "lang": names[labels[i]]})
        return pred, letters.max(axis=1) / np.maximum(total, 1), spans, known

    return group


def _parts(batch: pa.RecordBatch, column: int, langs: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, of bounded size unless one text is longer."""
    texts, size, lo, most = [], 0, 0, GROUP * 8 // max(8, langs)
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield batch.slice(lo, i + 1 - lo), texts
            texts, size, lo = [], 0, i + 1
    if texts:
        yield batch.slice(lo), texts


def label(docs: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text",
          switch: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, spans) for every row.

    `spans` lists (start, end, lang) of maximal runs of words of one language, in code
    points of the whole text, end exclusive. `lang_pred` is the language of most letters
    (ties: the first name), `score` its share of them. Texts that are null or hold no
    letter give `und`, score 0 and no spans, and so does everything if nothing was learned.
    """
    with_package(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # once per executor, not per task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, langs = _grouped(shared.value, switch), len(shared.value.langs)
        for batch in batches:
            for part, texts in _parts(batch, 1, langs):
                pred, share, spans, _ = group(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(spans, span)],
                    ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("t"))
    out = rows.mapInArrow(scan, "id bigint, lang_pred string, score double, "
                                "spans array<struct<start:bigint,end:bigint,lang:string>>")
    return out.withColumnRenamed("id", row_id)


def accepted(docs: DataFrame, model: Model, min_score: float, text: str = "text",
             switch: float = SWITCH, explained: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, whose main language has at least `min_score` of the
    letters. With `explained` only letters count that stand in words the language explains:
    words of a script that it does not use count for none, nor do words that it makes less
    likely than the background. Rows without letters go. One pass, nothing is shuffled."""
    with_package(docs.sparkSession)
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, langs = _grouped(shared.value, switch), len(shared.value.langs)
        for batch in batches:
            for part, texts in _parts(batch, column, langs):
                pred, share, _, known = group(texts)
                good = ((known if explained else share) >= min_score) & np.array([p != "und" for p in pred])
                yield part.filter(pa.array(good))

    return docs.mapInArrow(scan, docs.schema)


def held_out(row_id: Column) -> Column:
    """Rows that the model never learns from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, label all."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return label(docs.select("doc_id", "text"), model)
