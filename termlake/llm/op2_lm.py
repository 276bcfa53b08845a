"""LM scoring: a causal self-attention model over subword ids, with counts of the whole corpus behind it.

Counts of all words of all training rows are summed by Spark and give the base score (add-one over words). All training
rows are encoded once; Spark sums how often each subword id occurs and which id follows which, within words, across them
and at texts' ends, which gives the classes of ids and what follows a class. The attention's weights begin with those fitted
on the driver to windows of a bounded number of training documents (`FIT_DOCS`, at most `FIT_WINDOWS` windows of each,
spread over the whole text); from there each task goes once over all windows of its training rows, and the weights of
the tasks are averaged by their windows. Every text is then scored whole, in overlapping windows that score each token once, by batched masked attention. A word, with the white space
before it, is then given by either of two sources: by its subwords, or, with weight `WHOLE`, by the corpus's word counts and
the kind of white space; the probability of a text is the product of its words' mixed probabilities and its end's.

The base score needs a word's count for every word of every text. The `HEAD` most frequent words (a bound) are broadcast with
their counts; occurrences of all others are joined with the table of counts and summed for each row.

Cases: null text counts as empty: its end alone is scored; without training rows all counts are 0, classes are even and the
weights are those drawn at the start; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import CLASSES, START, WINDOW, Model, classes_of, initial, levels, log_probability, train, train_on, windows_of
from .common import chunks, cut, held_out, lower_ascii, small_batches, split_words
from .tokens import LONGEST_WORD, Encoder, default_tokenizer, encoder

HEAD = 200_000
FIT_DOCS, FIT_WINDOWS = 1500, 48
#: Weight of an id's share of its class among the counts behind one class.
BACKOFF = 20.0
LN10 = float(np.log(10))
#: Weight of the source of whole words; of those, shares of a space and of a line end before them.
WHOLE, AFTER_SPACE, AFTER_LINE = 0.4, 0.94, 0.06
ODD_LATIN = "\x00\x1c\x1d\x1e\x1f\x85\xa0"
ODD = ODD_LATIN + "\t\r\x0b\x0c"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(train_docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows, A-Z lower-cased, words parted at U+0020 and U+0009 to U+000D."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        held: pa.Table | None = None

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from t.filter(pc.not_equal(t["word"], "")).combine_chunks().to_batches(max_chunksize=50_000)

        for batch in batches:
            # Arrow's ASCII white space is just the six characters that part words here
            words = pc.value_counts(pc.ascii_split_whitespace(pc.ascii_lower(batch.column(0))).flatten())
            part = pa.table({"word": words.field(0), "n": words.field(1)})
            if held is not None:
                both = pa.concat_tables([held, part]).group_by("word", use_threads=False).aggregate([("n", "sum")])
                part = pa.table({"word": both["word"], "n": both["n_sum"]})
            held = part
            if held.num_rows > 400_000:
                yield from out(held)
                held = None
        if held is not None:
            yield from out(held)
        held = None
        pa.default_memory_pool().release_unused()

    return train_docs.select(text_col).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int):
    """An Arrow table of the most frequent words, at most `most`: all with a count above a border that a histogram gives.

    No task sorts or gathers more than it read.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    held, border = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect(), reverse=True):
        held += r["c"]
        if held > most:
            break
        border = r["step"]
    return counts.where(step >= border if border is not None else F.lit(False)).toArrow()


def encode_words(encode: Encoder, words: list[str], before: str, id_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, how many each has), each word with the character `before` in front.

    Encoders of this kind begin anew where white space follows other characters, so many words are encoded at once.
    """
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ids, sizes = [], []
    for a in range(0, len(words), 5000):
        text = before + before.join(words[a : a + 5000])
        own = np.frombuffer(encode(text), "<u4")
        starts = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == ord(before))
        # the last byte of each token lies in the token's word
        word = np.searchsorted(starts, np.cumsum(id_bytes[own]) - 1, side="right") - 1
        ids.append(own)
        sizes.append(np.bincount(word, minlength=len(starts)))
    return np.concatenate(ids), np.concatenate(sizes)


def plain(word: str, longest: int | None = LONGEST_WORD) -> bool:
    """Whether a word can be encoded among others: Latin-1 without odd white space, not too long, no special token."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return (longest is None or len(word) <= longest) and "<|" not in word and not any(c in word for c in ODD_LATIN)


def coded(train_docs: DataFrame, shared, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(ids): the 16-bit ids of each row's whole text and its end; `shared` has the known words and units to begin with."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = shared.value
        units = Units(encoder(tokenizer_path), known, base)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts, 600_000):
                _, _, ids, sizes, *_ = units([lower_ascii(t) for t in texts[a:b]])
                own = np.split(ids.astype("<u2"), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in own], pa.binary())], ["ids"])

    return train_docs.select(text_col).mapInArrow(encoded, "ids binary")


def _flat(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of some rows one after the other, how many each row has), about `most` ids at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(0)).to_numpy().astype(np.int64) // 2
        part = np.cumsum(sizes) // most
        begins = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(begins, [*begins[1:], len(sizes)], strict=True):
            yield np.frombuffer(b"".join(batch.column(0).slice(a, b - a).to_pylist()), "<u2").astype(np.int64), sizes[a:b]


def id_pairs(ids: DataFrame, n_ids: int) -> DataFrame:
    """(a, b, n): how often id b follows id a in the training rows; a = -1 stands before a text, a = -2 counts b alone."""

    def counted(batches):
        alone = np.zeros(n_ids, np.int64)
        raw: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(kinds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds // n_ids - 2), pa.array(kinds % n_ids), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        def sum_up() -> None:
            """What is raw is counted, and added to what is held."""
            held.append(np.unique(np.concatenate(raw), return_counts=True))
            raw.clear()
            if len(held) > 1:
                kinds, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                held[:] = [(kinds, np.bincount(back, np.concatenate([n for _, n in held]), len(kinds)))]

        for flat, sizes in _flat(batches):
            alone += np.bincount(flat, minlength=n_ids)
            before = np.concatenate(([0], flat[:-1] + 2))
            before[np.cumsum(sizes) - sizes] = 1
            raw.append(before * n_ids + flat)
            if sum(map(len, raw)) > 3_000_000:
                sum_up()
                if len(held[0][0]) > 1_000_000:
                    yield out(*held.pop())
        if raw:
            sum_up()
        if held:
            yield out(*held.pop())
        some = np.flatnonzero(alone)
        yield out(some, alone[some])

    return ids.mapInArrow(counted, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def subword_counts(pairs: DataFrame, n_ids: int) -> np.ndarray:
    """Occurrences of each id."""
    got = pairs.where("a = -2").select("b", "n").toArrow()
    out = np.zeros(n_ids)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def class_pairs(pairs: DataFrame, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(CLASSES + 1, used ids): how often an id follows a class, or the beginning of a text, in the training rows."""
    out = np.zeros((CLASSES + 1, int(place.max(initial=-1)) + 1))
    classes = pairs.sparkSession.createDataFrame([(-1, START), *((i, int(k)) for i, k in enumerate(kind))], "a bigint, kind int")
    # a row for each id of the tokenizer
    got = pairs.where("a >= -1").join(F.broadcast(classes), "a").groupBy("kind", "b").agg(F.sum("n").alias("n")).toArrow()
    out[got["kind"].to_numpy(), place[got["b"].to_numpy()]] = got["n"].to_numpy()
    return out


def _ids(encode: Encoder, text: str) -> np.ndarray:
    """Ids of a text and of its end, which is the one behind the tokenizer's."""
    return np.append(np.frombuffer(encode(lower_ascii(text)), "<u4"), np.uint32(encode.size))


def fit_windows(train_docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Windows (n, WINDOW + 1) of ids from a bounded number of documents: -2 before a text, -1 behind it."""
    some = train_docs.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS).distinct()
    texts = train_docs.join(F.broadcast(some), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi").select(text_col)

    def cut_out(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                ids = np.concatenate(([-2], _ids(encode, t or "").astype(np.int64)))
                steps = np.arange(0, max(1, len(ids) - 1), WINDOW)
                for a in steps if len(steps) <= FIT_WINDOWS else steps[np.linspace(0, len(steps) - 1, FIT_WINDOWS).astype(int)]:
                    w = np.full(WINDOW + 1, -1, "<i4")
                    part = ids[a : a + WINDOW + 1]
                    w[: len(part)] = part
                    out.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["w"])

    got = texts.mapInArrow(cut_out, "w binary").orderBy(F.xxhash64("w"), "w").limit(FIT_DOCS * FIT_WINDOWS).collect()
    return np.stack([np.frombuffer(r["w"], "<i4") for r in got]) if got else np.zeros((0, WINDOW + 1), np.int32)


#: Ids whose vectors are added up together.
ROWS = 2048


def trained_on_all(ids: DataFrame, start: dict[str, np.ndarray], kind: np.ndarray, priors) -> dict[str, np.ndarray]:
    """Weights after one pass of each task over all windows of its rows: those that all ids share are averaged by the tasks' numbers
    of windows, an id's own vector by how often the tasks met it.

    Tasks give their weights in parts, which are added up part by part as they stream by; the driver gets one sum of each part.
    """
    shared = ids.sparkSession.sparkContext.broadcast((start, kind, priors))
    dense = sorted(k for k in start if k != "own")

    def trained(batches):
        start, kind, priors = shared.value
        n, w, often = train_on((windows_of(flat, sizes, len(kind)) for flat, sizes in _flat(batches)), start, kind, priors)
        if n:
            flat = np.concatenate([w[k].ravel() for k in dense]).astype("<f8") * n
            parts = [(0, np.append(flat, n))]
            for a in range(0, len(often), ROWS):
                m = often[a : a + ROWS, None].astype("<f8")
                parts.append((1 + a // ROWS, np.concatenate([w["own"][a : a + ROWS] * m, m], 1).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([x.astype("<f8").tobytes() for _, x in parts], pa.binary())], ["part", "sums"])

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<f8")
                held[part] = held[part] + x if part in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "sums"])

    kinds = "part int, sums binary"
    got = cut(ids.mapInArrow(trained, kinds)).repartition("part").mapInArrow(added, kinds).collect()  # parts of one set of weights
    if not got:
        return start
    sums = {r["part"]: np.frombuffer(r["sums"], "<f8") for r in got}
    flat, out = sums[0][:-1] / sums[0][-1], {}
    for name, x in zip(dense, np.split(flat, np.cumsum([start[k].size for k in dense])[:-1]), strict=True):
        out[name] = x.reshape(start[name].shape).astype(np.float32)
    width = start["own"].shape[1] + 1
    own = np.concatenate([sums[p].reshape(-1, width) for p in sorted(sums) if p])
    out["own"] = np.where(own[:, -1:] > 0, own[:, :-1] / np.maximum(own[:, -1:], 1), start["own"]).astype(np.float32)
    return out


def fit(ids: DataFrame, train_docs: DataFrame, tokenizer_path: str, n_ids: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the training rows, of which `ids` has the encoded texts; n_ids counts the tokenizer's ids and the end."""
    pairs_of_ids = cut(id_pairs(ids, n_ids))
    total = subword_counts(pairs_of_ids, n_ids)
    kind, share = classes_of(total)
    used = np.flatnonzero(total > 0)
    place = np.full(n_ids, -1, np.int32)
    place[used] = np.arange(len(used))
    pairs = class_pairs(pairs_of_ids, kind, place)
    by_class = np.stack([np.bincount(kind[used], r, CLASSES) for r in pairs]) if len(used) else np.zeros((CLASSES + 1, CLASSES))
    priors = levels(by_class)
    # which id of its class: the corpus's counts behind the class before, leaning on its share
    after = np.zeros((CLASSES + 1, max(1, len(used))), np.float32)
    for c in range(CLASSES + 1 if len(used) else 0):
        after[c] = np.log((pairs[c] + BACKOFF * np.exp(share[used])) / (by_class[c, kind[used]] + BACKOFF))
    windows = fit_windows(train_docs, tokenizer_path, id_col, text_col)
    windows = np.where(windows == -2, n_ids, windows)
    weights = trained_on_all(ids, train(windows, kind, priors) if len(windows) else initial(n_ids), kind, priors)
    left = np.log(BACKOFF / (by_class + BACKOFF)).astype(np.float32)
    return Model(kind, share, priors, place, after, left, weights)


def word_spans(raw: list[bytes], ids: list[np.ndarray], id_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one after the other, each word and each text's end being a unit: unit of each token; log10 of the white space
    before each unit under the source of whole words (-inf where that source has none)."""
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[joined]
    sizes = np.array([len(r) for r in raw], np.int64)
    text_end = np.cumsum(sizes + 1)
    text_begin = text_end - sizes - 1
    word_end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    word_begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(joined) and not space[0]:
        word_begin = np.concatenate(([0], word_begin))
    ends = np.sort(np.concatenate([word_end, text_end]))
    is_end = np.zeros(len(ends), bool)
    is_end[np.searchsorted(ends, text_end)] = True
    begins = np.empty(len(ends), np.int64)
    begins[~is_end], begins[is_end] = word_begin, text_end - 1
    previous = np.concatenate(([0], ends[:-1]))
    gap = begins - previous
    at_start = np.isin(previous, text_begin)
    with np.errstate(divide="ignore"):
        white = np.where(gap == 0, np.where(at_start | is_end, 0.0, -np.inf), np.where((gap == 1) & ~is_end, np.where(joined[previous] == 32, np.log10(AFTER_SPACE), np.where(joined[previous] == 10, np.log10(AFTER_LINE), -np.inf)), -np.inf))
    token_end = [np.cumsum(id_bytes[x]) + b for x, b in zip(ids, text_begin, strict=True)]
    for x, e in zip(token_end, text_end, strict=True):
        x[-1] = e
    return np.searchsorted(ends, np.concatenate(token_end)), white


class Units(dict):
    """Texts as units (words, then the text's end), with their ids and counts; each distinct unit of a task is looked at once.

    Texts with single spaces and line ends between words go by a table of units, a unit being a word and the character before
    it; others are encoded as a whole and parted by word_spans().
    """

    def __init__(self, encode: Encoder, known: dict[str, int], base: tuple | None = None, limit: int = 200_000):
        super().__init__()
        self.encode, self.id_bytes, self.known, self.limit = encode, np.append(encode.id_bytes(encode.size), 1), known, limit + (len(base[0]) if base else 0)
        nothing = np.zeros(0, np.int64)
        self.base = base or ([], [nothing, nothing, np.zeros(0), np.zeros(0)], np.zeros(0, np.uint32))
        self._reset()

    def _reset(self) -> None:
        """Back to the units that were given: words after a space, columns (start, size, white, count) and ids."""
        self.clear()
        self.fresh: list[str] = []
        units, self.columns, self.flat = self.base
        self.update(zip(units, range(len(units)), strict=True))

    def learned(self, words: list[str]) -> tuple:
        """What another table can be begun with."""
        self.index(words)
        return words, self.columns, self.flat

    def index(self, units: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        if self.fresh:
            self._learn()
        return at

    def __missing__(self, unit: str) -> int:
        i = self[unit] = len(self)
        self.fresh.append(unit)
        return i

    def _learn(self) -> None:
        fresh, self.fresh = self.fresh, []
        sizes, parts, at = np.zeros(len(fresh), np.int64), [], []
        white = np.zeros(len(fresh))
        lined = [i for i, u in enumerate(fresh) if u < "\x0b" and u[0] == "\n"]
        bare = [i for i, u in enumerate(fresh) if u < "\x01"]
        marked = {*lined, *bare}
        spaced = [i for i in range(len(fresh)) if i not in marked]
        for own, before, texts in ((spaced, " ", [fresh[i] for i in spaced]), (lined, "\n", [fresh[i][1:] for i in lined])):
            ids, n = encode_words(self.encode, texts, before, self.id_bytes)
            parts.append(ids)
            at += own
            sizes[own], white[own] = n, np.log10(AFTER_SPACE if before == " " else AFTER_LINE)
        for i in bare:
            parts.append(np.frombuffer(self.encode(fresh[i][1:]), "<u4"))
            at.append(i)
            sizes[i] = len(parts[-1])
        # parts follow `at`; starts are put back in the order of `fresh`
        starts = np.zeros(len(fresh), np.int64)
        starts[at] = len(self.flat) + np.cumsum(sizes[at]) - sizes[at]
        counts = np.full(len(fresh), np.nan)
        # words after a space that are known were there from the beginning
        for i in marked if self.base[0] else range(len(fresh)):
            counts[i] = self.known.get(fresh[i][1:] if i in marked else fresh[i], np.nan)
        self.flat = np.concatenate([self.flat, *parts])
        self.columns = [np.concatenate(x) for x in zip(self.columns, (starts, sizes, white, np.log10(counts + 1)), strict=True)]

    def _simple(self, text: str) -> list[str] | None:
        """Units of a text that has only single spaces and line ends between plain words, else None."""
        if not text or any(c in text for c in ODD) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "<|" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        units = text.replace("\n", " \n").split(" ")
        if max(map(len, units)) > LONGEST_WORD:
            return None
        units[0] = "\0" + units[0]
        return units

    def __call__(self, texts: list[str]):
        """units as text (a line end or a NUL may stand before the word, one character in any case), words of each text, ids, ids of each text, unit of each id, white space before each unit and
        log10 of each unit's count + 1 (nan where it is not among the known, and for ends)."""
        if len(self) > self.limit:
            self._reset()
        keys: list[str] = []
        n_words, slow = np.zeros(len(texts), np.int64), {}
        for i, t in enumerate(texts):
            units = self._simple(t)
            if units is None:
                words = split_words(t)
                slow[i] = (len(keys), words)
                n_words[i] = len(words)
                keys += ["\0"] * (len(words) + 1)  # filled in below
            else:
                n_words[i] = len(units)
                keys += units
                keys.append("\0")
        at = self.index(keys)
        starts, sizes, white, counts = (c[at] for c in self.columns)
        ends = np.cumsum(n_words + 1) - 1
        counts[ends] = np.nan
        # ids of each unit: a stretch of the flat table, of a slow text's own ids, or an end
        flat, extra = [self.flat, np.array([self.encode.size], np.uint32)], len(self.flat) + 1
        starts[ends], sizes[ends] = len(self.flat), 1
        for i, (first, own) in slow.items():
            raw = [texts[i].encode("utf-8", "surrogatepass")]
            ids = _ids(self.encode, texts[i])
            unit, gaps = word_spans(raw, [ids], self.id_bytes)
            n = np.bincount(unit, minlength=len(own) + 1)
            spot = slice(first, first + len(own) + 1)
            sizes[spot], starts[spot], white[spot] = n, extra + np.cumsum(n) - n, gaps
            keys[spot] = [*("\0" + w for w in own), "\0"]
            counts[first : first + len(own)] = [np.log10(self.known[w] + 1) if w in self.known else np.nan for w in own]
            flat.append(ids)
            extra += len(ids)
        unit = np.repeat(np.arange(len(keys)), sizes)
        spots = np.arange(len(unit)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        ids = np.concatenate(flat)[spots]
        return keys, n_words, ids, np.add.reduceat(sizes, np.concatenate(([0], ends[:-1] + 1))) if len(texts) else sizes, unit, white, counts


def _mixed(by_subwords, by_whole):
    """log10 of the sum of two probabilities given as log10."""
    high, low = np.maximum(by_subwords, by_whole), np.minimum(by_subwords, by_whole)
    return high + np.log1p(np.exp(np.maximum(low - high, -300) * LN10)) / LN10


def score(docs: DataFrame, train_docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), head: int = HEAD) -> DataFrame:
    """id, `keep`, n_tokens, n_known, train_tokens, base_score, score, n_subwords of each row of docs."""
    small_batches(docs)
    spark, path = docs.sparkSession, tokenizer_path or default_tokenizer()
    counts = cut(word_counts(train_docs, text_col))
    ends = train_docs.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words + ends, kinds + (ends > 0)
    top = frequent(counts, head)
    known = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    encode = encoder(path)
    base = Units(encode, known, limit=head).learned([w for w in known if plain(w)])
    begun = spark.sparkContext.broadcast((known, base))
    fitted = spark.sparkContext.broadcast(fit(cut(coded(train_docs, begun, path, text_col)), train_docs, path, encode.size + 1, id_col, text_col))
    per_token, end_log = float(np.log10(n + v + 1)), float(np.log10(ends + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, base), model = begun.value, fitted.value
        units = Units(encoder(path), known, base)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, 600_000):
                own = [lower_ascii(t) for t in texts[a:b]]
                keys, n_words, ids, sizes, unit, white, counts = units(own)
                is_end = np.zeros(len(white), bool)
                is_end[np.cumsum(n_words + 1) - 1] = True
                doc = np.repeat(np.arange(b - a), n_words + 1)
                by_subwords = np.bincount(unit, log_probability(model, ids, sizes), len(white)) / np.log(10) + np.log10(1 - WHOLE)
                count_log = np.where(is_end, end_log, counts)
                rare = ~is_end & np.isnan(counts)
                by_whole = np.log10(WHOLE) + white - per_token
                mixed = np.where(rare, 0, _mixed(by_subwords, by_whole + np.where(rare, 0, count_log)))
                in_head = ~is_end & ~rare
                head_log = np.bincount(doc, np.where(in_head, counts, 0), b - a)
                tail = pa.StructArray.from_arrays([pa.array([k[1:] if k[0] in "\n\0" else k for k in map(keys.__getitem__, np.flatnonzero(rare).tolist())], pa.string()), pa.array(by_subwords[rare]), pa.array(np.maximum(by_whole[rare], -1e9))], ["word", "sub", "whole"])
                tails = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, rare, b - a)))), pa.int32()), tail)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)], pa.array(n_words + 1), pa.array(head_log), pa.array(np.bincount(doc, in_head, b - a).astype(np.int64)), pa.array(np.bincount(doc, mixed, b - a)), pa.array(sizes), tails],
                    ["id", *keep, "n_tokens", "head_log", "head_known", "head_score", "n_subwords", "tail"],
                )

    types = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {types}n_tokens bigint, head_log double, head_known bigint, head_score double, n_subwords bigint, tail array<struct<word: string, sub: double, whole: double>>"
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *keep).mapInArrow(scored, schema)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts, "word", "left")
    c = F.log10(F.coalesce("n", F.lit(0)) + 1)
    whole = F.col("whole") + c
    high, low = F.greatest("sub", whole), F.least("sub", whole)
    mixed = high + F.log10(1 + F.pow(F.lit(10.0), F.greatest(low - high, F.lit(-300.0))))
    sums = each.groupBy("row").agg(F.sum(c).alias("tail_log"), F.count("n").alias("tail_known"), F.sum(mixed).alias("tail_score"))
    out = rows.drop("tail").join(sums, "row", "left")
    known, zero = F.lit(int(ends > 0)), F.lit(0)
    return out.select(
        "id", *keep, "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", zero) + known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + end_log - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"), "n_subwords",
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    rows = docs.select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out"))
    return score(rows, rows.where("not held_out").select("doc_id", "text"), keep=("held_out",)).withColumnRenamed("id", "doc_id")
