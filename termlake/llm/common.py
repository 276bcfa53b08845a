"""What the corpus operators share: cutting lineage, fold columns and the per-task word table.

Every operator selects the columns it names before it adds its own, so extra or clashing columns of the
input neither break it nor leak into its result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut as cut  # noqa: PLC0414  operators take it from here

#: Characters of text that a Python worker holds as words at a time.
CHUNK_CHARS = 1_500_000
#: Bound of what a classifier's sample brings to the driver, at eight bytes each; a parameter of the classifiers' fit().
MOST_FEATURES = 30_000_000
#: Parts in which a sample reaches the driver.
SAMPLE_PARTS = 16


def small_batches(df: DataFrame, most: int = 16 << 20) -> None:
    """Hold Arrow batches of the session to `most` bytes, where they could be larger: long texts come by thousands otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, "64m").strip().lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    now = now.removesuffix("b") or "0" if now[-2:-1] in units else now
    size = int(now[:-1]) * units[now[-1]] if now[-1] in units else int(now)
    if size <= 0 or size > most:
        df.sparkSession.conf.set(key, f"{most}b")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32(id as text) mod modulus is remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == remainder


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_words(text: str) -> list[str]:
    """Maximal runs of characters other than U+0020 and U+0009 to U+000D (str.split() parts at more than these)."""
    odd = any(c in text for c in _ODD_ASCII) or not text.isascii() and _ODD.search(text)
    return _WORD.findall(text) if odd else text.split()


_WORD = re.compile("[^\x20\x09-\x0d]+")
_ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f")
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def maybe_in(df: DataFrame, key_col: str, keys: DataFrame, keys_col: str, most_bits: int = 27) -> DataFrame:
    """df with `__tl_maybe`: false where the key is surely not among `keys` (nulls too), true for all keys and few others.

    A bitmap of hashes with about 16 bits a key, at most 2**most_bits bits (16 MB) whatever the number of keys, is broadcast in rows
    of 64 words; df is not shuffled.
    """
    bits = min(most_bits, max(12, (16 * keys.count()).bit_length()))

    def parts(key: Column) -> tuple[Column, Column, Column]:
        h = F.pmod(F.xxhash64(F.lit("maybe"), key), F.lit(1 << bits))
        return F.shiftright(h, 12), F.shiftright(h, 6).bitwiseAND(63), h.bitwiseAND(63).cast("int")

    part, word, bit = parts(F.col(keys_col))
    words = keys.where(F.col(keys_col).isNotNull()).select(part.alias("__tl_part"), word.alias("_word"), F.expr("1L").alias("_one"), bit.alias("_bit"))
    words = words.groupBy("__tl_part", "_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits"))
    table = cut(words.groupBy("__tl_part").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("__tl_words")))
    part, word, bit = parts(F.col(key_col))
    found = df.withColumn("__tl_part", part).join(F.broadcast(table), "__tl_part", "left")
    held = F.getbit(F.coalesce(F.try_element_at(F.col("__tl_words"), word), F.lit(0).cast("bigint")), bit)
    return found.withColumn("__tl_maybe", F.col(key_col).isNotNull() & (held == 1)).drop("__tl_part", "__tl_words")


def only_kept(docs: DataFrame, key: Column, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with their own columns, but for the rows that are not kept; of rows alike in id and key as many as are kept, at most one.

    `rows` holds (id, key, kept) of each row of docs. Rows whose key is surely that of kept rows alone pass without a shuffle; the
    others are joined by key and id, and rows repeated with both are gathered by an aggregate that combines first.
    """
    touched = rows.groupBy("id", "key").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).where("n != k or n > 1")
    touched = cut(touched.select(F.col("id").alias("__tl_id"), F.col("key").alias("__tl_own"), F.col("k").alias("__tl_k")))
    marked = maybe_in(docs.withColumn("__tl_key", key), "__tl_key", touched.select("__tl_own"), "__tl_own")
    free = marked.where("not __tl_maybe").select(*docs.columns)
    joined = marked.where("__tl_maybe").join(touched, (F.col("__tl_key") == F.col("__tl_own")) & F.col(id_col).eqNullSafe(F.col("__tl_id")), "left")
    alone = joined.where("__tl_k is null").select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = joined.where("__tl_k > 0").groupBy("__tl_key", id_col).agg(F.max_by(row, F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("__tl_row")).select("__tl_row.*")
    return free.unionByName(alone).unionByName(one)


class WordTable(dict):
    """Index of the distinct words of a task; `rows` keeps a row of numbers for each.

    describe(words) gives the rows of words not seen before, so each is worked out once. Beyond `limit` words
    the table is emptied: that costs time, never results.
    """

    def __init__(self, describe, limit: int = 250_000):
        super().__init__()
        self.describe, self.limit = describe, limit
        self.fresh: list[str] = []
        self.rows: np.ndarray | None = None

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.fresh.append(word)
        return i

    def index(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words, valid until the next call."""
        if len(self) > self.limit:
            self.clear()
            self.rows = None
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.fresh:
            new = self.describe(self.fresh)
            n = 0 if self.rows is None else self.filled
            if self.rows is None or n + len(new) > len(self.rows):
                grown = np.zeros((2 * (n + len(new)), *new.shape[1:]), new.dtype)
                if n:
                    grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(new)] = new
            self.filled = n + len(new)
            self.fresh = []
        return at

    def take(self, words: list[str]) -> np.ndarray:
        """The rows of the words."""
        at = self.index(words)
        return self.rows[at]


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each; a longer text is a range of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def words_of(texts: list[str], split=str.split) -> tuple[list[str], np.ndarray]:
    """All words of some texts and where each text's words begin (one more entry for the end)."""
    words: list[str] = []
    ends = [0]
    for t in texts:
        words += split(t)
        ends.append(len(words))
    return words, np.array(ends, np.int64)


def sum_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]] along the first axis; empty ranges give 0."""
    total = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = starts[1:] > starts[:-1]
    if full.any():
        total[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=np.float64)
    return total


def gram_hashes(words: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: 32-bit hashes of the character n-grams of <word>, and where each word's begin.

    Words carry a mark at either end; n-grams do not cross words.
    """
    raw = ("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    opens = np.flatnonzero(codes == 2) if not any("\x02" in w for w in words) else _opens(words)
    sizes = np.diff(np.append(opens, len(codes)))
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
        if n in orders:
            counts = np.maximum(sizes - n + 1, 0)
            starts = np.concatenate(([0], np.cumsum(counts)))
            total = int(starts[-1])
            at = np.repeat(opens - starts[:-1], counts) + np.arange(total)
            x = h[at]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield x ^ (x >> np.uint32(13)), starts


def _opens(words: list[str]) -> np.ndarray:
    lengths = np.array([0] + [len(w) + 2 for w in words[:-1]], np.int64)
    return np.cumsum(lengths)


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each whole word."""
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def labelled_sample(labels: DataFrame, label_col: str, per_label: int, kinds: tuple[int, ...] = (0, 1), id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most `per_label` rows of `labels` for each label in `kinds`, by the order of a hash of the id.

    The bound is the caller's documented parameter; it holds for fitting a classifier only.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null")
    out = None
    for k in kinds:
        part = own.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        out = part if out is None else out.unionByName(part)
    return out


def sample_features(docs: DataFrame, sample: DataFrame, features, text_col: str = "text", id_col: str = "doc_id", most: int = 20_000, most_features: int = MOST_FEATURES):
    """The sample's documents as sparse rows: list of (label, buckets int32, counts float32), on the driver.

    `features(texts)` gives for each text its buckets and counts; it runs on the executors. The sample is
    bounded, so it is broadcast, and the documents are not shuffled. Rows come in the order of a hash, at most `most`
    of them, and no more than hold `most_features` features together. They reach the driver in `SAMPLE_PARTS` parts, one at a time.
    """

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                found = features(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x[0].astype("<i4").tobytes() for x in found], pa.binary()), pa.array([x[1].astype("<f4").tobytes() for x in found], pa.binary())],
                    ["_label", "_id", "at", "n"],
                )

    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_label", "_text", "_id")
    id_type = docs.schema[id_col].dataType.simpleString()
    found = joined.mapInArrow(rows, f"_label int, _id {id_type}, at binary, n binary")
    found = cut(found.withColumn("_h", F.xxhash64("_id", "at", "n")))
    sizes = found.select("_h", F.octet_length("at").alias("s")).orderBy("_h").limit(most).collect()
    total, last = 0, None
    for r in sizes:
        total += r["s"] // 4
        if total > most_features and last is not None:
            break
        last = r["_h"]
    if last is None:
        return []
    parts = found.where(F.col("_h") <= last).select("_h", "_label", "at", "n").repartition(SAMPLE_PARTS, "_h")
    got = sorted((tuple(r) for r in parts.toLocalIterator()), key=lambda r: r[:2])[:most]
    return [(label, np.frombuffer(at, "<i4"), np.frombuffer(n, "<f4")) for _, label, at, n in got]
