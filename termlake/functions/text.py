"""Tokens of text: a simple form in built-in functions, and the exact multilingual one as an Arrow UDF.

The simple form (lower-cased runs of letters and digits) stays in the JVM and is what large searches use. The exact form
needs Unicode normalisation and segmentation that no built-in function has.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import fnv1

WORD = "[\\p{L}\\p{N}]+"
#: Fixed value: the dotless i counts as i.
DOTLESS = {"ı": "i"}


def simple_words(text: Column) -> Column:
    """All lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def simple_tokens(text: Column) -> Column:
    """The distinct ones."""
    return F.array_distinct(simple_words(text))


def trigrams(text: Column) -> Column:
    """Overlapping stretches of three characters; a shorter text, or none, as it is. One pass, whatever the text's length."""
    return F.when((F.length(text) < 3) | text.isNull(), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1)))


def stretches(text: Column, n: int = 4096) -> Column:
    """The text in stretches whose trigrams are the text's, each at n places at most; a text below three characters, or none, as it is."""
    whole = F.when((F.length(text) <= n) | text.isNull(), F.array(text))
    return whole.otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{3,{n + 2}}})).{{1,{n}}}"), F.lit(1)))


def is_code(text: Column) -> Column:
    """All hexadecimal, or six and more characters of which a third are capitals A-Z."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    n = F.octet_length(text)
    return text.rlike("^[0-9a-fA-F]*$") | (n >= 6) & (capitals >= F.call_function("div", n, F.lit(3)))


def term_hashes(tokens: Column) -> Column:
    """FNV-1 of each token; for many rows hash the distinct tokens once and join."""
    return F.transform(tokens, fnv1)


def contains_tokens(a: Column, b: Column) -> Column:
    """Every key of token map b is in token map a."""
    return F.size(F.array_except(F.map_keys(b), F.map_keys(a))) == 0


def show_token(t: Column) -> Column:
    """name(freq), or <name,raw>(freq) where the two differ."""
    freq = F.format_string("(%.3f)", t["freq"])
    return F.when(t["name"] == t["raw"], F.concat(t["name"], freq)).otherwise(F.concat(F.lit("<"), t["name"], F.lit(","), t["raw"], F.lit(">"), freq))


def show_tokens(tokens: Column) -> Column:
    """A line for each token of a map in the order of names: show_token() and the token's code points in hexadecimal."""
    entries = F.array_sort(F.map_entries(tokens))
    return F.array_join(F.transform(entries, lambda e: F.concat(show_token(e["value"]), F.lit(" "), F.lower(F.hex(F.encode(e["key"], "UTF-32"))))), "\n")


def code_points(text: Column) -> Column:
    """Characters of a line of code points ("U+1F468 U+200D ..." or "1F468 200D"); null where one is none."""
    parts = F.filter(F.split(F.trim(text), "\\s+"), lambda x: x != "")
    digits = F.transform(parts, lambda x: F.regexp_replace(x, "^[Uu]\\+", ""))
    good = F.forall(digits, lambda x: x.rlike("^[0-9A-Fa-f]{1,6}$"))
    return F.when(good, F.decode(F.unhex(F.array_join(F.transform(digits, lambda x: F.lpad(x, 8, "0")), "")), "UTF-32"))


def emoji_dictionary(spark, path: str, column: str = "value") -> list[str]:
    """Emoji sequences, longest first, of a text file with a line of code points for each; lines that are none are left out.

    What it returns is the tokenizer's `emoji`. The file is the caller's, for one of Unicode's releases (some thousand lines).
    """
    line = F.trim(F.regexp_replace(F.col(column), "[;#\\t].*$", ""))
    rows = spark.read.text(path).select(code_points(line).alias("e")).where("e is not null and e <> ''").distinct()
    return [r["e"] for r in rows.orderBy(F.desc(F.length("e")), "e").collect()]


def remove_accents(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def lower(text: str) -> str:
    """Character by character, one for one."""
    return text.lower() if text.isascii() else "".join(x if len(x := c.lower()) == 1 else x[0] for c in text)


def icu_simplified(spark) -> dict[str, str]:
    """Traditional to simplified characters of the basic plane, from the ICU library on the driver's class path."""
    ids = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    every = [chr(c) for c in [*range(0x3400, 0xA000), *range(0xF900, 0xFB00)]]
    changed = ids.transliterate("\n".join(every)).split("\n")
    return {a: b for a, b in zip(every, changed, strict=True) if a != b and len(b) == 1} | DOTLESS


class Tokenizer:
    """Text to {token: (name, raw, freq)}.

    A segment is a run of characters that continue an identifier and agree in being ASCII once stripped of accents. Words
    become one lower-cased token (by code strings and in `more` mode: trigrams), other scripts overlapping pairs (`more`:
    single characters). Where segments of either kind meet, even over spaces, their facing characters make a token. Emoji
    are tokens, as are symbols beyond the basic plane (`more`: all but white space). U+FFFD ends the text and drops the
    segment before it. freq is a token's share of all tokens given.

    `emoji` lists sequences: the first in the list that fits is taken. Without it sequences are found by Unicode's
    properties. `simplify` maps characters to what counts for them, `lemmas` words to their base forms.
    """

    def __init__(self, more: bool = False, emoji: Iterable[str] | None = None, simplify: dict[str, str] | None = None, lemmas: dict[str, str] | None = None):
        import regex

        self.more, self.lemmas = more, lemmas or {}
        self.simplify = DOTLESS | (simplify or {})
        self.continues = lru_cache(1 << 16)(self._continues)
        self.plain = lru_cache(1 << 16)(self._plain)
        self.id_part = regex.compile(r"\p{ID_Continue}+")
        if emoji is None:
            one = r"(?:\p{Emoji_Presentation}️?|\p{Emoji}️|\p{Emoji_Modifier_Base}(?=\p{Emoji_Modifier}))\p{Emoji_Modifier}?"
            self.emoji = regex.compile(rf"\p{{Regional_Indicator}}{{2}}|[0-9#*]️?⃣|(?!\p{{Regional_Indicator}}|[0-9#*]){one}(?:‍{one})*")
        else:
            self.emoji = regex.compile("|".join(map(regex.escape, emoji)) or "(?!)")

    def _continues(self, c: str) -> bool:
        return bool(self.id_part.fullmatch(c) and self.id_part.fullmatch(unicodedata.normalize("NFKC", c)))

    def _plain(self, c: str) -> str:
        kept = remove_accents(c) or "�"
        return self.simplify.get(kept[0], kept[0])

    def _ascii(self, c: str) -> bool:
        return self.plain(c) <= "\x80"

    def pieces(self, text: str) -> Iterator[tuple[str, str]]:
        """("segment" or "symbol", text) in order."""
        text, broken, _ = text.partition("�")
        done: list[tuple[str, str]] = []
        for stretch, is_emoji in self._parted(text):
            if is_emoji:
                done.append(("symbol", stretch))
                continue
            for (joins, _), run in groupby(stretch, lambda c: (self.continues(c), self.continues(c) and self._ascii(c))):
                if joins:
                    done.append(("segment", "".join(run)))
                else:
                    done += [("symbol" if c > "￿" or self.more and not c.isspace() else "gap", c) for c in run]
        if broken and done and done[-1][0] == "segment":
            done.pop()
        return iter(done)

    def _parted(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.emoji.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _segment(self, s: str) -> Iterator[tuple[str, str]]:
        """(name, raw) of a segment's tokens."""
        first = s[0]
        if self.plain(first) < "\x80" or first.islower() or first.isupper():
            if len(s.encode()) == 1 and not self.more:
                return
            bare = remove_accents(s)
            word = lower(self.lemmas.get(bare, self.lemmas.get(lower(bare), bare)) if len(s.encode()) > 3 else bare)
            if self.more or all(c in "0123456789abcdefABCDEF" for c in word):
                for g in [word[i : i + 3] for i in range(len(word) - 2)] or [word]:
                    yield g, g
            else:
                yield word, s
            return
        mapped = [self.simplify.get(c, c) for c in s]
        step = 1 if self.more else 2
        for i in range(len(s) - step + 1):
            yield "".join(mapped[i : i + step]), s[i : i + step]

    def __call__(self, text: str) -> dict[str, tuple[str, str, float]]:
        raws: dict[str, str] = {}
        counts: dict[str, int] = {}
        last = ""
        for kind, piece in self.pieces(text):
            found: list[tuple[str, str]] = []
            if kind == "symbol":
                found.append((piece, piece))
            elif kind == "segment":
                a, b = last, piece[0]
                if a and (a <= "\x80") != (b <= "\x80") and self._ascii(a) != self._ascii(b):
                    found.append((lower(self.plain(a)) + lower(self.plain(b)), a + b))
                last = piece[-1]
                found += self._segment(piece)
            for name, raw in found:
                raws[name] = raw
                counts[name] = counts.get(name, 0) + 1
        total = sum(counts.values())
        return {name: (name, raws[name], n / total) for name, n in counts.items()}


def tokens_udf(more: bool = False, emoji: list[str] | None = None, simplify: dict[str, str] | None = None, lemmas: dict[str, str] | None = None):
    """Arrow UDF string -> map<string, struct<name, raw, freq>>; one tokenizer for each batch stream."""
    kind = pa.map_(pa.string(), pa.struct([("name", pa.string()), ("raw", pa.string()), ("freq", pa.float64())]))

    @F.arrow_udf("map<string, struct<name: string, raw: string, freq: double>>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = Tokenizer(more, emoji, simplify, lemmas)
        for texts in batches:
            rows = [None if t is None else [(k, {"name": n, "raw": r, "freq": f}) for k, (n, r, f) in split(t).items()] for t in texts.to_pylist()]
            yield pa.array(rows, kind)

    return tokens
